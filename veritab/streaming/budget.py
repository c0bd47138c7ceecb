"""Streams that end early: limits are checked after every micro-batch, and the reason of the end is stored.

`path` holds the batches (`b=<number>`), a row of progress for each (`progress`), and the checkpoint. A run whose limits
are met leaves the files that follow unread; a later run with wider limits goes on with them. Nothing is read twice: a
batch counts once its progress is written, and a repeated batch overwrites its own folder.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import StreamingQueryException

from ..shared import exists


class _Ended(Exception):
    pass


@dataclass
class Limits:
    """What ends a run. sums: the least sum of a counter at which it ends, by its name; seconds: the longest time of this run."""

    sums: dict[str, float] = field(default_factory=dict)
    seconds: float | None = None
    reasons: dict[str, str] = field(default_factory=dict)  # how a reason is said, by counter

    def met(self, totals: dict[str, float], elapsed: float) -> str | None:
        """The first limit that is met, in the order given; time comes last."""
        for name, most in self.sums.items():
            if totals.get(name, 0) >= most:
                return self.reasons.get(name, f"{name} reached {most:g}")
        return "time budget reached" if self.seconds is not None and elapsed > self.seconds else None


def progress(spark: SparkSession, path: str) -> DataFrame:
    """batch, counter sums so far (totals map<string,double>) and the reason why the run ended after that batch, or null."""
    schema = "batch long, totals map<string,double>, reason string"
    return spark.read.schema(schema).json(f"{path}/progress/*") if exists(spark, f"{path}/progress") else spark.createDataFrame([], schema)


def run(rows: DataFrame, counters: dict[str, Column], limits: Limits, path: str, clock=time.monotonic) -> tuple[DataFrame | None, str]:
    """(the rows read so far, why the run ended). rows: a stream, cut into micro-batches by its source's own options.

    counters are aggregates over a micro-batch; their sums over all batches, also of earlier runs, are held against limits."""
    spark = rows.sparkSession
    last = progress(spark, path).groupBy().agg(F.max_by("totals", "batch").alias("t")).first()
    totals: dict[str, float] = dict(last.t or {}) if last else {}
    began, ended = clock(), []
    names = list(counters)

    def save(batch: DataFrame, number: int) -> None:
        if not ended:
            reason = limits.met(totals, clock() - began)
            if reason:
                ended.append(reason)
        if ended:
            raise _Ended  # this batch isn't committed, so a later run begins with it
        batch.write.mode("overwrite").parquet(f"{path}/b={number}")
        now = spark.read.schema(batch.schema).parquet(f"{path}/b={number}").agg(*[counters[n].alias(n) for n in names]).first()
        for n in names:
            totals[n] = totals.get(n, 0.0) + float(now[n] or 0)
        reason = limits.met(totals, clock() - began)
        line = spark.createDataFrame([(number, totals, reason)], "batch long, totals map<string,double>, reason string")
        line.coalesce(1).write.mode("overwrite").json(f"{path}/progress/b={number}")
        if reason:
            ended.append(reason)

    query = rows.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not ended:
            raise
    written = spark.read.option("recursiveFileLookup", "true").schema(rows.schema).parquet(f"{path}/b=*") if exists(spark, f"{path}/progress") else None
    return written, ended[0] if ended else "all input was read"
