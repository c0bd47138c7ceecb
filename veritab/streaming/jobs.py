"""Streams over append-only tables: counters, duplicates, and hosts that keep failing.

Late rows: the watermark is a day behind the latest event. Every stream writes to a path with its checkpoint beside it,
so a restarted one goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "1 day"


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; the table may be one file or a folder, so its name is given as a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(rows: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives the table it wrote. In update mode each micro-batch is a version
    of its own (column _batch), of which the reader takes the last of each key."""
    spark = rows.sparkSession
    writer = rows.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").start(path)
    else:

        def save(batch: DataFrame, number: int) -> None:
            # overwriting one batch's own folder makes a repeated batch harmless
            batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/b={number}")

        query = writer.foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.parquet(path) if mode == "append" else spark.read.option("recursiveFileLookup", "true").parquet(path)


def latest_of(versions: DataFrame, key: str) -> DataFrame:
    """The last version of each key that a stream in update mode wrote; each key is written once a micro-batch at most."""
    others = [c for c in versions.columns if c not in (key, "_batch")]
    return versions.groupBy(key).agg(F.max_by(F.struct(*others), "_batch").alias("_last")).select(key, "_last.*")


def counters(events: DataFrame, key: str, value: str, path: str) -> DataFrame:
    """key, n, total: additive counters, updated with every micro-batch."""
    sums = events.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("total"))
    last = drain(sums, path, "update").groupBy(key).agg(F.max_by(F.struct("n", "total"), "_batch").alias("s"))
    return last.select(key, "s.n", (F.col("s.total") / 100).alias("total"))


def distinct(events: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The distinct keys of a stream, each written once."""
    return drain(events.select(*keys).dropDuplicates(keys), path)


def unknown(candidates: DataFrame, known: DataFrame, key: str, path: str) -> DataFrame:
    """Stream-static anti join: candidates whose key isn't in the known table, each key once."""
    return drain(candidates.join(known.select(key), key, "left_anti").dropDuplicates([key]), path)


def hourly(events: DataFrame, at: str, key: str, path: str) -> DataFrame:
    """Counts by hour; an hour is written when the watermark has passed it."""
    out = events.withWatermark(at, WATERMARK).groupBy(F.window(at, "1 hour").alias("w"), key).agg(F.count("*").alias("n"))
    return drain(out.select(F.col("w.start").alias("hour"), key, "n"), path)


def breaker(calls: DataFrame, host: str, path: str, limit: int = 3) -> DataFrame:
    """host, opened: hosts at the moment they fail `limit` times in a row. calls: host, seq (order), failed.

    The state of a host is two integers; a micro-batch's calls of a host are sorted by seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, -1)
        for rows in [pd.concat(list(batches)).sort_values("seq")]:
            for seq, failed in zip(rows["seq"], rows["failed"]):
                failures = failures + 1 if failed else 0
                if failures == limit and opened < 0:
                    opened = int(seq)
                    yield pd.DataFrame({"host": [key[0]], "opened": [opened]})
        state.update((failures, opened))

    rows = calls.select(F.col(host).alias("host"), "seq", "failed")
    out = rows.groupBy("host").applyInPandasWithState(step, "host long, opened long", "failures int, opened long", "append", GroupStateTimeout.NoTimeout)
    return drain(out, path)
