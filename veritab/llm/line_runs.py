"""Line deduplication over a corpus with levelled sorted runs of line hashes.

A line's key is the line without white space (0x20, 0x09-0x0D) at both ends, with A-Z in lower case. Keys of at least
`least` code points stay only in the first document that holds them. Documents arrive in batches of ascending doc_id:

  1. the batch's keys are hashed (128 bits) and reduced to the least doc_id of each,
  2. the reduced keys are merge-anti-joined with every run, and those that no run has become a run of level 0,
  3. a line whose key isn't in the batch's own run is in an older one and goes; one whose key is there goes unless its
     document is the run's first,
  4. `fanout` runs of a level are compacted to one of the next level.

A run is a table that is bucketed and sorted by the hashes, so that only a batch's reduced keys are shuffled to meet it;
with compaction a key is rewritten once a level and the number of runs grows with the logarithm of the number of
batches. Runs lie in a folder, where a later call goes on with them (`LineRuns(spark, path)`).

A key with a third of all lines is one row a task in step 1. In step 3 both sides are shuffled by key, so that adaptive
execution deals a hot key's lines to several tasks. Texts are shuffled once, to meet the numbers of their dropped lines.
Everything is a DataFrame expression; no Python runs on the executors.

Nulls: a null or empty text is one empty line. Rows with a null doc_id count as one document after all others (that of
the largest long). Rows that share a doc_id are one document: none of their lines is a repetition of another's.
doc_id must be a number. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import exists, new_path

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LAST = (1 << 63) - 1
KEY = ["h1", "h2"]


def key_of(line: Column) -> Column:
    """The key of a line. `lower` is used where it can't reach beyond A-Z."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.char_length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document() -> list[Column]:
    """What tells documents apart, and equal rows of one document not: the id, and a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")]


def hashed_lines(docs: DataFrame, least: int) -> DataFrame:
    """(d, t, pos, h1, h2) of each line whose key has at least `least` code points."""
    lines = docs.select(*_document(), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("d", "t", "pos", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return keys.select("d", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """Levelled runs of line hashes in a folder.

    A run is `run-<level>-<number>-<buckets>` there; it counts once its writer has committed it.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.path, self.fanout = spark, path, fanout
        self.runs: list[tuple[int, int, int]] = []
        if exists(spark, path):
            jvm = spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            for status in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder):
                found = re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", status.getPath().getName())
                if found and exists(spark, f"{path}/{found[0]}/_SUCCESS"):
                    self.runs.append(tuple(map(int, found.groups())))
        self.runs.sort(key=lambda r: r[1])

    def _folder(self, run: tuple[int, int, int]) -> str:
        return f"{self.path}/run-{run[0]}-{run[1]}-{run[2]}"

    def _table(self, run: tuple[int, int, int]) -> DataFrame:
        """The run with its buckets, for joins that need no shuffle of it."""
        name = f"run_{abs(hash(self.path))}_{run[1]}"
        self.spark.sql(f"create table if not exists {name} (h1 bigint, h2 bigint, first bigint) using parquet clustered by (h1, h2) sorted by (h1, h2) into {run[2]} buckets location '{self._folder(run)}'")
        return self.spark.table(name)

    def _write(self, keys: DataFrame, level: int) -> tuple[int, int, int]:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        run = (level, 1 + max((r[1] for r in self.runs), default=0), buckets)
        name = f"new_{abs(hash(self.path))}_{run[1]}"
        keys.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", self._folder(run)).saveAsTable(name)
        self.spark.sql(f"drop table {name}")  # the files stay: the table is external
        self.runs.append(run)
        return run

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (h1, h2, ...) that no run has."""
        for run in self.runs:
            keys = keys.join(self._table(run).select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> DataFrame:
        """Makes a run of the keys (h1, h2, first) that no run has, and returns it as a plain table."""
        run = self._write(self.unseen(keys).select(*KEY, "first"), 0)
        return self.spark.read.schema("h1 bigint, h2 bigint, first bigint").parquet(self._folder(run))

    def compact(self) -> None:
        """Merges the runs of each level that has `fanout` of them; runs share no key."""
        level = 0
        while level <= max((r[0] for r in self.runs), default=-1):
            full = [r for r in self.runs if r[0] == level]
            if len(full) >= self.fanout:
                merged = self._table(full[0])
                for run in full[1:]:
                    merged = merged.unionAll(self._table(run))
                self._write(merged, level + 1)
                for run in full:  # the merged run is committed
                    self._drop(run)
            level += 1

    def _drop(self, run: tuple[int, int, int]) -> None:
        self.spark.sql(f"drop table if exists run_{abs(hash(self.path))}_{run[1]}")
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(run))
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        self.runs.remove(run)


def repeated(lines: DataFrame, runs: LineRuns) -> DataFrame:
    """(d, t, pos) of the lines of a batch that go, after adding the batch's keys to the runs."""
    own = runs.add(lines.groupBy(*KEY).agg(F.min("d").alias("first")))
    return lines.join(own, KEY, "left").where(F.col("first").isNull() | (F.col("d") > F.col("first"))).select("d", "t", "pos")


def dedup(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2, path: str | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row of docs.

    The table is worked through in `batches` of about as many rows, by doc_id. With the path of older runs, keys that
    these hold count as seen before all of docs.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    runs = LineRuns(spark, path or new_path(spark, "line-runs"), fanout)
    work = new_path(spark, "line-dedup")
    shares = [i / batches for i in range(1, batches)]
    bounds = (docs.agg(F.percentile_approx(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), shares, 10_000).alias("b")).first().b or []) if shares else []
    bounds = sorted(set(bounds))
    number = sum((F.when(F.col("d") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    hashed_lines(docs, least).withColumn("batch", number).write.partitionBy("batch").parquet(f"{work}/lines")
    lines = spark.read.schema("d bigint, t bigint, pos int, h1 bigint, h2 bigint, batch int").parquet(f"{work}/lines")
    for i in range(len(bounds) + 1):
        repeated(lines.where(F.col("batch") == i).drop("batch"), runs).write.mode("append").parquet(f"{work}/dropped")
        runs.compact()
    dropped = spark.read.schema("d bigint, t bigint, pos int").parquet(f"{work}/dropped").groupBy("d", "t").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select("doc_id", "text", *_document()).join(dropped, ["d", "t"], "left").withColumn("lines", _lines(F.col("text")))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    kept = F.when(F.size(gone) == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept.alias("text"))
