"""The folder that driver and executors share, and the tables of a data folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or in local mode (tests) under a temporary folder where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, _own.get(app) or tempfile.mkdtemp(prefix="veritab-"))
    return f"{base}/veritab/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at path, in whatever store it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as the cluster has cores, where there are fewer: reading texts costs far more than moving them."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def growing(df: DataFrame) -> DataFrame:
    """df as a side of a join of which both sides grow: it is never broadcast. Its size is guessed from compressed files and from
    columns' types, so that texts made of a few megabytes of keys would pass through the driver."""
    return df.hint("merge")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that what is read twice is made once and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
