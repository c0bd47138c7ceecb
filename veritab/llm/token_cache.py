"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, n_tokens). Contents are normalised as far as the
tokenizer's file says that it makes no difference (white space around them, for tokenizers that drop it), digested by
sha256, and joined to the cache; only distinct contents that it lacks are encoded, and their counts are appended. The
digest of a tokenizer is that of its file, so that another version never meets old counts.

A content with very many copies is one row a task before any shuffle. When the counts come back to the rows, a digest
is dealt over `SALTS` parts by the row's own id, and the counts, one row a digest, are repeated for each part.

The library counts whole contents; a worker asks it once for each repeated piece (`pieces`).

Nulls: a null text counts as an empty one (0 tokens), a null doc_id stays a row. Repeated texts are encoded once.
Other columns are not read. An empty table appends nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship
from .common import exists, runs
from .pieces import CHUNK, encoder, ignores_outer_space
from .textstats import utf8

SCHEMA = "tokenizer string, digest string, n_tokens long"
SALTS = 8


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content(text: Column, tokenizer: str) -> Column:
    """What the count depends on."""
    whole = F.coalesce(text, F.lit(""))
    return F.btrim(whole, F.lit(" \t\n\r")) if ignores_outer_space(tokenizer) else whole


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)


def fill(docs: DataFrame, cache: str, tokenizer: str) -> None:
    """Encodes the distinct contents of docs that the cache lacks and appends their counts.

    Copies meet in a partial aggregate on the map side, so that a content with very many copies sends one row a task.
    """
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_digest(tokenizer)
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
    contents = docs.select(content(F.col("text"), tokenizer).alias("content")).withColumn("digest", F.sha2("content", 256))
    misses = contents.groupBy("digest").agg(F.first("content").alias("content")).join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(1))
            counts = [n for lo, hi in runs([len(t) for t in texts], CHUNK) for n in encoder(tokenizer).encode(texts[lo:hi])[1]]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(texts), pa.string()), b.column(0), pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    misses.mapInArrow(encode, SCHEMA).write.mode("append").parquet(cache)


def count(docs: DataFrame, cache: str, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs, after filling the cache."""
    fill(docs, cache, tokenizer)
    # two runs at once may both have appended a content: one count each
    counts = read_cache(docs.sparkSession, cache).where(F.col("tokenizer") == tokenizer_digest(tokenizer)).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = docs.select("doc_id", n_bytes.alias("n_bytes"), F.sha2(content(F.col("text"), tokenizer), 256).alias("digest"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return rows.join(counts, ["digest", "salt"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
