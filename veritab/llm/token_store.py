"""Token-id output: concatenated id arrays with Elias-Fano encoded document boundaries.

A store is a folder of Parquet files that Spark's writers commit, so a lost executor leaves no half file. A row is a
shard: about `shard_ids` consecutive ids of whole documents in the store's order (ascending doc_id and, of equal ids, a
hash of the text and then the text, unless columns to order by are given), as

  part, seq     shard order: shards sort by (part, seq)
  n_docs, n_ids
  doc_ids       the documents' ids
  ids           little-endian unsigned ids, 2 bytes each where the vocabulary and the end id allow, else 4 (id_bytes)
  low_bits, low, high   Elias-Fano code of the n_docs + 1 boundaries in the shard

Boundaries are non-decreasing numbers up to n_ids. Each is split into low_bits low bits, packed, and a high part,
written in unary in `high`: boundary i sets bit (high part + i). With low_bits = log2(n_ids / n_docs) this takes
about 2 + low_bits bits a document. `Boundaries` answers select(i) from a sampled directory of `high`, without a
table of 64-bit offsets. Offsets over the whole store add the ids of earlier shards.

Reading is map-side: the offsets of shards, one small row each, are broadcast up to `BROADCAST_SHARDS` rows, so that the
shards' bytes stay where they lie; a store of more shards is joined with its offsets by shuffle.

Nulls: a null text is an empty one, a null doc_id comes first. Every document ends with the end id, so an empty one
has one id. Repeated rows are stored again. Other columns are not read. An empty table makes an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import ship
from .common import cut, map_arrow, runs
from .pieces import CHUNK, encoder
from .textstats import utf8

SCHEMA = "part int, seq int, n_docs long, n_ids long, doc_ids array<bigint>, id_bytes int, ids binary, low_bits int, low binary, high binary"
SELECT_STEP = 64
#: Shards up to which the offsets are broadcast (24 bytes each).
BROADCAST_SHARDS = 1_000_000


def encode_boundaries(bounds: np.ndarray) -> tuple[int, bytes, bytes]:
    """(low_bits, low, high) of non-decreasing non-negative integers."""
    n, top = len(bounds), int(bounds[-1]) if len(bounds) else 0
    low_bits = max(0, int(top // max(n, 1)).bit_length() - 1)
    b = bounds.astype(np.uint64)
    low = ((b[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    where = (b >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(where[-1]) + 1 if n else 0, np.uint8)
    high[where] = 1
    return low_bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


class Boundaries:
    """Select over an Elias-Fano code: a directory holds the byte in which every SELECT_STEP-th one lies."""

    ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        total = np.cumsum(self.ONES[self.high])
        self.directory = np.searchsorted(total, np.arange(0, n, SELECT_STEP) + 1).astype(np.uint32)
        self.before = (total[self.directory] - self.ONES[self.high[self.directory]]).astype(np.uint32) if n else self.directory

    def select(self, i: int) -> int:
        """Boundary i."""
        k = i // SELECT_STEP
        byte, seen = int(self.directory[k]), int(self.before[k])
        while seen + int(self.ONES[self.high[byte]]) <= i:
            seen += int(self.ONES[self.high[byte]])
            byte += 1
        bits = int(self.high[byte])
        for _ in range(i - seen):
            bits &= bits - 1
        high = 8 * byte + (bits & -bits).bit_length() - 1 - i
        return high << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        first, last = at >> 3, (at + self.low_bits + 7) >> 3
        return int.from_bytes(self.low[first:last].tobytes(), "little") >> (at & 7) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every boundary at once."""
        where = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (where - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        return (high | (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)).astype(np.int64)


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes that hold every id of the tokenizer and the end id."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()
    return 2 if max([end_id, *vocabulary]) < 1 << 16 else 4


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, order: list[str] | None = None, shard_ids: int = 1 << 20) -> None:
    """Encodes every text, appends end_id, and writes shards in ascending doc_id order, or in that of the columns in order.

    Documents are dealt by ranges of (doc_id, text hash), so that one doc_id with very many rows is split too."""
    ship(docs.sparkSession)
    id_bytes = id_width(tokenizer, end_id)
    by = [F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(order or [])]
    rows = docs.select(*by, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = [f"by{i}" for i in range(len(by))] + ["doc_id", "h"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    end = np.array([end_id], np.dtype(f"<u{id_bytes}")).tobytes()

    def shard(part: int, seq: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.cumsum([len(x) // id_bytes for x in ids])])
        low_bits, low, high = encode_boundaries(bounds)
        one = {"part": part, "seq": seq, "n_docs": len(ids), "n_ids": int(bounds[-1]), "doc_ids": doc_ids, "id_bytes": id_bytes, "ids": b"".join(ids), "low_bits": low_bits, "low": low, "high": high}
        return pa.RecordBatch.from_pylist([one], ARROW)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, doc_ids, ids, size, part = 0, [], [], 0, 0
        for b in batches:
            texts = utf8(b.column(2))
            part = b.column(0)[0].as_py() if len(texts) else part
            keys = b.column(1).to_pylist()
            for lo, hi in runs([len(t) for t in texts], CHUNK):
                flat, counts = encoder(tokenizer, f"<u{id_bytes}").encode(texts[lo:hi])
                for key, x in zip(keys[lo:hi], np.split(flat, np.cumsum(counts)[:-1])):
                    doc_ids.append(key)
                    ids.append(x.tobytes() + end)
                    size += len(x) + 1
                    if size >= shard_ids:
                        yield shard(part, seq, doc_ids, ids)
                        seq, doc_ids, ids, size = seq + 1, [], [], 0
        if ids:
            yield shard(part, seq, doc_ids, ids)

    dealt.mapInArrow(build, SCHEMA).write.option("compression", "zstd").parquet(path)


ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("id_bytes", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()),
])


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, first): ids before each shard. Parts are few (one a task), so their running total is one small window."""
    shards = spark.read.schema(SCHEMA).parquet(path).select("part", "seq", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return shards.withColumn("inside", inside).join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("first"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from its shard's bytes and boundaries."""

    def unpack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s in batch.to_pylist():
            bounds = Boundaries(s["n_docs"] + 1, s["low_bits"], s["low"], s["high"]).all()
            ids = np.frombuffer(s["ids"], np.dtype(f"<u{s['id_bytes']}")).astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(s["doc_ids"], pa.int64()), pa.array(bounds[:-1] + s["first"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    first = cut(offsets(spark, path), "offsets")
    shards = spark.read.schema(SCHEMA).parquet(path).join(F.broadcast(first) if first.count() <= BROADCAST_SHARDS else first, ["part", "seq"])
    return map_arrow(shards, unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")
