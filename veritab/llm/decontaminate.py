"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased and everything between letters and digits becomes one space. An item of n
characters allows e = floor(rate * n) edits, or as many as its length lets the filter prove. Text that aligns with it
within e edits shares at least n + 1 - q * (e + 1) q-grams with it, on diagonals no more than e apart. So the q-grams
of whole texts that occur in any item are counted per item in overlapping bands of 2 (e + 1) diagonals; regions whose
count reaches the bound are kept, and an alignment of the item inside that band decides: the regions of a chunk of
texts are aligned together, row by row, and leave as soon as no cell is within the budget, so that items with a common
beginning cost little more where only that occurs.

The items are a stated query set: they go to the executors in blocks of bounded size, and documents never move.
Items longer than `window` characters are matched by overlapping windows, any of which counts; window=None matches
items of any length as a whole. One with fewer than q characters after normalising has no q-gram: it matches the texts
that consist of it alone, exactly.

Nulls: a null text is an empty one, a null item never matches, a null doc_id stays a row. Repeated rows give repeated
rows, repeated items one row for each item_id. Other columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, runs
from .textstats import U, mix

Q, RATE = 10, 0.08
WINDOW, STEP = 400, 200
#: Characters of items that are matched at once.
BLOCK_CHARS = 4_000_000
_BITS = 23
_M = U(0x9E3779B97F4A7C15 | 1)
_FAR = 1 << 44


@functools.cache
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() if not 0xD800 <= i < 0xE000 else False for i in range(sys.maxunicode + 1)), bool)


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, one after another with a space after each, and where each begins (and the end)."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join(f"{t}\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = _alnum()[code]
    ends = np.cumsum([len(t) + 1 for t in low])
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    starts = np.concatenate([[0], np.cumsum(keep)[ends - 1]])
    return np.where(solid, code, 32)[keep], starts


def grams(code: np.ndarray, q: int) -> np.ndarray:
    if len(code) < q:
        return np.zeros(0, U)
    out = np.zeros(len(code) - q + 1, U)
    for j in range(q):
        out = out * _M + code[j : len(code) - q + 1 + j].astype(U)
    return mix(out)


@dataclass
class Items:
    ids: list  # item_id of each pattern
    codes: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    hashes: np.ndarray  # sorted distinct q-grams
    first: np.ndarray  # postings of hashes[i]: first[i] to first[i + 1]
    pattern: np.ndarray
    position: np.ndarray
    q: int
    short: dict[bytes, list[int]]  # patterns without a q-gram, by their code points

    @functools.cached_property
    def seen(self) -> np.ndarray:
        bits = np.zeros(1 << _BITS, bool)
        bits[(self.hashes >> U(64 - _BITS)).astype(np.int64)] = True
        return bits


def stripped(code: np.ndarray) -> np.ndarray:
    """Without the spaces around it."""
    solid = np.flatnonzero(code != 32)
    return code[solid[0] : solid[-1] + 1] if len(solid) else code[:0]


def index(items: list[tuple[object, str]], q: int = Q, rate: float = RATE, window: int | None = WINDOW) -> Items:
    ids, codes, short = [], [], {}
    for item_id, text in items:
        code = stripped(normalise([text or ""])[0])
        if not len(code):
            continue
        starts = [0]
        if window and len(code) > window:
            starts = sorted({min(at, len(code) - window) for at in range(0, len(code) - window + STEP, STEP)})
        for at in starts:
            if len(code) < q:
                short.setdefault(code.tobytes(), []).append(len(codes))
            ids.append(item_id)
            codes.append(code[at : at + window] if window else code)
    n = np.array([len(c) for c in codes], np.int64)
    budget = np.maximum(np.minimum((rate * n).astype(np.int64), n // q - 1), 0)
    count = np.maximum(n - q + 1, 0)
    pattern = np.repeat(np.arange(len(codes)), count)
    position = np.concatenate([np.arange(k) for k in count]) if len(codes) else np.zeros(0, np.int64)
    h = np.concatenate([grams(c, q) for c in codes]) if codes else np.zeros(0, U)
    order = np.argsort(h, kind="stable")
    hashes, first = np.unique(h[order], return_index=True)
    return Items(ids, codes, budget, n + 1 - q * (budget + 1), hashes, np.append(first, len(h)), pattern[order], position[order], q, short)


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of item to any part of region, and where that part ends."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, c in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (region != c), row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min()), int(row.argmin())


def align_bands(items: Items, code: np.ndarray, p: np.ndarray, lo: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern p, its least edit distance to a part of code[begin:end] that starts on the diagonals lo to lo + 2 (e + 1),
    and where that part ends. Distances over the budget e may come out larger than they are."""
    n = np.array([len(items.codes[i]) for i in p], np.int64)
    e = items.budget[p]
    found, at_end = np.full(len(p), 1 << 20, np.int64), np.zeros(len(p), np.int64)
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        size = max(1, BATCH_CELLS // int(n[order[min(at + 256, len(order) - 1)]] + 5 * e[order[at]] + 8))
        rows = order[at : at + size]
        at += size
        width, longest = int(4 * e[rows].max() + 4), int(n[rows].max())
        first = lo[rows] - e[rows]
        where = first[:, None] + np.arange(longest + width)
        inside = (where >= begin[rows, None]) & (where < end[rows, None])
        text = np.where(inside, code[np.clip(where, 0, len(code) - 1)].astype(np.int32), -1)
        item = np.full((len(rows), longest), -2, np.int32)
        for k, i in enumerate(rows.tolist()):
            item[k, : n[i]] = items.codes[p[i]]
        steps = np.arange(width, dtype=np.int32)
        cost = np.zeros((len(rows), width), np.int32)
        for i in range(longest):
            best = cost + (text[:, i : i + width] != item[:, i : i + 1])
            np.minimum(best[:, :-1], cost[:, 1:] + 1, out=best[:, :-1])
            cost = np.minimum.accumulate(best - steps, axis=1) + steps
            least = cost.min(axis=1)
            over = n[rows] == i + 1
            if over.any():
                found[rows[over]] = least[over]
                at_end[rows[over]] = np.minimum(first[over] + i + 1 + cost[over].argmin(axis=1), end[rows[over]])
            if over.any() or i % 8 == 7:
                on = ~over & (least <= e[rows])
                rows, first, text, item, cost = rows[on], first[on], text[on], item[on], cost[on]
                if not len(rows):
                    break
    return found, at_end


#: Characters of regions that are aligned at once.
BATCH_CELLS = 1 << 18


def find(texts: list[str], items: Items) -> list[tuple[int, int, int, int]]:
    """(text, pattern, distance, end in the normalised text) of every pattern that a text holds within its budget."""
    code, starts = normalise(texts)
    q = items.q
    out: dict[tuple[int, int], tuple[int, int]] = {}
    if items.short:
        for t in np.flatnonzero(np.diff(starts) <= q + 2).tolist():
            own = stripped(code[starts[t] : starts[t + 1]])
            for p in items.short.get(own.tobytes(), ()):
                out[t, p] = (0, int(starts[t + 1] - starts[t]))
    if not len(items.hashes) or len(code) < q:
        return [(t, p, d, end) for (t, p), (d, end) in sorted(out.items())]
    h = grams(code, q)
    hit = np.flatnonzero(items.seen[(h >> U(64 - _BITS)).astype(np.int64)])
    where = np.searchsorted(items.hashes, h[hit])
    true = (where < len(items.hashes)) & (items.hashes[np.minimum(where, len(items.hashes) - 1)] == h[hit])
    hit, where = hit[true], where[true]
    size = items.first[where + 1] - items.first[where]
    post = np.repeat(items.first[where] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    pattern = items.pattern[post]
    diagonal = np.repeat(hit, size) - items.position[post] + _FAR // 4
    band = diagonal // (items.budget[pattern] + 1)
    keys = np.concatenate([pattern * _FAR + band, pattern * _FAR + band - 1])
    keys, counts = np.unique(keys, return_counts=True)
    kept = keys[counts >= items.bound[keys // _FAR]]
    p = kept // _FAR
    stride = items.budget[p] + 1
    lo = (kept % _FAR) * stride - _FAR // 4
    hi = lo + 2 * stride + np.array([len(items.codes[i]) for i in p], np.int64)
    # a band may lie over the end of a text: its part in each text is tried
    t = np.maximum(np.searchsorted(starts, np.maximum(lo, 0), "right") - 1, 0)
    many = np.maximum(np.minimum(np.searchsorted(starts[:-1], hi, "left"), len(texts)) - t, 0)
    each = np.repeat(np.arange(len(kept)), many)
    t = t[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    p, lo = p[each], lo[each]
    distance, end = align_bands(items, code, p, lo, starts[t], starts[t + 1])
    for k in np.flatnonzero(distance <= items.budget[p]).tolist():
        key, one = (int(t[k]), int(p[k])), (int(distance[k]), int(end[k] - starts[t[k]]))
        out[key] = min(one, out.get(key, one))
    return [(t, p, d, end) for (t, p), (d, end) in sorted(out.items())]


def blocks(benchmark: DataFrame, q: int, rate: float, window: int | None) -> Iterator[Items]:
    """The items as indexes of about BLOCK_CHARS characters each, one gathered after another."""
    own = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + chars // BLOCK_CHARS
    for i in range(n):
        yield index(sorted((tuple(r) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()), key=str), q, rate, window)


def matches(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, rate: float = RATE, window: int | None = WINDOW) -> DataFrame:
    """doc_id, item_id, distance, n_chars (of the item or window), text_end (in the normalised text), one row a match."""
    out = None
    for items in blocks(benchmark, q, rate, window):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows = []
            for lo, hi in runs([len(t) for t in texts]):
                best: dict[tuple, tuple] = {}
                for t, p, d, end in find(texts[lo:hi], shared.value):
                    key = (lo + t, shared.value.ids[p])
                    one = (d, len(shared.value.codes[p]), end)
                    best[key] = min(one, best.get(key, one))
                rows += [(batch.column(0)[t].as_py(), i, *one) for (t, i), one in best.items()]
            cols = list(zip(*rows)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "distance", "n_chars", "text_end"])

        found = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, item_id long, distance long, n_chars long, text_end long")
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, rate: float = RATE, window: int | None = WINDOW) -> DataFrame:
    """The rows of docs that hold no item, with their own columns."""
    for items in blocks(benchmark, q, rate, window):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            clean = np.ones(len(texts), bool)
            for lo, hi in runs([len(t) for t in texts]):
                for t, *_ in find(texts[lo:hi], shared.value):
                    clean[lo + t] = False
            return batch.filter(pa.array(clean)).select([0])

        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
        docs = map_arrow(rows, run, rows.select("_row").schema).select("_row.*")
    return docs
