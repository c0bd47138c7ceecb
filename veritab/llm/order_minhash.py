"""Order MinHash: near-duplicate documents, verified by banded alignment.

Words are runs of non-space characters, ASCII-lower-cased. Two documents are linked if at most (1 - similarity) of the
longer one's words must be edited to turn one into the other; `similarity` is 0.9, so that one word in ten may differ.
Classes are the components of the links.

Sketch: shingles are `k` = 5 words, labelled by their occurrence number in the document. Each of `m` = 32 hash functions
picks the `l` = 3 labelled shingles with the smallest hashes and keeps them in text order; their digest is one bucket key.
Of a text with one word in ten edited at random 0.59 of the shingles stay, 0.42 of both texts' together: such pairs, at the
very limit, share one of 32 keys in 91 of 100 cases, with one word in twenty edited in all. Edits that lie as far apart as
they can leave a third, and a key in 70 of 100 cases; under 30 words chance decides. Texts that share no key directly often
meet through a third. Documents with fewer than l shingles link to their copies only.

Copies (equal words) collapse first, by sha256, onto their least doc_id. Then the members of each bucket are aligned with
its leaders, the least document of each class of lengths. What is left are buckets that still hold several classes: their
members meet in blocks of bounded size (members and words), where pairs of different classes within neighbouring lengths are
compared by counts of words in `CELLS` cells (an edit takes one from a cell and adds one to another, so a larger difference
rules a link out), each pair at the first key that it shares only. No pair becomes a row: members with a possible partner get
their texts and meet again, the pairs are aligned inside the block, and a tree of links that joins its classes leaves it.
Pairs of n unlike documents with one key are n * n / 2 comparisons all the same; rows dealt to blocks are n times the number
of blocks, which grows with n and from 8 blocks on with its root, unless texts are long (WORDS). No bucket, pair or class is
capped or sampled.

Nulls: a null text is an empty one; rows with a null doc_id form no links and have a null class. Documents without a
word are copies of each other. Rows that share a doc_id count as one document with several texts. Repeated rows give
one result row (rows with a null doc_id one each). Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from .common import cut, map_arrow, runs
from .textstats import Chunk, U, mix, rows_numbered, utf8

K, L, M, SIMILARITY = 5, 3, 32, 0.9
#: Cells in which the words of a document are counted, one byte each.
CELLS = 256
#: Members of a bucket that meet in one task at once.
BLOCK = 512
#: Words of a bucket's members in one block.
WORDS = 1 << 20
#: Pairs whose cells are compared at once.
STEP = 20_000
_SEEDS = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.lower() for t in texts]  # ASCII letters only: bytes


@functools.lru_cache(1 << 18)
def _digest(word: bytes) -> bytes:
    return hashlib.blake2b(word, digest_size=8).digest()


def word_hashes(c: Chunk) -> np.ndarray:
    """64 bits of BLAKE2 for each word of the chunk: the same in every task."""
    return np.frombuffer(b"".join(map(_digest, c.vocabulary)), U)[c.w_id]


def _combine(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(parts[0]), U)
    for p in parts:
        out = mix(out * U(0x9E3779B97F4A7C15) + p + U(1))
    return out


def shingles(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle that lies within one text, and its text."""
    h = word_hashes(c)
    at = np.flatnonzero(c.w_doc[k - 1 :] == c.w_doc[: len(h) - k + 1]) if len(h) >= k else np.zeros(0, np.int64)
    return _combine([h[at + j] for j in range(k)]), c.w_doc[at]


def labelled(s: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with their occurrence numbers in their texts."""
    salted = mix(s + mix(doc.astype(U) + U(3)))
    order = np.argsort(salted, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = salted[order][1:] != salted[order][:-1]
    run = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    occurrence = np.empty(len(order), np.int64)
    occurrence[order] = np.arange(len(order)) - run
    return mix(s + occurrence.astype(U) * U(0xD6E8FEB86659FD93))


def _smallest(v: np.ndarray, below: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray, l: int) -> np.ndarray:
    """Positions of the l smallest values of each text (texts x l), in text order. below: bounds under which they probably are."""
    at = np.flatnonzero(v <= below)
    short = np.flatnonzero(np.bincount(doc[at], minlength=len(size)) < l)
    if len(short):  # the bound was too low for these
        at = np.sort(np.concatenate([at, *(first[d] + np.flatnonzero(v[first[d] : first[d] + size[d]] > below[first[d]]) for d in short)]))
    of = doc[at]
    order = np.lexsort((v[at], of))
    rank = np.arange(len(order)) - np.searchsorted(of, of)
    return np.sort(at[order[rank < l]].reshape(len(size), l), axis=1)


def sketches(texts: list[bytes], k: int = K, l: int = L, m: int = M) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The digest of each text's words, its number of words, and its keys (texts x m; 0 throughout for fewer than l shingles)."""
    texts = lowered(texts)
    c = Chunk(texts)
    digests = [hashlib.sha256(b" ".join(t.split())).digest() for t in texts]
    keys = np.zeros((c.n, m), U)
    s, doc = shingles(c, k)
    label = labelled(s, doc)
    count = np.bincount(doc, minlength=c.n)
    able = np.flatnonzero(count >= l)
    if len(able):
        mine = count[doc] >= l
        label, size = label[mine], count[able]
        of, first = np.repeat(np.arange(len(able)), size), np.cumsum(size) - size
        below = np.repeat((np.minimum(1.0, (l + 5 * math.sqrt(l)) / size) * float(2**64 - 2**12)).astype(U), size)
        for r in range(m):
            v = (label ^ _SEEDS[r]) * (_SEEDS[r] | U(1))
            picked = _smallest(v, below, of, first, size, l)
            keys[able, r] = _combine([label[p] for p in picked.T] + [np.full(len(able), r, U)])
    return digests, c.count_words(), keys


def _run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """Length of the common run of a from i and b from j."""
    n, width = min(len(a) - i, len(b) - j), 64
    at = 0
    while at < n:
        differ = a[i + at : i + min(at + width, n)] != b[j + at : j + min(at + width, n)]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, width = at + width, width * 4
    return n


def _ranks(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... the numbers of the stretches of that length in a and then b; equal for equal stretches only."""
    out = [np.unique(np.concatenate([a, b]), return_inverse=True)[1]]
    both, step = len(a) + len(b), 1
    while 2 * step <= min(len(a), len(b)):
        out.append(np.unique(rows_numbered(out[-1][: both - 2 * step + 1], out[-1][step : both - step + 1]), return_inverse=True)[1])
        step *= 2
    return out


def _runs(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """_run for many starts at once."""
    out = np.zeros(len(i), np.int64)
    for power in range(len(ranks) - 1, -1, -1):
        step = 1 << power
        for _ in range(2 if power == len(ranks) - 1 else 1):
            fits = np.flatnonzero((i + out + step <= len(a)) & (j + out + step <= len(b)))
            same = ranks[power][i[fits] + out[fits]] == ranks[power][len(a) + j[fits] + out[fits]]
            out[fits[same]] += step
    return out


def edit_distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two sequences of numbers if it is at most limit: furthest-reaching points on the diagonals of the band."""
    if abs(len(a) - len(b)) > limit:
        return None
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        d = max(len(a), len(b))
        return d if d <= limit else None
    # words without a partner on the other side bound the distance from below
    both, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = np.bincount(where[: len(a)], minlength=len(both)), np.bincount(where[len(a) :], minlength=len(both))
    if max(np.maximum(ca - cb, 0).sum(), np.maximum(cb - ca, 0).sum()) > limit:
        return None
    ranks: list[np.ndarray] = []
    goal = len(a) - len(b)  # diagonal i - j of the end
    reach = np.zeros(1, np.int64)  # nothing in common at the start, after trimming
    e = 0
    while True:
        if abs(goal) <= e and reach[goal + e] >= len(a):
            return e
        if e == limit:
            return None
        e += 1
        old = np.full(2 * e + 3, -2, np.int64)
        old[2 : 2 * e + 1] = reach  # old[k + e + 1]: diagonal k of the step before
        k = np.arange(-e, e + 1)
        i = np.maximum(np.maximum(old[1:-1] + 1, old[:-2] + 1), old[2:])  # substitution, deletion from a, insertion
        i = np.minimum(np.minimum(i, len(a)), len(b) + k)
        reach = np.where((i >= 0) & (i >= k), i, -2)
        on = np.flatnonzero((reach >= 0) & (reach < len(a)) & (reach - k < len(b)))
        on = on[a[reach[on]] == b[reach[on] - k[on]]]
        if len(on) > 12:
            ranks = ranks or _ranks(a, b)
            reach[on] += _runs(ranks, a, b, reach[on], reach[on] - k[on])
        else:
            for x in on:
                reach[x] += _run(a, b, int(reach[x]), int(reach[x] - k[x]))


def edits_allowed(longer, similarity: float):
    return ((1 - similarity) * longer + 1e-9).astype(np.int64) if isinstance(longer, np.ndarray) else int((1 - similarity) * longer + 1e-9)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    return edit_distance_within(a, b, edits_allowed(max(len(a), len(b)), similarity)) is not None


def _sign(docs: DataFrame, k: int, l: int, m: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        digests, n_words, keys = [], [np.zeros(0, np.int64)], []
        for lo, hi in runs([len(t) for t in texts]):
            d, n, x = sketches(texts[lo:hi], k, l, m)
            digests += d
            n_words.append(n)
            x = x.view(np.int64)
            keys += [row if row.any() else row[:0] for row in x]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(np.concatenate(n_words).astype(np.int32)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n_words", "keys"])

    return map_arrow(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, digest binary, n_words int, keys array<bigint>")


def _cells(texts: DataFrame) -> DataFrame:
    """id, copy and cells of each text: how many of its words are in each of CELLS classes of hashes, up to 255."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs = utf8(batch.column(1))
        for lo, hi in runs([len(t) for t in docs]):
            c = Chunk(lowered(docs[lo:hi]))
            cell = (word_hashes(c) % U(CELLS)).astype(np.int64)
            counts = np.bincount(c.w_doc * CELLS + cell, minlength=c.n * CELLS).reshape(c.n, CELLS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([x.tobytes() for x in np.minimum(counts, 255).astype(np.uint8)], pa.binary())], names=["id", "copy", "cells"])

    return map_arrow(texts.select("id", "text", "copy"), run, "id long, copy long, cells binary")


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (id, leader) that are linked."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left, right = utf8(batch.column(2)), utf8(batch.column(3))
        linked = np.zeros(len(left), bool)
        for lo, hi in runs([len(x) + len(y) for x, y in zip(left, right)]):
            c = Chunk(lowered(left[lo:hi] + right[lo:hi]))
            words = np.split(c.w_id, np.cumsum(c.count_words())[:-1])
            half = hi - lo
            linked[lo:hi] = [similar(words[i], words[half + i], similarity) for i in range(half)]
        yield batch.select([0, 1]).filter(pa.array(linked))

    one = texts.select("id", F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("leader"), F.col("text").alias("text_b"))
    return map_arrow(pairs.join(one, "id").join(two, "leader").select("id", "leader", "text_a", "text_b"), run, "id long, leader long")


def components(links: DataFrame) -> DataFrame:
    """(id, class_id) of the ids in links (a, b): the least id of each component. Two tables a round, until none changes."""
    sides = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "sides")
    labels = cut(sides.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("class_id")), "labels")
    while True:
        near = sides.join(labels, sides["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("near"))
        met = cut(labels.join(near, "id").select("id", "class_id", F.least("class_id", "near").alias("met")), "met")
        if met.where("met < class_id").isEmpty():  # the label of a component is the same throughout
            return labels
        up = met.select(F.col("id").alias("met"), F.col("met").alias("up"))
        labels = cut(met.join(up, "met").select("id", F.least("met", "up").alias("class_id")), "jumped")


def _merge(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (id, class_id) after the links found (id, leader): components of classes, which are few."""
    if found.isEmpty():
        return labels
    edges = _named(found, labels).select(F.col("id_class").alias("a"), F.col("leader_class").alias("b")).where("a != b").distinct()
    joined = components(edges).select(F.col("id").alias("class_id"), F.col("class_id").alias("new"))
    return cut(labels.join(joined, "class_id", "left").select("id", F.coalesce("new", "class_id").alias("class_id")), "labels")


def _named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with the classes of id and leader."""
    one = labels.select("id", F.col("class_id").alias("id_class"))
    two = labels.select(F.col("id").alias("leader"), F.col("class_id").alias("leader_class"))
    return pairs.join(one, "id").join(two, "leader")


def _length_class(n: str, similarity: float):
    """Lengths that may link lie in the same class or in neighbouring ones."""
    return F.floor(F.log(F.greatest(F.col(n), F.lit(1))) / F.lit(-math.log(similarity) + 1e-6)).cast("int")


def classes(docs: DataFrame, *, k: int = K, l: int = L, m: int = M, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and copy_of (least doc_id with the same words)."""
    signed = cut(_sign(docs, k, l, m), "signed")
    # the keys depend on the words only
    copies = cut(signed.groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys")), "copies")
    named = cut(signed.select("doc_id", "digest").join(copies.select("digest", "copy_of"), "digest").select("doc_id", "copy_of").distinct(), "named")
    no_id = docs.where(F.col("doc_id").isNull()).select(*[F.lit(None).cast("long").alias(c) for c in ("doc_id", "class_id", "copy_of")])
    every_key = copies.select(F.col("copy_of").alias("id"), "n_words", F.posexplode("keys").alias("at", "key")).repartition("key")
    shared = every_key.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = cut(every_key.join(shared, "key").withColumn("size", _length_class("n_words", similarity)), "shared")

    # members meet the least document of their bucket and class of lengths, and of the class below
    heads = rows.groupBy("key", "size").agg(F.min("id").alias("leader"))
    every = heads.select("key", F.explode(F.array("size", F.col("size") + 1)).alias("size"), "leader")
    pairs = cut(rows.join(every, ["key", "size"]).where("id != leader").select(F.greatest("id", "leader").alias("id"), F.least("id", "leader").alias("leader")).distinct(), "pairs")
    if pairs.isEmpty():
        return named.select("doc_id", F.col("copy_of").alias("class_id"), "copy_of").union(no_id)
    wanted = cut(pairs.select("id").union(pairs.select("leader")).distinct(), "wanted")
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi"), "texts")
    labels = wanted.select("id", F.col("id").alias("class_id"))
    # a member's least leader first: most of a class meets there, and need not meet again elsewhere
    first = cut(pairs.groupBy("id").agg(F.min("leader").alias("leader")), "first")
    labels = _merge(labels, cut(_verify(first, texts, similarity), "found"))
    left = cut(_named(pairs, labels).where("id_class != leader_class").select("id", "leader").join(first, ["id", "leader"], "left_anti"), "left")
    labels = _merge(labels, cut(_verify(left, texts, similarity), "found"))
    labels = _meet(rows, heads, labels, texts, similarity)
    labels = labels.select(F.col("id").alias("copy_of"), "class_id")
    return named.join(labels, "copy_of", "left").select("doc_id", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of").union(no_id)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks of (key, group, lo, hi), by which the rows of batches are sorted."""
    rest = None
    for b in batches:
        table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        # the last block may go on in the next batch
        last = [table.column(i).to_numpy() for i in range(4)]
        same = np.logical_and.reduce([x == x[-1] for x in last]) if table.num_rows else np.zeros(0, bool)
        whole = table.num_rows - int(same[::-1].argmin() if not same.all() else len(same))
        if whole:
            yield table.slice(0, whole)
        rest = table.slice(whole)
    if rest is not None and rest.num_rows:
        yield rest


def _pairs(rows: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows in one block that are of two classes, that cells allow to link and that meet at no earlier key; and how far apart their cells are."""
    key, size, lo, hi, ids, label, n, block, own, this = (rows.column(i).to_numpy() for i in range(10))
    cells = np.frombuffer(b"".join(rows.column(10).to_pylist()), np.uint8).reshape(-1, CELLS)
    shared = rows.column(11).combine_chunks()
    of, (at, bucket, heads) = np.repeat(np.arange(len(key)), shared.value_lengths().to_numpy()), (x.to_numpy(zero_copy_only=False) for x in shared.flatten().flatten())
    keys = np.zeros((len(key), int(at.max(initial=0)) + 1), np.int64)
    head = np.zeros(keys.shape, bool)
    keys[of, at], head[of, at] = bucket, heads
    new = np.ones(len(key) + 1, bool)
    new[1:-1] = (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    edges = np.flatnonzero(new)
    end = np.repeat(edges[1:], np.diff(edges))
    at, step = np.arange(len(key)), 1
    held: list[np.ndarray] = []

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        i, j = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
        held.clear()
        for a in range(0, len(i), STEP):
            x, y = i[a : a + STEP], j[a : a + STEP]
            d = cells[x].astype(np.int16) - cells[y]
            more = np.maximum(d, 0).sum(1)
            apart = np.maximum(more, more - d.sum(1, dtype=np.int64))
            good = apart <= edits_allowed(np.maximum(n[x], n[y]), similarity)
            x, y, apart = x[good], y[good], apart[good]
            same = (keys[x] == keys[y]) & (keys[x] != 0)
            # aligned before: one is the leader of the other, which is of its class of lengths or the next
            tried = (same & (head[x] & (own[y] | ~own[x])[:, None] | head[y] & (own[x] | ~own[y])[:, None])).any(1)
            good = ((same.argmax(1) == this[x]) | ~same.any(1)) & ~tried
            yield x[good], y[good], apart[good]

    while len(at := at[at + step < end[at]]):
        j = at + step
        meet = (label[at] != label[j]) & (own[at] | own[j]) & ((block[at] != block[j]) | (lo[at] == hi[at]))
        meet &= np.abs(n[at] - n[j]) <= edits_allowed(np.maximum(n[at], n[j]), similarity)
        held.append(np.stack([at[meet], j[meet]]))
        if sum(x.shape[1] for x in held) >= STEP:
            yield from flush()
        step += 1
    yield from flush()


def _possible(members: DataFrame, similarity: float) -> DataFrame:
    """The members that have a possible partner in their block: at most the rows that came. They come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            some = np.zeros(rows.num_rows, bool)
            for x, y, _ in _pairs(rows, similarity):
                some[x] = some[y] = True
            yield from rows.filter(pa.array(some)).combine_chunks().to_batches()

    ship(members.sparkSession)
    return members.mapInArrow(run, members.schema)


def _links(members: DataFrame, similarity: float) -> DataFrame:
    """(id, leader) of links that join the classes of each block, a tree of them: fewer than the rows that came.

    members are those of _possible with their texts, sorted by block. Pairs are aligned where they are found, the likeliest
    of some STEP first, except pairs of classes that links of this block have joined already."""

    def of_blocks(rows: pa.Table, texts: list[bytes], block: np.ndarray) -> pa.RecordBatch:
        words, number = [], defaultdict(itertools.count().__next__)
        for lo, hi in runs([len(t) for t in texts]):
            c = Chunk(lowered(texts[lo:hi]))
            w_id = np.fromiter(map(number.__getitem__, c.vocabulary), np.int64, len(c.vocabulary))[c.w_id]
            words += np.split(w_id, np.cumsum(c.count_words())[:-1])
        ids, label = rows.column(4).to_numpy(), rows.column(5).to_numpy()
        node = np.unique(rows_numbered(block - block[0], np.unique(label, return_inverse=True)[1]), return_inverse=True)[1].tolist()
        up, found = list(range(len(node))), []

        def top(a: int) -> int:
            while up[a] != a:
                up[a] = a = up[up[a]]
            return a

        for x, y, apart in _pairs(rows, similarity):
            order = np.argsort(apart, kind="stable")
            for i, j in zip(x[order].tolist(), y[order].tolist()):
                a, b = top(node[i]), top(node[j])
                if a != b and similar(words[i], words[j], similarity):
                    up[a] = b
                    found.append((i, j))
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[i], ids[j])), pa.array(np.minimum(ids[i], ids[j]))], names=["id", "leader"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            texts = utf8(rows.column(13).combine_chunks())
            place = np.stack([rows.column(i).to_numpy() for i in range(4)])
            first = np.concatenate([[0], np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1, [len(texts)]])
            block = np.repeat(np.arange(len(first) - 1), np.diff(first))
            lengths = np.bincount(block, [len(t) + 1 for t in texts])
            for lo, hi in runs(lengths.tolist()):
                lo, hi = int(first[lo]), int(first[hi])
                yield of_blocks(rows.slice(lo, hi - lo), texts[lo:hi], block[lo:hi])

    ship(members.sparkSession)
    return members.mapInArrow(run, "id long, leader long")


def _shared_keys(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """id and its shared keys with the numbers of their hash functions, and whether it leads there; none for an id of several texts."""
    led = rows.join(heads, ["key", "size"]).select("id", "at", "key", (F.col("id") == F.col("leader")).alias("head"), "n_words").repartition("id")
    one = led.groupBy("id", "at").agg(F.count("*").alias("n"), F.first("key").alias("key"), F.first("head").alias("head"), F.min("n_words").alias("least"), F.max("n_words").alias("most"))
    keys = F.collect_list(F.struct("at", "key", "head"))
    single = (F.max("n") == 1) & (F.min("least") == F.max("most"))
    return one.groupBy("id").agg(F.when(single, keys).otherwise(F.slice(keys, 1, 0)).alias("shared"))


def _meet(rows: DataFrame, heads: DataFrame, labels: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """labels after all pairs of two classes that share a key are compared, but those of members and leaders."""
    groups = rows.join(labels, "id").select("id", "key", "n_words", "class_id", "at", F.explode(F.array("size", F.col("size") + 1)).alias("group"), "size")
    groups = groups.withColumn("own", F.col("group") == F.col("size"))
    mixed = groups.groupBy("key", "group").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.count("*").alias("n"), F.sum("n_words").alias("words"), F.max("own").alias("own")).where("lo < hi and own")
    blocks = F.greatest(F.least(F.col("n") / BLOCK, F.sqrt(8 * F.col("n") / BLOCK)), F.least(F.col("words") / WORDS, F.col("n")))
    mixed = mixed.select("key", "group", F.ceil(blocks).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = groups.join(mixed, ["key", "group"]).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "class_id", "n_words", "block", "own", "at")
    copies = texts.withColumn("copy", F.xxhash64("text"))  # texts of one id are told apart by it
    told = _cells(copies).dropDuplicates(["id", "copy"]).join(_shared_keys(rows, heads), "id")
    together = ["key", "group", "lo", "hi"]
    order = [*together, "id", "class_id", "n_words", "block", "own", "at", "cells", "shared", "copy"]
    dealt = dealt.join(cut(told, "cells"), "id").select(order)
    near = _possible(dealt.repartition(*together).sortWithinPartitions(*together), similarity)
    near = near.join(copies.select("id", "copy", "text"), ["id", "copy"]).select(*order, "text")
    return _merge(labels, cut(_links(near.repartition(*together).sortWithinPartitions(*together), similarity), "found"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id stands for its class, one row each, and those with a null doc_id; columns as they are."""
    stay = cut(classes(docs, **options).where("doc_id = class_id").select(F.col("doc_id").alias("id")), "stay")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    one = rows.where(F.col("id").isNotNull()).join(stay, "id", "left_semi").dropDuplicates(["id"])
    return one.unionByName(rows.where(F.col("id").isNull())).select("row.*")
