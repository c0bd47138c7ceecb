"""Periodic runs of words, by the runs theorem, and texts with the repetitions collapsed.

Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of consecutive words with smallest period q (words q
apart are identical) that no neighbouring word extends keeping the period. Reported are runs of at least
`max(6, 4 * q)` words.

By the runs theorem each run has, under one of an order of words and its reverse, a Lyndon root: the longest Lyndon word
that starts at some place in the run, as long as the period. The longest Lyndon word at i ends before the next suffix
that is smaller than the one at i, so both orders take the inverse suffix array's next smaller and next greater values.
A root that comes twice in a row is a candidate. It is extended to the right by the longest common extension of its start
and the place one period on, to the left by the same over the reversed words: range minima over the LCP array, from
minima of blocks of 16 and a sparse table over the blocks.

Suffix arrays are only made of the stretches that can hold a run. In a run of four periods and six words every three
consecutive words come at least three times (4q - 2 windows fall into q classes), so words in no such window are in none,
and a stretch of words in such windows holds whole runs. All stretches of some megabytes of texts are sorted together, by
doubling prefixes, each stretch for itself; only suffixes that aren't told apart yet are sorted again.

A text is worked on in one task: time n log n in its words, and about 200 bytes a word.

Nulls: a null text has no words; a null doc_id stays a row. Empty texts have no runs. Repeated rows give equal rows.
Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, runs
from .textstats import Chunk, rows_numbered, utf8

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
BLOCK = 16


def suffix_ranks(s: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Rank of the suffix at each place, parts one after another. Each part ends with a number smaller than all others in it,
    so that suffixes of a part are told apart before it ends."""
    n = len(s)
    key = part * (int(s.max(initial=0)) + 1) + s
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    at, key = order, key[order]
    old = np.zeros(n, np.int64)  # where the group that is being split begins
    base = np.zeros(n, np.int64)  # and its first place in `at`
    k = 1
    while True:
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        rank[at] = old + first - base
        alone = head.copy()
        alone[:-1] &= head[1:]
        at = at[~alone]
        if not len(at):
            return rank
        key = rank[at] * (n + 1) + rank[at + k]
        o = np.argsort(key, kind="stable")
        at, key = at[o], key[o]
        old = rank[at]
        group = np.ones(len(at), bool)
        group[1:] = old[1:] != old[:-1]
        base = np.maximum.accumulate(np.where(group, np.arange(len(at)), 0))
        k *= 2


def next_values(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next place with a smaller value and with a greater one; the length where there is none."""
    v, n = rank.tolist(), len(rank)
    smaller, greater = [n] * n, [n] * n
    falling: list[int] = []
    rising: list[int] = []
    for i, x in enumerate(v):
        while rising and v[rising[-1]] > x:
            smaller[rising.pop()] = i
        rising.append(i)
        while falling and v[falling[-1]] < x:
            greater[falling.pop()] = i
        falling.append(i)
    return np.array(smaller, np.int64), np.array(greater, np.int64)


def common_prefixes(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP array: by rank, how many numbers a suffix shares with the one before it. Ends of parts must differ from all else."""
    v, r = s.tolist(), rank.tolist()
    at = np.empty(len(s), np.int64)
    at[rank] = np.arange(len(s))
    at = at.tolist()
    out = [0] * len(v)
    h = 0
    for i, k in enumerate(r):
        if k:
            j = at[k - 1]
            while v[i + h] == v[j + h]:
                h += 1
            out[k] = h
            h -= h > 0
        else:
            h = 0
    return np.array(out, np.int64)


class RangeMin:
    """Minima of ranges: of blocks from both sides, and a sparse table over whole blocks."""

    def __init__(self, values: np.ndarray):
        n = -(-max(1, len(values)) // BLOCK) * BLOCK
        self.rows = np.full(n, np.iinfo(np.int64).max, np.int64)
        self.rows[: len(values)] = values
        self.rows = self.rows.reshape(-1, BLOCK)
        self.left = np.minimum.accumulate(self.rows, axis=1).ravel()
        self.right = np.minimum.accumulate(self.rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [self.rows.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(self.rows):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima from lo to hi, both included."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.right[lo], self.left[hi])
        same = np.flatnonzero(a == b)
        if len(same):
            column = np.arange(BLOCK)
            inside = (column >= (lo[same] % BLOCK)[:, None]) & (column <= (hi[same] % BLOCK)[:, None])
            out[same] = np.where(inside, self.rows[a[same]], np.iinfo(np.int64).max).min(axis=1)
        far = np.flatnonzero(b - a > 1)
        level = np.frexp((b - a - 1)[far].astype(float))[1] - 1
        for k in np.unique(level).tolist():
            x = far[level == k]
            out[x] = np.minimum(out[x], np.minimum(self.table[k][a[x] + 1], self.table[k][b[x] - (1 << k)]))
        return out


class Extensions:
    """Longest common extensions of two places of a part."""

    def __init__(self, s: np.ndarray, part: np.ndarray, rank: np.ndarray | None = None):
        self.rank = suffix_ranks(s, part) if rank is None else rank
        ends = np.where(s == 0, -1 - part, s)
        self.least = RangeMin(common_prefixes(ends, self.rank))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b))


def runs_of_parts(s: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the long runs in parts s[begin:end] of numbers from 1 on; s[end] is 0."""
    part = np.repeat(np.arange(len(begin)), end - begin + 1)
    rank = suffix_ranks(s, part)
    at, period = [], []
    stop = end[part]
    for after in next_values(rank):
        p = after - np.arange(len(s))
        i = np.flatnonzero((s > 0) & (after < stop) & (4 * p <= stop - begin[part]))
        i = i[(p[i + p[i]] == p[i]) & (s[i] == s[i + p[i]])]  # the root comes again
        at.append(i)
        period.append(p[i])
    i, p = np.concatenate(at), np.concatenate(period)
    if not len(i):
        return i, i, p
    # only parts with a candidate are needed from here on
    used = np.zeros(len(begin), bool)
    used[part[i]] = True
    keep = used[part]
    place = np.cumsum(keep) - 1
    back = np.flatnonzero(keep)
    s, part, i = s[keep], (np.cumsum(used) - 1)[part[keep]], place[i]
    begin, end = place[begin[used]], place[end[used]]
    rank = (np.cumsum(np.bincount(rank[keep], minlength=len(keep))) - 1)[rank[keep]]
    mirror = np.where(s == 0, np.arange(len(s)), begin[part] + end[part] - 1 - np.arange(len(s)))
    forward, backward = Extensions(s, part, rank), Extensions(s[mirror], part)
    right = forward(i, i + p)
    left = np.where(i > begin[part[i]], backward(mirror[np.maximum(i - 1, 0)], mirror[i + p - 1]), 0)
    start, stop = i - left, i + p + right
    long = stop - start >= np.maximum(6, 4 * p)
    found = np.unique(np.stack([start[long], stop[long], p[long]], axis=1), axis=0)
    return back[found[:, 0]], back[found[:, 1] - 1] + 1, found[:, 2]


def runs_of_words(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the long runs of word numbers, by start and period; a run lies in one document."""
    none = np.zeros(0, np.int64)
    at = np.flatnonzero(doc[2:] == doc[:-2]) if len(w) > 2 else none
    if not len(at):
        return none, none, none
    _, window, count = np.unique(rows_numbered(doc[at], w[at], w[at + 1], w[at + 2]), return_inverse=True, return_counts=True)
    often = at[count[window] >= 3]
    active = np.zeros(len(w) + 1, bool)
    for k in range(3):
        active[often + k] = True
    first = active[:-1].copy()
    first[1:] &= ~active[:-2] | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(first)
    last = active[:-1].copy()
    last[:-1] &= ~active[1:-1] | (doc[1:] != doc[:-1])
    end = np.flatnonzero(last) + 1
    long = end - begin >= 6
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return none, none, none
    new_end = np.cumsum(size + 1) - 1
    new_begin = new_end - size
    source = np.repeat(begin - new_begin, size + 1) + np.arange(int(new_end[-1]) + 1)
    s = np.zeros(len(source), np.int64)
    inside = np.ones(len(source), bool)
    inside[new_end] = False
    s[inside] = w[source[inside]] + 1
    start, stop, period = runs_of_parts(s, new_begin, new_end)
    order = np.lexsort((period, start))
    start, stop, period = source[start[order]], source[stop[order] - 1] + 1, period[order]
    return start, stop - start, period


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the long runs by start and period, and the text without what repeats: each run keeps its first period,
    words are joined by one space."""

    def one(batch: pa.RecordBatch):
        texts = utf8(batch.column(1))
        for lo, hi in runs([len(t) for t in texts]):
            c = Chunk(texts[lo:hi])
            start, length, period = runs_of_words(c.w_id, c.w_doc)
            words = c.count_words()
            before = np.cumsum(words) - words
            edge = np.zeros(len(c.w_id) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            keep = np.cumsum(edge[:-1]) == 0
            vocabulary = np.array(c.vocabulary, object)
            kept = vocabulary[c.w_id[keep]].tolist()
            cuts = np.cumsum(np.bincount(c.w_doc[keep], minlength=c.n)).tolist()
            collapsed = [b" ".join(kept[a:b]) for a, b in zip([0, *cuts[:-1]], cuts)]
            doc = c.w_doc[start]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=c.n))]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - before[doc], length, period)], names=["start", "length", "period"])
            columns = [batch.column(0).slice(lo, hi - lo), pa.array(words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "text"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), one, SCHEMA)
