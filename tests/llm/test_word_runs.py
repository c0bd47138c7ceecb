"""Periodic runs against a search of all periods, for arrays, for DataFrames and for the query."""

import hashlib
import random
import zlib

import numpy as np
from conftest import docs, words

from veritab.llm import word_runs
from veritab.llm.common import table
from veritab.llm.queries import op11_word_runs


def plain(w):
    """All long runs (start, length, period) of a list, by trying every period at every place."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            s = w[i : j + q]
            if length >= max(6, 4 * q) and all(s[d:] != s[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def made(rng, k):
    if rng.random() < 0.5:
        return [rng.randrange(k) for _ in range(rng.randint(0, 60))]
    out, least = [], rng.randint(5, 80)
    while len(out) < least:
        out += [rng.randrange(k + 1) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
        out = out[: len(out) - rng.randint(0, 2)]
    return out


def test_arrays_of_several_documents():
    rng = random.Random(2)
    for _ in range(800):
        many = [made(rng, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 4))]
        w = np.array([x for d in many for x in d], np.int64)
        doc = np.repeat(np.arange(len(many)), [len(d) for d in many])
        before = np.cumsum([0, *map(len, many)])
        want = [(int(before[i]) + s, n, q) for i, d in enumerate(many) for s, n, q in plain(d)]
        assert list(zip(*(x.tolist() for x in word_runs.runs_of_words(w, doc)))) == want


def test_range_minima():
    rng = np.random.default_rng(3)
    for n in (1, 15, 16, 17, 200, 1000):
        v = rng.integers(0, 50, n)
        lo, hi = np.sort(rng.integers(0, n, (2, 500)), axis=0)
        assert word_runs.RangeMin(v)(lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi)]


def test_texts_and_edge_cases(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{x}" for x in made(rng, 3)) for _ in range(60)] + [words(rng, 200), "\t a  a\na a\x0ba a\r\n", "é é é é é é", "a b a b a b a b", "a b a b a b a", "", None, "   ", "Aa aa Aa aa Aa aa Aa aa"]
    rows = [*enumerate(texts), (None, "x x x x x x x"), (7, texts[7]), (7, "y y y y y y")]
    got = word_runs.find(docs(spark, rows))
    assert got.columns == ["doc_id", "n_words", "runs", "text"]
    want = []
    for i, t in rows:
        w = (t or "").split()
        r = plain(w)
        want.append((i, len(w), r, collapse(w, r)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert word_runs.find(docs(spark, [])).count() == 0


def test_a_very_long_text(spark):
    w = [f"v{i % 1000}" for i in range(150_000)]
    r = word_runs.find(docs(spark, [(1, " ".join(["start", *w, "end"])), (2, "x " * 100_000)])).collect()
    assert {x.doc_id: [tuple(y) for y in x.runs] for x in r} == {1: [(1, 150_000, 1000)], 2: [(0, 100_000, 1)]}


def test_query_equals_a_loop(spark, sf_dir):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d in table(spark, sf_dir, "documents").collect():
        w = (d.text or "").translate({c: " " for c in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        h = zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = plain(w) if n < 3000 else None
        if r is None:
            continue
        best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None)
        want.append((d.doc_id, len(r), *best, 1000 * best[1] // best[2] if r else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in r)), sha(collapse(w, r))))
    got = {x.doc_id: tuple(x) for x in op11_word_runs(spark, sf_dir).collect()}
    assert len(got) >= len(want) > 150
    assert [got[x[0]] for x in want] == want
