"""Order MinHash: links against brute force over all pairs."""

import numpy as np
from pyspark.sql import functions as F
from conftest import docs, words  # noqa: F401

from veritab.llm import order_minhash
from veritab.llm.order_minhash import SIMILARITY, edit_distance_within, similar


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_equals_the_full_one(rng):
    for _ in range(300):
        n = rng.randint(0, 30)
        a = [rng.randint(0, 4) for _ in range(n)]
        b = [x for x in a if rng.random() > 0.15]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 6))
        d, limit = distance(a, b), rng.randint(0, 8)
        got = edit_distance_within(np.array(a, np.int64), np.array(b, np.int64), limit)
        assert got == (d if d <= limit else None)


def test_many_diagonals_equal_the_full_alignment(rng):
    """Texts of two words, so that runs are met on many diagonals at once."""
    for _ in range(12):
        a = [rng.randint(0, 1) for _ in range(300)]
        b = [x if rng.random() > 0.1 else 1 - x for x in a if rng.random() > 0.1]
        d = distance(a, b)
        assert edit_distance_within(np.array(a, np.int64), np.array(b, np.int64), 80) == d


def changed(rng, text, share):
    return " ".join(w if rng.random() > share else "zz" + str(rng.randint(0, 999)) for w in text.split(" "))


def test_classes_hold_every_link(spark, rng):
    rows, k = [], 0
    for base in range(12):
        text = words(rng, rng.randint(60, 300))
        for copy in range(rng.choice([1, 2, 6])):
            rows.append((k, text if copy == 1 else changed(rng, text, 0.02 * min(copy, 2))))
            k += 1
    rows += [(k, ""), (k + 1, " \n"), (k + 2, "short text"), (k + 3, "Short  text"), (k + 4, None), (None, "a null id"), (k + 5, words(rng, 20000))]
    got = {r.doc_id: (r.class_id, r.copy_of) for r in order_minhash.classes(docs(spark, rows)).collect() if r.doc_id is not None}
    texts = {i: (t or "").lower().split() for i, t in rows if i is not None}
    code = {w: n for n, w in enumerate({w for t in texts.values() for w in t})}
    arrays = {i: np.array([code[w] for w in t], np.int64) for i, t in texts.items()}
    assert set(got) == set(texts)
    for i in texts:
        for j in texts:
            if similar(arrays[i], arrays[j]):
                assert got[i][0] == got[j][0], (i, j)
    for i, (c, _) in got.items():  # nothing else is drawn together
        assert i == c or any(similar(arrays[i], arrays[j]) for j in texts if j != i and got[j][0] == c)
    kept = order_minhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c, _ in got.values()})


def test_groups_of_copies_and_empty_tables(spark, rng):
    text = words(rng, 80)
    rows = [(i, text) for i in range(300)] + [(300 + i, changed(rng, text, 0.02)) for i in range(60)] + [(500, words(rng, 80)), (500, words(rng, 80))]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs(spark, rows)).collect()}
    assert {got[i] for i in range(360)} == {0} and got[500] == 500
    assert order_minhash.classes(docs(spark, [])).count() == 0
    assert order_minhash.keep_one(docs(spark, [])).count() == 0


def test_repeated_lines_count_each_time(spark, rng):
    """Texts whose likeness is a line said 92 times, with 40 words of their own at the end."""
    line = words(rng, 10)
    own = [" ".join(f"own{i}x{j}" for j in range(40)) for i in range(2)]
    texts = [" ".join([line] * 92 + [x]) for x in own]
    *_, keys = order_minhash.sketches([t.encode() for t in texts])
    assert (keys[0] == keys[1]).sum() >= 10
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {0: 0, 1: 0}


def test_a_chain_of_texts_is_one_class(spark, rng):
    """Each text is within the limit of a few neighbours in the chain only; longer texts lead in most of their buckets."""
    base = words(rng, 400).split(" ")
    rows = [(i, " ".join(base[:n])) for i, n in enumerate(range(399, 200, -9))]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs(spark, rows)).collect()}
    assert set(got.values()) == {0} and len(got) == len(rows)


def test_texts_that_collide_under_polynomial_hashes(spark, thue_morse):
    """Words and texts of Thue-Morse pairs are not copies of each other."""
    a, b = thue_morse(2048)
    rows = [(0, a), (1, b), (2, " ".join(a)), (3, " ".join(b)), (4, a.upper())]
    got = {r.doc_id: r.copy_of for r in order_minhash.classes(docs(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}


def test_recall_over_all_pairs_of_a_table(spark):
    """Queries: every row whose id is divisible by 20, against all rows of the generated documents; links by full alignment."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs(spark, rows)).collect()}
    texts = {i: (t or "").lower().split() for i, t in rows}
    code = {w: n for n, w in enumerate({w for t in texts.values() for w in t})}
    arrays = {i: np.array([code[w] for w in t], np.int64) for i, t in texts.items()}
    cells = np.array([np.bincount(a % 256, minlength=256) for a in arrays.values()], np.int32)
    ids, n = np.array(list(arrays)), cells.sum(1)
    caught = total = 0
    for x in np.flatnonzero(ids % 20 == 0):
        limit = ((1 - SIMILARITY) * np.maximum(n, n[x]) + 1e-9).astype(int)
        for y in np.flatnonzero(np.maximum(np.maximum(cells - cells[x], 0).sum(1), np.maximum(cells[x] - cells, 0).sum(1)) <= limit):
            i, j = ids[x], ids[y]
            if x != y and texts[i] != texts[j] and similar(arrays[i], arrays[j]):
                total, caught = total + 1, caught + (got[i] == got[j])
    print("links between different texts:", total, "in one class:", caught)
    assert total >= 100 and caught >= 0.9 * total


def test_nulls_repeated_rows_and_clashing_columns(spark, rng):
    text = words(rng, 50)
    rows = [(1, text), (1, text), (None, text), (None, None), (2, text + " more"), (3, None)]
    df = docs(spark, rows).withColumn("id", F.lit(1)).withColumn("_stays", F.lit("x")).withColumn("class_id", F.lit(5))
    got = sorted((r.doc_id or 0, r.class_id, r.copy_of) for r in order_minhash.classes(df).collect())
    assert got == [(0, None, None), (0, None, None), (1, 1, 1), (2, 1, 2), (3, 3, 3)]
    kept = order_minhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3]


def unlike(rng, n):
    """Texts of one passage and the same other words in different orders: counts of words never tell them apart. Then ten with three words changed."""
    passage, own = words(rng, 60), [f"own{i}" for i in range(60)]
    texts = [passage + " " + " ".join(rng.sample(own, 60)) for _ in range(n)]
    return list(enumerate(texts + [t.replace("own7 ", "x ").replace("own8 ", "y ").replace("own9 ", "z ") for t in texts[:10]]))


def test_unlike_texts_of_one_bucket_do_not_become_rows_of_pairs(spark, rng, monkeypatch):
    rows, made = unlike(rng, 200), []

    def counted(f):
        def call(*args):
            df = f(*args)
            made.append(df.count())
            return df

        return call

    for name in ("_possible", "cut"):
        monkeypatch.setattr(order_minhash, name, counted(getattr(order_minhash, name)))
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs(spark, rows)).collect()}
    assert got == {i: i if i < 200 else i - 200 for i, _ in rows}
    assert len(made) > 10 and max(made) <= len(rows) * order_minhash.M


def test_small_blocks_lose_no_link(spark, rng, monkeypatch):
    """Links inside blocks and between them; an id of two texts, each of which is linked to another."""
    rows = unlike(rng, 60)
    rows += [(100 + i, changed(rng, t, 0.03)) for i, t in rows[20:40]] + [(200, rows[50][1] + " more"), (200, rows[51][1] + " more")]
    expected = {r.doc_id: r.class_id for r in order_minhash.classes(docs(spark, rows)).collect()}
    monkeypatch.setattr(order_minhash, "BLOCK", 4)
    monkeypatch.setattr(order_minhash, "WORDS", 700)
    monkeypatch.setattr(order_minhash, "STEP", 50)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs(spark, rows)).collect()}
    assert got == expected
    assert all(got[60 + i] == i for i in range(10)) and all(got[100 + i] == i for i in range(20, 40))
    assert got[50] == got[51] == got[200] == 50
