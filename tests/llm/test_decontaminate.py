"""Q-gram lemma: matches against alignment of every item with every text."""

from conftest import docs, words  # noqa: F401

from veritab.llm import decontaminate
from veritab.llm.decontaminate import align, index, normalise


def brute(rows, items, rate=decontaminate.RATE, q=decontaminate.Q):
    idx = index([(i, t) for i, t in items], q, rate)
    out = set()
    for pos, (i, t) in enumerate(rows):
        code, _ = normalise([t or ""])
        for p, c in enumerate(idx.codes):
            if len(code) and align(c, code)[0] <= idx.budget[p]:
                out.add((i, idx.ids[p]))
    return out


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        t[rng.randrange(len(t))] = rng.choice("abcxyz ")
    return "".join(t)


def test_matches_equal_brute_force(spark, rng):
    items = [(i, words(rng, rng.randint(8, 40)).capitalize()) for i in range(6)] + [(6, words(rng, 150)), (7, "short"), (8, None), (9, "")]
    rows = []
    for i in range(30):
        text = words(rng, rng.randint(0, 120))
        if i % 2:
            passage = items[i % 7][1]
            text = text + "\n" + edited(rng, passage, rng.choice([0, 0, 1, 3, 12])) + " " + text
        rows.append((i, text))
    rows += [(30, None), (31, ""), (32, items[0][1] + " " + words(rng, 20000)), (33, items[1][1].upper().replace(" ", " -- "))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, rows), bench).collect()}
    assert got == brute(rows, items)
    assert (32, 0) in got and (33, 1) in got
    kept = decontaminate.keep_clean(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in rows} - {i for i, _ in got})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs(spark, [(1, "a text")]), none).count() == 0
    assert decontaminate.keep_clean(docs(spark, [(1, "a text")]), none).count() == 1
    assert decontaminate.keep_clean(docs(spark, []), spark.createDataFrame([(1, "some passage of text")], none.schema)).count() == 0


def test_items_with_a_common_beginning(rng):
    """Items that share a long prompt, and a text that repeats it: nothing is found, and regions leave the alignment early."""
    import time

    prompt = "answer the following question about the text given below please"
    items = index([(i, prompt + " " + words(rng, 14)) for i in range(100)])
    began = time.time()
    assert decontaminate.find([" ".join([prompt] * 10)], items) == [] and time.time() - began < 5


def test_short_items_match_whole_texts_exactly(spark):
    bench = spark.createDataFrame([(1, "Yes, no!"), (2, "?"), (3, "a b")], "item_id long, text string")
    rows = [(1, "yes no"), (2, "yes no maybe"), (3, "A  B"), (4, "?"), (5, None)]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, rows), bench).collect())
    assert got == [(1, 1), (3, 3)]


def test_whole_items_instead_of_windows(rng):
    item = words(rng, 300)
    half = item[: len(item) // 2]
    assert decontaminate.find([half], index([(1, item)])) and not decontaminate.find([half], index([(1, item)], window=None))
    assert decontaminate.find(["before " + item + " after"], index([(1, item)], window=None))
