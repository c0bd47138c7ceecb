"""Line deduplication against a loop over documents, its runs, and its edge cases."""

import random

import pytest
from conftest import docs

from veritab.llm import line_runs
from veritab.llm.line_runs import LineRuns


def plain(rows, least=10):
    """(doc_id, n_lines, n_dropped, text) by a loop; a null doc_id comes last."""
    last = line_runs.LAST
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(line_runs.SPACE))
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k, d0 = key(line), last if d is None else d
            first[k] = min(first.get(k, last), d0)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == (last if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (4, 3)])
def test_equals_a_loop(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"Line number {i} of the pool" for i in range(30)] + ["short", "  PADDED line here \t", "padded LINE here", "ÉCOLE des écoliers", "école des écoliers", "", "\x0bvertical tab\x0c"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in rng.sample(range(1000), 120)]
    got = line_runs.dedup(docs(spark, rows), batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_nulls_repeats_and_a_long_text(spark):
    line = "the same long line"
    long = "\n".join([f"line {i} of a very long text" for i in range(60_000)] + [line])
    rows = [(5, long), (3, None), (4, ""), (5, long), (None, line), (None, f"{line}\nonly without an id"), (7, f"x\n{line}\n{line}\ny"), (9, f"{line}\r\n\n")]
    got = line_runs.dedup(docs(spark, rows), batches=3)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
    assert line_runs.dedup(docs(spark, [])).count() == 0
    assert [r.n_lines for r in line_runs.dedup(docs(spark, [(None, None)])).collect()] == [1]


def test_runs_level_up_and_are_taken_on(spark, tmp_path):
    path, seen = str(tmp_path / "runs"), set()
    for i in range(5):
        keys = {(x, -x) for x in range(i * 7, i * 7 + 20)}
        runs = LineRuns(spark, path, fanout=2)  # opened anew each time
        frame = spark.createDataFrame([(a, b, 1) for a, b in keys], "h1 long, h2 long, first long")
        fresh = {(r.h1, r.h2) for r in runs.add(frame).collect()}
        assert fresh == keys - seen
        seen |= keys
        runs.compact()
        levels = [level for level, _, _ in runs.runs]
        assert sorted(levels) == sorted(bit for bit in range(3) if (i + 1) >> bit & 1)  # a binary counter
    assert runs.unseen(frame).count() == 0
    plan = runs.unseen(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the runs aren't shuffled


def test_a_second_corpus_meets_the_first(spark, tmp_path):
    path = str(tmp_path / "kept")
    line_runs.dedup(docs(spark, [(50, "a line of the first corpus")]), path=path).count()
    got = line_runs.dedup(docs(spark, [(1, "a line of the first corpus\nand a new line there")]), path=path).collect()
    assert [(r.n_dropped, r.text) for r in got] == [(1, "and a new line there")]
