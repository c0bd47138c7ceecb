"""Quality, toxicity and quality rules: held-out accuracy, edge cases, and forward-backward against enumeration."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from conftest import docs, words  # noqa: F401
from pyspark.sql import functions as F

from veritab.llm import decision_list, quality_crf, queries, toxicity
from veritab.llm.common import table

SF = "/root/testdata/sf0.01"


def auc(rows):
    good, bad = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 4, 2, 6])
    emit, tie = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    good, log_z, _ = quality_crf.forward_backward(emit, lengths, tie)
    at = 0
    for d, n in enumerate(lengths):
        total, marginal = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):  # 0 good, 1 bad
            e = sum(emit[at + t] for t in range(n) if labels[t] == 0) + sum(tie[a, b] for a, b in zip(labels, labels[1:]))
            total += np.exp(e)
            marginal += np.exp(e) * (np.array(labels) == 0)
        assert log_z[d] == pytest.approx(np.log(total))
        assert good[at : at + n] == pytest.approx(marginal / total)
        at += n


@pytest.mark.parametrize("query, label, least", [("op1_quality_crf", "quality", 0.9), ("op2_toxicity_lexicon", "toxic", 0.9)])
def test_held_out_rows(spark, query, label, least):
    out = queries.QUERIES[query](spark, SF)
    rows = out.join(table(spark, SF, "labels"), "doc_id").where("held_out").select("score", label).collect()
    assert auc([tuple(r) for r in rows]) >= least
    everything = out.collect()
    assert len(everything) == table(spark, SF, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in everything)


EDGES = [(1, None), (2, ""), (3, "\n\n"), (None, "a text"), (4, "x" * 300_000), (5, "one two\n" * 20_000), (6, "a"), (6, "a")]


def test_scores_of_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = EDGES + [(i, "plain words here " * 20 if i % 2 else "### $$$ vileword " * 20) for i in range(10, 40)]
    for train, score in ((quality_crf.train, quality_crf.score), (toxicity.learn, toxicity.score)):
        out = score(docs(spark, rows), train(docs(spark, rows), labels)).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        assert score(docs(spark, EDGES), train(docs(spark, EDGES), labels.limit(0))).count() == len(EDGES)
        assert score(docs(spark, []), train(docs(spark, []), labels)).count() == 0


def test_folding_and_exceptions():
    lex = toxicity.Lexicon({toxicity.WORD + w + toxicity.END: 1.0 for w in ("".join(toxicity.words_of([x])[0]) for x in ("idiot", "trash"))}, (0, 0, 0, 0))
    m = toxicity.Matcher(lex)
    texts = ["an idiot", "an 1d10t", "an іdіоt", "an i​diot", "IDIOT!", "idiotic", "a trash can", "pure trash", "", "ｉｄｉｏｔ"]
    assert m.sums(texts)[0].tolist() == [1, 1, 1, 1, 1, 0, 0, 1, 0, 1]


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    rep = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines, before, dup = (t or "").split("\n"), set(), 0
    for x in lines:
        dup += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in before
        before.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(rep)


def test_statistics_equal_brute_force(spark, rng):
    rows = EDGES + [(100 + i, "".join(rng.choice("ab é#$\n\n\t  \x0b\x1fcd") for _ in range(rng.randint(0, 200)))) for i in range(60)]
    got = sorted((r.doc_id or -1, *(r[c] for c in decision_list.COUNTS)) for r in decision_list.statistics(docs(spark, rows)).collect())
    assert got == sorted((i or -1, *brute_counts(t)) for i, t in rows)


def test_rules(spark, rng):
    good = [(i, ". ".join(words(rng, 10) for _ in range(12))) for i in range(60)]
    bad = [(100 + i, " ".join("### " + words(rng, 2) for _ in range(40))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int")
    rules = decision_list.learn(decision_list.labelled_statistics(docs(spark, good + bad), labels))
    assert rules and all(r.precision >= 0.9 for r in rules)
    kept = decision_list.keep_good(docs(spark, good + bad + EDGES), rules)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in good]
    assert kept.columns == docs(spark, []).columns
    out = {r.doc_id: r for r in decision_list.apply(docs(spark, EDGES), []).collect()}
    assert out[1].base_failed and out[5].base_failed and not out[1].kept
    assert decision_list.learn(decision_list.labelled_statistics(docs(spark, good), labels.limit(0))) == []
    assert decision_list.keep_good(docs(spark, []), rules).count() == 0


def test_rule_query(spark):
    out = queries.QUERIES["op8_decision_list"](spark, SF)
    rows = out.join(table(spark, SF, "labels"), "doc_id").where(~F.col("base_failed")).select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.85 * len(rows)


def test_colliding_lines_are_different_lines(spark, thue_morse):
    a, b = thue_morse(1024)
    got = decision_list.statistics(docs(spark, [(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{a}\n\n")])).collect()
    assert {r.doc_id: r.n_dup_lines for r in got} == {1: 0, 2: 1}


def test_one_very_long_text_beside_short_ones():
    """Messages lie in flat arrays: the longest text doesn't size what the short ones take."""
    rng = np.random.default_rng(7)
    lengths = np.array([20_000, *[3] * 300])
    emit, tie = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    together, log_z, pairs = quality_crf.forward_backward(emit, lengths, tie)
    first, z0, p0 = quality_crf.forward_backward(emit[:20_000], lengths[:1], tie)
    rest, z1, p1 = quality_crf.forward_backward(emit[20_000:], lengths[1:], tie)
    assert np.allclose(together, np.concatenate([first, rest])) and np.allclose(log_z, np.concatenate([z0, z1])) and np.allclose(pairs, p0 + p1)


def test_columns_of_the_contract_come_first(spark):
    for score in (quality_crf.score(docs(spark, EDGES), None), toxicity.score(docs(spark, EDGES), toxicity.Lexicon({}, (0.0, 0.0, 0.0, -50.0)))):
        assert score.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
