"""Quality rules: a learned decision list over text statistics.

`statistics` counts, per document, words and the signs of junk. `learn` grows ordered rules from labelled
statistics by sequential covering: each rule is a conjunction of thresholds grown on two thirds of the rows,
pruned on the other third, and kept while it is precise there. `verdict` turns the list into one Spark
conditional expression.

Nulls: a null text counts as an empty one, a null doc_id stays a row. Empty texts and texts under 50 words fail
the base rules. Repeated rows give repeated rows. Other columns are not read. Without labelled rows, or without a
precise rule, the list is empty and every document that passes the base rules is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import label_sample, map_arrow, runs
from .textstats import SYMBOL, Chunk, utf8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may test, as SQL over the counts.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The counts of COUNTS for each row of docs, beside the columns in keep (doc_id)."""
    keep = keep or ["doc_id"]
    own = docs.select(*keep, F.col("text").alias("_body"))
    schema = own.drop("_body").schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(len(keep)))
        out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
        for lo, hi in runs([len(t) for t in texts]):
            c = Chunk(texts[lo:hi])
            out["n_words"][lo:hi] = c.count_words()
            out["word_chars"][lo:hi] = c.per_doc(c.code_points)
            out["n_symbols"][lo:hi] = c.per_doc(SYMBOL[c.buf])
            out["n_dup_lines"][lo:hi] = np.bincount(c.l_doc[c.duplicate_lines], minlength=c.n)
            out["n_repeat_words"][lo:hi] = c.count_words(c.repeated_words)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(out[c]) for c in COUNTS)], names=[*keep, *COUNTS])

    return map_arrow(own, count, schema)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, '<=' or '>', threshold) holds."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.tests)


def learn(labelled: DataFrame, *, max_rules: int = 8, max_tests: int = 3, min_cover: int = 5, min_precision: float = 0.9) -> list[Rule]:
    """Rules that reject label 0, from (label, counts). labelled is gathered on the driver: give it a bounded sample."""
    rows = labelled.where(~base_failed()).select("label", *(F.expr(e).alias(f) for f, e in FEATURES.items())).toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    x, bad = rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy() == 0
    prune = np.arange(len(rows)) % 3 == 2
    left = np.ones(len(rows), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and (bad & left & ~prune).sum() >= min_cover:
        tests = _grow(x[left & ~prune], bad[left & ~prune], max_tests)
        tests = _prune(x[left & prune], bad[left & prune], tests)
        hit = _covers(x, tests) & left
        wrong = (hit & ~bad).sum()
        if not tests or (hit & bad).sum() < min_cover or (hit & bad).sum() < min_precision * hit.sum():
            break
        rules.append(Rule(tuple((list(FEATURES)[f], op, float(t)) for f, op, t in tests), round(float(1 - wrong / hit.sum()), 4), int(hit.sum())))
        left &= ~hit
    return rules


def _covers(x: np.ndarray, tests: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, t in tests:
        out &= x[:, f] <= t if op == "<=" else x[:, f] > t
    return out


def _grow(x: np.ndarray, bad: np.ndarray, max_tests: int) -> list[tuple[int, str, float]]:
    """Adds the test with the largest information gain over the rows still covered, until they are all bad."""
    tests: list[tuple[int, str, float]] = []
    on = np.ones(len(x), bool)
    while len(tests) < max_tests and on.any() and not bad[on].all():
        base, best = np.log2(max(bad[on].mean(), 1e-9)), (1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(x[on, f])
            if len(values) < 2:
                continue
            cuts = np.unique((values[1:] + values[:-1]) / 2)
            cuts = cuts[np.unique(np.linspace(0, len(cuts) - 1, 128).astype(int))] if len(cuts) > 128 else cuts
            order = np.sort(x[on & bad, f]), np.sort(x[on, f])
            below = np.searchsorted(order[0], cuts, "right"), np.searchsorted(order[1], cuts, "right")
            for op, p, n in (("<=", *below), (">", len(order[0]) - below[0], len(order[1]) - below[1])):
                gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(n, 1)) - base)
                if gain.max() > best[0]:
                    best = gain.max(), (f, op, cuts[gain.argmax()])
        if best[1] is None:
            break
        tests.append(best[1])
        on &= _covers(x, [best[1]])
    return tests


def _prune(x: np.ndarray, bad: np.ndarray, tests: list[tuple[int, str, float]]) -> list[tuple[int, str, float]]:
    """The leading tests with the best (bad - good) / covered on the pruning rows; the longest of equals."""

    def worth(k: int) -> tuple[float, int]:
        hit = _covers(x, tests[:k])
        return ((2 * (hit & bad).sum() - hit.sum()) / hit.sum() if hit.any() else -1.0, k)

    return tests[: max(range(1, len(tests) + 1), key=worth)] if tests else tests


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects; the rules are tested in their order."""
    out = None
    for r in rules:
        out = F.when(F.expr(r.sql()), False) if out is None else out.when(F.expr(r.sql()), False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled_statistics(docs: DataFrame, labels: DataFrame, limit: int = 12_000) -> DataFrame:
    """(label, counts) of at most limit labelled documents, chosen by a hash of doc_id."""
    # at most limit rows of two integers: broadcast
    chosen = F.broadcast(label_sample(labels, "quality", -1, 1, limit))
    return statistics(docs.select("doc_id", "text").join(chosen, "doc_id"), ["label"])


def apply(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """keep, the counts, base_failed and kept for each row of docs."""
    return statistics(docs, keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that pass, with their own columns, whatever these are called."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return apply(rows, rules, ["_row"]).where("kept").select("_row.*")
