"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its evidence is its own surface statistics and those of the lines before and after it;
neighbouring labels are tied by transition weights. Forward-backward gives each line's marginal, and the
marginals, weighted by line length, give the document's score after a two-parameter calibration.

The model is fitted on the driver from a bounded sample of labelled documents: at most `limit`, chosen by a hash, taken
whole as long as they have at most `lines` lines together; all lines take the document's label. Scoring reads every whole
text, line by line, with forward and backward passes over all documents of a chunk at once.

Nulls: a null text scores as an empty one, a null doc_id stays a row. An empty text is one line of length 0 and
takes that line's marginal. Repeated rows give repeated rows; other columns are not read. Without labels of both
kinds the score is 0.5 everywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, label_sample, map_arrow, runs
from .textstats import DIGIT, LETTER, PUNCT, SYMBOL, UPPER, Chunk, utf8

N_OWN = 14


@dataclass
class Crf:
    weights: np.ndarray  # of the standardised features of a line and its neighbours, with a bias
    mean: np.ndarray
    scale: np.ndarray
    tie: np.ndarray  # log potentials of (label before, label): good-good, good-bad, bad-good, bad-bad as 2 x 2
    calibration: tuple[float, float]


def line_features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A row for each line of the chunk: N_OWN statistics of the line, of the line before and of the line after
    (0 beyond the ends of a text); and the lines' lengths in code points of words."""
    w_line = np.searchsorted(c.l_start, c.w_start, "right") - 1
    lines = len(c.l_start)
    words = np.bincount(w_line, minlength=lines).astype(float)
    chars = c.per_line(c.code_points).astype(float)
    letters = np.maximum(c.per_line(LETTER[c.buf]), 1)
    repeated = np.zeros(len(c.w_id), bool)
    repeated[1:] = (c.w_id[1:] == c.w_id[:-1]) & (c.w_doc[1:] == c.w_doc[:-1])
    starts_upper = UPPER[c.buf[c.w_start]]
    per_word = np.maximum(words, 1)
    share = lambda mask: np.bincount(w_line[mask], minlength=lines) / per_word
    bytes_of = lambda lut: c.per_line(lut[c.buf])
    own = np.column_stack([
        np.log1p(words),
        chars / per_word,
        bytes_of(SYMBOL) / per_word,
        np.minimum(bytes_of(SYMBOL), 3),
        c.per_line(c.buf == ord("!")) / per_word,
        bytes_of(UPPER) / letters,
        bytes_of(DIGIT) / np.maximum(chars, 1),
        bytes_of(PUNCT) / per_word,
        share(repeated),
        share(c.repeated_words),
        share(starts_upper),
        c.duplicate_lines.astype(float),
        (words == 0).astype(float),
        PUNCT[c.buf[np.maximum(c.l_end - 1, 0)]].astype(float),
    ]).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = (c.l_doc[1:] == c.l_doc[:-1])[:, None]
    before[1:] = own[:-1] * same
    after[:-1] = own[1:] * same
    return np.hstack([own, before, after]), chars


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, step) of lines that follow each other document by document."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _sum_exp(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


#: Documents that must still have lines for a step to be taken by array operations; fewer go on line by line.
WIDE = 8


def forward_backward(emit: np.ndarray, lengths: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good per line, log partition per document, and expected transition counts.

    emit: log potential of good (bad has 0) for each line, documents one after another. Documents advance together, the
    longest first; messages lie step by step in flat arrays, one number a line, whatever the lengths."""
    doc, step = _steps(lengths)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    sizes = lengths[order]
    alive = np.bincount(step)  # documents with more than t lines
    off = np.cumsum(alive) - alive
    wide = int(np.searchsorted(-alive, -WIDE, "right"))  # steps with at least WIDE documents
    at = off[step] + rank[doc]
    e, g, b = np.empty(len(emit)), np.empty(len(emit)), np.zeros(len(emit))
    e[at] = emit
    g[: alive[0]] = e[: alive[0]]
    (gg, gb), (bg_, bb_) = tie.tolist()  # from good to good, to bad; from bad to good, to bad
    tails = range(int(alive[wide]) if wide < len(alive) else 0)
    for t in range(1, wide):
        p, c = slice(off[t - 1], off[t - 1] + alive[t]), slice(off[t], off[t] + alive[t])
        g[c] = np.logaddexp(g[p] + gg, b[p] + bg_) + e[c]
        b[c] = np.logaddexp(g[p] + gb, b[p] + bb_)
    for r in tails:
        where = off[wide : sizes[r]] + r
        x, y = (g[off[wide - 1] + r], b[off[wide - 1] + r]) if wide else (0.0, 0.0)
        own_g, own_b = [], []
        for t, z in enumerate(e[where].tolist(), wide):
            x, y = (_sum_exp(x + gg, y + bg_) + z, _sum_exp(x + gb, y + bb_)) if t else (z, 0.0)
            own_g.append(x)
            own_b.append(y)
        g[where], b[where] = own_g, own_b
    last = off[sizes - 1] + np.arange(len(sizes))
    log_z = np.logaddexp(g[last], b[last])
    after_g, after_b = np.zeros(len(emit)), np.zeros(len(emit))
    for r in tails:
        where = off[max(wide - 1, 0) : sizes[r]] + r
        x = y = 0.0
        own_g, own_b = [x], [y]
        for z in e[where[:0:-1]].tolist():
            x, y = _sum_exp(gg + z + x, gb + y), _sum_exp(bg_ + z + x, bb_ + y)
            own_g.append(x)
            own_b.append(y)
        after_g[where], after_b[where] = own_g[::-1], own_b[::-1]
    for t in range(wide - 1, 0, -1):
        p, c = slice(off[t - 1], off[t - 1] + alive[t]), slice(off[t], off[t] + alive[t])
        to_g, to_b = e[c] + after_g[c], after_b[c]
        after_g[p] = np.logaddexp(gg + to_g, gb + to_b)
        after_b[p] = np.logaddexp(bg_ + to_g, bb_ + to_b)
    inner = np.flatnonzero(step > 0)
    c, p, z = at[inner], off[step[inner] - 1] + rank[doc[inner]], log_z[rank[doc[inner]]]
    pairs = np.array([[np.exp(a[p] + tie[i, j] + to - z).sum() for j, to in enumerate((e[c] + after_g[c], after_b[c]))] for i, a in enumerate((g, b))])
    good = np.exp(g[at] + after_g[at] - log_z[rank[doc]])
    return np.clip(good, 0, 1), log_z[rank], pairs


def fit(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, chars: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam. features: lines of all documents one after another; labels: by document, 1 good."""
    mean, scale = features.mean(0), features.std(0) + 1e-3
    x = np.hstack([np.clip((features - mean) / scale, -6, 6), np.ones((len(features), 1))])
    y = np.repeat(labels, lengths).astype(float)
    doc, _ = _steps(lengths)
    # a document counts once however many lines it has, and both labels together count the same
    weight = 1 / np.maximum(np.bincount(labels, minlength=2), 1)
    tie, w = np.zeros((2, 2)), np.zeros(x.shape[1])
    seen = np.zeros((2, 2))
    inner = lengths - 1
    seen[0, 0], seen[1, 1] = (inner * weight[1])[labels == 1].sum(), (inner * weight[0])[labels == 0].sum()
    groups = [labels == 1, labels == 0]
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for i in range(1, steps + 1):
        grad_w, grad_tie = np.zeros_like(w), seen.copy()
        for label, group in zip((1, 0), groups):
            rows = group[doc]
            p, _, pairs = forward_backward(x[rows] @ w, lengths[group], tie)
            grad_w += weight[label] * (x[rows].T @ (y[rows] - p))
            grad_tie -= weight[label] * pairs
        grad = np.concatenate([grad_w - ridge * w, (grad_tie - ridge * tie).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w += move[:-4]
        tie += move[-4:].reshape(2, 2)
    model = Crf(w, mean, scale, tie, (1.0, 0.0))
    raw = _logit(_aggregate(model, features, lengths, chars))
    model.calibration = _calibrate(raw, labels)
    return model


def _aggregate(model: Crf, features: np.ndarray, lengths: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Marginals of good, averaged over a document's lines by length; evenly where it has no word."""
    emit = np.clip((features - model.mean) / model.scale, -6, 6) @ model.weights[:-1] + model.weights[-1]
    good, _, _ = forward_backward(emit, lengths, model.tie)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(doc, chars, minlength=len(lengths))
    by_length = np.bincount(doc, good * chars, minlength=len(lengths)) / np.maximum(total, 1)
    return np.where(total > 0, by_length, np.bincount(doc, good, minlength=len(lengths)) / lengths)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _calibrate(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from raw scores to labels, by ridged Newton steps; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = _sigmoid(a * raw + b)
        s = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((labels - p) * raw).sum() - 0.1 * a, (labels - p).sum()])
        h = np.array([[(s * raw * raw).sum() + 0.1, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = float(np.clip(a + d[0], 0.05, 20)), float(np.clip(b + d[1], -20, 20))
    return a, b


def train(docs: DataFrame, labels: DataFrame, *, fold: int = 2, folds: int = 4, limit: int = 3000, lines: int = 150_000) -> Crf | None:
    """Fits on at most limit labelled documents outside the held-out fold, with at most lines lines together."""
    sample = docs.select("doc_id", "text").join(F.broadcast(label_sample(labels, "quality", fold, folds, limit)), "doc_id")  # at most limit rows of two integers
    counted = sample.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]", "")) + 1).alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    room, taken = lines, []
    for r in sorted(counted, key=lambda r: (r.h, r.doc_id)):
        if r.n <= room:
            room -= r.n
            taken.append((r.doc_id,))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long"))

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(2))
        features, chars_of = [], []
        for lo, hi in runs([len(t) for t in texts]):
            c = Chunk(texts[lo:hi])
            x, chars = line_features(c)
            edges = np.cumsum(np.bincount(c.l_doc, minlength=c.n))[:-1]
            features += [part.tobytes() for part in np.split(x, edges)]
            chars_of += [part.tobytes() for part in np.split(chars, edges)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.binary()), pa.array(chars_of, pa.binary())], names=["doc_id", "label", "features", "chars"])

    rows = map_arrow(sample.join(chosen, "doc_id").select("doc_id", "label", "text"), gather, "doc_id long, label int, features binary, chars binary").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, bytes(r.features)))
    if len({r.label for r in rows}) < 2:
        return None
    x = [np.frombuffer(r.features, np.float32).reshape(-1, 3 * N_OWN) for r in rows]
    chars = np.concatenate([np.frombuffer(r.chars, np.float64) for r in rows])
    return fit(np.concatenate(x), np.array([len(m) for m in x]), np.array([r.label for r in rows]), chars)


def score(docs: DataFrame, model: Crf | None, *, fold: int = 2, folds: int = 4, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines and bad_chars (code points on lines more likely bad) of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(2))
        out = np.full(len(texts), 0.5)
        n_lines, bad = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for lo, hi in runs([len(t) for t in texts]):
            c = Chunk(texts[lo:hi])
            x, chars = line_features(c)
            lengths = np.bincount(c.l_doc, minlength=c.n)
            n_lines[lo:hi] = lengths
            if model is not None:
                emit = np.clip((x - model.mean) / model.scale, -6, 6) @ model.weights[:-1] + model.weights[-1]
                good, _, _ = forward_backward(emit, lengths, model.tie)
                total = np.bincount(c.l_doc, chars, minlength=c.n)
                by_length = np.bincount(c.l_doc, good * chars, minlength=c.n) / np.maximum(total, 1)
                p = np.where(total > 0, by_length, np.bincount(c.l_doc, good, minlength=c.n) / lengths)
                out[lo:hi] = _sigmoid(model.calibration[0] * _logit(p) + model.calibration[1])
                bad[lo:hi] = np.bincount(c.l_doc, chars * (good < 0.5), minlength=c.n)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array(n_lines), pa.array(bad)], names=["doc_id", "held_out", "score", "n_lines", "bad_chars"])

    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), folds) == fold).alias("held_out"), "text")
    done = map_arrow(rows, run, "doc_id long, held_out boolean, score double, n_lines long, bad_chars long")
    return done.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", "bad_chars")
