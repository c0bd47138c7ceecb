"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text and normalised by length.

Folding undoes NFKC forms, zero-width characters, look-alike letters of other scripts and digits or signs that
stand for letters, and lower-cases; texts and lexicon go through the same fold. An entry is a whole word or a word
beginning; each word counts its heaviest entry once. Words inside an exception phrase don't count. The sum of
weights, that sum per hundred words and the text's length then enter a logistic curve.

`learn` finds entries whose share of toxic documents is far above the others': prefix and word counts are summed
in Spark over at most `limit` labelled documents outside the held-out fold, which also fit the curve. Scoring reads
every whole text.

Nulls: a null text scores as an empty one (no entry, so the curve's lowest score), a null doc_id stays a row.
Repeated rows give repeated rows; other columns are not read. Without labels of both kinds the lexicon is empty and
every score is 0.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, label_sample, map_arrow, runs

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ꜱ": "s", "ᴏ": "o", "ᴜ": "u", "ᴛ": "t", "ᴀ": "a", "ᴇ": "e", "ᴄ": "c", "ᴅ": "d", "ᴋ": "k", "ᴍ": "m", "ᴘ": "p", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}
#: Digits and signs that stand for letters inside a word. i and l share one form, as 1 stands for both.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "€": "e", "£": "i", "¡": "i", "|": "i"}
ONE_FORM = {"l": "i"}
HIDDEN = "­͏​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "class clown", "clown fish", "pond scum", "sore loser rule", "stupid simple", "pathetic fallacy")

WORD, END = "\x01", "\x02"  # marks before and after each word in matched text
MIN_PREFIX, MAX_PREFIX = 3, 8


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its folded form (0 hidden), whether it makes part of a word, and the letter a sign stands for."""
    to = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    word = np.zeros(len(to), bool)
    for i in range(len(to)):
        ch = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        base = unicodedata.normalize("NFKC", ch) if i > 127 else ch
        low = (base if len(base) == 1 else ch).lower()
        low = LOOKALIKES.get(low, low)
        low = ONE_FORM.get(low, STAND_INS.get(low, low))
        to[i] = ord(low) if len(low) == 1 else i
        word[i] = low.isalnum() or unicodedata.combining(ch) > 0
    for ch in HIDDEN:
        to[ord(ch)] = 0
    to[1] = to[2] = 32
    sign = np.zeros(len(to), np.uint32)
    for ch, letter in SIGNS.items():
        sign[ord(ch)] = ord(letter)
    return to, word, sign


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of the texts with a newline after each, the positions of word starts and of word ends."""
    to, word, sign = _tables()
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = raw[to[raw] != 0]
    stands = sign[raw] != 0
    if stands.any():
        # a sign is a letter only between letters or at a word's beginning
        inside = word[raw]
        follows = np.zeros(len(raw), bool)
        follows[:-1] = inside[1:]
        precedes = np.ones(len(raw), bool)
        precedes[1:] = inside[:-1] | (raw[:-1] == 32) | (raw[:-1] == 10)
        raw = np.where(stands & follows & precedes, sign[raw], raw)
    out = to[raw]
    inside = word[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return out, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of(texts: list[str]) -> list[list[str]]:
    code, starts, ends = fold(texts)
    line = code.tobytes().decode("utf-32-le", "surrogatepass")
    breaks = _doc_breaks(texts, code)
    out: list[list[str]] = [[] for _ in texts]
    doc = np.searchsorted(breaks, starts, "left")
    for d, s, e in zip(doc.tolist(), starts.tolist(), ends.tolist()):
        out[d].append(line[s:e])
    return out


def _doc_breaks(texts: list[str], code: np.ndarray) -> np.ndarray:
    """Positions of the newlines that end the texts."""
    lines = np.flatnonzero(code == 10)
    return lines[np.cumsum([t.count("\n") + 1 for t in texts]) - 1]


@dataclass
class Lexicon:
    entries: dict[str, float]  # with WORD before, and END after whole words
    curve: tuple[float, float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.entries.items():
            self.automaton.add_word(entry, (len(entry), weight, 0))
        for phrase in lexicon.exceptions:
            folded = [WORD + w + END for w in words_of([phrase])[0]]
            self.automaton.add_word(" ".join(folded), (len(" ".join(folded)), 0.0, len(folded)))
        self.usable = len(self.automaton) > 0
        if self.usable:
            self.automaton.make_automaton()

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight, number of hits and of words of each text."""
        code, starts, ends = fold(texts)
        doc = np.searchsorted(_doc_breaks(texts, code), starts, "left")
        n_words = np.bincount(doc, minlength=len(texts))
        best = np.zeros(len(starts))
        if self.usable and len(starts):
            marked = np.insert(code, np.concatenate([starts, ends]), np.concatenate([np.full(len(starts), 1, np.uint32), np.full(len(ends), 2, np.uint32)]))
            at = starts + 2 * np.arange(len(starts))  # positions of WORD marks
            line = marked.tobytes().decode("utf-32-le", "surrogatepass")
            hits = [(end - size + 1, weight, harmless) for end, (size, weight, harmless) in self.automaton.iter(line)]
            if hits:
                pos = np.searchsorted(at, [h[0] for h in hits])
                np.maximum.at(best, pos, [h[1] for h in hits])
                for i, h in zip(pos, hits):
                    if h[2]:
                        best[i : i + h[2]] = 0
        return np.bincount(doc, best, minlength=len(texts)), np.bincount(doc, best > 0, minlength=len(texts)), n_words


def curve_inputs(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1)), np.log1p(words), np.ones(len(words))])


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def learn(docs: DataFrame, labels: DataFrame, *, fold_out: int = 1, folds: int = 3, limit: int = 8000, min_docs: int = 4, min_lift: float = 6.0, max_entries: int = 3000) -> Lexicon:
    chosen = F.broadcast(label_sample(labels, "toxic", fold_out, folds, limit))  # at most limit rows of two integers
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "label", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, label = _texts(batch.column(2)), batch.column(1).to_pylist()
        toxic, every = Counter(), Counter()
        for lo, hi in runs([len(t) for t in texts]):
            for y, words in zip(label[lo:hi], words_of(texts[lo:hi])):
                found = set()
                for w in set(words):
                    found.add(WORD + w + END)
                    found.update(WORD + w[:k] for k in range(MIN_PREFIX, min(MAX_PREFIX, len(w)) + 1))
                every.update(found)
                if y:
                    toxic.update(found)
        keys = list(every)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([every[k] for k in keys], pa.int64())], names=["entry", "toxic", "every"])

    n1, n = rows.select(F.sum("label"), F.count("*")).first()
    if not n or not n1 or n1 == n:
        return Lexicon({}, (0.0, 0.0, 0.0, -50.0))
    n0 = n - n1
    counts = map_arrow(rows, count, "entry string, toxic long, every long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("every").alias("every"))
    lift = ((F.col("toxic") + 0.2) / (n1 + 0.4)) / ((F.col("every") - F.col("toxic") + 0.2) / (n0 + 0.4))
    best = counts.where(F.col("toxic") >= min_docs).withColumn("lift", lift).where(F.col("lift") >= min_lift).orderBy(F.desc(F.col("toxic") * F.log("lift")), "entry").limit(max_entries).collect()
    support = {r.entry: r.toxic for r in best}
    # of entries that extend each other with nearly the same documents, the most specific says it all
    vague = {e[:-1] for e, k in support.items() if k >= 0.95 * support.get(e[:-1], sys.maxsize)}
    lexicon = Lexicon({r.entry: float(np.log(r.lift)) for r in best if r.entry not in vague}, (0.0, 0.0, 0.0, -50.0))
    fitted = sums(rows, lexicon, ["doc_id", "label"]).toPandas().sort_values(["doc_id", "weight"])
    lexicon.curve = _fit_curve(curve_inputs(fitted["weight"].to_numpy(), fitted["n_words"].to_numpy()), fitted["label"].to_numpy())
    return lexicon


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Ridged logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + 0.3 * np.eye(len(w)), x.T @ (y - p) - 0.3 * w)
        w += np.clip(step, -5, 5)
    return tuple(float(v) for v in w)


def sums(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """keep, weight, n_hits and n_words for each row of docs."""
    rows = docs.select(*keep, F.col("text").alias("_body"))
    schema = rows.drop("_body").schema.add("weight", "double").add("n_hits", "long").add("n_words", "long")
    matchers: list[Matcher] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not matchers:
            matchers.append(Matcher(lexicon))
        texts = _texts(batch.column(len(keep)))
        weight, hits, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for lo, hi in runs([len(t) for t in texts]):
            weight[lo:hi], hits[lo:hi], words[lo:hi] = matchers[0].sums(texts[lo:hi])
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(weight), pa.array(hits), pa.array(words)], names=schema.names)

    return map_arrow(rows, run, schema)


def score(docs: DataFrame, lexicon: Lexicon, *, fold_out: int = 1, folds: int = 3, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, weight, n_hits, n_words of every document."""
    a, b, c, d = (F.lit(x) for x in lexicon.curve)
    found = sums(docs.select("doc_id", (crc_mod(F.col("doc_id"), folds) == fold_out).alias("held_out"), "text"), lexicon, ["doc_id", "held_out"])
    x = a * F.log1p("weight") + b * F.log1p(100 * F.col("weight") / F.greatest("n_words", F.lit(1))) + c * F.log1p("n_words") + d
    out = found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(50.0)), F.lit(-50.0)))))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight", "n_hits", "n_words")
