"""Grounding: whether a quote stands in its source, exactly or as a long run of the same words.

A quote of n words is found approximately if a run of at least 6 of its words, and at least 0.65 n, stands in the source in
the same order. Such a run shares a 6-word shingle, so sources and quotes meet on hashes of shingles, and runs are the
unbroken stretches of shared shingles on one diagonal. A quote of fewer than 8 words can stand in a source without a
whole shingle (its first and last word may be parts of the source's words); it meets sources on an anchor: its longest
inner word, of two words or one the first five letters of the longer, wherever they stand in a word.

Texts never meet pairwise. A run that is as long as its quote proves it; only quotes of which a run lacks one or two words
at the ends, and short ones, are looked up in the text, all candidates of a source together (in `PARTS` lists, so that no
list holds all of a source's). Nothing is collected and no number of quotes is too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalise_quote, tokens
from ..shared import cut, growing

MIN_CHARS, MIN_RUN, MIN_SHARE = 12, 6, 0.65
#: Letters of an anchor inside a word.
ANCHOR = 5
#: Lists that the candidates of a source are dealt to.
PARTS = 16


def contains_quote(quote: Column, source: Column) -> Column:
    q = normalise_quote(quote)
    return F.coalesce((F.length(F.trim(quote)) >= MIN_CHARS) & (q != "") & F.contains(normalise_quote(source), q), F.lit(False))


def _words(text: str) -> Column:
    return tokens(F.col(text))


def _shingles(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, pos, shingle of every run of n words of column t: a hash of the hashes of its words."""
    hashed = rows.select(*keys, F.transform("t", lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") >= n)
    grams = F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(n)]))
    return hashed.select(*keys, F.posexplode(grams).alias("pos", "shingle"))


def _runs(sources: DataFrame, quotes: DataFrame, within: list[str], n: int) -> DataFrame:
    """source_id, quote_id, run of every pair (of equal `within`) that has a common run of n words or more. Both have words t."""
    q = _shingles(quotes, [*within, "quote_id"], n).withColumnRenamed("pos", "q_pos")
    q = growing(q) if within else q
    met = _shingles(sources, [*within, "source_id"], n).join(q, [*within, "shingle"]).select("source_id", "quote_id", "pos", (F.col("pos") - F.col("q_pos")).alias("diagonal"))
    line = Window.partitionBy("source_id", "quote_id", "diagonal").orderBy("pos")
    islands = met.distinct().withColumn("island", F.col("pos") - F.row_number().over(line))
    stretches = islands.groupBy("source_id", "quote_id", "diagonal", "island").agg(F.count("*").alias("k"))
    return stretches.groupBy("source_id", "quote_id").agg((F.max("k") + n - 1).cast("long").alias("run"))


def longest_runs(sources: DataFrame, quotes: DataFrame, *, n: int = MIN_RUN) -> DataFrame:
    """source_id, quote_id, run: longest run of common words of every pair that has one of n words or more.

    sources (source_id, text), quotes (quote_id, quote)."""
    return _runs(sources.select("source_id", _words("text").alias("t")), quotes.select("quote_id", _words("quote").alias("t")), [], n)


def _longest(words: Column) -> Column:
    return F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]


def _near(sources: DataFrame, short: DataFrame, within: list[str]) -> DataFrame:
    """source_id, quote_id of the short quotes whose anchor a source has."""
    inner = F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(0)))
    word = _longest(F.col("t"))
    kind = F.when(F.size("t") > 2, "word").when(F.length(word) >= ANCHOR, "part").otherwise("letter")
    anchor = F.when(F.size("t") > 2, _longest(inner)).when(F.length(word) >= ANCHOR, F.substring(word, 1, ANCHOR)).otherwise(F.substring(word, 1, 1))
    anchors = short.select(*within, "quote_id", kind.alias("kind"), F.xxhash64(anchor).alias("key"))
    here = F.col("t")
    parts = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - ANCHOR + 1), lambda i: F.substr(w, i, F.lit(ANCHOR)))
    keys = {
        "word": here, "part": F.flatten(F.transform(F.filter(here, lambda w: F.length(w) >= ANCHOR), parts)), "letter": F.flatten(F.transform(here, lambda w: F.filter(F.split(w, ""), lambda c: c != ""))),
    }
    kinds = {r.kind for r in anchors.select("kind").distinct().collect()}  # three at most
    found = None
    for k in sorted(kinds):
        own = sources.select(*within, "source_id", F.explode(F.array_distinct(F.transform(keys[k], lambda w: F.xxhash64(w)))).alias("key"))
        asked = anchors.where(F.col("kind") == k)
        met = own.join(growing(asked) if within else asked, [*within, "key"]).select("source_id", "quote_id")
        found = met if found is None else found.unionAll(met)
    return sources.select("source_id").join(anchors.select("quote_id"), F.lit(False)) if found is None else found


def _written(sources: DataFrame, pairs: DataFrame, quotes: DataFrame, within: list[str]) -> DataFrame:
    """source_id, quote_id of the pairs whose quote (column q) stands in the text (column s): each text meets lists of quotes."""
    asked = growing(quotes.select("quote_id", "q")) if within else quotes.select("quote_id", "q")
    listed = pairs.join(asked, "quote_id").groupBy("source_id", F.pmod(F.xxhash64("quote_id"), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("quote_id", "q")).alias("asked"))
    met = sources.select("source_id", "s").join(growing(listed) if within else listed, "source_id")
    return met.select("source_id", F.explode(F.filter("asked", lambda x: F.contains(F.col("s"), x["q"]))).alias("x")).select("source_id", "x.quote_id")


def find_quotes(sources: DataFrame, quotes: DataFrame, within: list[str] | None = None) -> DataFrame:
    """source_id, quote_id, mode (exact or approximate), run, words of the quotes (quote_id, quote) that stand in a source
    (source_id, text). With columns `within`, only sources and quotes of equal values there meet."""
    within = within or []
    sized = quotes.select(*within, "quote_id", "quote", _words("quote").alias("t"), normalise_quote(F.col("quote")).alias("q")).where((F.length(F.trim("quote")) >= MIN_CHARS) & (F.col("q") != ""))
    sized = sized.withColumn("words", F.size("t").cast("long"))
    s = sources.select(*within, "source_id", normalise_quote(F.col("text")).alias("s"))
    s = s if within else cut(s, "folded")  # read by the shingles, the anchors and the look-up
    s = s.withColumn("t", F.filter(F.split("s", " "), lambda w: w != ""))
    sizes = growing(sized.select("quote_id", "words")) if within else sized.select("quote_id", "words")
    runs = _runs(s, sized, within, MIN_RUN).join(sizes, "quote_id")
    short = sized.where("words < 8")
    unsure = runs.where("words >= 8 and run < words and run >= words - 2").select("source_id", "quote_id")
    written = _written(s, _near(s, short, within).unionByName(unsure.select("source_id", "quote_id")), sized, within).withColumn("written", F.lit(True))
    met = runs.drop("words").join(growing(written), ["source_id", "quote_id"], "full").join(sizes, "quote_id")
    exact = F.coalesce("written", F.lit(False)) | F.coalesce(F.col("run") >= F.col("words"), F.lit(False))
    mode = F.when(exact, "exact").when(F.col("run") / F.col("words") >= MIN_SHARE, "approximate")
    run = F.when(exact & (F.col("words") < 8), F.col("words")).otherwise(F.col("run"))
    return met.select("source_id", "quote_id", mode.alias("mode"), run.alias("run"), "words").where("mode is not null")


def ground_claims(claims: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of claims (company_id, claim_id, url, quote): a claim stays if one of its company's sources
    (company_id, seq, url, text) holds its quote; the cited source first, then the others by seq."""
    own = sources.select("company_id", "seq", F.col("url").alias("source_url"), "text", F.struct("company_id", "seq").alias("source_id"))
    found = find_quotes(own, claims.select("company_id", F.col("claim_id").alias("quote_id"), "quote"), ["company_id"])
    placed = found.withColumnRenamed("quote_id", "claim_id").join(growing(own.select("source_id", "seq", "source_url")), "source_id").join(growing(claims.select("claim_id", "url")), "claim_id")
    order = F.struct((~F.coalesce(F.col("source_url") == F.col("url"), F.lit(False))).cast("int"), "seq")
    best = placed.groupBy("claim_id").agg(F.min_by(F.struct("mode", F.col("source_url").alias("grounded_in")), order).alias("b"))
    kept = claims.join(growing(best.select("claim_id", "b.mode", "b.grounded_in")), "claim_id")
    return kept, claims.join(growing(best), "claim_id", "left_anti")
