"""Extraction: typed facts from text, each with the place it stands in."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.email import find_emails
from ..functions.money import CONTEXT, classify_amount, factor, figures, guess_currency, is_cumulative, is_plain, lookup, resolve_currency, sentence_at, to_decimal
from ..functions.people import people
from ..functions.places import country_from_demonym, is_united_states, us_signals
from ..functions.text import alternation, collapse, normalise_domain, normalise_name, sentences
from ..functions.tokens import any_of, near
from ..session import ship
from ..shared import cut
from ..vocab import FX, FX_DATE, PLATFORM_TERMS, QUALIFYING_TYPES, SECTOR_KEYWORDS

#: Words that a promising snippet has.
FOUNDER_WORDS = ["co-founder", "cofounder", "founder", "ceo"]
PRODUCT_WORDS = "platform software app saas marketplace api technology tech startup solution tool system".split()

_NAMED = lambda x: F.coalesce(x, F.lit(""))


def _figures(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, raw, before, sign, number, multiplier, after, context, body, sentence, start, end of every figure with a currency.

    No built-in gives the places of all matches, so a small helper reads them, batch by batch, from the texts that have
    a digit."""
    kind = texts.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.StringType()) for c in ("raw", "before", "sign", "number", "multiplier", "after", "context", "body", "sentence")), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    ship(texts.sparkSession)
    around = CONTEXT

    def read(batches):
        for batch in batches:
            rows = {f.name: [] for f in schema}
            for i, body in enumerate(batch.column(1).to_pylist()):
                first = True
                for start, end, *parts in figures(body):
                    # the whole text goes with its first figure only
                    one = (batch.column(0)[i].as_py(), body[start:end], *parts, body[max(0, start - around) : end + around], body if first else None, sentence_at(body, start, end), start, end)
                    first = False
                    for values, v in zip(rows.values(), one):
                        values.append(v)
            fields = [batch.column(0).type, *[pa.string()] * 9, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), fields)], names=list(rows))

    likely = F.col(text).rlike(r"\d")
    return texts.where(likely).select(key, text).mapInArrow(read, schema)


def amounts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a money figure of (key, text): raw, amount_original, currency, amount_usd, fx_rate, fx_date, amount_type,
    is_cumulative, context, sentence, start, end. Figures without a currency, or below 1000 without a multiplier, are no rows.

    A bare dollar or a word that several countries share is read by the places named around it, else in the whole text."""
    value = to_decimal(F.col("number"))
    scaled = F.when(F.col("multiplier").isNotNull(), (value * factor(F.col("multiplier"))).cast("decimal(38,6)")).when(value >= 1000, value.cast("decimal(38,6)"))
    found = cut(_figures(texts, key, text), "figures")
    whole = found.where("body is not null").select(key, guess_currency(F.col("body")).alias("_of_text")).where("_of_text is not null").groupBy(key).agg(F.first("_of_text").alias("_of_text"))
    typed = found.drop("body").withColumn("amount_original", scaled).where(F.col("amount_original") > 0).withColumn("_near", F.when(~is_plain(F.col("sign"), F.col("before"), F.col("after")), guess_currency(F.col("context")))).join(whole, key, "left")
    placed = typed.withColumn("_guess", F.coalesce("_near", "_of_text"))
    priced = placed.withColumn("currency", resolve_currency(F.col("sign"), F.col("before"), F.col("after"), F.col("_guess"))).withColumn("fx_rate", lookup(FX, F.col("currency")).cast("decimal(20,8)")).where(F.col("fx_rate").isNotNull())
    once = priced.withColumn("_slot", F.floor(F.col("start") / 40)).groupBy(key, "currency", "amount_original", "_slot").agg(F.min_by(F.struct("raw", "fx_rate", "context", "sentence", "start", "end"), "start").alias("r"))
    return once.select(
        key, F.trim("r.raw").alias("raw"), "amount_original", "currency", (F.col("amount_original") * F.col("r.fx_rate")).cast("decimal(38,6)").alias("amount_usd"), "r.fx_rate", F.lit(FX_DATE).cast("date").alias("fx_date"),
        classify_amount(F.col("r.context")).alias("amount_type"), is_cumulative(F.col("r.context")).alias("is_cumulative"), collapse(F.col("r.context")).alias("context"), "r.sentence", "r.start", "r.end",
    )


def emails(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq, address."""
    likely = F.col(text).rlike(r"(?i)@|\[\s*at\s*\]|\(\s*at\s*\)|&#64;|&#x40;|\{at\}|\s+dot\s+")
    return texts.where(likely).select(key, F.posexplode(find_emails(F.col(text))).alias("seq", "address"))


def persons(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq, name, title: the first statement of each person's name in a text."""
    rows = texts.select(key, F.posexplode(people(F.col(text))).alias("seq", "p"))
    once = rows.groupBy(key, F.lower("p.name").alias("k")).agg(F.min_by(F.struct("p.name", "p.title"), "seq").alias("p"), F.min("seq").alias("seq"))
    return once.select(key, "seq", "p.name", "p.title")


def presence(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind: signs of a presence in the United States."""
    return texts.select(key, F.explode(us_signals(F.col(text))).alias("kind"))


def quotes(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq, sentence."""
    return texts.select(key, F.posexplode(sentences(_NAMED(F.col(text)))).alias("seq", "sentence"))


def description(text: Column, least: int = 40) -> Column:
    """The first sentence of at least that many characters, up to 400."""
    return F.substring(F.try_element_at(F.filter(sentences(_NAMED(text)), lambda s: F.length(s) >= least), F.lit(1)), 1, 400)


def platform_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_NAMED(text)), F.lit(rf"\b({alternation(sorted(PLATFORM_TERMS, key=len, reverse=True))})\b"), 1))


def leading_name(text: Column, most: int = 4) -> Column:
    """The words at the beginning of a text that begin with a capital or a digit, at most so many."""
    words = F.slice(F.split(F.trim(text), r"\s+"), 1, most)
    run = F.aggregate(words, F.struct(F.lit("").alias("name"), F.lit(True).alias("on")), lambda a, w: F.when(
        a["on"] & w.rlike(r"^[\p{Lu}\p{N}]"),
        F.struct(F.concat_ws(" ", F.nullif(a["name"], F.lit("")), F.regexp_replace(w, r"[,;:.!?]+$", "")).alias("name"), (~w.rlike(r"[,;:.!?]$")).alias("on")),
    ).otherwise(F.struct(a["name"].alias("name"), F.lit(False).alias("on"))))
    return run["name"]


def keys_of(rows: DataFrame, name: str = "name", domain: str = "domain") -> DataFrame:
    """rows with dedup_key: the domain where there is one, else the name."""
    return rows.withColumn("dedup_key", F.coalesce(normalise_domain(F.col(domain)), normalise_name(F.col(name))))


def sector(text: Column) -> Column:
    """struct<sector, hits> with the most different keywords in a text; of equal ones the first listed; null without any."""
    low = F.lower(_NAMED(text))
    scored = []
    for i, (name, words) in enumerate(SECTOR_KEYWORDS.items()):
        hits = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(rf"({alternation(words.split('|'))})"), 1)))
        scored.append(F.struct(hits.alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("sector")))
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, F.struct(best["sector"].alias("sector"), best["hits"].alias("hits")))


def promise(candidates: DataFrame, lo: float, hi: float) -> DataFrame:
    """candidates (seq, snippet, domain, source_kind) with promise and hopeless: what the snippet that found a company shows.

    3 for a figure in the band (a figure outside is hopeless, and so is a company in the United States), 1.5 for a named
    founder or 0.4 for the word, 1 for another country, 0.5 each for a platform's words, a domain and a headline."""
    found = amounts(candidates, "seq", "snippet").where(F.col("amount_type").isin(QUALIFYING_TYPES))
    usd = F.col("amount_usd").cast("double")
    band = found.groupBy("seq").agg(F.max(usd.between(lo, hi)).alias("_in"))
    text = _NAMED(F.col("snippet"))
    person, office = r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+", f"(?i:{any_of(FOUNDER_WORDS)})"
    named = text.rlike(near(person, office, 6)) | text.rlike(near(office, person, 6))
    role = text.rlike(rf"(?i)\b{any_of([*FOUNDER_WORDS, 'chief executive', 'managing director'])}\b")
    country = country_from_demonym(text)
    met = candidates.join(band, "seq", "left").withColumn("_country", country)
    hopeless = F.when(F.col("_in") == False, "its figure is outside the band").when(is_united_states(F.col("_country")), "a company of the United States")  # noqa: E712
    worth = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0.0)
    total = (
        worth(F.col("_in"), 3.0) + F.when(named, 1.5).when(role, 0.4).otherwise(0.0) + worth(F.col("_country").isNotNull(), 1.0)
        + worth(text.rlike(rf"(?i)\b{any_of(PRODUCT_WORDS)}\b"), 0.5)
        + worth(F.col("domain").isNotNull(), 0.5) + worth(F.col("source_kind") == "headline", 0.5)
    )
    return met.withColumn("hopeless", F.when(text != "", hopeless)).withColumn("promise", F.when((text == "") | F.col("hopeless").isNotNull(), 0.0).otherwise(total)).drop("_in", "_country")
