"""Places that a text names, found by n-grams of its tokens in a gazetteer, and what the words around them say.

Tokens are looked up by hash, so a text costs its length whatever the number of places. `locations` reads a sentence:
the country it gives a company, and by which kind of statement (rung).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..vocab import (
    AMBIGUOUS_STATES, CITY_COUNTRY, COUNTRIES, DEMONYM_COUNTRY, LOCATING_CUES, SEAT_CUES, SECOND_LEVEL_COUNTRY, TLD_COUNTRY, US_AFTER, US_BEFORE, US_CITIES, US_NAMES, US_PRONOUN_AFTER,
    US_PRONOUN_BEFORE, US_SECOND_SIGNS, US_STATES,
)
from .companies import once
from .money import lookup
from .places import DESCRIBED_WITHIN, ORGANISATIONS, SEATED
from .tokens import any_of

#: How the United States are marked in the gazetteer, and a state whose name is also a country's.
US, STATE = "United States", "?"
#: Names in lower case with their country; of equal names the United States win.
PLACES: dict[str, str] = (
    CITY_COUNTRY | {c.lower(): c for c in COUNTRIES} | {n: US for n in [*US_STATES, *US_CITIES]} | {s: STATE for s in AMBIGUOUS_STATES}
    | {n: US for n in US_NAMES if n not in ("us", "u.s.", "u.s.a.", "america")} | {"america": US}
)
#: Which of two names found in one phrase counts: the United States, then countries, then cities.
_COUNTRY_NAMES = [c.lower() for c in COUNTRIES]
_MOST = max(len(n.split()) for n in [*PLACES, *DEMONYM_COUNTRY])
#: The mark of what was '-based' behind a name.
BASED = "#based"
_TOKEN = r"#based|[\p{L}\p{N}](?:[\p{L}\p{N}'’&.-]*[\p{L}\p{N}])?"


def tokens(text: Column) -> Column:
    """Words in lower case without signs around them; U.S. and U.S.A. are one word, 'X-based' is two."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)[-\x{2010}\x{2011}](?=(?:based|headquartered)\b)", " #")
    body = F.regexp_replace(body, r"(?i)#headquartered\b", BASED)
    body = F.regexp_replace(body, r"\bU\.\s?S\.(?:\s?A\.)?", " usa ")
    return F.transform(F.regexp_extract_all(F.lower(body), F.lit(_TOKEN), 0), lambda t: F.regexp_replace(t, r"['’]s$", ""))


def _grams(ts: Column, names: dict[str, str]) -> Column:
    """array<struct<at, n, name>> of the n-grams that are names."""
    first = sorted({n.split()[0] for n in names})
    starts = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: F.get(ts, i).isin(first))
    gram = lambda i, n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice(ts, i + 1, n), " ").alias("name"))
    sizes = F.sequence(F.lit(1), F.lit(_MOST))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda n: i + n <= F.size(ts)), lambda n: gram(i, n))))
    found = F.filter(grams, lambda g: lookup(names, g["name"]).isNotNull())  # few begin with a name's first word
    # of names that begin at one place the longest
    longest = lambda fs: F.filter(fs, lambda g: ~F.exists(fs, lambda h: (h["at"] <= g["at"]) & (h["at"] + h["n"] >= g["at"] + g["n"]) & (h["n"] > g["n"])))
    return F.when(F.size(ts) > 0, once(found, longest)).otherwise(F.array().cast("array<struct<at:int,n:int,name:string>>"))


def _bare_us(ts: Column) -> Column:
    """Places of a bare 'us' that is the country: after 'the', before what it can only describe, or after 'in' and its like where
    nothing speaks for the pronoun."""

    def is_country(i: Column) -> Column:
        before, after = F.coalesce(F.get(ts, i - 1), F.lit("")), F.coalesce(F.get(ts, i + 1), F.lit(""))
        pronoun = before.isin(US_PRONOUN_BEFORE) | after.isin(US_PRONOUN_AFTER)
        return (F.get(ts, i) == "us") & ((before == "the") | after.isin(US_AFTER) | (after == BASED) | (before.isin(US_BEFORE) & ~pronoun))

    return F.filter(F.sequence(F.lit(0), F.size(ts) - 1), is_country)


def _hits(ts: Column) -> Column:
    """array<struct<at, n, country, weight>> of the places named; weight 3 for the United States, 2 for a country, 1 for a city."""
    second = F.arrays_overlap(ts, F.split(F.lit(" ".join(US_SECOND_SIGNS)), " "))

    def read(g: Column) -> Column:
        of = lookup(PLACES, g["name"])
        country = F.when(of == STATE, F.when(second, US).otherwise(F.initcap(g["name"]))).otherwise(of)
        part = F.get(ts, g["at"] - 1).isin("latin", "south", "north", "central") & (g["name"] == "america")
        weight = F.when(country == US, 3).when((of == STATE) | (F.lower(of) == g["name"]), 2).otherwise(1)
        return F.struct(g["at"].alias("at"), g["n"].alias("n"), F.when(~F.coalesce(part, F.lit(False)), country).alias("country"), weight.alias("weight"))

    named = F.filter(F.transform(_grams(ts, PLACES), read), lambda h: h["country"].isNotNull())
    bare = F.transform(_bare_us(ts), lambda i: F.struct(i.alias("at"), F.lit(1).alias("n"), F.lit(US).alias("country"), F.lit(3).alias("weight")))
    return F.when(F.size(ts) > 0, F.concat(named, bare)).otherwise(F.array().cast("array<struct<at:int,n:int,country:string,weight:int>>"))


def _best(hits: Column) -> Column:
    """The country of a phrase: by weight, then the longest name, then the first."""
    return F.array_max(F.transform(hits, lambda h: F.struct(h["weight"].alias("w"), h["n"].alias("n"), (-h["at"]).alias("at"), h["country"].alias("country"))))["country"]


def country_in(text: Column) -> Column:
    """The country that a phrase names: the United States first, then countries, then cities; null if none."""
    return once(tokens(text), lambda ts: _best(_hits(ts)))


def mentions_united_states(text: Column) -> Column:
    """Whether a text names the United States, as a country and not as a pronoun; states and cities aside."""

    def read(ts: Column) -> Column:
        american = F.exists(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (F.get(ts, i) == "america") & ~F.coalesce(F.get(ts, i - 1), F.lit("")).isin("latin", "south", "north", "central"))
        states = F.array_contains(ts, "usa") | F.contains(F.concat(F.lit(" "), F.array_join(ts, " "), F.lit(" ")), F.lit(" united states "))
        return (F.size(ts) > 0) & (states | american | (F.size(_bare_us(ts)) > 0))

    return once(tokens(text), read)


def names_us_place(text: Column) -> Column:
    """Whether a text names the United States, a state or a city of it."""
    return once(tokens(text), lambda ts: F.exists(_hits(ts), lambda h: h["country"] == US))


def normalise_country(raw: Column) -> Column:
    """The country that a value gives: a name, a state or a city; null for anything else."""
    bare = F.regexp_replace(F.trim(raw), r"^[.,\s]+|[.,\s]+$", "")
    whole = once(tokens(bare), lambda ts: F.when(F.array_join(ts, " ").isin(US_NAMES), US).otherwise(lookup({s: US for s in US_STATES} | {c.lower(): c for c in COUNTRIES}, F.array_join(ts, " "))))
    return F.coalesce(whole, once(tokens(bare), lambda ts: _best(F.filter(_hits(ts), lambda h: (h["weight"] != 2)))))


def _demonyms(ts: Column) -> Column:
    """array<struct<at, n, country>> of nationalities that describe a company: one stands within a few words after, or 'based'."""
    nouns, seats = F.split(F.lit("|".join(ORGANISATIONS)), r"\|"), [*SEATED, BASED]

    def describes(g: Column) -> Column:
        after = g["at"] + g["n"]
        near = F.slice(ts, after + 1, DESCRIBED_WITHIN + 1)
        return F.arrays_overlap(near, nouns) | F.coalesce(F.get(ts, after).isin(seats), F.lit(False))

    return F.transform(F.filter(_grams(ts, DEMONYM_COUNTRY), describes), lambda g: F.struct(g["at"].alias("at"), g["n"].alias("n"), lookup(DEMONYM_COUNTRY, g["name"]).alias("country")))


def locations(sentence: Column, within: int = 10) -> Column:
    """array<struct<rung, country>> that a sentence gives its company: 2 'X-based', 3 a seat 'in X' at most so many words on,
    4 a nationality that describes a company."""

    def read(ts: Column) -> Column:
        def by_place(hits: Column) -> Column:
            based = F.filter(hits, lambda h: F.get(ts, h["at"] + h["n"]) == BASED)
            seats = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (F.get(ts, i) == "in") & (F.get(ts, i - 1).isin([c.split()[-1] for c in SEAT_CUES]) | (F.get(ts, i - 1) == BASED)))
            near = F.filter(hits, lambda h: F.exists(seats, lambda i: (h["at"] > i) & (h["at"] <= i + within)))
            made = lambda rung, found: F.when(F.size(found) > 0, F.struct(F.lit(rung).alias("rung"), _best(found).alias("country")))
            return F.array(made(2, based), made(3, near))

        described = once(_demonyms(ts), lambda ds: F.when(F.size(ds) > 0, F.struct(F.lit(4).alias("rung"), F.array_max(F.transform(ds, lambda d: F.struct(d["n"].alias("n"), (-d["at"]).alias("at"), d["country"].alias("country"))))["country"].alias("country"))))
        return F.filter(F.concat(once(_hits(ts), by_place), F.array(described)), lambda x: x.isNotNull() & x["country"].isNotNull())

    return F.when(F.length(F.coalesce(sentence, F.lit(""))) > 0, once(tokens(sentence), lambda ts: F.when(F.size(ts) > 0, read(ts)))).otherwise(F.array().cast("array<struct<rung:int,country:string>>"))


def is_locating(quote: Column, note: Column | None = None) -> Column:
    """Whether a quote behind a country says where a company is: an inference that calls itself one, a cue, a place named outright,
    or a nationality that describes a company."""
    cue = F.coalesce(quote, F.lit("")).rlike(rf"(?i)\b{any_of(LOCATING_CUES)}\b")
    named = once(tokens(quote), lambda ts: F.coalesce(lookup(dict.fromkeys([*US_NAMES, *_COUNTRY_NAMES], "x"), F.array_join(ts, " ")).isNotNull() | F.exists(_hits(ts), lambda h: h["weight"] != 2) | (F.size(_demonyms(ts)) > 0), F.lit(False)))
    inferred = F.lit(False) if note is None else F.coalesce(F.contains(note, F.lit("INFERRED")), F.lit(False))
    return inferred | cue | named


def domain_ending(text: Column) -> Column:
    """The ending under which companies of the country register that a text names, or whose nationality it has; null without one."""
    endings = {country: tld for tld, country in TLD_COUNTRY.items()} | SECOND_LEVEL_COUNTRY

    def read(ts: Column) -> Column:
        nation = F.transform(_grams(ts, DEMONYM_COUNTRY), lambda g: F.struct(g["n"].alias("n"), (-g["at"]).alias("at"), lookup(DEMONYM_COUNTRY, g["name"]).alias("country")))
        return lookup(endings, F.coalesce(_best(_hits(ts)), F.array_max(nation)["country"]))

    return once(tokens(text), read)
