"""Countries and signs of a presence in the United States."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..vocab import CITY_COUNTRY, COUNTRIES, DEMONYM_COUNTRY, TLD_COUNTRY, US_CITIES, US_NAMES, US_STATES
from .money import lookup
from .text import labels_of, strings
from .tokens import any_of, near, plurals

#: Nouns that a nationality describes as a company, and how far before them it may stand, in words.
ORGANISATIONS = plurals("""startup start-up scaleup scale-up company firm business venture platform provider vendor maker developer studio agency group
    team founder cofounder co-founder entrepreneur fintech marketplace unicorn bank lender retailer operator manufacturer brand enterprise corporation
    subsidiary""".split()) + "proptech insurtech healthtech edtech adtech deeptech saas software technology tech outfit venture-backed".split()
DESCRIBED_WITHIN = 3
SEATED = "based headquartered owned founded registered".split()
#: Words of the signs of a presence in the United States.
US_WORDS = ["US", "U.S.", "USA", "United States"]
US_TOWNS = ["New York", "San Francisco", "Boston", "Chicago", "Austin", "Seattle", "Los Angeles", "Miami", "Atlanta", "Denver"]
US_PLACES = [*US_TOWNS, "NYC", "Palo Alto", "Silicon Valley", "United States", "USA", "U.S."]
US_OFFICE_WORDS = plurals(["office", "hub", "location", "team"]) + ["headquarters", "HQ", "branch", "presence"]
US_OFFICE_LINKS = "in across from between spanning span spans include includes including".split()
US_ENTITY_WORDS = "subsidiary entity arm affiliate".split()
US_FORMS = ["C-Corp", "C Corp", "corporation", "LLC"]
US_FOUNDED_WORDS = "incorporated registered domiciled".split()
US_JOB_WORDS = "based only hiring position role opening".split()
US_STATE_CODES = "NY CA TX MA WA IL FL GA CO NJ VA".split()
STREET_WORDS = "Street St. St Avenue Ave. Ave Road Rd. Rd Boulevard Blvd. Blvd Suite Ste. Ste".split()


def us_patterns() -> dict[str, list[str]]:
    """For each kind of signal the patterns of which one must hold."""
    us, american = any_of(US_WORDS), any_of([*US_WORDS, "American", "Delaware", *US_TOWNS])
    return {
        "us_office": [near(american, any_of(US_OFFICE_WORDS), 0), near(near(any_of(US_OFFICE_WORDS), any_of(US_OFFICE_LINKS), 0)[2:], any_of(US_PLACES), 12)],
        "us_subsidiary": [near(any_of([*US_WORDS, "American"]), any_of(US_ENTITY_WORDS), 0), rf"\bInc\.?\s*\(\s*{any_of(['USA', 'United States'])}\s*\)"],
        "us_incorporation": [near(any_of(f"{w} in" for w in US_FOUNDED_WORDS), any_of(["Delaware", *US_WORDS, *(f"the {w}" for w in US_WORDS)]), 0), near("Delaware", any_of(US_FORMS), 0)],
        "us_job_posting": [near(us, any_of(US_JOB_WORDS), 6), near(any_of(US_TOWNS), any_of([*US_STATE_CODES, "US", "USA"]), 0)],
        "us_address_mention": [near(near(r"\d{1,5}", any_of(STREET_WORDS), 5)[2:], rf"{any_of(US_STATE_CODES)}\s+\d{{5}}", 6)],
        "us_phone": [r"\+1(?:[\s.()-]{0,3}\d){10}\b"],
    }


US_SIGNALS = {kind: "(?i)" + "|".join(patterns) for kind, patterns in us_patterns().items()}
#: What any of the signals needs, so that most texts are read once.
_US_HINT = rf"(?i)\+1|{any_of([*US_PLACES, *US_WORDS, 'American', 'Delaware'])}|\d{{5}}"


def us_signals(text: Column) -> Column:
    """Kinds of signals in a text."""
    body = F.coalesce(text, F.lit(""))
    return F.when(body.rlike(_US_HINT), F.array_compact(F.array(*[F.when(body.rlike(p), k) for k, p in US_SIGNALS.items()]))).otherwise(F.array().cast("array<string>"))


def is_united_states(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin([*US_NAMES, *US_STATES, *US_CITIES]), F.lit(False))


def country_named(place: Column) -> Column:
    """Country of a place given by name: the United States first, then countries and cities; null for anything else."""
    names = {c.lower(): c for c in COUNTRIES} | CITY_COUNTRY
    return F.when(is_united_states(place), "United States").otherwise(lookup(names, F.lower(F.trim(place))))


def country_from_domain(domain: Column) -> Column:
    """Country of a domain's ending where it has one alone."""
    return lookup(TLD_COUNTRY, F.try_element_at(labels_of(domain), F.lit(-1)))


def country_from_demonym(text: Column) -> Column:
    """Country of the longest nationality that describes a company in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    nouns, seated = any_of(ORGANISATIONS), any_of(SEATED)
    described = [(d, rf"\b{re.escape(d)}[- ]{seated}\b|{near(re.escape(d), nouns, DESCRIBED_WITHIN)}|\b{re.escape(d)}-{nouns}\b") for d in sorted(DEMONYM_COUNTRY, key=len, reverse=True)]
    hit = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(d)) & low.rlike(p), DEMONYM_COUNTRY[d]) for d, p in described]))
    return F.try_element_at(hit, F.lit(1))


def us_level(country: Column, kinds: Column, hard: list[str], max_weak: int) -> Column:
    """none, minimal or significant; null where the country isn't known."""
    weak = F.size(F.array_distinct(F.filter(kinds, lambda k: ~k.isin(hard))))
    significant = is_united_states(country) | F.arrays_overlap(kinds, strings(hard)) | (weak > max_weak)
    return F.when(country.isNull(), None).when(significant, "significant").when(weak > 0, "minimal").otherwise("none")
