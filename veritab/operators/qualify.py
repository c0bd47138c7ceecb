"""Gates and scores. The verdict comes from the gates alone; scores order, they never change it.

A profile row has company_id, usd, amount_type, tech, us_level, title, email_status, country, sector, domain, founder,
address. What is unknown is null, and a gate on an unknown fact fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.email import belongs_to, is_role_account, matches_name
from ..functions.gazetteer import is_locating
from ..functions.people import is_founder_or_ceo, is_no_person
from ..functions.text import alternation, names_a_publication
from ..vocab import FIT_SECTORS, GATES, HUB_COUNTRIES, INVESTOR_TLDS, INVESTOR_WORDS, QUALIFYING_TYPES
from .authority import authority


@dataclass(frozen=True)
class Band:
    least: float = 1_000_000.0
    most: float = 5_000_000.0
    tolerance: float = 0.10


def gates(band: Band = Band()) -> Column:
    """array<struct<gate, passed, reason>> in the order of GATES."""
    usd = F.col("usd").cast("double")
    email_reason = F.coalesce(F.concat(F.lit("the address is "), F.col("email_status")), F.lit("no address was found"))
    checks = [
        (
            usd.isNotNull() & F.col("amount_type").isin(QUALIFYING_TYPES) & (usd >= band.least) & (usd <= band.most),
            F.when(usd.isNull(), "no figure was found").when(~F.col("amount_type").isin(QUALIFYING_TYPES), F.concat(F.lit("the figure is of type "), F.col("amount_type"))).when(usd < band.least, "below the band").when(usd > band.most, "above the band").otherwise("within the band"),
        ),
        (F.col("tech"), F.when(F.col("tech"), "a platform was found").otherwise("no platform was found")),
        (F.col("us_level").isin("none", "minimal"), F.when(F.col("us_level").isNull(), "the country is unknown").otherwise(F.concat(F.lit("presence is "), F.col("us_level")))),
        (is_founder_or_ceo(F.col("title")), F.when(F.col("title").isNull(), "nobody was found").when(is_founder_or_ceo(F.col("title")), "a founder or chief executive was found").otherwise("the office isn't that of a founder or chief executive")),
        (F.col("email_status") == "verified", email_reason),
    ]
    return F.array(*[F.struct(F.lit(g).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed"), why.alias("reason")) for g, (ok, why) in zip(GATES, checks)])


def near_boundary(band: Band = Band()) -> Column:
    usd = F.col("usd").cast("double")
    return F.coalesce((F.abs(usd - band.least) / band.least <= band.tolerance) | (F.abs(usd - band.most) / band.most <= band.tolerance), F.lit(False))


def fit_score() -> Column:
    """0.40 sector, 0.30 country, 0.20 size, 0.05 for a verified address and 0.05 for a founder."""
    sector = F.lower(F.coalesce("sector", F.lit("")))
    by_sector = F.greatest(*[F.when(F.contains(sector, F.lit(k)), float(w)).otherwise(0.0) for k, w in FIT_SECTORS.items()])
    by_country = F.coalesce(*[F.when(F.col("country") == c, float(w)) for c, w in HUB_COUNTRIES.items()], F.when(F.col("country").isNotNull(), 0.45), F.lit(0.0))
    usd = F.col("usd").cast("double")
    size = F.when(usd.isNull(), 0.0).when((usd >= 1.5e6) & (usd <= 4.0e6), 1.0).otherwise(0.7)
    extra = F.when(F.col("email_status") == "verified", 0.05).otherwise(0.0) + F.when(is_founder_or_ceo(F.col("title")), 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), 0.40 * by_sector + 0.30 * by_country + 0.20 * size + extra), 3)


def confidence(parts: list[Column], corroborated: Column, failed: Column) -> Column:
    """Mean of the facts' confidences, 0.04 up for each corroborated one, 0.08 down for each failed gate, within 0 and 0.99."""
    mean = sum(parts[1:], parts[0]) / len(parts)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), mean + 0.04 * corroborated - 0.08 * failed))


def qualify(profiles: DataFrame, band: Band = Band()) -> DataFrame:
    """profiles with gates, qualified, failed (names of failed gates), first_failure, near_boundary and fit_score."""
    judged = profiles.withColumn("gates", gates(band))
    failed = F.transform(F.filter("gates", lambda g: ~g["passed"]), lambda g: g["gate"])
    reason = F.try_element_at(F.filter("gates", lambda g: ~g["passed"]), F.lit(1))["reason"]
    return judged.withColumns({
        "qualified": F.forall("gates", lambda g: g["passed"]), "failed": failed, "first_failure": reason,
        "near_boundary": near_boundary(band), "fit_score": fit_score(),
    })


def names_an_investor(domain: Column) -> Column:
    host = F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")
    label = F.replace(F.split(host, r"\.")[0], F.lit("-"), F.lit(""))
    ends = F.lit(False)
    for tld in INVESTOR_TLDS:
        ends = ends | host.endswith(tld)
    return ends | label.rlike(alternation(INVESTOR_WORDS))


def fails_now(band: Band = Band(), *, located: bool = False) -> Column:
    """Why a stored lead no longer qualifies: the first rule that it breaks, or null.

    located: whether leads carry country and country_evidence array<struct<quote, note>>, of which one must say where the company is."""
    site = F.concat(F.lit("https://"), F.col("domain"), F.lit("/"))
    usd = F.col("usd").cast("double")
    rules = [
        (F.coalesce("founder", F.lit("")) == "", "no founder on record"),
        (is_no_person(F.col("founder")), "the founder is a job, not a person"),
        (F.coalesce(F.trim("address"), F.lit("")) == "", "no address on record"),
        (is_role_account(F.col("address")), "the address is a shared mailbox"),
        (names_an_investor(F.col("domain")), "the domain is an investor's"),
        (authority(site) == "tier1_press", "the domain is a publication's"),
        (authority(site) == "social_profile", "the domain is a social network's"),
        (names_a_publication(F.col("domain")), "the domain names itself a publication"),
        (~belongs_to(F.col("address"), F.col("domain")) & ~matches_name(F.col("address"), F.col("founder")), "the address belongs to neither company nor founder"),
        (usd.isNull(), "no figure on record"),
        ((usd < band.least) | (usd > band.most), "the figure is outside the band"),
        (F.coalesce("email_status", F.lit("")) != "verified", "the address isn't verified"),
    ]
    if located:
        proof = F.exists(F.coalesce("country_evidence", F.array().cast("array<struct<quote:string,note:string>>")), lambda e: is_locating(e["quote"], e["note"]))
        rules.append((F.col("country").isNotNull() & ~proof, "no quote says where the company is"))
    return F.coalesce(*[F.when(test, why) for test, why in rules])


def recheck(leads: DataFrame, band: Band = Band()) -> tuple[DataFrame, DataFrame]:
    """(still qualified, rejected with reason) of stored leads."""
    judged = leads.withColumn("reason", fails_now(band, located="country_evidence" in leads.columns))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
