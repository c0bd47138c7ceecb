"""Entity resolution: which candidates are one company, and which are known already."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import normalise_domain, normalise_name
from ..vocab import SOURCE_KIND_RANK


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_domain", normalise_domain(F.col("domain"))).withColumn("_name", F.nullif(normalise_name(F.col("name")), F.lit("")))


def merge(candidates: DataFrame) -> DataFrame:
    """One row an entity of candidates (seq, name, domain, snippet, source_kind).

    Candidates with one domain are one entity. A candidate without a domain joins the earliest domain known under its
    name, else the others of its name. Two domains never merge, whatever their names. Names are aggregated before they
    are joined, so a name with very many rows is one row on that side."""
    keyed = _keyed(candidates).where(F.coalesce("_domain", "_name").isNotNull())
    domain_of = keyed.where("_domain is not null and _name is not null").groupBy("_name").agg(F.min_by("_domain", "seq").alias("_known"))
    placed = keyed.join(domain_of, "_name", "left").withColumn("entity", F.coalesce("_domain", "_known", F.concat(F.lit("name:"), F.col("_name"))))
    kind = F.coalesce(*[F.when(F.col("source_kind") == k, r) for k, r in SOURCE_KIND_RANK.items()], F.lit(9))
    return placed.groupBy("entity").agg(
        F.min_by("name", "seq").alias("name"), F.min_by("_domain", F.when(F.col("_domain").isNotNull(), F.col("seq"))).alias("domain"), F.count("*").alias("n_sources"),
        F.max_by("snippet", F.struct(F.length("snippet"), -F.col("seq"))).alias("snippet"), F.min_by("source_kind", F.struct(kind, "seq")).alias("source_kind"), F.min("seq").alias("seq"),
    )


def known_keys(companies: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """key: every domain and name of companies (name, domain) and aliases (alias)."""
    keyed = _keyed(companies)
    keys = keyed.select(F.col("_domain").alias("key")).union(keyed.select(F.col("_name").alias("key")))
    if aliases is not None:
        keys = keys.union(aliases.select(normalise_name(F.col("alias"))))
    return keys.where("key is not null").distinct()


def unknown(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """The candidates none of whose keys is known: two anti joins."""
    keyed = _keyed(candidates)
    left = keyed.join(keys, keyed["_domain"] == keys["key"], "left_anti")
    return left.join(keys, left["_name"] == keys["key"], "left_anti").drop("_domain", "_name")


def find(asked: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked (ask_id, name, domain) with company_id: by domain, else by name, else by alias; of several, the least id."""
    own = _keyed(companies)
    by_domain = own.where("_domain is not null").groupBy("_domain").agg(F.min("company_id").alias("c1"))
    by_name = own.where("_name is not null").groupBy("_name").agg(F.min("company_id").alias("c2"))
    by_alias = aliases.groupBy(normalise_name(F.col("alias")).alias("_name")).agg(F.min("company_id").alias("c3"))
    met = _keyed(asked).join(by_domain, "_domain", "left").join(by_name, "_name", "left").join(by_alias, "_name", "left")
    return met.select("ask_id", F.coalesce("c1", "c2", "c3").alias("company_id"), F.when(F.col("c1").isNotNull(), "domain").when(F.col("c2").isNotNull(), "name").when(F.col("c3").isNotNull(), "alias").alias("found_by"))
