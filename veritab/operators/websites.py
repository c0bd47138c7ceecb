"""Sites of companies: whose a host is, what is a placeholder, what to search for; sources within a prompt's budget, and
addresses that cited pages really hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.companies import is_generic_name, once
from ..functions.text import alternation, collapse, host_of, labels_of
from ..vocab import HOST_PREFIXES, PARKED_TELLS
from .authority import authority, rank
from .fuse import mentions


def host_matches_name(host: Column, name: Column) -> Column:
    """Whether a host may be that of a company by its name: one holds the other, also behind a usual prefix; the name's longest word
    of five letters or more is in the host; or the host is the name's initials, of three words or more."""

    def judge(x: Column) -> Column:
        root, whole, words = x["root"], x["whole"], x["words"]
        within = lambda a: F.contains(whole, a) | F.contains(a, whole)
        stems = F.transform(F.filter(F.array(*map(F.lit, HOST_PREFIXES)), lambda p: root.startswith(p)), lambda p: F.substr(root, F.length(p) + 1))
        prefixed = F.exists(stems, lambda s: (F.length(s) >= 4) & within(s))
        longest = F.array_max(F.transform(F.filter(words, lambda w: F.length(w) >= 5), lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
        initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
        named = within(root) | prefixed | F.coalesce(F.contains(root, longest), F.lit(False)) | ((F.length(initials) >= 3) & (root == initials))
        return (root != "") & (whole != "") & named

    own = labels_of(host)
    label = F.when((F.get(own, F.lit(0)) == "www") & (F.size(own) > 1), F.get(own, F.lit(1))).otherwise(F.get(own, F.lit(0)))
    low = F.lower(F.coalesce(name, F.lit("")))
    parts = F.struct(
        F.coalesce(F.regexp_replace(label, "[^a-z0-9]", ""), F.lit("")).alias("root"), F.regexp_replace(low, r"[^\p{L}\p{N}]", "").alias("whole"),
        F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "").alias("words"),
    )
    return once(parts, judge)


def looks_parked(text: Column, within: int = 4000, least: int = 120) -> Column:
    """A placeholder: its beginning says so, or has hardly any text."""
    start = F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, within)
    return start.rlike(alternation(PARKED_TELLS)) | (F.length(collapse(start)) < least)


def is_worth_a_search(name: Column, has_excerpt: Column, source_kind: Column, n_sources: Column) -> Column:
    """Whether a candidate without a site is worth one search: a name that is one, found in prose, on a site, or more than once."""
    real = (F.length(F.trim(F.coalesce(name, F.lit("")))) >= 3) & ~is_generic_name(name)
    channel = F.coalesce(has_excerpt, F.lit(False)) | F.coalesce(source_kind.isin("headline", "article", "company_site"), F.lit(False)) | (F.coalesce(n_sources, F.lit(0)) > 1)
    return real & channel


def within_budget(sources: DataFrame, per_source: int = 9_000, total: int = 40_000) -> DataFrame:
    """company_id, seq, url, part of the sources (company_id, seq, url, text) that a prompt takes, in order of seq: of each at most
    per_source characters, of all at most total; the last one is cut where the budget ends. Only lengths are summed up in order."""
    size = F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(per_source)).cast("long")
    line = Window.partitionBy("company_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sized = sources.select("company_id", "seq", size.alias("size")).withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
    taken = sized.where(F.col("before") < total).select("company_id", "seq", F.least("size", total - F.col("before")).cast("int").alias("take"))
    return sources.join(taken, ["company_id", "seq"]).select("company_id", "seq", "url", F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.col("take")).alias("part"))


def confirmed(findings: DataFrame, pages: DataFrame, most: int = 2) -> DataFrame:
    """company_id, address, url of the addresses (company_id, address, source_urls) that one of their first cited pages holds as a
    whole: the first such page. pages: url, text. Pages and findings meet on url and address."""
    cited = findings.select("company_id", F.lower("address").alias("address"), F.posexplode(F.slice("source_urls", 1, most)).alias("rank", "url")).where("url is not null and url <> ''")
    said = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+"), 0))
    there = pages.select("url", F.explode(said).alias("address")).distinct()
    return cited.join(there, ["url", "address"]).groupBy("company_id", "address").agg(F.min_by("url", "rank").alias("url"))


def unread_snippets(snippets: DataFrame, fetched: DataFrame) -> DataFrame:
    """The snippets (url, ...) whose hosts have no fetched page (url)."""
    keyed = snippets.withColumn("_host", host_of(F.col("url")))
    return keyed.join(fetched.select(host_of(F.col("url")).alias("_host")).distinct(), "_host", "left_anti").drop("_host")


def excerpts(candidates: DataFrame) -> DataFrame:
    """company_id, url, text, authority: the search excerpts (company_id, name, domain, snippet, urls) that may serve as sources: from
    a host of standing that isn't the company's own, and naming the company."""
    first = F.try_element_at(F.filter("urls", lambda u: F.coalesce(u, F.lit("")) != ""), F.lit(1))
    rows = candidates.select("company_id", "name", "domain", F.trim("snippet").alias("text"), first.alias("url")).where("url is not null and text <> ''")
    rows = rows.where(~F.coalesce(host_of(F.col("url")) == F.lower("domain"), F.lit(False))).withColumn("authority", authority(F.col("url"), F.col("domain")))
    return rows.where((rank(F.col("authority")) >= rank(F.lit("aggregator"))) & mentions(F.col("text"), F.col("name"))).select("company_id", "url", "text", "authority")
