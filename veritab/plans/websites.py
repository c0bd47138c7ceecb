"""Queries over sites of companies, derived from customers and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import normalise_quote, raw_span, sentences
from ..operators.websites import confirmed, host_matches_name, is_worth_a_search, looks_parked, unread_snippets, within_budget
from ..shared import table

#: Host and name of a company, and whether they may belong together; {n} is the key.
HOSTS = [
    ("novapay{n}.ng", "Nova Pay{n}", True), ("www.usenova{n}.com", "Nova{n}", True), ("zetahq{n}.com", "Zeta{n} Care Systems", False), ("fundsite.vc", "Firm{n}", False),
    ("zcs.io", "Zeta Care Systems", True), ("carestem{n}.com", "The Carestem Group", True), ("ab.io", "Zeta Care", False), ("", "Firm{n}", False), ("x.io", "", False), ("getacme.io", "Acme Robotics", True),
]


def _picked(rows: DataFrame, values: list):
    n = F.col("c_custkey")
    return F.coalesce(*[F.when(n % len(values) == i, F.replace(F.lit(v), F.lit("{n}"), n.cast("string"))) for i, v in enumerate(values)])


def hosts_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", host_matches_name(_picked(rows, [h for h, _, _ in HOSTS]), _picked(rows, [x for _, x, _ in HOSTS])).alias("matches"))


#: A page's text, a candidate's name, kind and number of sources; whether the page is a placeholder and the candidate worth a search.
SITES = [
    ("Coming soon: firm {n} is under construction. " + "A line of text that fills the page. " * 5, "Firm{n}", "headline", 1, True, True), ("Short page {n}", "Fintech", "headline", 3, True, False),
    ("Firm {n} makes cells for trains and ships. " * 4, "Firm{n}", "link_hub", 1, False, False), ("Firm {n} makes cells for trains and ships. " * 4, "Firm{n}", "link_hub", 2, False, True), ("Index of /{n} " + "x " * 80, "AB", "article", 2, True, False),
]


def parked_and_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    n_sources = F.coalesce(*[F.when(F.col("c_custkey") % len(SITES) == i, s[3]) for i, s in enumerate(SITES)])
    return rows.select("c_custkey", looks_parked(_picked(rows, [s[0] for s in SITES])).alias("parked"), is_worth_a_search(_picked(rows, [s[1] for s in SITES]), F.lit(False), _picked(rows, [s[2] for s in SITES]), n_sources).alias("worth"))


def prompt_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources of 37 companies, within 2,000 characters each and 9,000 together."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 37).alias("company_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("https://d.example/"), "doc_id").alias("url"), "text")
    return within_budget(docs, 2_000, 9_000).select("company_id", "seq", F.length("part").cast("long").alias("n_chars"), F.md5("part").alias("part_md5"))


def cited_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that outside services named, confirmed on the first cited page that holds them as a whole."""
    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(n, F.concat(F.lit("jane@firm"), n, F.lit(".io")).alias("address"), *[F.concat(F.lit(f"https://p{i}.example/"), n).alias(f"u{i}") for i in range(3)])
    findings = rows.select(n.alias("company_id"), F.upper("address").alias("address"), F.array("u0", "u1", "u2").alias("source_urls"))
    page = lambda i, when, text: rows.where(when).select(F.col(f"u{i}").alias("url"), text.alias("text"))
    pages = page(0, n % 4 < 2, F.concat(F.lit("Write to mary-"), "address", F.lit(" or x"), "address")).unionByName(page(0, n % 4 == 2, F.concat(F.lit("Write to <"), "address", F.lit("> now")))).unionByName(page(1, n % 2 == 0, F.concat("address", F.lit(", or ring")))).unionByName(page(2, n % 4 == 1, F.col("address")))
    return confirmed(findings, pages)


def snippets_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results of hosts of which no page was fetched."""
    n = F.col("c_custkey")
    snippets = table(spark, sf_dir, "customer").select(n, F.concat(F.lit("https://www.firm"), n % 50, F.lit(".io/news")).alias("url"))
    fetched = table(spark, sf_dir, "supplier").select(F.concat(F.lit("https://firm"), F.col("s_suppkey") * 3, F.lit(".io/")).alias("url"))
    return unread_snippets(snippets, fetched)


def quotes_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest sentence of each document, folded: whether what stands in the text for it folds to the same."""
    longest = F.array_max(F.transform(sentences(F.coalesce("text", F.lit(""))), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", normalise_quote(longest).alias("q"))
    span = raw_span(F.col("q"), F.col("text"))
    return rows.select("doc_id", ((F.col("q") == "") | (normalise_quote(span) == F.col("q"))).alias("as_written"))


QUERIES = {f.__name__: f for f in (hosts_of_names, parked_and_worth, prompt_budgets, cited_addresses, snippets_left, quotes_as_written)}

_bools = lambda values: "[" + ", ".join(str(v).lower() for v in values) + "]"

SQL = {
    "hosts_of_names": f"select c_custkey, ({_bools([m for _, _, m in HOSTS])})[c_custkey % {len(HOSTS)} + 1] as matches from customer",
    "parked_and_worth": f"select c_custkey, ({_bools([s[4] for s in SITES])})[c_custkey % {len(SITES)} + 1] as parked, ({_bools([s[5] for s in SITES])})[c_custkey % {len(SITES)} + 1] as worth from customer",
    "prompt_budgets": """
        with d as (select doc_id % 37 as company_id, doc_id as seq, text, least(length(coalesce(text, '')), 2000) as size from documents),
        w as (select *, coalesce(sum(size) over (partition by company_id order by seq rows between unbounded preceding and 1 preceding), 0) as before from d),
        t as (select company_id, seq, substr(coalesce(text, ''), 1, least(size, 9000 - before)::bigint) as part from w where before < 9000)
        select company_id, seq, length(part) as n_chars, md5(part) as part_md5 from t""",
    "cited_addresses": """
        select c_custkey as company_id, 'jane@firm' || c_custkey || '.io' as address, 'https://p' || (case when c_custkey % 4 = 2 then 0 else 1 end) || '.example/' || c_custkey as url from customer where c_custkey % 2 = 0""",
    "quotes_as_written": "select doc_id, true as as_written from documents",
    "snippets_left": "select c_custkey, 'https://www.firm' || c_custkey % 50 || '.io/news' as url from customer where c_custkey % 50 not in (select s_suppkey * 3 from supplier)",
}
