"""Queries over discovery. Search results, articles and pages of links are derived from customers and suppliers, so that the
SQL knows each candidate from a key, not from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.companies import clean_company_name, is_generic_name
from ..operators.discover import from_articles, from_links, from_search, is_link_hub
from ..operators.html import links
from ..operators.resolve import merge
from ..shared import table

#: Names as they are written, by key modulo their number; {n} is the key.
WRITTEN = ["Firm{n} Ltd.", "Fintech Ventures", "Apply Now", "Tel Aviv Israel", "https://firm{n}.com/", "EIF", "Firm{n} Robotics with Friends", ' "Firm{n}  Robotics", ', "Top", "New Relic", "Top 10 startups", "Firm{n} Labs GmbH"]
#: Title, url and snippet of search results.
FOUND = [
    ("Indian fintech Firm{n} raises $2M seed - Daily", "https://firm{n}.io/news", "A round for the company"),
    ("About us", "https://www.firm{n}.io/about", "Lagos-based Firm{n} Pay, a platform for shops"),
    ("Home", "https://firm{n}-pay.com", "We make software"),
    ("A story", "https://medium.com/p/{n}", "Nothing about anybody"),
    ("Lecture {n}", "https://cs.uni.edu.ng/{n}", "Notes"),
    ("Tel Aviv secures seed", "https://techcrunch.com/{n}", "A city of the north"),
]


def _written(rows: DataFrame, key: str, texts: list[str]):
    n = F.col(key)
    return F.coalesce(*[F.when(n % len(texts) == i, F.replace(F.lit(t), F.lit("{n}"), n.cast("string"))) for i, t in enumerate(texts)])


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    raw = _written(rows, "c_custkey", WRITTEN)
    return rows.select("c_custkey", clean_company_name(raw).alias("name"), is_generic_name(raw).alias("generic"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("seq"), *[_written(rows, "c_custkey", [x[i] for x in FOUND]).alias(c) for i, c in enumerate(("title", "url", "snippet"))])


def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_search(_results(spark, sf_dir)).select("seq", "name", "domain", "source_kind", "snippet")


def article_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article a supplier: two lines name one company, one another, and one a trade."""
    n = F.col("s_suppkey")
    text = F.replace(F.lit("The week in funding\nFirm{n} raises $2 million\nKenyan startup Firm{n} closes its round\nBerlin-based Acme{n} Energy, a maker of cells\nSoftware raises prices"), F.lit("{n}"), n.cast("string"))
    texts = table(spark, sf_dir, "supplier").select(n.alias("page_id"), F.lit("https://daily.example/a").alias("url"), text.alias("text"))
    return from_articles(texts).select("seq", "name", "source_kind", "snippet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a supplier with links to a company, to it again, to a button, deep into a site, to a platform and home."""
    n = F.col("s_suppkey")
    html = F.replace(F.lit(
        "<title>Our portfolio</title><p>All</p><a href='https://firm{n}.id/'>Firm{n}</a><a href='https://www.firm{n}.id/about'>Firm{n} Ltd</a><a href='https://other{n}.com'>Assets</a>"
        "<a href='https://green{n}.com/en/home'>Green Steel{n}</a><a href='https://deep{n}.com/a/b/c'>Deep Sea{n}</a><a href='https://linkedin.com/company/x'>Linked Name{n}</a><a href='/join'>Join Us{n}</a>"
    ), F.lit("{n}"), n.cast("string"))
    url = F.when(n % 3 == 0, "https://hub.example/vc-firms").otherwise("https://hub.example/list")
    more = F.when(n % 3 == 0, "<p>A list of investors</p>").otherwise("")
    return table(spark, sf_dir, "supplier").select(n.alias("page_id"), url.alias("url"), F.concat(html, more).alias("html"))


def link_page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = _pages(spark, sf_dir).where(is_link_hub(F.col("url"), F.lit(""), F.col("html")))
    return from_links(links(hubs)).select("seq", "name", "domain", "source_kind")


def discovered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results and pages of links together, one row an entity."""
    both = from_search(_results(spark, sf_dir)).unionByName(from_links(links(_pages(spark, sf_dir))))
    return merge(both).select("entity", "domain", "n_sources", "source_kind")


QUERIES = {f.__name__: f for f in (company_names, search_candidates, article_candidates, link_page_candidates, discovered_entities)}

_FOUND = """
    c as (select c_custkey as n, c_custkey % 6 as k from customer),
    found as (select n as seq, case k when 0 then 'Firm' || n when 1 then 'Firm' || n || ' Pay' else 'Firm' || n || ' Pay' end as name, case k when 1 then 'firm' || n || '.io' when 2 then 'firm' || n || '-pay.com' end as domain,
                     case k when 0 then 'headline' when 1 then 'article' else 'company_site' end as source_kind,
                     case k when 0 then 'Indian fintech Firm' || n || ' raises $2M seed - Daily. A round for the company' when 1 then 'About us. Lagos-based Firm' || n || ' Pay, a platform for shops' else 'Home. We make software' end as snippet
              from c where k < 3)"""

SQL = {
    "company_names": """
        select c_custkey, case c_custkey % 12 when 0 then 'Firm' || c_custkey when 7 then 'Firm' || c_custkey || ' Robotics' when 9 then 'New Relic' when 11 then 'Firm' || c_custkey || ' Labs' end as name,
               c_custkey % 12 in (1, 2, 3, 5, 8, 10) as generic from customer""",
    "search_candidates": f"with {_FOUND} select * from found",
    "article_candidates": """
        select s_suppkey as seq, 'Firm' || s_suppkey as name, 'article' as source_kind, 'Firm' || s_suppkey || ' raises $2 million' as snippet from supplier
        union all select s_suppkey, 'Acme' || s_suppkey || ' Energy', 'article', 'Berlin-based Acme' || s_suppkey || ' Energy, a maker of cells' from supplier""",
    "link_page_candidates": """
        select s_suppkey as seq, 'Firm' || s_suppkey as name, 'firm' || s_suppkey || '.id' as domain, 'link_hub' as source_kind from supplier where s_suppkey % 3 <> 0
        union all select s_suppkey, 'Green Steel' || s_suppkey, 'green' || s_suppkey || '.com', 'link_hub' from supplier where s_suppkey % 3 <> 0""",
    "discovered_entities": f"""
        with {_FOUND},
        linked as (select 'firm' || s_suppkey || '.id' as domain, 'firm' || s_suppkey as nn from supplier union all select 'green' || s_suppkey || '.com', 'green steel' || s_suppkey from supplier),
        rows as (select domain, lower(name) as nn, source_kind from found union all select domain, nn, 'link_hub' from linked),
        placed as (select coalesce(r.domain, l.domain, 'name:' || r.nn) as entity, coalesce(r.domain, l.domain) as d, r.source_kind from rows r left join linked l on r.nn = l.nn and r.domain is null)
        select entity, any_value(d) as domain, count(*) as n_sources, case min(case source_kind when 'headline' then 0 when 'company_site' then 1 when 'article' then 2 else 3 end) when 0 then 'headline' when 1 then 'company_site' when 2 then 'article' else 'link_hub' end as source_kind
        from placed group by 1""",
}
