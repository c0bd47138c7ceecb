"""Discovery: candidates for companies in search results, articles and pages of links.

Every operator returns seq, name, domain, source_kind, snippet, source_url, as `resolve.merge` takes them. Whole texts are
read, and nothing is cut off after a number of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.companies import clean_company_name, names_its_host
from ..functions.people import company_from_headline
from ..functions.text import alternation, host_of, name_from_domain, normalise_domain, normalise_name, path_of
from ..vocab import HUB_HINTS, INVESTOR_HINTS
from .authority import is_company_host
from .extract import leading_name
from .html import made

_said = lambda x: F.coalesce(x, F.lit(""))


def passage(title: Column, snippet: Column) -> Column:
    """Both halves of a search result as one text: 'title. snippet', unless the snippet begins with the title."""
    t, s = F.trim(_said(title)), F.trim(_said(snippet))
    return F.when((t == "") | s.startswith(t), F.when(s == "", t).otherwise(s)).when(s == "", t).otherwise(F.concat(t, F.lit(". "), s))


def based_name(text: Column) -> Column:
    """The name after 'X-based' or 'based in X,', or null."""
    after = lambda pattern: F.nullif(leading_name(F.regexp_extract(_said(text), pattern, 1)), F.lit(""))
    return F.coalesce(after(r"\p{Lu}[\w\-]*[- ]based\s+(.*)"), after(r"based in \p{Lu}[\w\- ]*,\s*(.*)"))


def from_search(results: DataFrame) -> DataFrame:
    """Candidates of results (seq, title, url, snippet): by headline, else by 'X-based Name', else the site itself.

    A headline is an article about a company, so the host of its result never becomes the company's domain."""
    based = F.coalesce(based_name(F.col("title")), based_name(F.col("snippet")))
    host = F.when(is_company_host(F.col("url")), host_of(F.col("url")))

    def choose(r):
        kind = F.when(r["h"].isNotNull(), "headline").when(r["b"].isNotNull(), "article").when(r["host"].isNotNull(), "company_site")
        domain = F.when(r["h"].isNull(), r["host"])
        name = F.coalesce(clean_company_name(F.coalesce(r["h"], r["b"])), clean_company_name(F.when(domain.isNotNull(), name_from_domain(domain))))
        return F.struct(name.alias("name"), domain.alias("domain"), kind.alias("source_kind"))

    # as a generated row: the filter below would else compute all of it a second time
    chosen = F.transform(F.array(F.struct(company_from_headline(F.col("title")).alias("h"), based.alias("b"), host.alias("host"))), choose)
    rows = results.select("seq", passage(F.col("title"), F.col("snippet")).alias("snippet"), F.col("url").alias("source_url"), F.inline(chosen))
    return rows.where("name is not null").select("seq", "name", "domain", "source_kind", "snippet", "source_url")


def _first_of_each(rows: DataFrame, page: str) -> DataFrame:
    """Of each page's candidates with one key the first, in the order of at."""
    key = F.coalesce(normalise_domain(F.col("domain")), normalise_name(F.col("name")))
    first = rows.groupBy(page, key.alias("_key")).agg(F.min_by(F.struct("at", "name", "domain", "source_kind", "snippet", "source_url"), "at").alias("c"))
    return first.select(F.col(page).alias("seq"), "c.name", "c.domain", "c.source_kind", "c.snippet", "c.source_url")


def from_articles(texts: DataFrame) -> DataFrame:
    """Candidates of articles (page_id, url, text): of each line the company of a headline and the name after 'X-based'."""
    lines = texts.select("page_id", "url", F.posexplode(F.split(_said(F.col("text")), "\n")).alias("line", "said"))
    both = lines.select("page_id", "url", "line", "said", F.posexplode(F.transform(F.array(company_from_headline(F.col("said")), based_name(F.col("said"))), clean_company_name)).alias("way", "name"))
    named = both.where("name is not null")
    rows = named.select("page_id", F.struct("line", "way").alias("at"), "name", F.lit(None).cast("string").alias("domain"), F.lit("article").alias("source_kind"), F.trim("said").alias("snippet"), F.col("url").alias("source_url"))
    return _first_of_each(rows, "page_id")


def is_investor_directory(url: Column, title: Column, text: Column) -> Column:
    """A page that lists funds rather than companies."""
    return F.lower(F.concat_ws(" ", _said(url), _said(title), _said(text))).rlike(alternation(INVESTOR_HINTS))


def is_link_hub(url: Column, title: Column, text: Column) -> Column:
    """A page that lists companies, and no directory of investors."""
    return F.lower(F.concat_ws(" ", _said(url), _said(title), _said(text))).rlike(alternation(HUB_HINTS)) & ~is_investor_directory(url, title, text)


def from_links(links: DataFrame) -> DataFrame:
    """Candidates of a page's links (page_id, url, seq, target, label): other companies' sites, at most two segments deep,
    whose label is a name; a label of one word must agree with the host."""
    path = F.regexp_replace(path_of(F.col("target")), "^/+|/+$", "")
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    placed = links.select("page_id", "url", "seq", "label", made(domain=host_of(F.col("target")), own=is_company_host(F.col("target")), here=host_of(F.col("url")), depth=depth))
    out = placed.where(F.col("own") & (F.col("domain") != F.col("here")) & (F.col("depth") <= 1))
    named = out.select("page_id", "url", "seq", "label", "domain", made(name=clean_company_name(F.col("label")))).where(F.col("name").isNotNull() & names_its_host(F.col("name"), F.col("domain")))
    rows = named.select("page_id", F.col("seq").alias("at"), "name", "domain", F.lit("link_hub").alias("source_kind"), F.col("label").alias("snippet"), F.col("url").alias("source_url"))
    return _first_of_each(rows, "page_id")
