"""Pages: text, titles, links, and which pages of a site are worth reading. Expressions only, so scans and filters merge."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import constant_map
from ..functions.text import collapse, host_of, strings
from ..vocab import PAGE_INTENTS

#: Elements whose contents are no text of the page.
DROPPED = ["script", "style", "noscript", "svg", "iframe", "nav", "footer", "form"]
#: Character references by the standard's table, with and without the semicolon that a few old names may lack; spaces that don't
#: break are plain ones here.
NAMED = {name[:-1]: signs.replace("\xa0", " ") for name, signs in html5.items() if name.endswith(";")}
BARE = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
#: Numbers from 128 to 159 stand for the signs of windows-1252.
NUMBERED = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
#: Those that most pages have no others than, besides that of '&'.
COMMON = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·"}
#: Numbers that no code point has stand for a replacement character.
_NO_SIGN = 0xFFFD


def decode(text: Column, bare_names: bool = True) -> Column:
    """Character references as their signs, each read once: decimal and hexadecimal numbers, and names; without bare_names, old
    names count with their semicolon only."""
    named, numbered = constant_map(NAMED), constant_map(NUMBERED)

    def read(after: Column) -> Column:
        ref = F.regexp_extract(after, r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 8), 16, 10)).when(ref.startswith("#"), F.substring(ref, 2, 8)).cast("int")
        valid = F.when((number <= 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), _NO_SIGN).otherwise(number)
        sign = F.when(number == 160, " ").otherwise(F.coalesce(F.when(number.between(0x80, 0x9F), F.try_element_at(numbered, number.cast("string"))), F.decode(F.unhex(F.lpad(F.hex(valid.cast("long")), 8, "0")), "UTF-32")))
        whole = F.when(ref.startswith("#"), sign).otherwise(F.try_element_at(named, ref))
        read_whole = F.concat(F.when(ref != "", whole), F.substr(after, F.length(ref) + 2))
        if not bare_names:
            return F.coalesce(read_whole, F.concat(F.lit("&"), after))
        bare = F.when(F.coalesce(whole, F.lit("")) == "", F.regexp_extract(after, f"^({'|'.join(BARE)})", 1))
        short = F.concat(F.try_element_at(named, bare), F.substr(after, F.length(bare) + 1))
        return F.coalesce(read_whole, F.when(bare != "", short), F.concat(F.lit("&"), after))

    pieces = F.split(text, "&")
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    common = text
    for ref, sign in COMMON.items():
        common = F.replace(common, F.lit(ref), F.lit(sign))
    others = common.rlike("&(?!amp;)[#A-Za-z]")
    return F.when(others, F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(rest, read), ""))).otherwise(F.replace(common, F.lit("&amp;"), F.lit("&")))


def title_of(html: Column, bare_names: bool = True) -> Column:
    return collapse(decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), bare_names))


def description_of(html: Column, bare_names: bool = True) -> Column:
    """The first description among the page's meta tags that has more than 30 characters, or null."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*?(?:name|property)\s*=\s*[\"'](?:description|og:description|twitter:description)[\"'][^>]*?content\s*=\s*[\"']([^\"']*)"), 1)
    return F.try_element_at(F.filter(F.transform(found, lambda x: collapse(decode(x, bare_names))), lambda x: F.length(x) > 30), F.lit(1))


def mailto_of(html: Column) -> Column:
    """Addresses that the page links to, as sentences. They are read before footers are dropped."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"']mailto:([^\"'?]+)"), 1))
    return F.transform(found, lambda a: F.concat(F.lit("Contact: "), a))


def text_of(html: Column, bare_names: bool = True) -> Column:
    """Description, text with a line for each run between tags, and linked addresses."""
    html = F.coalesce(html, F.lit(""))
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in [*DROPPED, "title"]:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    lines = F.split(decode(F.regexp_replace(body, r"(?s)<[^>]*>", "\n"), bare_names), "\n")
    kept = F.filter(F.transform(lines, collapse), lambda x: x != "")
    return F.array_join(F.concat(F.array_compact(F.array(description_of(html, bare_names))), kept, mailto_of(html)), "\n")


def with_text(pages: DataFrame, bare_names: bool = True) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.withColumns({"title": title_of(html, bare_names), "text": text_of(html, bare_names)})


def absolute(href: Column, base: Column) -> Column:
    """A link's target: absolute, of the same scheme, from the root, or beside the page."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(page, r"^(.*/)", 1))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("?"), F.concat(page, href)).otherwise(F.concat(folder, href))
    )


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, seq, href, target, label: every link that leads to a page."""
    pattern = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)[\"']?[^>]*>(.*?)</a>"
    html = F.coalesce("html", F.lit(""))
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1), F.regexp_extract_all(html, F.lit(pattern), 2))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("seq", "m")).select("page_id", "url", "seq", F.col("m.0").alias("raw"), F.col("m.1").alias("inner"))
    text = collapse(decode(F.regexp_replace("inner", r"(?s)<[^>]*>", " ")))
    alt = F.regexp_extract("inner", r"(?is)<img\s[^>]*?(?:alt|title)\s*=\s*[\"']([^\"']+)", 1)
    label = F.substring(F.coalesce(F.nullif(text, F.lit("")), alt), 1, 200)
    # as generated rows: each is computed once, however often it is read
    read = rows.select("page_id", "url", "seq", made(href=decode(F.col("raw")), label=label))
    kept = read.where(~F.col("href").rlike(r"(?i)^(?:#|mailto:|tel:|javascript:)"))
    return kept.select("page_id", "url", "seq", "href", made(target=absolute(F.col("href"), F.col("url"))), "label")


def made(**values: Column) -> Column:
    """Columns as one generated row: the optimizer doesn't copy what they are made of to where they are read."""
    return F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()])))


def intent(target: Column, label: Column) -> Column:
    """about, team, contact ... of a link, or null: the intent of its deepest path segment, else that of its label."""
    path = F.lower(F.regexp_extract(target, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    segments = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, r"\.(?:html?|php|aspx?)$", ""))
    said = collapse(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z ]+", " "))
    by_path, by_label = [], []
    for name, keys in PAGE_INTENTS.items():
        spelled = [*keys, *(k.replace("-", "") for k in keys if "-" in k)]
        depth = F.array_max(F.transform(segments, lambda s, i: F.when(s.isin(spelled), i + 1)))
        by_path.append(F.when(depth.isNotNull(), F.struct(depth.alias("depth"), F.lit(-len(by_path)).alias("order"), F.lit(name).alias("intent"))))
        names = [k.replace("-", " ") for k in keys]
        is_label = F.exists(strings(names), lambda k: ((said == k) | said.startswith(F.concat(k, F.lit(" ")))) & (F.length(said) <= F.length(k) + 12))
        by_label.append(F.when(is_label, name))
    return F.coalesce(F.array_max(F.array_compact(F.array(*by_path)))["intent"], F.coalesce(*by_label))


def pages_to_read(linked: DataFrame, per_intent: int = 2, total: int = 12) -> DataFrame:
    """Of each page's links on its own host: up to per_intent targets an intent and total in all, in order of intent."""
    order = F.array_position(strings(list(PAGE_INTENTS)), F.col("intent"))
    own = linked.withColumn("intent", intent(F.col("target"), F.col("label"))).where(F.col("intent").isNotNull() & (host_of(F.col("target")) == host_of(F.col("url"))))
    first = own.groupBy("page_id", "url", "intent", "target").agg(F.min("seq").alias("seq"))
    # a page has few distinct targets, so these windows stay small whatever the number of pages
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "intent").orderBy("seq", "target"))).where(F.col("n") <= per_intent)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(order, "seq", "target"))).where(F.col("rank") <= total).drop("n")
