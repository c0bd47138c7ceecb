"""Names, hosts, domains and text as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..vocab import INSTITUTION_LABELS, LEGAL_SUFFIXES, PUBLICATION_LABELS, SECOND_LEVEL, SKIPPED_ENDINGS


def strings(values) -> Column:
    """A constant array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def alternation(phrases) -> str:
    return "|".join(re.escape(p) for p in phrases)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# ---- hosts and domains
def host_of(url: Column) -> Column:
    """The host in lower case without its port and one leading www; '' if there is none."""
    host = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalise_domain(domain: Column) -> Column:
    """Without scheme, path, query and www; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(domain)), r"^https?://", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"[/?].*$", ""), r"^www\.", ""), F.lit(""))


def labels_of(domain: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(domain, F.lit(""))), r"\."), lambda x: x != "")


def registrable_root(domain: Column) -> Column:
    """The label that names the owner: acme for mail.acme.io and acme.co.uk; '' without labels."""
    own = labels_of(domain)
    n = F.size(own)
    second = F.try_element_at(own, F.lit(-2))
    return (
        F.when(n == 0, F.lit("")).when(n == 1, F.try_element_at(own, F.lit(1)))
        .when((n >= 3) & second.isin(SECOND_LEVEL), F.try_element_at(own, F.lit(-3))).otherwise(second)
    )


def suffixes_of(host: Column) -> Column:
    """The host and every host above it."""
    own = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(own)), lambda i: F.array_join(F.slice(own, i, F.size(own)), "."))


def is_institution(host: Column) -> Column:
    own = labels_of(host)
    return F.arrays_overlap(F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), strings(INSTITUTION_LABELS))


def is_fetchable(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://") & ~url.rlike("(?i)" + SKIPPED_ENDINGS), F.lit(False))


def names_a_publication(domain: Column) -> Column:
    return F.split(F.coalesce(domain, F.lit("")), r"\.")[0].rlike(alternation(PUBLICATION_LABELS))


# ---- names
def normalise_name(name: Column) -> Column:
    """Lower case, without apostrophes, other signs and forms of companies; the folded name if only such forms make it up."""
    folded = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "['’]", ""), "[^a-z0-9]+", " "))
    bare = F.regexp_replace(F.concat(F.lit(" "), folded), f"( ({'|'.join(LEGAL_SUFFIXES)}))+$", "")
    bare = F.trim(F.regexp_replace(bare, "^( the)+( |$)", " "))
    return F.when(bare == "", folded).otherwise(bare)


def canonical_id(name: Column, domain: Column) -> Column:
    """16 hex digits of the domain's SHA-1, or of the name's letters and digits where there is no domain."""
    key = F.coalesce(F.nullif(F.lower(domain), F.lit("")), F.regexp_replace(F.lower(name), "[^a-z0-9]", ""))
    return F.substring(F.sha1(key), 1, 16)


def name_from_domain(domain: Column) -> Column:
    return F.initcap(F.regexp_replace(F.split(F.coalesce(domain, F.lit("")), r"\.")[0], "[-_]+", " "))


# ---- quotes and sentences
def normalise_quote(text: Column) -> Column:
    """Folded for comparison: typographic signs as plain ones, lower case, only word characters and signs of figures."""
    plain = F.translate(F.coalesce(text, F.lit("")), "‘’‚‛“”„‟–—−‐‑   ", "''''\"\"\"\"-----   ")
    kept = F.regexp_replace(F.lower(F.regexp_replace(plain, "​", "")), r"[^\p{L}\p{N}_\s%$€£₹.,:/+-]", " ")
    return collapse(kept)


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalise_quote(text), " "), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Sentences of a text: they end at a newline, or at a stop, question or exclamation mark before white space."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), r"\n+")
    return F.filter(F.transform(parts, collapse), lambda s: s != "")


def sentence_containing(text: Column, start: Column, end: Column, most: int = 400) -> Column:
    """The sentence around text[start:end], with white space as single spaces: from behind the last '. ' or newline to the next one,
    looked for up to `most` characters to either side."""
    before = F.substr(text, F.greatest(start - most, F.lit(0)) + 1, F.least(start, F.lit(most)))
    after = F.substr(text, end + 1, F.lit(most))
    return collapse(F.concat(F.regexp_extract(before, r"(?s)^(?:.*(?:\.\s|\n))?(.*)$", 1), F.substr(text, start + 1, end - start), F.regexp_extract(after, r"(?s)^(.*?(?:\.(?=\s)|(?=\n))|.*)", 1)))


def shortened(text: Column, n: int) -> Column:
    """At most n characters, with white space as single spaces; a text that was longer ends with an ellipsis."""
    flat = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…")))


def quote_pattern(quote: Column) -> Column:
    """A pattern that finds the raw text which `normalise_quote` makes equal to the normalised quote."""
    q = normalise_quote(quote)
    q = F.regexp_replace(q, r"([.$+])", r"\\$1")
    q = F.replace(q, F.lit("-"), F.lit("[-–—−‐‑]"))
    return F.regexp_replace(q, " ", r"[^\\p{L}\\p{N}_%\$€£₹.,:/+–—−‐‑-]+")


def raw_span(quote: Column, text: Column) -> Column:
    """What stands in the text for the quote, as it is written there; null if the quote isn't in it.

    White space, signs that don't count, capitals, dashes and zero-width spaces may differ."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "\u200b", "")
    found = F.call_function("regexp_extract", plain, F.concat(F.lit("(?iu)"), quote_pattern(quote)), F.lit(0))
    return F.when((normalise_quote(quote) != "") & (found != ""), found)


def snippet_around(quote: Column, text: Column, window: int = 320) -> Column:
    """The text around a quote, a quarter of the window before it, as written but for white space; the quote where it isn't found."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "\u200b", "")
    span = raw_span(quote, text)
    start = F.greatest(F.call_function("instr", plain, span) - window // 4, F.lit(1))
    return F.when(span.isNotNull(), collapse(F.substr(plain, start, F.lit(window)))).otherwise(shortened(F.trim(quote), window))


def distinct_evidence(evidence: Column, chars: int | None = 80) -> Column:
    """The evidence (url, quote, ...) without repeats of a url with the same first characters of a quote (None: whole quotes); the
    first of each stays, in its order."""
    key = lambda e: F.struct(e["url"], e["quote"] if chars is None else F.substring(e["quote"], 1, chars))
    keys = F.transform(evidence, key)
    return F.filter(evidence, lambda e, i: F.array_position(keys, key(e)) == i + 1)
