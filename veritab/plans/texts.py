"""Queries over documents: addresses, signals, quotes, sentences, copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.email import domain_part, is_disposable, is_freemail, is_role_account
from ..functions.text import registrable_root
from ..functions.text import sentences as sentences_of
from ..functions.places import us_level, us_patterns
from ..operators.extract import description, emails, presence
from ..operators.ground import find_quotes
from ..operators.report import audit, audit_evidence
from ..shared import table
from ..vocab import CITY_COUNTRY, COUNTRIES, DISPOSABLE_DOMAINS, FREEMAIL_DOMAINS, HARD_US_SIGNALS, ROLE_LOCAL_PARTS, SECOND_LEVEL, TLDS, US_CITIES


def emails_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emails(table(spark, sf_dir, "documents")).select("doc_id", F.col("seq").cast("long").alias("seq"), "address")


def email_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("address")
    once = emails(table(spark, sf_dir, "documents")).groupBy("address").agg(F.count("*").alias("n_docs"))
    return once.select("address", "n_docs", domain_part(a).alias("domain"), registrable_root(domain_part(a)).alias("root"), is_role_account(a).alias("is_role"), is_freemail(a).alias("is_free"), is_disposable(a).alias("is_disposable"))


def us_signals_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence(table(spark, sf_dir, "documents"))


def us_presence_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    country = F.when(F.col("lang") == "de", "Germany").when(F.col("lang") == "fr", "France").when(F.col("lang") == "en", "United Kingdom")
    kinds = presence(docs).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    level = us_level(country, F.coalesce("kinds", F.array().cast("array<string>")), HARD_US_SIGNALS, 1)
    return docs.select("doc_id", "lang").join(kinds, "doc_id", "left").select("doc_id", level.alias("us_level"))


def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return find_quotes(sources, quotes).select(F.col("source_id").alias("doc_id"), F.col("quote_id").alias("item_id"), "mode", F.col("run").cast("long").alias("run"), F.col("words").cast("long").alias("words"))


def ungrounded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id")
    return items.join(quote_grounding(spark, sf_dir).select("item_id"), "item_id", "left_anti")


def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a record that cites two documents: those whose ids are its own and ten times its own."""
    url = lambda c: F.concat(F.lit("doc/"), c)
    records = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("company_id"), F.array(F.struct(url(F.col("item_id")).alias("url"), F.col("text").alias("quote")), F.struct(url(F.col("item_id") * 10).alias("url"), F.col("text").alias("quote"))).alias("evidence"))
    return audit(records, table(spark, sf_dir, "documents").select(url(F.col("doc_id")).alias("url"), "text"))


def audit_by_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a record that cites the document of its own id and one that isn't there."""
    url = lambda c: F.concat(F.lit("doc/"), c)
    cited = lambda c: F.struct(url(c).alias("url"), F.col("text").alias("quote"))
    records = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("company_id"), F.array(cited(F.col("item_id")), cited(-F.col("item_id") - 1)).alias("evidence"))
    return audit_evidence(records, table(spark, sf_dir, "documents").select(url(F.col("doc_id")).alias("url"), "text"))


def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.countDistinct("source").alias("sources"))
    return groups.where("copies > 1").select("first_doc", "copies", "sources")


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sentences_of(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", own.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


def best_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", description(F.col("text")).alias("sentence"))


def label_quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return met.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), F.round(F.avg("quality"), 6).alias("share_good"))


QUERIES = {f.__name__: f for f in (emails_in_documents, email_kinds, us_signals_in_documents, us_presence_by_document, quote_grounding, ungrounded_quotes, evidence_audit, audit_by_quote, duplicate_documents, sentence_stats, best_sentence, label_quality_by_source)}

_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_EMAILS = rf"""
    m as (select doc_id, regexp_extract_all(text, '([A-Za-z0-9._%+\-]{{1,64}})\s*@\s*((?:[A-Za-z0-9\-]{{1,63}}\s*\.\s*){{1,4}}[A-Za-z]{{2,63}})', 1) as locals,
                 regexp_extract_all(text, '([A-Za-z0-9._%+\-]{{1,64}})\s*@\s*((?:[A-Za-z0-9\-]{{1,63}}\s*\.\s*){{1,4}}[A-Za-z]{{2,63}})', 2) as domains from documents where text like '%@%'),
    p as (select doc_id, unnest(range(0, len(locals))) as pos, trim(unnest(locals), '.') as loc, string_split(lower(regexp_replace(unnest(domains), '\s+', '', 'g')), '.') as d from m),
    k as (select *, list_max(list_filter(range(2, len(d) + 1), lambda i: list_contains({_list(TLDS)}, d[i]))) as n from p),
    a as (select doc_id, min(pos) as pos, lower(loc) || '@' || array_to_string(d[1:n], '.') as address from k where n is not null group by doc_id, address),
    found as (select doc_id, row_number() over (partition by doc_id order by pos) - 1 as seq, address from a)"""
#: Of the signals only telephone numbers and mentions by name can occur in these texts: each rule over its word lists.
_KINDS = us_patterns()
_re2 = lambda p: p.replace("(?!\\w)", r"(?:\W|$)").replace("'", "''")
_SIGNALS = " union all ".join(f"select doc_id, '{k}' as kind from documents where " + " or ".join(f"regexp_matches(text, '(?i){_re2(p)}')" for p in ps) for k, ps in _KINDS.items())
_norm = lambda x: (
    "trim(regexp_replace(regexp_replace(lower(replace(translate(coalesce(" + x + ", ''), '‘’‚‛“”„‟–—−‐‑   ', repeat(chr(39), 4) || '\"\"\"\"-----   '), '​', '')), '[^\\p{L}\\p{N}_\\s%$€£₹.,:/+-]', ' ', 'g'), '\\s+', ' ', 'g'))"
)
#: Runs word by word: a common word on a diagonal, and the longest unbroken stretch of them.
_RUNS = f"""
    dn as (select doc_id, {_norm("text")} as s from documents), bn as (select item_id, {_norm("text")} as q from benchmark),
    dt as (select doc_id, unnest(string_split(s, ' ')) as w, unnest(range(0, len(string_split(s, ' ')))) as i from dn),
    bt as (select item_id, unnest(string_split(q, ' ')) as w, unnest(range(0, len(string_split(q, ' ')))) as j from bn),
    met as (select doc_id, item_id, i, i - j as d, i - row_number() over (partition by doc_id, item_id, i - j order by i) as island from dt join bt using (w) {{where}}),
    runs as (select doc_id, item_id, max(k) as run from (select doc_id, item_id, d, island, count(*) as k from met group by all) group by all),
    judged as (select r.doc_id, r.item_id, case when contains(s, q) then 'exact' when run >= 6 and run / len(string_split(q, ' ')) >= 0.65 then 'approximate' end as mode, run, len(string_split(q, ' ')) as words
               from runs r join dn using (doc_id) join bn using (item_id)),
    grounded as (select * from judged where mode is not null and run >= 6)"""
_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"
_PLACES = [p.lower().replace(" ", "") for p in [*CITY_COUNTRY, *COUNTRIES, *US_CITIES]]

SQL = {
    "emails_in_documents": f"with {_EMAILS} select doc_id, seq, address from found",
    "email_kinds": rf"""
        with {_EMAILS}, once as (select address, count(*) as n_docs from found group by 1),
        l as (select *, split_part(address, '@', 2) as domain, string_split(split_part(address, '@', 2), '.') as d, split_part(address, '@', 1) as whole from once)
        select address, n_docs, domain, case when len(d) >= 3 and list_contains({_list(SECOND_LEVEL)}, d[-2]) then d[-3] else d[-2] end as root,
               list_has_any(list_concat([whole, regexp_replace(whole, '\d+$', '')], list_concat(regexp_split_to_array(whole, '[+._\-]'), list_transform(regexp_split_to_array(whole, '[+._\-]'), lambda x: regexp_replace(x, '\d+$', '')))), {_list([*ROLE_LOCAL_PARTS, *_PLACES])}) as is_role,
               list_contains({_list(FREEMAIL_DOMAINS)}, domain) as is_free, list_contains({_list(DISPOSABLE_DOMAINS)}, domain) as is_disposable
        from l""",
    "us_signals_in_documents": _SIGNALS,
    "us_presence_by_document": f"""
        with s as ({_SIGNALS}), k as (select doc_id, bool_or(kind in {tuple(HARD_US_SIGNALS)}) as hard, count(distinct case when kind not in {tuple(HARD_US_SIGNALS)} then kind end) as weak from s group by 1)
        select doc_id, case when lang not in ('de', 'fr', 'en') or lang is null then null when coalesce(hard, false) or coalesce(weak, 0) > 1 then 'significant' when coalesce(weak, 0) > 0 then 'minimal' else 'none' end as us_level
        from documents left join k using (doc_id)""",
    "quote_grounding": f"with {_RUNS.replace('{where}', '')} select doc_id, item_id, mode, run, words from grounded",
    "ungrounded_quotes": f"with {_RUNS.replace('{where}', '')} select item_id from benchmark where item_id not in (select item_id from grounded)",
    "evidence_audit": f"""
        with {_RUNS.replace('{where}', 'where doc_id = item_id or doc_id = 10 * item_id')},
        cited as (select item_id, unnest([item_id, 10 * item_id]) as doc_id from benchmark)
        select item_id as company_id, count(*) as n_evidence, count(mode) as n_found, count(mode) > 0 and count(mode) = count(*) as clean
        from cited left join grounded using (item_id, doc_id) group by 1""",
    "audit_by_quote": f"""
        with {_RUNS.replace('{where}', 'where doc_id = item_id')}
        select b.item_id as company_id, 0 as seq, 'doc/' || b.item_id as url, d.doc_id is not null as reachable, mode is not null as quote_found, mode
        from benchmark b left join documents d on d.doc_id = b.item_id left join grounded g on g.item_id = b.item_id and g.doc_id = b.item_id
        union all select item_id, 1, 'doc/' || (-item_id - 1), false, false, null from benchmark""",
    "duplicate_documents": "select min(doc_id) as first_doc, count(*) as copies, count(distinct source) as sources from documents group by text having count(*) > 1",
    "sentence_stats": f"select doc_id, cast(len({_SENTENCES}) as bigint) as n_sentences, coalesce(list_max(list_transform({_SENTENCES}, lambda x: length(x))), 0) as longest from documents",
    "best_sentence": f"select doc_id, substr(list_filter({_SENTENCES}, lambda x: length(x) >= 40)[1], 1, 400) as sentence from documents",
    "label_quality_by_source": "select source, count(*) as n, cast(sum(quality) as bigint) as good, cast(sum(toxic) as bigint) as toxic, round(avg(quality), 6) as share_good from documents join labels using (doc_id) group by 1",
}
