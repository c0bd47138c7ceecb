"""Reports over verdicts: funnels, audits and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.email import SYNTAX, is_role_account
from ..functions.money import human
from ..functions.text import distinct_evidence, shortened
from ..vocab import EMAIL_STATUS_RANK, GATES
from .ground import ground_claims

#: The columns of the exported table.
CSV_COLUMNS = [
    "company_name", "description", "industry_sector", "funding_or_revenue", "funding_type", "ceo_or_cofounder", "founder_title", "verified_email", "website",
    "country", "us_presence", "confidence", "fit_score", "evidence_urls",
]
_ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}"


def gate_failures(judged: DataFrame) -> DataFrame:
    """gate, n: how often each gate failed."""
    return judged.select(F.explode("failed").alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))


def failed_only_on(judged: DataFrame, gate: str) -> Column:
    return F.count_if(F.col("failed") == F.array(F.lit(gate)))


def near_misses(judged: DataFrame, top: int = 6) -> DataFrame:
    """gate, reason, n of entities that failed one gate alone, most frequent first: a top-k report."""
    one = judged.where(F.size("failed") == 1).select(F.col("failed")[0].alias("gate"), F.substring("first_failure", 1, 90).alias("reason"))
    return one.groupBy("gate", "reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gate", "reason").limit(top)


def export_rows(judged: DataFrame, describe: int | None = 400, urls: int | None = 8) -> DataFrame:
    """The exported columns and `qualified`, of judged profiles with `evidence` and `confidence`; facts that are unknown are empty.

    Descriptions are shortened to `describe` characters, the sorted urls to `urls` of them, as the format asks; None keeps all."""
    return _exported(judged, describe, urls, [])


def _exported(judged: DataFrame, describe: int | None, urls: int | None, more: list[Column]) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["url"])))
    text = said("description") if describe is None else F.substring(said("description"), 1, describe)
    row = {
        "company_name": said("name"), "description": text, "industry_sector": said("sector"), "funding_or_revenue": F.when(F.col("usd").isNotNull(), human(F.col("usd").cast("double"))).otherwise(""), "funding_type": said("amount_type"),
        "ceo_or_cofounder": said("founder"), "founder_title": said("title"), "verified_email": F.when(F.col("email_status") == "verified", F.col("address")).otherwise(""), "website": F.coalesce(F.concat(F.lit("https://"), "domain"), F.lit("")),
        "country": said("country"), "us_presence": said("us_level"), "confidence": F.round("confidence", 3), "fit_score": F.round("fit_score", 3), "evidence_urls": F.array_join(own if urls is None else F.slice(own, 1, urls), " | "),
    }
    return judged.select(*[v.alias(k) for k, v in row.items()], "qualified", *more)


def export_documents(judged: DataFrame, quote: int = 400) -> DataFrame:
    """The exported columns with the whole trail: evidence (url, quote, authority) without repeats, gates, the address's state."""
    e = F.transform(distinct_evidence(F.col("evidence")), lambda x: F.struct(x["url"].alias("url"), shortened(x["quote"], quote).alias("quote"), x["authority"].alias("authority")))
    detail = F.struct(F.col("email_status").alias("status"), F.col("email_note").alias("note"))
    return _exported(judged, 400, 8, [e.alias("evidence"), F.col("gates"), detail.alias("email_detail"), F.col("near_boundary")])


def mask_addresses(text: Column) -> Column:
    return F.regexp_replace(text, _ADDRESS, "[address withheld]")


def bank(judged: DataFrame, rejected: int = 80) -> DataFrame:
    """Leads, and the rejections with the fewest failed gates, addresses in them masked: what a bank file keeps."""
    lost = judged.where(~F.col("qualified")).orderBy(F.size("failed"), "company_id").limit(rejected)
    masked = [mask_addresses(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in lost.dtypes]
    return judged.where("qualified").unionByName(lost.select(*masked))


def audit_evidence(records: DataFrame, pages: DataFrame) -> DataFrame:
    """company_id, seq, url, reachable, quote_found, mode of every quote of records (company_id, evidence array<struct<url, quote>>),
    looked for again in the page (url, text) that it cites. A page that isn't there isn't reachable."""
    quotes = records.select("company_id", F.posexplode("evidence").alias("seq", "e")).select("company_id", "seq", F.concat_ws("#", "company_id", "seq").alias("claim_id"), F.col("e.url").alias("url"), F.col("e.quote").alias("quote"))
    there = pages.select("url", "text").join(quotes.select("url").distinct(), "url", "left_semi")
    cited = quotes.select("company_id", "url").distinct().join(there, "url").withColumn("seq", F.lit(0))
    kept, _ = ground_claims(quotes, cited)
    found = quotes.join(kept.where("grounded_in = url").select("claim_id", "mode"), "claim_id", "left").join(there.select("url", F.lit(True).alias("_read")).distinct(), "url", "left")
    return found.select("company_id", "seq", "url", F.coalesce("_read", F.lit(False)).alias("reachable"), F.col("mode").isNotNull().alias("quote_found"), "mode")


def audit_records(records: DataFrame, pages: DataFrame, checks: DataFrame) -> DataFrame:
    """company_id, address, syntax_ok, not_role, mx_ok, n_evidence, n_found, issues, clean: a record (with `address`) is clean if it
    has a quote that was found and no issue. checks: address, has_mx."""
    sums = audit_evidence(records, pages).groupBy("company_id").agg(
        F.count("*").alias("n_evidence"), F.count_if("quote_found").alias("n_found"), F.count_if(~F.col("reachable")).alias("_unread"), F.count_if(F.col("reachable") & ~F.col("quote_found")).alias("_amiss"),
    )
    mail = checks.select(F.lower("address").alias("_a"), "has_mx").groupBy("_a").agg(F.max("has_mx").alias("has_mx"))
    met = records.select("company_id", F.coalesce("address", F.lit("")).alias("address")).join(sums, "company_id", "left").fillna(0, ["n_evidence", "n_found", "_unread", "_amiss"]).join(mail, F.lower("address") == F.col("_a"), "left")
    met = met.select("*", F.col("address").rlike(SYNTAX).alias("syntax_ok"), (~is_role_account(F.col("address"))).alias("not_role"), F.coalesce("has_mx", F.lit(False)).alias("mx_ok"))
    issues = [
        (~F.col("syntax_ok"), F.lit("the address isn't one")), (~F.col("not_role"), F.lit("the address is a shared mailbox")), (F.col("syntax_ok") & ~F.col("mx_ok"), F.lit("its domain takes no mail")),
        (F.col("_unread") > 0, F.concat("_unread", F.lit(" cited pages can't be read"))), (F.col("_amiss") > 0, F.concat("_amiss", F.lit(" quotes aren't on their page"))), (F.col("n_evidence") == 0, F.lit("no evidence")),
    ]
    said = F.array_compact(F.array(*[F.when(test, text) for test, text in issues]))
    return met.withColumn("issues", said).select("company_id", "address", "syntax_ok", "not_role", "mx_ok", "n_evidence", "n_found", "issues", ((F.size("issues") == 0) & (F.col("n_found") > 0)).alias("clean"))


def audit_totals(audited: DataFrame) -> DataFrame:
    """One row: records, clean ones, quotes, quotes found."""
    return audited.agg(F.count("*").alias("records"), F.count_if("clean").alias("clean"), F.coalesce(F.sum("n_evidence"), F.lit(0)).alias("quotes"), F.coalesce(F.sum("n_found"), F.lit(0)).alias("found"))


def address_outcomes(judged: DataFrame) -> DataFrame:
    """rank, status, n: how many addresses ended in each state, all states in their order."""
    spark = judged.sparkSession
    states = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(s).alias("status")) for s, r in EMAIL_STATUS_RANK.items()])).alias("x")).select("x.*")
    counted = judged.groupBy(F.col("email_status").alias("status")).agg(F.count("*").alias("n"))
    return states.join(counted, "status", "left").select("rank", "status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def ruled_out(candidates: DataFrame, top: int | None = 3) -> DataFrame:
    """reason, n of the candidates that their excerpts ruled out (`hopeless`), most frequent first: a top-k report unless top is None."""
    counted = candidates.where("hopeless is not null").groupBy(F.col("hopeless").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")
    return counted if top is None else counted.limit(top)


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    """The last n runs (at, id, ...)."""
    return runs.orderBy(F.desc("at"), F.desc("id")).limit(n)


def missing_gates(gates: Column) -> Column:
    """The gates that a verdict lacks; a verdict is whole only if there are none."""
    return F.array_except(F.array(*map(F.lit, GATES)), F.transform(gates, lambda g: g["gate"]))


def whole_verdicts(judged: DataFrame) -> DataFrame:
    """judged, where a row that lacks a gate ends the job."""
    lacks = missing_gates(F.col("gates"))
    return judged.where(F.when(F.size(lacks) == 0, True).otherwise(F.raise_error(F.concat(F.lit("gates are missing: "), F.array_join(lacks, ", "))).cast("boolean")))


def verification_strength(status: Column, deliverability: Column, verifier: Column, standing: Column) -> Column:
    """How strong a verified address is: confirmed by a service, answered otherwise by one, or published (or named by a contact
    database) without a check of delivery."""
    asked = F.coalesce(verifier, F.lit("none")) != "none"
    return (
        F.when(F.coalesce(status, F.lit("")) != "verified", "not verified").when(asked & (deliverability == "deliverable"), F.concat(F.lit("confirmed deliverable by "), verifier))
        .when(asked & (F.coalesce(deliverability, F.lit("")) != ""), F.concat(verifier, F.lit(" answered '"), deliverability, F.lit("', which confirms no delivery")))
        .when(standing == "aggregator", "a contact database and a domain that takes mail; delivery wasn't checked").otherwise("an authoritative source and a domain that takes mail; delivery wasn't checked")
    )


def audit(records: DataFrame, pages: DataFrame) -> DataFrame:
    """company_id, n_evidence, n_found, clean. records: company_id, evidence array<struct<url, quote>>; pages: url, text.

    Every quote is looked for again in the page it cites; a record is clean with at least one quote and none amiss."""
    quotes = records.select("company_id", F.posexplode("evidence").alias("seq", "e")).select("company_id", F.concat_ws("#", "company_id", "seq").alias("claim_id"), F.col("e.url").alias("url"), F.col("e.quote").alias("quote"))
    cited = quotes.select("company_id", "url").distinct().join(pages.select("url", "text"), "url").withColumn("seq", F.lit(0))
    kept, _ = ground_claims(quotes, cited)
    found = quotes.join(kept.where("grounded_in = url").select("claim_id", "mode"), "claim_id", "left")
    sums = found.groupBy("company_id").agg(F.count("*").alias("n_evidence"), F.count("mode").alias("n_found"))
    return records.select("company_id").join(sums, "company_id", "left").fillna(0, ["n_evidence", "n_found"]).withColumn("clean", (F.col("n_found") > 0) & (F.col("n_found") == F.col("n_evidence")))


def kpis(judged: DataFrame) -> DataFrame:
    """One row: leads, with address, countries, mean fit."""
    return judged.agg(F.count_if("qualified").alias("leads"), F.count_if(F.col("email_status") == "verified").alias("verified"), F.countDistinct("country").alias("countries"), F.round(F.avg("fit_score"), 6).alias("mean_fit"))
