"""Files of leads and banks, canned search results, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.report import CSV_COLUMNS, export_documents, export_rows

LEAD = "company_name string, verified_email string, evidence array<struct<url: string, quote: string, authority: string>>"
BANK = "format int, note string, runs array<string>, leads array<string>"


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """Leads of JSON files that hold a bare array or {"leads": [...]}; each file is one document."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    bare = F.from_json("v", f"array<struct<{_fields(LEAD)}>>")
    wrapped = F.from_json("v", f"leads array<struct<{_fields(LEAD)}>>")["leads"]
    return text.select(F.explode(F.when(F.col("v").startswith("["), bare).otherwise(wrapped)).alias("r")).select("r.*")


def _fields(schema: str) -> str:
    return ", ".join(f"{n.strip()}: {t}" for n, t in (x.split(" ", 1) for x in schema.split(", ", 2)))


def read_bank(spark: SparkSession, path: str, *, version: int = 1) -> DataFrame:
    """company, qualified, run_id, qualification (JSON text) of bank files of this version; records that don't parse are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "format int, leads array<string>").alias("b"))
    rows = whole.where(F.col("b.format") == version).select(F.explode("b.leads").alias("json"))
    record = F.from_json("json", "run_id string, qualified boolean, company string, qualification string")
    return rows.select(record.alias("r")).where("r.company is not null").select("r.*")


def write_bank(rows: DataFrame, path: str) -> None:
    """One JSON record a line, written by all tasks."""
    rows.write.json(path)


def write_csv(leads: DataFrame, path: str) -> None:
    export_rows(leads).select(*CSV_COLUMNS).write.option("header", True).option("escape", '"').csv(path)


def write_json(leads: DataFrame, path: str) -> None:
    """Leads with the evidence behind all of it, one document a line."""
    export_documents(leads).write.json(path)


def canned_results(queries: DataFrame, canned: DataFrame) -> DataFrame:
    """Results (pattern, title, url, snippet) of the queries that contain their pattern: a search service for tests.

    canned is a fixture of a few rows; it goes to every task."""
    rows = [r.asDict() for r in canned.select("pattern", "title", "url", "snippet").collect()]
    listed = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("pattern", "title", "url", "snippet")]) for r in rows])
    hits = F.filter(listed, lambda x: F.contains(F.lower(F.col("query")), F.lower(x["pattern"])))
    return queries.select("query", F.posexplode(hits).alias("rank", "x")).select("query", "rank", "x.title", "x.url", "x.snippet")
