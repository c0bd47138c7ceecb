"""python -m veritab.cli leads|export|audit|bank|replay: reads stored tables (Parquet folders) and reports on them.

Exit codes: 0 done, 1 nothing to report or an audit that found a fault, 2 wrong usage."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from .operators import bank, report, store
from .operators.qualify import Band, recheck
from .sources import files


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veritab")
    p.add_argument("command", choices=["leads", "export", "audit", "bank", "replay"])
    p.add_argument("--companies", help="table of companies")
    p.add_argument("--verdicts", help="table of verdicts")
    p.add_argument("--leads", help="JSON file of leads, for audit")
    p.add_argument("--pages", help="table of pages (url, text), for audit")
    p.add_argument("--runs", help="table of runs (id, at, ...), for bank")
    p.add_argument("--bank", help="folder of a bank, for replay")
    p.add_argument("--out", help="folder to write to; the store for replay")
    p.add_argument("--limit", type=int, default=20, help="rows to print")
    a = p.parse_args(args)
    needed = {"leads": ["companies", "verdicts"], "export": ["companies", "verdicts", "out"], "audit": ["leads", "pages"], "bank": ["companies", "verdicts", "runs", "out"], "replay": ["bank", "out"]}
    missing = [n for n in needed[a.command] if getattr(a, n) is None]
    if missing:
        print("needed: " + ", ".join(f"--{n}" for n in missing), file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("veritab").getOrCreate()
    if a.command == "audit":
        records = files.read_leads(spark, a.leads).withColumnRenamed("company_name", "company_id")
        judged = report.audit(records, spark.read.parquet(a.pages))
        judged.orderBy("clean", "company_id").show(a.limit, truncate=False)
        return int(judged.where("not clean").count() > 0)
    if a.command == "replay":
        print(bank.replay(spark, a.bank, a.out))
        return 0
    rows = store.leads(spark.read.parquet(a.companies), spark.read.parquet(a.verdicts))
    if a.command == "bank":
        facts = [c for c in rows.columns if c not in ("run_id", "qualified", "gates")]
        leads = rows.select(F.col("run_id").cast("string").alias("run_id"), "qualified", F.struct(*facts).alias("company"), F.struct("gates").alias("qualification"))
        bank.write(leads, spark.read.parquet(a.runs), a.out)
        return 0
    kept, _ = recheck(rows.where("qualified"), Band())
    if a.command == "export":
        files.write_csv(kept, a.out)
        return 0
    kept.show(a.limit, truncate=60)
    return int(kept.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
