"""Queries over banks: leads derived from customers are written, replayed twice, and read from the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bank
from ..shared import new_path, table
from ..vocab import GATES


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in 50 customers qualifies; the others fail one to four gates."""
    n = F.col("c_custkey")
    failed = F.when(n % 50 == 0, 0).otherwise(1 + n % 4)
    gates = F.array(*[F.struct(F.lit(g).alias("gate"), (F.lit(i) >= failed).alias("passed"), F.concat(F.lit("said to firm"), n, F.lit("@acme.io")).alias("reason")) for i, g in enumerate(GATES)])
    company = F.struct(F.format_string("c%06d", n).alias("company_id"), F.col("c_name").alias("name"), F.concat(F.lit("firm"), n, F.lit(".io")).alias("domain"), F.concat(F.lit("lena@firm"), n, F.lit(".io")).alias("address"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("run-"), n % 9).alias("run_id"), (n % 50 == 0).alias("qualified"), company.alias("company"), F.struct(gates.alias("gates")).alias("qualification"))


def bank_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after a bank was replayed twice; `repeated` is how many rows the second time added."""
    runs = table(spark, sf_dir, "events").where("event_id < 20").select(F.concat(F.lit("run-"), "event_id").alias("id"), F.col("ts").alias("at"), "event_type")
    path, store = new_path(spark, "bank"), new_path(spark, "store")
    bank.write(_leads(spark, sf_dir), runs, path)
    bank.replay(spark, path, store)
    again = sum(bank.replay(spark, path, store).values())
    verdicts, companies = bank.stored(spark, store, "verdicts"), bank.stored(spark, store, "companies")
    met = verdicts.join(companies.select("company_id", "name", "domain", "company"), "company_id").join(bank.stored(spark, store, "runs").select(F.col("id").alias("run_id"), F.get_json_object("run", "$.event_type").alias("run_type")), "run_id", "left")
    return met.select("company_id", "run_id", "qualified", "n_failed", "name", "domain", "run_type", F.contains("company", F.lit("@")).alias("address_kept"), F.contains("qualification", F.lit("@")).alias("reason_kept"), F.lit(again).cast("long").alias("repeated"))


QUERIES = {f.__name__: f for f in (bank_replay,)}

SQL = {
    "bank_replay": """
        with c as (select 'c' || lpad(cast(c_custkey as varchar), 6, '0') as company_id, 'run-' || c_custkey % 9 as run_id, c_custkey % 50 = 0 as qualified, case when c_custkey % 50 = 0 then 0 else 1 + c_custkey % 4 end as n_failed, c_name as name, 'firm' || c_custkey || '.io' as domain from customer),
        kept as (select * from c where qualified union all (select * from c where not qualified order by n_failed, company_id, run_id limit 80))
        select company_id, run_id, qualified, cast(n_failed as integer) as n_failed, name, domain, event_type as run_type, qualified as address_kept, qualified as reason_kept, 0::bigint as repeated
        from kept left join events on event_id < 20 and 'run-' || event_id = run_id""",
}
