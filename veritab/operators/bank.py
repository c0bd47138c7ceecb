"""Banks: leads and instructive rejections as JSON lines that replay into a store, any number of times to the same effect.

A bank is a folder of text files, one record a line: one of kind `format`, runs, and leads. A store is a folder of
versions (`v=<n>`) of a table; `upsert` appends only rows that differ from the current ones, so a repeated replay writes
nothing, and `current` is the last version of each key. Every write is one Spark job whose folder counts once committed.

Rejections travel for their reasons: addresses in them are masked. Records of another format, lines that aren't JSON and
leads without a company id or gates are left out, never guessed at.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import exists
from .report import mask_addresses

FORMAT = 1
LINE = "kind string, format int, id string, run string, run_id string, qualified boolean, company string, qualification string"
COMPANY = "company_id string, name string, domain string, run_id string, company string"
VERDICT = "company_id string, run_id string, qualified boolean, n_failed int, qualification string"


def lines(leads: DataFrame, runs: DataFrame, rejections: int = 80, recent: int = 200) -> DataFrame:
    """value: a bank of leads (run_id, qualified, company struct<company_id, ...>, qualification struct<gates, ...>) and the runs
    (id, at, ...) that they refer to, among the `recent` last ones. All qualified leads, and of the others the `rejections` with the
    fewest failed gates: a top-k report."""
    n_failed = F.size(F.filter("qualification.gates", lambda g: ~g["passed"]))
    text = leads.select("run_id", "qualified", n_failed.alias("n"), F.col("company.company_id").alias("id"), F.to_json("company").alias("company"), F.to_json("qualification").alias("qualification"))
    lost = text.where("not qualified").orderBy("n", "id", "run_id").limit(rejections)
    kept = text.where("qualified").unionByName(lost.withColumns({c: mask_addresses(F.col(c)) for c in ("company", "qualification")}))
    # the records' own JSON stays an object in the line
    quoted = lambda c: F.to_json(F.struct(F.col(c)))
    inner = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    kept = kept.select("run_id", "qualified", "company", "qualification", quoted("run_id").alias("r"))
    lead = F.concat(F.lit('{"kind":"lead",'), inner("r"), F.lit(',"qualified":'), F.col("qualified").cast("string"), F.lit(',"company":'), "company", F.lit(',"qualification":'), "qualification", F.lit("}"))
    last = runs.orderBy(F.desc("at"), F.desc("id")).limit(recent).join(kept.select(F.col("run_id").alias("id")), "id", "left_semi")
    run = F.to_json(F.struct(F.lit("run").alias("kind"), "id", F.struct(*[F.col(c) for c in last.columns]).alias("run")))
    head = leads.sparkSession.range(1).select(F.to_json(F.struct(F.lit("format").alias("kind"), F.lit(FORMAT).alias("format"))).alias("value"))
    return head.unionByName(last.select(run.alias("value"))).unionByName(kept.select(lead.alias("value")))


def write(leads: DataFrame, runs: DataFrame, path: str, rejections: int = 80, recent: int = 200) -> None:
    lines(leads, runs, rejections, recent).write.text(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, verdicts, runs) of a bank; empty tables for one of another format."""
    rows = spark.read.text(path).select(F.from_json("value", LINE).alias("r")).select("r.*")
    known = not rows.where((F.col("kind") == "format") & (F.col("format") == FORMAT)).isEmpty()
    rows = rows if known else rows.where("false")
    gates = F.from_json("qualification", "struct<gates:array<struct<gate:string,passed:boolean,reason:string>>>")["gates"]
    leads = rows.where("kind = 'lead'").select(
        F.get_json_object("company", "$.company_id").alias("company_id"), F.get_json_object("company", "$.name").alias("name"), F.get_json_object("company", "$.domain").alias("domain"),
        F.coalesce("run_id", F.lit("shipped")).alias("run_id"), "qualified", F.size(F.filter(gates, lambda g: ~g["passed"])).alias("n_failed"), "company", "qualification",
    ).where("company_id is not null and n_failed is not null and qualified is not null")
    return leads.select("company_id", "name", "domain", "run_id", "company"), leads.select("company_id", "run_id", "qualified", "n_failed", "qualification"), rows.where("kind = 'run' and id is not null").select("id", "run")


def _versions(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, path):
        return []
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(int(n[2:]) for n in names if re.fullmatch(r"v=\d+", n) and exists(spark, f"{path}/{n}/_SUCCESS"))


def current(spark: SparkSession, path: str, key: list[str], schema: str) -> DataFrame:
    """The last version of each key."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    rows = None
    for v in versions:
        one = spark.read.schema(schema).parquet(f"{path}/v={v}").withColumn("_v", F.lit(v))
        rows = one if rows is None else rows.unionByName(one)
    others = [c for c in rows.columns if c not in (*key, "_v")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "_v").alias("_last")).select(*key, "_last.*")


def upsert(rows: DataFrame, path: str, key: list[str], schema: str) -> int:
    """Adds the rows that differ from the current ones of their keys, of several of a key the greatest; how many there were."""
    spark = rows.sparkSession
    columns = current(spark, path, key, schema).columns
    others = [c for c in columns if c not in key]
    once = rows.select(*columns).groupBy(*key).agg(F.max(F.struct(*others)).alias("_last")).select(*key, "_last.*")
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("_digest")
    new = once.withColumn("_digest", digest).join(current(spark, path, key, schema).select(*key, digest), [*key, "_digest"], "left_anti").drop("_digest")
    to = f"{path}/v={max(_versions(spark, path), default=0) + 1}"
    if new.isEmpty():
        return 0
    new.write.mode("overwrite").parquet(to)
    return spark.read.schema(schema).parquet(to).count()


TABLES = {"companies": (["company_id"], COMPANY), "verdicts": (["company_id", "run_id"], VERDICT), "runs": (["id"], "id string, run string")}


def replay(spark: SparkSession, bank: str, store: str) -> dict[str, int]:
    """Replays a bank into the store's tables; how many rows of each were new or changed."""
    return {name: upsert(rows, f"{store}/{name}", *TABLES[name]) for name, rows in zip(TABLES, read(spark, bank))}


def stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    return current(spark, f"{store}/{name}", *TABLES[name])
