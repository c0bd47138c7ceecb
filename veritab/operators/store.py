"""Tables that grow from run to run: upserts, counters, caches and ordered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest(rows: DataFrame, key: str, order: str, first: dict[str, str] | None = None) -> DataFrame:
    """The last row of each key by (order, then the row's own values), with some columns of the first row under new names.

    One aggregate with partial sums on the map side, so a key with very many versions moves one row a task."""
    others = [c for c in rows.columns if c != key]
    last = F.max(F.struct(order, *[c for c in others if c != order])).alias("_last")
    kept = [F.min(F.struct(order, src)).alias(f"_{name}") for name, src in (first or {}).items()]
    out = rows.groupBy(key).agg(last, *kept)
    return out.select(key, *[F.col(f"_last.{c}").alias(c) for c in others], *[F.col(f"_{name}.{src}").alias(name) for name, src in (first or {}).items()])


def first_wins(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, F.struct(order, value)).alias(value))


def accumulate(deltas: DataFrame, key: str, sums: list[str], order: str, last: str) -> DataFrame:
    """Additive counters and the last value of another column."""
    return deltas.groupBy(key).agg(F.count("*").alias("times"), *[F.sum(c).alias(c) for c in sums], F.max_by(last, F.struct(order, last)).alias(f"last_{last}"))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """The wanted keys that the cache lacks, or has only in versions older than the time to live."""
    fresh = cache.where(F.col(at) >= now - F.expr(f"interval {int(ttl_seconds)} seconds")).select(key)
    return wanted.join(fresh, key, "left_anti")


def after(log: DataFrame, last_id: int, limit: int, key: str) -> DataFrame:
    """The next page of an append-only log."""
    return log.where(F.col(key) > last_id).orderBy(key).limit(limit)


def leads(companies: DataFrame, qualifications: DataFrame) -> DataFrame:
    """Qualifications with their companies, best first."""
    return qualifications.join(companies, "company_id").orderBy(F.desc("qualified"), F.desc("fit_score"), F.desc("confidence"), "company_id")


def frontier(candidates: DataFrame, kind_rank: Column, n: int) -> DataFrame:
    """The n most promising candidates: promise, kind, number of sources, whether there is a domain, then arrival."""
    return candidates.orderBy(F.desc("promise"), kind_rank, F.desc("n_sources"), F.col("domain").isNull(), "seq").limit(n)


def broken(calls: DataFrame, host: str, at: str, failed: Column, run: int = 3, order: str | None = None) -> DataFrame:
    """host, longest_run of hosts with `run` failures in a row. Runs are the calls between two successes.

    Each host's calls are ordered by one window; hosts with very many calls should be split by day first."""
    from pyspark.sql import Window

    line = Window.partitionBy(host).orderBy(at, *([order] if order else []))
    flagged = calls.select(host, at, *([order] if order else []), failed.alias("_failed"))
    runs = flagged.withColumn("_island", F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(line))
    return runs.where("_failed").groupBy(host, "_island").agg(F.count("*").alias("n")).groupBy(host).agg(F.max("n").alias("longest_run")).where(F.col("longest_run") >= run)
