"""Queries over planning and over tables that grow from run to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.plan import cell_space as all_cells
from ..operators.plan import diversified, score, sibling_yield
from ..operators.store import accumulate, after, broken, cache_misses, first_wins, frontier, latest, leads
from ..shared import new_path, table
from ..streaming import jobs
from ..streaming.cache import lives, stale_at
from ..streaming.frontier import frontier as stream_entries
from ..vocab import FIXED_WINDOWS, GEOGRAPHIES, PHRASINGS, ROLLING_WINDOWS, SECTORS, SHAPE_BONUS, SHAPES


def cell_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole space, counted by sector and geography, with how often events (as searches) tried each of these."""
    of = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    tried = table(spark, sf_dir, "events").groupBy(of(SECTORS, F.col("user_id")).alias("sector"), of(GEOGRAPHIES, F.col("event_id")).alias("geography")).agg(F.count("*").alias("tried"))
    cells = all_cells(spark).groupBy("sector", "geography").agg(F.count("*").alias("cells"), F.countDistinct("cell_key").alias("n_keys"), F.min("cell_key").alias("first_key"))
    return cells.join(tried, ["sector", "geography"], "left").withColumn("tried", F.coalesce("tried", F.lit(0).cast("long")))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by event type (as sector), user group (as geography) and shape."""
    shape = F.coalesce(*[F.when(F.col("event_id") % 9 == i, s) for i, s in enumerate(SHAPES)])
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("sector"), (F.col("user_id") % 7).alias("geography"), shape.alias("shape"), "value")
    return rows.groupBy("sector", "geography", "shape").agg(F.count("*").alias("used"), F.count_if(F.col("value") > 50).alias("found"), F.count_if(F.col("value") > 200).alias("qualified"))


def sibling_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sibling_yield(_stats(spark, sf_dir)).select("sector", "geography", "shape", "used", F.round("yield", 9).alias("yield"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sibling_yield(_stats(spark, sf_dir))
    window = F.when(F.col("geography") % 3 == 0, "this week").when(F.col("geography") % 3 == 1, "2026").otherwise("2025")
    worth = score(F.col("used"), F.col("yield"), window, F.col("shape"), F.col("geography") == 2)
    return cells.select(F.concat_ws("|", "sector", "geography", "shape").alias("cell_key"), "shape", F.round(worth, 9).alias("score"))


def cell_rank_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 21 cells: a top-k report."""
    return diversified(_scored(spark, sf_dir), 21).select("cell_key", "shape", "score")


def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.round("value").alias("promise"), (F.col("user_id") % 5).alias("kind"), (F.col("event_id") % 4).alias("n_sources"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("domain"))
    return frontier(rows, F.col("kind"), 40)


def leads_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "F").alias("qualified"), F.round(F.col("o_totalprice") / 500000, 2).alias("fit_score"), F.round(F.col("o_orderkey") % 100 / 100, 2).alias("confidence"))
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))
    return leads(companies, verdicts).select("run_id", "company_id", "name", "qualified", "fit_score", "confidence")


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 50 log rows after id 500."""
    return after(table(spark, sf_dir, "events").select("event_id", "event_type"), 500, 50, "event_id")


def frontier_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("cell"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.col("event_type").alias("run"))
    return accumulate(rows, "cell", ["cents"], "event_id", "run")


def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return latest(rows, "user_id", "event_id", {"first_type": "event_type"})


def alias_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-"), F.col("user_id") % 20).alias("alias"), "event_id", "user_id")
    return first_wins(rows, "alias", "event_id", "user_id")


def ttl_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without an event in the day before a fixed instant."""
    events = table(spark, sf_dir, "events")
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    cache = events.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).where(F.col("ts") <= now)
    return cache_misses(events.select("user_id").distinct(), cache, "user_id", "ts", now, 86400)


def host_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", order="event_id")


def funnel_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.countDistinct("user_id").alias("users"))


def run_stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of counters a day, as JSON text with sorted keys."""
    rows = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    return rows.select("day", F.to_json(F.struct("errors", "n")).alias("stats"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.counters(jobs.follow(spark, f"{sf_dir}/events.parquet"), "event_type", "value", new_path(spark, "counts"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.distinct(jobs.follow(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"], new_path(spark, "distinct"))


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = jobs.follow(spark, f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    return jobs.breaker(calls, "user_id", new_path(spark, "breaker"))


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of companies: users are keys, a purchase closes one, an error is a hopeless excerpt."""
    e = jobs.follow(spark, f"{sf_dir}/events.parquet")
    kind = F.coalesce(*[F.when(F.col("event_id") % 5 == i, k) for i, k in enumerate(("headline", "company_site", "article", "link_hub", "unknown"))])
    done = (F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 0)
    return e.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(done, "done").otherwise("candidate").alias("event"), F.concat(F.lit("Firm "), "event_id").alias("name"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("firm"), "event_id", F.lit(".io"))).alias("domain"), F.col("event_type").alias("source"), F.col("props").alias("snippet"), kind.alias("source_kind"),
        F.when(F.col("event_type") == "error", "outside the band").alias("hopeless"),
    )


def stream_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_entries(_sightings(spark, sf_dir), new_path(spark, "frontier")).withColumn("discovered_via", F.array_join("discovered_via", ","))


def stream_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without an event in the day before a fixed instant, from a stream of lives."""
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    fetches = jobs.follow(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at")).where(F.col("at") <= now)
    known = stale_at(lives(fetches, 86400, new_path(spark, "lives")), now)
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key")).distinct()
    never = users.join(table(spark, sf_dir, "events").where(F.col("ts").cast("timestamp") <= now).select(F.col("user_id").cast("string").alias("key")), "key", "left_anti")
    return known.unionByName(never).select(F.col("key").cast("long").alias("user_id"))


QUERIES = {f.__name__: f for f in (cell_space, sibling_yields, cell_rank_diversified, frontier_topk, leads_order, log_tail, frontier_accumulate, latest_wins_upsert, alias_first_wins, ttl_cache_miss, host_circuit_breaker, funnel_by_type, run_stats_json, stream_counts, stream_dedup, stream_breaker, stream_frontier, stream_ttl)}

_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_STATS = f"""
    st as (select event_type as sector, user_id % 7 as geography, ({_list(SHAPES)})[event_id % 9 + 1] as shape, count(*) as used, count(*) filter (where value > 50) as found, count(*) filter (where value > 200) as qualified from events group by 1, 2, 3),
    y as (select a.sector, a.geography, a.shape, a.used, (sum(b.found) + 3.0::double * sum(b.qualified)) / (1.0::double + sum(b.used)) as yield from st a join st b on a.sector = b.sector or a.geography = b.geography group by 1, 2, 3, 4),
    sc as (select sector || '|' || geography || '|' || shape as cell_key, shape, round(0.60::double / (1 + used) + 0.30::double * least(yield, 3) / 3 + (case geography % 3 when 0 then 0.45 when 1 then 0.25 else 0 end)::double
           + (case shape {" ".join(f"when '{s}' then {b}" for s, b in SHAPE_BONUS.items())} end)::double + (case when geography = 2 then 0.28 else 0 end)::double, 9) as score from y)"""
_FLAGS = """f as (select user_id, event_id, event_type = 'error' as bad, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by {order}) as island from events)"""

SQL = {
    "cell_space": f"""
        with c as (select s.sector, g.geography, count(*) as cells, count(distinct k) as n_keys, min(k) as first_key
            from (select unnest({_list(SECTORS)}) as sector) s, (select unnest({_list(GEOGRAPHIES)}) as geography) g, (select unnest({_list(PHRASINGS)}) as p) p, (select unnest({_list(ROLLING_WINDOWS + FIXED_WINDOWS)}) as w) w, (select unnest({_list(SHAPES)}) as h) h,
                 lateral (select substr(sha1(concat_ws('|', s.sector, g.geography, p.p, w.w, h.h)), 1, 12) as k) group by 1, 2),
        t as (select ({_list(SECTORS)})[user_id % {len(SECTORS)} + 1] as sector, ({_list(GEOGRAPHIES)})[event_id % {len(GEOGRAPHIES)} + 1] as geography, count(*) as tried from events group by 1, 2)
        select sector, geography, cells, n_keys, first_key, coalesce(tried, 0) as tried from c left join t using (sector, geography)""",
    "sibling_yields": f"with {_STATS} select sector, geography, shape, used, round(yield, 9) as yield from y",
    "cell_rank_diversified": f"with {_STATS}, r as (select *, row_number() over (partition by shape order by score desc, cell_key) as place from sc) select cell_key, shape, score from r order by place > 11, score desc, cell_key limit 21",
    "frontier_topk": "select event_id as seq, round(value) as promise, user_id % 5 as kind, event_id % 4 as n_sources, case when event_type <> 'error' then event_type end as domain from events order by promise desc, kind, n_sources desc, domain is null, seq limit 40",
    "leads_order": "select o_orderkey as run_id, o_custkey as company_id, c_name as name, o_orderstatus = 'F' as qualified, round(o_totalprice / 500000, 2) as fit_score, round(o_orderkey % 100 / 100, 2) as confidence from orders join customer on c_custkey = o_custkey",
    "log_tail": "select event_id, event_type from events where event_id > 500 order by 1 limit 50",
    "frontier_accumulate": "select user_id as cell, count(*) as times, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents, arg_max(event_type, event_id) as last_run from events group by 1",
    "latest_wins_upsert": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value, arg_min(event_type, event_id) as first_type from events group by 1",
    "alias_first_wins": "select event_type || '-' || user_id % 20 as alias, arg_min(user_id, event_id) as user_id from events group by 1",
    "ttl_cache_miss": "select distinct user_id from events where user_id not in (select user_id from events where ts between timestamp '2024-01-19 12:00:00' and timestamp '2024-01-20 12:00:00')",
    "host_circuit_breaker": f"with {_FLAGS.format(order='ts, event_id')} select user_id, max(n) as longest_run from (select user_id, island, count(*) as n from f where bad group by 1, 2) group by 1 having max(n) >= 3",
    "funnel_by_type": "select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as sum_k, count(distinct user_id) as users from events group by 1",
    "run_stats_json": """select strftime(ts, '%Y-%m-%d') as day, '{"errors":' || count(*) filter (where event_type = 'error') || ',"n":' || count(*) || '}' as stats from events group by 1""",
    "stream_counts": "select event_type, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as double) / 100 as total from events group by 1",
    "stream_dedup": "select distinct user_id, event_type from events",
    "stream_frontier": """
        with s as (select cast(user_id as varchar) as key, event_id, event_type, props, event_type = 'purchase' and user_id % 3 = 0 as done from events),
        d as (select key, bool_or(done) as done from s group by 1),
        c as (select key, min(event_id) as seq, arg_min(event_type, event_id) as first_type, min(event_id) filter (where event_type = 'signup') as signup, first(props order by length(props) desc, event_id) as snippet,
                     min(event_id % 5) as kind, string_agg(distinct event_type, ',' order by event_type) as discovered_via from s where not done group by 1)
        select key, case when done then 'done' when first_type = 'error' then 'ruled_out' else 'open' end as status, seq, 'Firm ' || seq as name, 'firm' || signup || '.io' as domain, snippet,
               (['headline', 'company_site', 'article', 'link_hub', 'unknown'])[kind + 1] as source_kind, coalesce(discovered_via, '') as discovered_via, case when first_type = 'error' then 'outside the band' end as reason
        from d left join c using (key)""",
    "stream_ttl": "select distinct user_id from events where user_id not in (select user_id from events where ts between timestamp '2024-01-19 12:00:00' and timestamp '2024-01-20 12:00:00')",
    "stream_breaker": f"with {_FLAGS.format(order='event_id')}, r as (select *, row_number() over (partition by user_id, island order by event_id) as n from f where bad) select user_id as host, min(event_id) as opened from r where n = 3 group by 1",
}
