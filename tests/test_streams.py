"""Streams with state: order, replays and restarts change nothing; timers fire; budgets end a run and a later one goes on."""

import random

import pytest
from pyspark.sql import functions as F

from veritab.streaming import budget, cache, frontier, jobs

SIGHTING = "key string, seq long, event string, name string, domain string, source string, snippet string, source_kind string, hopeless string"


def write(spark, rows, schema, folder, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part-{n:02d}")


def follow(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part-*")


def sightings(rng, n):
    kinds, keys = ["headline", "article", "link_hub", None, "other"], [f"k{i}" for i in range(12)]
    return [(rng.choice([*keys, None]), i, "done" if rng.random() < 0.05 else "candidate", f"N{i}", rng.choice([None, f"d{i % 4}.io"]), rng.choice(["a", "b", None]), rng.choice([None, "", "x" * (i % 7)]), rng.choice(kinds), rng.choice([None, None, "hopeless"])) for i in range(n)]


def plain(rows):
    """The entries of a list of sightings by one pass."""
    out = {}
    for key in {r[0] for r in rows if r[0]}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        seen = [r for r in own if r[2] != "done"]
        first = seen[0] if seen else (None,) * 9
        ranks = ["headline", "company_site", "article", "link_hub", "unknown"]
        kinds = sorted({r[7] for r in seen if r[7]}, key=lambda k: (ranks.index(k) if k in ranks else 5, k))
        said = sorted((r for r in seen if r[6] is not None), key=lambda r: (-len(r[6]), r[1]))
        status = "done" if len(seen) < len(own) else "ruled_out" if first[8] else "open"
        out[key] = (status, first[1], first[3], next((r[4] for r in seen if r[4]), None), said[0][6] if said else None, kinds[0] if kinds else None, sorted({r[5] for r in seen if r[5]}), first[8])
    return out


def entries(df):
    return {r.key: (r.status, r.seq, r.name, r.domain, r.snippet, r.source_kind, list(r.discovered_via), r.reason) for r in df.collect()}


def test_frontier_in_any_order_with_replays_and_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = sightings(rng, 400)
    shuffled = rng.sample(rows, len(rows)) + rng.sample(rows, 50)  # late and repeated ones
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for i in range(2):
        write(spark, shuffled[i * 100 : (i + 1) * 100], SIGHTING, folder, i)
    half = entries(frontier.frontier(follow(spark, SIGHTING, folder), state))
    assert half == plain(shuffled[:200])
    write(spark, shuffled[200:], SIGHTING, folder, 2)
    again = frontier.frontier(follow(spark, SIGHTING, folder), state)  # goes on from its checkpoint
    assert entries(again) == plain(rows)
    # once done, done: a better candidate afterwards opens nothing
    closed = [k for k, v in plain(rows).items() if v[0] == "done"]
    write(spark, [(k, -5, "candidate", "Better", "new.io", "z", "a much longer snippet", "headline", None) for k in closed], SIGHTING, folder, 3)
    late = entries(frontier.frontier(follow(spark, SIGHTING, folder), state))
    assert closed and all(late[k][0] == "done" for k in closed)
    top = frontier.next_of(again.withColumn("promise", F.lit(1.0)), F.col("promise"), 3).collect()
    assert all(r.status == "open" for r in top)


def test_lives_end_by_a_timer_and_survive_a_restart(spark, tmp_path):
    from datetime import datetime, timedelta

    schema, t0 = "key string, at timestamp", datetime(2024, 1, 1)
    at = lambda h: t0 + timedelta(hours=h)
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, [("a", at(0)), ("b", at(0)), ("b", at(5)), (None, at(1))], schema, folder, 0)
    first = {r.key: r.expires_ms for r in cache.lives(follow(spark, schema, folder), 10 * 3600, state).collect()}
    hour = lambda h: int((at(h) - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert first == {"a": hour(10), "b": hour(15)}
    write(spark, [("c", at(14)), ("b", at(2))], schema, folder, 1)  # the late fetch of b shortens nothing
    write(spark, [("c", at(14))], schema, folder, 2)
    known = cache.lives(follow(spark, schema, folder), 10 * 3600, state)
    assert {r.key: (r.state, r.expires_ms) for r in known.collect()} == {"a": ("stale", hour(10)), "b": ("fetched", hour(15)), "c": ("fetched", hour(24))}
    assert {r.key for r in cache.stale_at(known, F.lit("2024-01-01 16:00:00").cast("timestamp")).collect()} == {"a", "b"}


@pytest.mark.parametrize("limits, batches, reason", [
    (budget.Limits({"qualified": 3}), 2, "qualified reached 3"),
    (budget.Limits({"qualified": 99, "researched": 12}, reasons={"researched": "research budget reached"}), 3, "research budget reached"),
    (budget.Limits(seconds=-1), 0, "time budget reached"),
    (budget.Limits({"researched": 1000}, seconds=1e9), 5, "all input was read"),
])
def test_budgets_end_a_run(spark, tmp_path, limits, batches, reason):
    schema, folder, path = "id long, ok boolean", str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(5):
        write(spark, [(i * 5 + j, j % 3 == 0) for j in range(5)], schema, folder, i)
    counters = {"qualified": F.count_if("ok"), "researched": F.count("*")}
    got, why = budget.run(follow(spark, schema, folder), counters, limits, path)
    assert why == reason
    assert (0 if got is None else got.count()) == 5 * batches
    said = budget.progress(spark, path).orderBy("batch").collect()
    assert [r.reason for r in said] == [None] * (batches - 1) + [reason if reason != "all input was read" else None] * (batches > 0)
    # a later run without limits reads exactly the rest
    rest, why = budget.run(follow(spark, schema, folder), counters, budget.Limits(), path)
    assert why == "all input was read" and sorted(r.id for r in rest.collect()) == list(range(25))
    assert budget.progress(spark, path).orderBy(F.desc("batch")).first().totals == {"qualified": 10.0, "researched": 25.0}


def test_latest_version_of_each_key(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 3), ("b", 5, 1)], "key string, v int, _batch long")
    assert {tuple(r) for r in jobs.latest_of(rows, "key").collect()} == {("a", 2), ("b", 5)}
