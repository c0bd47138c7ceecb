"""Fusion, gates, stores, files and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from veritab.operators import fuse, plan, report, resolve, store
from veritab.operators.ground import ground_claims
from veritab.operators.qualify import Band, qualify
from veritab.sources import files
from veritab.streaming import jobs

CLAIM = "company_id string, seq long, field string, value string, url string, quote string, authority string, extra struct<title: string>"
OWN, PRESS, BLOG = "company_owned", "tier1_press", "unknown"


def claims(spark, rows):
    return spark.createDataFrame([(c, i, f, v, u, q, a, (t,)) for i, (c, f, v, u, q, a, t) in enumerate(rows)], CLAIM)


def test_email_ladder(spark):
    """One company a branch of the ladder."""
    cases = {
        # company: (founder, domain, [(address, quote, authority)], (mx, deliverability, catch all), status)
        "none": ("Lena Brandt", "acme.io", [], None, "not_found"),
        "role": ("Lena Brandt", "acme.io", [("info@acme.io", "", OWN)], None, "role_only"),
        "disposable": ("Lena Brandt", "acme.io", [("lena@yopmail.com", "", OWN)], None, "not_found"),
        "nobody": (None, "acme.io", [("lena@acme.io", "", OWN)], (True, "deliverable", False), "found_unverified"),
        "weak": ("Lena Brandt", "acme.io", [("lena@acme.io", "", BLOG)], (True, "deliverable", False), "found_unverified"),
        "others": ("Lena Brandt", "acme.io", [("otto@acme.io", "", OWN)], (True, "deliverable", False), "found_unverified"),
        "free": ("Lena Brandt", "acme.io", [("lena.brandt@gmail.com", "", PRESS)], (True, "deliverable", False), "found_unverified"),
        "elsewhere": ("Lena Brandt", "acme.io", [("lena.brandt@northstar.vc", "Lena Brandt", PRESS)], (True, "deliverable", False), "found_unverified"),
        "no mx": ("Lena Brandt", "acme.io", [("lena@acme.io", "", OWN)], (False, "deliverable", False), "invalid"),
        "bounces": ("Lena Brandt", "acme.io", [("lena@b.acme.io", "", OWN)], (True, "undeliverable", False), "invalid"),
        "catch all": ("Lena Brandt", "acme.io", [("lena@c.acme.io", "", OWN)], (True, "deliverable", True), "source_verified"),
        "good": ("Lena Brandt", "acme.io", [("info@d.acme.io", "", OWN), ("lena@d.acme.io", "", OWN)], (True, "deliverable", False), "verified"),
        "risky": ("Lena Brandt", "acme.io", [("lena@e.acme.io", "", OWN)], (True, "risky", False), "source_verified"),
        "desk": ("Lena Brandt", "acme.io", [("ceo@f.acme.io", "", OWN)], (True, "deliverable", False), "verified"),
    }
    rows, checks = [], {}
    for c, (_, _, found, check, _) in cases.items():
        for a, q, s in found:
            rows.append((c, "email", a, f"https://{c}.io", q, s, None))
            if check and a.split("@")[0] not in ("info",):
                checks.setdefault(a if c != "no mx" else "lena@acme.io", (a, *check))
    # one address in several companies would need one answer: these have their own
    rows = [(c, f, v.replace("@acme.io", f"@{c.replace(' ', '')}.acme.io") if "@acme.io" in v and not v.startswith("info") else v, u, q, a, t) for c, f, v, u, q, a, t in rows]
    checks = [(v, *next(x[3] for k, x in cases.items() if k == c)) for c, _, v, *_ in rows if cases[c][3]]
    companies = spark.createDataFrame([(c, d, f) for c, (f, d, *_) in cases.items()], "company_id string, domain string, founder string")
    answers = spark.createDataFrame(checks, "address string, has_mx boolean, deliverability string, catch_all boolean").dropDuplicates(["address"])
    got = {r.company_id: r.status for r in fuse.email(claims(spark, rows), companies, answers).collect()}
    assert got == {c: x[4] for c, x in cases.items()}
    without = fuse.email(claims(spark, [("a", "email", "lena@acme.io", "u", "", OWN, None)]), spark.createDataFrame([("a", "acme.io", "Lena Brandt")], "company_id string, domain string, founder string"), spark.createDataFrame([("lena@acme.io", True, None, None)], answers.schema), has_provider=False)
    assert without.first().status == "verified"


def test_best_amount(spark):
    rows = [("in band", 1, 2.5e6, "funding_raised", False), ("in band", 2, 3e6, "revenue", False), ("in band", 3, 2e6, "revenue", True), ("above", 1, 2.5e6, "funding_raised", False), ("above", 2, 52e6, "funding_raised", False), ("none", 1, 9e6, "valuation", False), ("small", 1, 5e5, "arr", False)]
    df = spark.createDataFrame(rows, "company_id string, seq long, amount_usd double, amount_type string, is_cumulative boolean")
    got = {r.company_id: r.amount.amount_usd for r in fuse.best_amount(df, 1e6, 5e6).collect()}
    assert got == {"in band": 2e6, "above": 52e6, "small": 5e5}


def test_founder_country_technology(spark):
    names = spark.createDataFrame([("a", "Acme Robotics", "acme.de"), ("b", "Beta", "beta.io")], "company_id string, name string, domain string")
    cl = claims(spark, [("a", "founder", "Rita Report", "https://p.com/1", "Rita Report, CEO of Other", PRESS, "CEO"), ("a", "founder", "Lena Brandt", "https://acme.de/1", "Lena Brandt, CEO", OWN, "CEO"), ("a", "founder", "Lena Brandt", "https://p.com/2", "Acme Robotics CEO Lena Brandt", PRESS, "CEO"), ("a", "founder", "Ex-Acme Founder", "https://acme.de", "x", OWN, "Founder"), ("b", "country", "kenya", "https://beta.io", "Kenya", OWN, None)])
    f = {r.company_id: r.founder for r in fuse.founder(cl, names).collect()}
    assert set(f) == {"a"} and f["a"].value.name == "Lena Brandt" and f["a"].status == "corroborated" and len(f["a"].evidence) == 2
    sources = spark.createDataFrame([("a", 0, "https://acme.de/platform", "Our software platform sorts parcels", OWN), ("b", 0, "https://beta.io", "A consulting firm with a dashboard", OWN)], "company_id string, seq long, url string, text string, authority string")
    assert [r.company_id for r in fuse.technology(sources).collect()] == ["a"]
    got = {r.company_id: (r.country, r.rung) for r in fuse.country(cl, sources, names).collect()}
    assert got == {"a": ("Germany", 5), "b": ("Kenya", 1)}
    levels = fuse.us_presence(spark.createDataFrame([("a", "Germany"), ("b", "Kenya"), ("c", None), ("d", "USA"), ("e", "Kenya")], "company_id string, country string"), spark.createDataFrame([("b", "us_phone"), ("b", "us_phone"), ("e", "us_office")], "company_id string, kind string"))
    assert {r.company_id: r.us_level for r in levels.collect()} == {"a": "none", "b": "minimal", "c": None, "d": "significant", "e": "significant"}
    hub = spark.createDataFrame([("v", "we invest in founders"), ("s", "seed fund. family office. "), ("p", "raised $2 million in seed funding")], "company_id string, text string")
    assert {r.company_id for r in fuse.non_operating(hub).collect()} == {"v", "s"}


def test_gates(spark):
    base = {"company_id": "ok", "usd": 2e6, "amount_type": "funding_raised", "tech": True, "us_level": "none", "title": "CEO", "email_status": "verified", "country": "India", "sector": "fintech"}
    variants = [base, *({**base, "company_id": k, **v} for k, v in {"low": {"usd": 999_999.0}, "high": {"usd": 5_000_001.0}, "edge": {"usd": 1e6}, "edge2": {"usd": 5e6}, "type": {"amount_type": "tam"}, "us": {"us_level": "significant"}, "unknown": {"us_level": None}, "chair": {"title": "Chair"}, "mail": {"email_status": "source_verified"}}.items()), dict.fromkeys(base) | {"company_id": "empty"}]
    df = spark.createDataFrame([tuple(v[k] for k in base) for v in variants], "company_id string, usd double, amount_type string, tech boolean, us_level string, title string, email_status string, country string, sector string")
    got = {r.company_id: r for r in qualify(df, Band()).collect()}
    assert {k for k, r in got.items() if r.qualified} == {"ok", "edge", "edge2"}
    assert len(got["empty"].failed) == 5 and got["edge"].near_boundary and not got["ok"].near_boundary
    assert got["ok"].fit_score == pytest.approx(1.0)
    assert got["us"].failed == ["us_presence"]


def test_claims_are_grounded_in_their_company(spark):
    cl = spark.createDataFrame([("a", "1", "u1", "raised two million dollars"), ("a", "2", "u1", "raised nine million dollars"), ("b", "3", "u9", "raised two million dollars")], "company_id string, claim_id string, url string, quote string")
    src = spark.createDataFrame([("a", 0, "u0", "nothing"), ("a", 1, "u2", "Acme raised two million dollars"), ("b", 0, "u9", "else")], "company_id string, seq long, url string, text string")
    kept, dropped = ground_claims(cl, src)
    assert [(r.claim_id, r["mode"], r.grounded_in) for r in kept.collect()] == [("1", "exact", "u2")]
    assert sorted(r.claim_id for r in dropped.collect()) == ["2", "3"]


def test_second_run_is_disjoint(spark):
    first = spark.createDataFrame([(1, "Acme Ltd", None, "s", "headline"), (2, "Acme", "acme.io", "longer", "article"), (3, None, None, "x", "unknown"), (4, "Acme", "acme.com", "s", "article")], "seq long, name string, domain string, snippet string, source_kind string")
    merged = {r.entity: r for r in resolve.merge(first).collect()}
    assert set(merged) == {"acme.io", "acme.com"} and merged["acme.io"].n_sources == 2 and merged["acme.io"].source_kind == "headline"
    again = resolve.unknown(first.where("seq <> 3"), resolve.known_keys(spark.createDataFrame(list(merged.values()))))
    assert again.count() == 0


def test_planning(spark):
    assert plan.cell_space(spark).count() == 17 * 36 * 8 * 10 * 9
    assert plan.cell_space(spark, sectors=["nowhere"]).select("sector").distinct().count() == 17
    cells = spark.createDataFrame([(f"k{i}", "a" if i < 6 else "b", 10.0 - i) for i in range(8)], "cell_key string, shape string, score double")
    assert [r.cell_key for r in plan.diversified(cells, 4).collect()] == ["k0", "k1", "k6", "k7"]
    one = plan.cell_space(spark, ["fintech"], ["kenya"]).where("phrasing = 'seed_usd' and time_window = '2026' and shape = 'company_site'")
    t = spark.createDataFrame([("seed_usd", "seed fintech")], "phrasing string, query string")
    assert [r.query for r in plan.render(one, t).collect()] == ["seed fintech kenya 2026"]
    assert plan.render(one, t, spark.createDataFrame([("seed fintech kenya 2026",)], "query string")).count() == 0


def test_files(spark, tmp_path):
    lead = {"company_name": "Acme", "verified_email": "a@acme.io", "evidence": [{"url": "u", "quote": "q", "authority": "unknown"}]}
    (tmp_path / "bare.json").write_text(json.dumps([lead]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"leads": [lead, lead]}))
    assert files.read_leads(spark, str(tmp_path / "*.json")).count() == 3
    record = json.dumps({"run_id": "r", "qualified": True, "company": "{}", "qualification": "{}"})
    (tmp_path / "bank.txt").write_text(json.dumps({"format": 1, "leads": [record, "no json"]}))
    (tmp_path / "old.txt").write_text(json.dumps({"format": 0, "leads": [record]}))
    assert files.read_bank(spark, str(tmp_path / "*.txt")).count() == 1
    q = files.canned_results(spark.createDataFrame([("Seed fintech",), ("other",)], "query string"), spark.createDataFrame([("FINTECH", "t", "u", "s")], "pattern string, title string, url string, snippet string"))
    assert [(r.query, r.title) for r in q.collect()] == [("Seed fintech", "t")]


def test_reports(spark):
    rows = [("a", True, [], None), ("b", False, ["email_verified"], "x a@b.io"), ("c", False, ["us_presence", "email_verified"], "y")]
    df = spark.createDataFrame(rows, "company_id string, qualified boolean, failed array<string>, first_failure string")
    out = report.bank(df, rejected=1).collect()
    assert [(r.company_id, r.first_failure) for r in out] == [("a", None), ("b", "x [address withheld]")]
    assert {r.gate: r.n for r in report.gate_failures(df).collect()} == {"email_verified": 2, "us_presence": 1}


def test_store(spark):
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("k", 2, "y"), ("l", 1, None)], "key string, at long, v string")
    assert {(r.key, r.at, r.v, r.first_v) for r in store.latest(rows, "key", "at", {"first_v": "v"}).collect()} == {("k", 3, "z", "x"), ("l", 1, None, None)}


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    schema = "id long, key string"
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema).write.parquet(folder)
    assert {r.key for r in jobs.distinct(jobs.follow(spark, folder), ["key"], out).collect()} == {"a", "b"}
    spark.createDataFrame([(4, "b"), (5, "c")], schema).write.mode("append").parquet(folder)
    assert sorted(r.key for r in jobs.distinct(jobs.follow(spark, folder), ["key"], out).collect()) == ["a", "b", "c"]
    known = spark.createDataFrame([("a",)], "key string")
    assert sorted(r.key for r in jobs.unknown(jobs.follow(spark, folder), known, "key", str(tmp_path / "new")).collect()) == ["b", "c"]
