"""Answers of outside services, promise of candidates, sectors, gaps."""

from pyspark.sql import functions as F

from veritab.operators import extract, fuse
from veritab.sources import services


def test_answers(spark):
    words = spark.createDataFrame([("valid",), ("Accept_All",), ("spamtrap",), ("new word",), (None,)], "a string")
    assert [tuple(r) for r in words.select(services.delivery(F.col("a")), services.catch_all(F.col("a"))).collect()] == [("deliverable", False), ("risky", True), ("undeliverable", False), ("unknown", False), ("unknown", False)]
    codes = spark.createDataFrame([(200,), (429,), (403,), (402,), (503,), (404,)], "s int")
    assert [r[0] for r in codes.select(services.outcome(F.col("s"))).collect()] == ["ok", "rate_limited", "not_configured", "quota_exhausted", "retry", "failed"]
    rows = [("a", "Lena Brandt", "lena@a.io", "citing", 69, 2, None), ("a", "Lena Brandt", "l@a.io", "verifying", None, 0, "verified"), ("b", "Lena", "x@b.io", "citing", 99, 1, None), ("c", "Lena Brandt", "x@c.io", "citing", 80, 1, None), ("c", "Lena Brandt", "y@c.io", "verifying", None, 0, "verified")]
    out = services.accepted_contacts(spark.createDataFrame(rows, "company_id string, person string, address string, service string, score int, n_sources int, status string"))
    assert {(r.company_id, r.address) for r in out.collect()} == {("a", "l@a.io"), ("c", "x@c.io")}


def test_enriched_addresses(spark):
    found = spark.createDataFrame([("a", "lena.brandt@acme.io", "Lena Brandt"), ("b", "otto@acme.io", "Lena Brandt"), ("c", "lena@acme.io", "Otto Weber")], "company_id string, address string, person string")
    companies = spark.createDataFrame([(c, "acme.io", "Lena Brandt") for c in "abc"], "company_id string, domain string, founder string")
    checks = spark.createDataFrame([("lena.brandt@acme.io", True, "deliverable", False)], "address string, has_mx boolean, deliverability string, catch_all boolean")
    assert {r.company_id: r.status for r in fuse.enriched(found, companies, checks).collect()} == {"a": "verified", "b": "found_unverified", "c": "not_found"}


def test_promise_and_sector(spark):
    rows = [(1, "Kenyan fintech startup raises $2 million, says founder Ann Otieno", None, "headline"), (2, "raised $45 million Series B", "x.io", "article"), (3, "the American startup Acme", None, "article"), (4, None, "x.io", "link_hub"), (5, "a CEO speaks", "x.io", "article")]
    df = spark.createDataFrame(rows, "seq long, snippet string, domain string, source_kind string")
    got = {r.seq: (r.promise, r.hopeless is not None) for r in extract.promise(df, 1e6, 5e6).collect()}
    assert got == {1: (6.5, False), 2: (0.0, True), 3: (0.0, True), 4: (0.0, False), 5: (0.9, False)}
    s = df.select("seq", extract.sector(F.col("snippet")).alias("s")).collect()
    assert {r.seq: r.s and r.s.sector for r in s} == {1: "Fintech / Payments", 2: None, 3: None, 4: None, 5: None}


def test_gaps_become_probes(spark):
    df = spark.createDataFrame([("a", "Acme", None, "x"), ("b", "Beta", "y", "x")], "company_id string, name string, founder string, funding string")
    gaps = df.select("company_id", "name", fuse.open_gaps({"founder": F.col("founder"), "funding": F.col("funding")}).alias("gaps"))
    t = spark.createDataFrame([("founder", '"{name}" founder'), ("funding", '"{name}" raises')], "gap string, query string")
    assert [(r.company_id, r["query"]) for r in fuse.probes(gaps, t).collect()] == [("a", '"Acme" founder')]
