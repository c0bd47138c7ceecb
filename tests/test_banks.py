"""Banks replay to the same store any number of times; exports have the columns of the format."""

import json

from pyspark.sql import functions as F

from veritab import cli
from veritab.operators import bank, report
from veritab.operators.qualify import qualify
from veritab.sources import files

GATE = "array<struct<gate:string,passed:boolean,reason:string>>"
LEAD = f"run_id string, qualified boolean, company struct<company_id:string,name:string,domain:string,address:string>, qualification struct<gates:{GATE}>"


def lead(i, run, failed, name="Acme \"quoted\" é"):
    return (run, failed == 0, (f"c{i}", name, "acme.io", "lena@acme.io"), ([("g", k >= failed, "write lena@acme.io") for k in range(5)],))


def tables(spark, store):
    return {n: sorted(map(tuple, bank.stored(spark, store, n).collect())) for n in bank.TABLES}


def test_write_read_read_again(spark, tmp_path):
    path, store = str(tmp_path / "bank"), str(tmp_path / "store")
    leads = spark.createDataFrame([lead(1, "r1", 0), lead(2, "r2", 3), lead(3, "r3", 1), lead(4, "r9", 4)], LEAD)
    runs = spark.createDataFrame([(f"r{i}", i, "done") for i in range(6)], "id string, at int, stop_reason string")
    bank.write(leads, runs, path, rejections=2)
    assert bank.replay(spark, path, store) == {"companies": 3, "verdicts": 3, "runs": 3}
    first = tables(spark, store)
    assert bank.replay(spark, path, store) == {"companies": 0, "verdicts": 0, "runs": 0}
    assert tables(spark, store) == first
    assert [r[0] for r in first["runs"]] == ["r1", "r2", "r3"]  # only those that are referred to
    assert {r[0]: (r[2], r[3]) for r in first["verdicts"]} == {"c1": (True, 0), "c2": (False, 3), "c3": (False, 1)}
    company = {r[0]: json.loads(r[4]) for r in first["companies"]}
    assert company["c1"]["address"] == "lena@acme.io" and company["c2"]["address"] == "[address withheld]" and company["c3"]["name"] == 'Acme "quoted" é'
    assert "@" not in first["verdicts"][1][4]
    # a changed lead replaces the stored one, the others stay as they are
    other = str(tmp_path / "later")
    bank.write(spark.createDataFrame([lead(1, "r1", 0, "Renamed"), lead(3, "r3", 1)], LEAD), runs, other)
    assert bank.replay(spark, other, store) == {"companies": 1, "verdicts": 0, "runs": 0}
    assert [r[1] for r in tables(spark, store)["companies"]][0] == "Renamed" and len(tables(spark, store)["companies"]) == 3


def test_foreign_and_broken_banks(spark, tmp_path):
    good = {"kind": "lead", "run_id": None, "qualified": True, "company": {"company_id": "a", "name": "A"}, "qualification": {"gates": []}}
    folder = tmp_path / "b"
    folder.mkdir()
    (folder / "part").write_text("\n".join([json.dumps({"kind": "format", "format": 1}), json.dumps(good), "no json", json.dumps({**good, "company": {}}), json.dumps({**good, "qualification": "x"}), "", "[1]", json.dumps({"kind": "run"})]))
    companies, verdicts, runs = bank.read(spark, str(folder))
    assert [(r.company_id, r.run_id) for r in companies.collect()] == [("a", "shipped")] and verdicts.count() == 1 and runs.count() == 0
    for head in ({"kind": "format", "format": 2}, {}):
        (folder / "part").write_text("\n".join([json.dumps(head), json.dumps(good)]))
        assert [t.count() for t in bank.read(spark, str(folder))] == [0, 0, 0]
    assert bank.replay(spark, str(folder), str(tmp_path / "s")) == {"companies": 0, "verdicts": 0, "runs": 0}
    assert bank.stored(spark, str(tmp_path / "s"), "companies").count() == 0


def test_export(spark, tmp_path):
    rows = [("a", "Acme, Inc", "acme.io", 2.4e6, "funding_raised", True, "none", "CEO", "verified", "India", "fintech", "Lena Brandt", "lena@acme.io", None, "x" * 500, 0.81234, [("u2", "q", "unknown"), ("u1", "q " * 300, "unknown"), ("u2", "q", "unknown")]),
            ("b", "Beta", None, None, None, None, None, None, "role_only", None, None, None, "info@beta.io", "shared", None, 0.1, [])]
    df = spark.createDataFrame(rows, "company_id string, name string, domain string, usd double, amount_type string, tech boolean, us_level string, title string, email_status string, country string, sector string, founder string, address string, email_note string, description string, confidence double, evidence array<struct<url:string,quote:string,authority:string>>")
    judged = qualify(df)
    out = {r.company_name: r for r in report.export_rows(judged).collect()}
    assert list(out["Beta"].asDict()) == [*report.CSV_COLUMNS, "qualified"]
    a, b = out["Acme, Inc"], out["Beta"]
    assert (a.funding_or_revenue, a.website, a.evidence_urls, len(a.description), a.confidence, a.verified_email) == ("$2.40M", "https://acme.io", "u1 | u2", 400, 0.812, "lena@acme.io")
    assert (b.funding_or_revenue, b.website, b.verified_email, b.founder_title, b.us_presence) == ("", "", "", "", "")
    assert len(report.export_rows(judged, None, None).where("company_name = 'Acme, Inc'").first().description) == 500
    files.write_csv(judged, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == report.CSV_COLUMNS and {r.company_name for r in back.collect()} == {"Acme, Inc", "Beta"}
    files.write_json(judged, str(tmp_path / "json"))
    doc = {r.company_name: r for r in spark.read.json(str(tmp_path / "json")).collect()}["Acme, Inc"]
    assert [e.url for e in doc.evidence] == ["u2", "u1"] and len(doc.evidence[1].quote) == 400 and len(doc.gates) == 5 and doc.email_detail.status == "verified"


def test_command_line(spark, tmp_path):
    verdict = spark.createDataFrame([("a", "r1", True, [], 0.5, 0.5, [("g", True, "x")]), ("b", "r1", False, ["g"], 0.5, 0.5, [("g", False, "x")])], f"company_id string, run_id string, qualified boolean, failed array<string>, fit_score double, confidence double, gates {GATE}")
    spark.createDataFrame([("a", "A", "a.io"), ("b", "B", "b.io")], "company_id string, name string, domain string").write.parquet(str(tmp_path / "c"))
    verdict.write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([("r1", 1)], "id string, at int").write.parquet(str(tmp_path / "r"))
    args = ["--companies", str(tmp_path / "c"), "--verdicts", str(tmp_path / "v"), "--out", str(tmp_path / "bank")]
    assert cli.main(["bank", *args]) == 2  # the runs are missing
    assert cli.main(["bank", *args, "--runs", str(tmp_path / "r")]) == 0
    assert cli.main(["replay", "--bank", str(tmp_path / "bank"), "--out", str(tmp_path / "store")]) == 0
    assert bank.stored(spark, str(tmp_path / "store"), "verdicts").where(F.col("qualified")).count() == 1


def test_audit_of_records(spark):
    record = "company_id string, address string, evidence array<struct<url:string,quote:string>>"
    rows = [("ok", "lena@acme.io", [("u1", "raised two million dollars")]), ("amiss", "lena@acme.io", [("u1", "raised nine million dollars"), ("u1", "raised two million dollars")]), ("unread", "info@acme.io", [("u9", "raised two million dollars")]), ("none", None, [])]
    df = spark.createDataFrame(rows, record)
    pages = spark.createDataFrame([("u1", "Acme raised two million dollars")], "url string, text string")
    checks = spark.createDataFrame([("lena@acme.io", True)], "address string, has_mx boolean")
    got = {r.company_id: r for r in report.audit_records(df, pages, checks).collect()}
    assert {k: r.clean for k, r in got.items()} == {"ok": True, "amiss": False, "unread": False, "none": False}
    assert got["amiss"].issues == ["1 quotes aren't on their page"] and (got["amiss"].n_evidence, got["amiss"].n_found) == (2, 1)
    assert got["unread"].issues == ["the address is a shared mailbox", "its domain takes no mail", "1 cited pages can't be read"]
    assert got["none"].issues == ["the address isn't one", "no evidence"]
    assert tuple(report.audit_totals(report.audit_records(df, pages, checks)).first()) == (4, 1, 4, 2)
    assert tuple(report.audit_totals(report.audit_records(df.where("false"), pages, checks)).first()) == (0, 0, 0, 0)


def test_small_reports(spark):
    import pytest
    from pyspark.errors import PySparkException

    from veritab.functions.gazetteer import domain_ending
    from veritab.operators.websites import excerpts
    from veritab.vocab import GATES

    whole = spark.createDataFrame([([(g, True, "") for g in GATES],), ([(g, True, "") for g in GATES[:4]],)], f"gates {GATE}")
    assert [list(r.m) for r in whole.select(report.missing_gates(F.col("gates")).alias("m")).collect()] == [[], ["email_verified"]]
    assert report.whole_verdicts(whole.limit(1)).count() == 1
    with pytest.raises(PySparkException):
        report.whole_verdicts(whole).collect()
    cases = [("found", "x", "y", "z"), ("verified", "deliverable", "acme", "z"), ("verified", "risky", "acme", "z"), ("verified", None, None, "aggregator"), ("verified", "deliverable", "none", "company_owned"), (None, None, None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, c string, d string")
    said = [r.x.split(" ")[0] for r in df.select("i", report.verification_strength(*[F.col(c) for c in "abcd"]).alias("x")).orderBy("i").collect()]
    assert said == ["not", "confirmed", "acme", "a", "an", "not"]
    texts = spark.createDataFrame([(0, "a Kenyan startup"), (1, "in Munich"), (2, "a London and Paris firm"), (3, "nowhere"), (4, None)], "i int, t string")
    assert [r.x for r in texts.select("i", domain_ending(F.col("t")).alias("x")).orderBy("i").collect()][:2] == ["co.ke", "de"]
    assert [r.x for r in texts.where("i > 2").select("i", domain_ending(F.col("t")).alias("x")).orderBy("i").collect()] == [None, None]
    found = spark.createDataFrame([("a", "Acme", "acme.io", "Acme raised money", [None, "https://techcrunch.com/a"]), ("b", "Beta", "beta.io", "Acme raised money", ["https://techcrunch.com/a"]), ("c", "Acme", "acme.io", "Acme raised", ["https://acme.io/x"]), ("d", "Acme", "acme.io", "Acme raised", ["https://blog.example/x"]), ("e", "Acme", None, None, [])], "company_id string, name string, domain string, snippet string, urls array<string>")
    assert [(r.company_id, r.authority) for r in excerpts(found).collect()] == [("a", "tier1_press")]
    runs = spark.createDataFrame([("r1", 1), ("r2", 3), ("r3", 2)], "id string, at int")
    assert [r.id for r in report.recent_runs(runs, 2).collect()] == ["r2", "r3"]
