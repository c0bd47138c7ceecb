"""Cases that reviews found."""

import duckdb
from pyspark.sql import functions as F

from veritab.functions.money import rounded
from veritab.functions.people import people
from veritab.operators.fuse import best_amount
from veritab.operators.ground import find_quotes, ground_claims
from veritab.operators.html import decode, with_text
from veritab.shared import growing


def test_names_cut_from_their_semicolon(spark):
    """html_text_stats: its SQL reads references with their semicolon only."""
    page = spark.createDataFrame([(1, "<title>a &amp;&amp;&amp</title><p>b &amp;c&lt;</p><p>d&amp</p>")], "page_id long, html string")
    row = with_text(page, bare_names=False).first()
    assert (row.title, row.text) == ("a &&&amp", "b &c<\nd&amp")
    assert page.select(decode(F.lit("x&amp &lty"))).first()[0] == "x& <y"  # the standard's way stays


def test_equal_figures_above_the_band(spark):
    """money_best_per_company: of equally large figures above the band the cumulative one, then funding, then the earlier one."""
    rows = [("a", 1, 6e6, "revenue", False), ("a", 2, 6e6, "funding_raised", False), ("a", 3, 6e6, "funding_raised", True), ("b", 1, 6e6, "revenue", False), ("b", 2, 6e6, "funding_raised", False), ("b", 3, 6e6, "funding_raised", False)]
    df = spark.createDataFrame(rows, "company_id string, seq long, amount_usd double, amount_type string, is_cumulative boolean")
    assert {r.company_id: r.amount.seq for r in best_amount(df, 1e6, 5e6).collect()} == {"a": 3, "b": 2}


def test_halves_of_stored_values(spark):
    """money_parse: prices of which the hundred thousandth ends in a half are rounded as their SQL rounds the stored value."""
    prices = [500.0 + 1000 * i for i in range(600)]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in prices], "p double").select(rounded(F.col("p") / 100000, 2)).collect()]
    con = duckdb.connect()
    assert got == [con.execute("select round(cast(? as double) / 100000, 2)", [p]).fetchone()[0] for p in prices]


def test_a_text_is_cut_into_words_once(spark):
    """people_in_sentences, claim_fields, text_to_verdict: what lambdas read is bound, not computed again at every place."""
    rows = spark.createDataFrame([("a",)], "t string")
    parsed = rows.select(people(F.col("t")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert parsed.count("regexp_extract_all(") == 1


def test_texts_of_many_keys_are_not_broadcast(spark):
    """model_claims, text_to_verdict: a side that grows with the companies doesn't pass through the driver, however small it looks."""
    few = spark.range(10).withColumnRenamed("id", "k")
    plan = few.join(growing(few.withColumn("t", F.lit("x"))), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    own = spark.createDataFrame([("c", 0, "u", "one two three four five six seven eight nine")], "company_id string, seq long, url string, text string")
    said = spark.createDataFrame([("c", "c#0", "u", "two three four five six seven eight nine")], "company_id string, claim_id string, url string, quote string")
    kept, dropped = ground_claims(said, own)
    for df in (kept, dropped):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.mode for r in kept.collect()] == ["exact"] and dropped.count() == 0


def test_texts_are_folded_once(spark):
    """quote_grounding, ungrounded_quotes: shingles, anchors and the look-up read one table of folded texts."""
    texts = spark.createDataFrame([(1, "One two, three four five six seven eight nine"), (2, None)], "source_id long, text string")
    quotes = spark.createDataFrame([(7, "two three four five six seven eight nine"), (8, "three four five six")], "quote_id long, quote string")
    found = find_quotes(texts, quotes)
    assert {(r.source_id, r.quote_id, r.mode) for r in found.collect()} == {(1, 8, "exact"), (1, 7, "approximate")}
    assert any("folded-" in f for f in found.inputFiles())
