"""Quotes of all lengths in sources, against a comparison of every pair."""

import random

from pyspark.sql import functions as F

from veritab.functions.text import normalise_quote
from veritab.operators.ground import find_quotes, ground_claims

WORDS = ["alpha", "beta", "gamma", "to", "of", "seed", "round", "raised", "2.4", "million", "Delta—x", "in", "company", "a"]


def longest_run(a, b):
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = before[j] + 1
                best = max(best, now[j + 1])
        before = now
    return best


def test_equals_every_pair(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(99, None), (98, "")]
    quotes = [(1000, "!!!!!!!!!!!!a"), (1001, "companyraised"), (1002, None), (1003, " " * 12)]
    for j in range(250):
        s = rng.choice(texts)[1] or ""
        at = rng.randrange(len(s)) if s else 0
        q = s[at : at + rng.randint(5, 90)] if s and rng.random() < 0.7 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 14)))
        quotes.append((j, q.upper() if rng.random() < 0.2 else q))
    for j in range(300, 330):  # long runs with words of their own at an end
        w = rng.choice([t for _, t in texts if t and len(t.split()) > 20]).split()
        quotes.append((j, " ".join([*w[3 : 3 + rng.randint(5, 12)], *["other"] * rng.randint(1, 5)])))
    sources, asked = spark.createDataFrame(texts, "source_id long, text string"), spark.createDataFrame(quotes, "quote_id long, quote string")
    folded = lambda df, key, c: {r[0]: (r[1], r[2]) for r in df.select(key, normalise_quote(F.col(c)), F.coalesce(F.length(F.trim(c)), F.lit(0))).collect()}
    s, q = folded(sources, "source_id", "text"), folded(asked, "quote_id", "quote")
    want = set()
    for i, (text, _) in s.items():
        for j, (quote, size) in q.items():
            if size >= 12 and quote:
                n = len(quote.split())
                r = longest_run(quote.split(), text.split())
                if quote in text:
                    want.add((i, j, "exact"))
                elif r >= 6 and r / n >= 0.65:
                    want.add((i, j, "approximate"))
    assert len(want) > 100 and {m for _, _, m in want} == {"exact", "approximate"}
    assert {(r.source_id, r.quote_id, r["mode"]) for r in find_quotes(sources, asked).collect()} == want
    # within groups only
    half = find_quotes(sources.withColumn("g", F.col("source_id") % 2), asked.withColumn("g", F.col("quote_id") % 2), ["g"])
    assert {(r.source_id, r.quote_id, r["mode"]) for r in half.collect()} == {x for x in want if (x[0] - x[1]) % 2 == 0}


def test_no_text_is_joined_pair_by_pair(spark):
    sources, quotes = spark.range(3).selectExpr("id as source_id", "'some text of a source' as text"), spark.range(3).selectExpr("id as quote_id", "'text of a source' as quote")
    plan = find_quotes(sources, quotes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and find_quotes(sources, quotes).count() == 9
    assert find_quotes(sources, quotes.where("false")).count() == 0 and find_quotes(sources.where("false"), quotes).count() == 0


def test_the_cited_source_comes_first(spark):
    claims = spark.createDataFrame([("a", "1", "u2", "raised two million"), ("a", "2", "u9", "raised two million dollars in a seed round led by nobody"), ("b", "3", "u1", "raised two million"), ("a", "4", None, "nothing of the kind")], "company_id string, claim_id string, url string, quote string")
    sources = spark.createDataFrame([("a", 0, "u1", "Acme raised two million dollars in a seed round led by somebody"), ("a", 1, "u2", "it raised two millions"), ("b", 0, "u1", "other")], "company_id string, seq long, url string, text string")
    kept, dropped = ground_claims(claims, sources)
    assert sorted((r.claim_id, r["mode"], r.grounded_in) for r in kept.collect()) == [("1", "exact", "u2"), ("2", "approximate", "u1")]
    assert sorted(r.claim_id for r in dropped.collect()) == ["3", "4"]
