"""From texts to verdicts on a small simulated web, claims of a model, snippets, and what locates a company."""

import pytest
from pyspark.sql import functions as F

from veritab.functions import gazetteer, text
from veritab.operators import claims as C
from veritab.operators import discover
from veritab.operators.html import links, with_text
from veritab.operators.qualify import qualify

SOURCE = "company_id string, seq long, url string, text string, authority string"
COMPANY = "company_id string, name string, domain string"
CHECK = "address string, has_mx boolean, deliverability string, catch_all boolean"
OWN, PRESS = "company_owned", "tier1_press"


def run(spark, cases, fn):
    rows = [(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)]
    names = [f"a{k}" for k in range(len(rows[0]) - 1)]
    out = spark.createDataFrame(rows, "i int, " + ", ".join(f"{x} string" for x in names)).select("i", fn(*[F.col(x) for x in names]).alias("r"))
    return [r.r for r in sorted(out.collect(), key=lambda r: r.i)]


#: Six companies and the traps on their pages.
WEB = {
    ("helio", "Heliora Health", "heliora.in"): [
        ("https://heliora.in/", "<p>Heliora Health is a care coordination platform that helps clinics in India.</p><a href='/about'>About</a>", OWN),
        ("https://heliora.in/about", "<p>Heliora Health is headquartered in Bengaluru, India. Digital health is a market worth $400 billion.</p>", OWN),
        ("https://heliora.in/team", "<p>Meera Iyer, Co-founder &amp; CEO, leads it.</p><p>Write to Meera Iyer at meera.iyer [at] heliora.in.</p><p>General: info@heliora.in</p>", OWN),
        ("https://techcrunch.com/2026/seed", "<p>Bengaluru-based Heliora Health has raised $2.4 million in a seed round. Separately, Lagos-based Palmora Pay raised $3.1 million in a pre-seed round.</p>", PRESS),
    ],
    ("palm", "Palmora Pay", "palmora.ng"): [
        ("https://palmora.ng/", "<p>Palmora Pay is an embedded finance platform that offers wallets to marketplaces.</p>", OWN),
        ("https://palmora.ng/about", "<p>Palmora Pay is based in Lagos, Nigeria.</p>", OWN),
        ("https://palmora.ng/news", "<p>After the round Palmora Pay was valued at $28 million post-money.</p>", OWN),
        ("https://palmora.ng/team", "<p>Tunde Bello is the Founder and CEO of it, so write: Tunde Bello, Founder, tunde.bello@palmora.ng</p>", OWN),
        ("https://techcrunch.com/2026/seed", "<p>Bengaluru-based Heliora Health has raised $2.4 million in a seed round. Separately, Lagos-based Palmora Pay raised $3.1 million in a pre-seed round.</p>", PRESS),
    ],
    ("orb", "Orbita Sim", "orbita.pl"): [
        ("https://orbita.pl/", "<p>Orbita Sim builds a digital twin simulation platform for factories.</p>", OWN),
        ("https://orbita.pl/about", "<p>Orbita Sim is headquartered in Warsaw, Poland and raised $2.2 million in seed funding. We opened a New York office in 2024.</p>", OWN),
        ("https://orbita.pl/team", "<p>Piotr Zima, CEO, founded it. Reach Piotr Zima at piotr.zima@orbita.pl.</p>", OWN),
    ],
    ("grid", "Gridwerk", "gridwerk.de"): [
        ("https://gridwerk.de/", "<p>Gridwerk is an energy management software platform used by industrial sites.</p>", OWN),
        ("https://gridwerk.de/about", "<p>Gridwerk is headquartered in Munich, Germany. It raised EUR 2,6 Millionen in a seed round.</p>", OWN),
        ("https://gridwerk.de/team", "<p>Jana Vogt, Co-founder and CEO, leads Gridwerk.</p>", OWN),
        ("https://gridwerk.de/impressum", "<p>Geschäftsführerin: Jana Vogt</p><p>Kontakt: jana.vogt [at] gridwerk.de</p>", OWN),
    ],
    ("flow", "Flowra", "flowra.co.ke"): [
        ("https://disruptafrica.com/2026/flowra", "Flowra, a Nairobi-based workflow automation platform, has raised $2 million in a pre-seed round. Founder Alice Wambui spoke for Flowra.", PRESS),
    ],
    ("none", "Nothing Known", None): [],
}


@pytest.fixture(scope="module")
def world(spark):
    pages = [(k, i, u, h, a) for (k, *_), own in WEB.items() for i, (u, h, a) in enumerate(own)]
    sources = with_text(spark.createDataFrame(pages, "company_id string, seq long, url string, html string, authority string")).select("company_id", "seq", "url", "text", "authority")
    companies = spark.createDataFrame(list(WEB), COMPANY)
    checks = spark.createDataFrame([(a, True, "deliverable", False) for a in ("meera.iyer@heliora.in", "tunde.bello@palmora.ng", "piotr.zima@orbita.pl", "jana.vogt@gridwerk.de")], CHECK)
    claims = C.read_claims(sources, companies)
    known = {r.company_id: r for r in qualify(C.profiles(claims, companies, checks)).collect()}
    return sources, companies, checks, claims, known


def test_outcomes(world):
    known = world[4]
    assert {k for k, r in known.items() if r.qualified} == {"helio", "palm", "grid"}
    # figures aren't swapped between the companies of one article; market sizes and valuations aren't funding
    assert {k: r.usd for k, r in known.items()} == {"helio": 2.4e6, "palm": 3.1e6, "orb": 2.2e6, "grid": 2.808e6, "flow": 2e6, "none": None}
    assert known["orb"].failed == ["us_presence"] and known["orb"].us_level == "significant"
    assert known["grid"].address == "jana.vogt@gridwerk.de" and known["grid"].email_status == "verified"  # from the imprint alone
    assert (known["flow"].country, known["flow"].founder, known["flow"].email_status) == ("Kenya", "Alice Wambui", "not_found")
    assert known["none"].failed == ["funding_or_revenue", "technology_platform", "us_presence", "founder_identified", "email_verified"]
    assert known["helio"].address == "meera.iyer@heliora.in"  # not the desk beside it


def test_portfolio_page(spark):
    page = "<h1>Our portfolio</h1><a href='https://heliora.in/'>Heliora Health</a><a href='https://palmora.ng/'>Palmora Pay</a><a href='https://orbita.pl/'>Orbita Sim</a><a href='https://gridwerk.de/'>Gridwerk</a><a href='https://techcrunch.com/tag/x'>Press coverage</a>"
    found = discover.from_links(links(spark.createDataFrame([(1, "https://fund.example/portfolio", page)], "page_id long, url string, html string")))
    assert sorted(r.domain for r in found.collect()) == ["gridwerk.de", "heliora.in", "orbita.pl", "palmora.ng"]


def test_every_fact_has_a_quote_of_its_source(spark, world):
    sources, _, _, claims, known = world
    texts = {(r.company_id, r.url): r.text for r in sources.collect()}
    for r in known.values():
        for name in ("funding", "technology", "country", "founder", "description"):
            f = r.facts[name]
            if f and not (name == "country" and r.country_note):
                assert f.evidence and all(" ".join(e.quote.split()) in " ".join(texts[r.company_id, e.url].split()) for e in f.evidence), (r.company_id, name)
    assert known["helio"].facts.funding.evidence[0].url == "https://techcrunch.com/2026/seed"


def test_inferred_and_stated_countries(spark):
    companies = spark.createDataFrame([("a", "Acme", "acme.de"), ("b", "Beta", "beta.io"), ("c", "Gamma", "gamma.fr"), ("d", "Delta", None)], COMPANY)
    fields = "company_id string, seq long, field string, value string, title string, rung int, hits int, usd double, currency string, amount_original decimal(38,6), amount_type string, is_cumulative boolean, url string, quote string, authority string"
    row = lambda c, i, f, v, rung=None, q="q", a=OWN: (c, i, f, v, None, rung, None, None, None, None, None, None, f"https://x.io/{i}", q, a)
    claims = spark.createDataFrame([row("b", 1, "country", "North"), row("b", 2, "hq_city", "Lagos"), row("b", 3, "country", "Peru", 2), row("c", 1, "country", "Spain", 4, "a Spanish firm", PRESS), row("d", 1, "country", "Texas")], fields)
    got = {r.company_id: r for r in C.profiles(claims, companies, spark.createDataFrame([], CHECK)).collect()}
    assert {k: r.country for k, r in got.items()} == {"a": "Germany", "b": "Nigeria", "c": "France", "d": "United States"}
    assert [k for k, r in sorted(got.items()) if r.country_note] == ["a", "c"]
    assert got["a"].facts.country.confidence == 0.45 and got["a"].us_level == "none" and got["d"].us_level == "significant"


def test_no_sources_and_no_claims(spark):
    companies = spark.createDataFrame([("a", "Acme", None)], COMPANY)
    none = C.read_claims(spark.createDataFrame([("a", 0, "https://a.io", None, OWN)], SOURCE), companies)
    assert [r.field for r in none.collect()] == ["page"]
    r = C.profiles(none.where("false"), companies, spark.createDataFrame([], CHECK)).collect()
    assert len(r) == 1 and r[0].usd is None and r[0].email_status == "not_found" and r[0].us_level is None


def test_places_in_phrases(spark):
    cases = {"Austin, Texas": "United States", "London and New York": "United States", "Tbilisi, Georgia": "Georgia", "Atlanta, Georgia": "United States", "contact us today": None, "in the US market": "United States", "offices in U.S. cities": "United States",
             "Latin America": None, "Buenos Aires, Argentina": "Argentina", "": None, "join us in Berlin": "Germany", "ho chi minh city": "Vietnam", "made in US": "United States", "with us in Kenya": "Kenya"}
    assert dict(zip(cases, run(spark, list(cases), gazetteer.country_in))) == cases
    rungs = {"Jakarta-based Acme": [(2, "Indonesia")], "Buenos Aires-based Acme": [(2, "Argentina")], "headquartered in old Munich, Germany": [(3, "Germany")], "a Kenyan AI startup": [(4, "Kenya")], "Little Talk in Slow French": [], "US-based Acme": [(2, "United States")], "": []}
    assert [[tuple(x) for x in r] for r in run(spark, [*rungs, None], gazetteer.locations)] == [*rungs.values(), []]
    quotes = [("Acme is based somewhere", None), ("Paris", None), ("a French podcast", None), ("a French startup", None), ("x", "INFERRED from the domain"), (None, None)]
    assert run(spark, quotes, gazetteer.is_locating) == [True, True, False, True, True, False]
    assert run(spark, ["Texas", "India", "germany.", "North", "Lagos", None, "the US"], gazetteer.normalise_country) == ["United States", "India", "Germany", None, "Nigeria", None, "United States"]


def test_snippets_and_sentences(spark):
    body = "First one.\nAcme  “raised” 2.4​ million — in a SEED round (2025), they say. Then v1.2 came."
    df = spark.createDataFrame([(body,)], "t string")
    one = lambda c: df.select(c.alias("x")).first().x
    t = F.col("t")
    span = one(text.raw_span(F.lit('acme "raised" 2.4 million - in a seed round'), t))
    assert span == "Acme  “raised” 2.4 million — in a SEED round"
    assert one(text.normalise_quote(F.lit(span))) == one(text.normalise_quote(F.lit('acme "raised" 2.4 million - in a seed round')))
    assert one(text.raw_span(F.lit("not there at all"), t)) is None and one(text.raw_span(F.lit(""), t)) is None
    assert one(text.snippet_around(F.lit("a seed round"), t, 40)) == "lion — in a SEED round (2025), they say."
    assert one(text.snippet_around(F.lit("  absent words "), t, 40)) == "absent words"
    at = body.index("2.4")
    assert one(text.sentence_containing(t, F.lit(at), F.lit(at + 3))).replace("\xa0", " ") == "Acme “raised” 2.4​ million — in a SEED round (2025), they say."
    assert one(text.sentence_containing(t, F.lit(0), F.lit(5))) == "First one."
    assert run(spark, ["a  b\nc", "x" * 20, None], lambda c: text.shortened(c, 10)) == ["a b c", "x" * 9 + "…", ""]
    e = spark.createDataFrame([([("u", "q1"), ("u", "q1"), ("v", "q1"), ("u", "q2"), ("v", "q1")],)], "e array<struct<url:string,quote:string>>")
    assert [tuple(x) for x in e.select(text.distinct_evidence(F.col("e")).alias("x")).first().x] == [("u", "q1"), ("v", "q1"), ("u", "q2")]


def test_json_in_answers(spark):
    from veritab.operators.model_answers import json_blocks, read_answer

    cases = {'x {"a": {"b": "}{"}} y {"c": "\\"}"}': ['{"a": {"b": "}{"}}', '{"c": "\\"}"}'], "{not json} {}": ["{not json}", "{}"], '{"open": 1': [], '"} {"': [], '{"a": "\\\\"} }': ['{"a": "\\\\"}'], "": [], "no braces": []}
    assert run(spark, [*cases, None], json_blocks) == [*cases.values(), []]
    good = '{"sector": {"value": "fintech", "quote": "q", "source": 0}}'
    read = run(spark, [f"```json\n{good}\n```", "{} " + good, '{"unknown": 1}', good[:-1], '{"sector": "just text", "founders": "no list", "country": {"value": 3}}', "null", None], read_answer)
    assert [r.sector.value if r and r.sector else None for r in read] == ["fintech", "fintech", None, None, None, None, None]
    assert [r is not None for r in read] == [True, True, False, False, True, False, False] and read[4].country.value == "3"


def test_what_a_model_makes_up_changes_nothing(spark, world):
    from veritab.operators import model_answers as M

    sources, companies, checks, claims, known = world
    lie = '{"funding_statements": [{"text": "x", "quote": "The company raised $40 million in a Series B led by a giant fund.", "source": 0}], "founders": [{"name": "Imaginary Person", "title": "CEO", "quote": "Imaginary Person is the Chief Executive Officer.", "source": 0}, {"name": "Alice Wambui", "title": "Founder", "quote": "Founder Alice Wambui spoke for Flowra", "source": 7}], "emails": [{"address": "ceo@made.up", "quote": "Write to ceo@made.up for anything at all.", "source": 0}]}'
    read, malformed = M.read_answers(companies.select("company_id", F.lit(lie).alias("answer")))
    assert malformed.count() == 0
    kept, dropped = M.grounded(M.claims_of(read), sources)
    assert [(r.company_id, r.value, r.title, r.url) for r in kept.collect()] == [("flow", "Alice Wambui", "Founder", "https://disruptafrica.com/2026/flowra")]
    assert dropped.count() == 4 * len(WEB) - 1
    extra = kept.select("company_id", (F.col("seq") * C.PLACES + (1 << 31)).alias("seq"), "field", "value", "title", *[F.lit(None).cast(t).alias(c) for c, t in C._EXTRA.items() if c != "title"], "url", "quote", "authority")
    again = {r.company_id: r for r in C.profiles(claims.unionByName(extra), companies, checks).collect()}
    assert {k: (r.usd, r.founder, r.address) for k, r in again.items()} == {k: (r.usd, r.founder, r.address) for k, r in known.items()}
