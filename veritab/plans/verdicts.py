"""Queries from text to verdict. Sites of seven kinds are derived from customers, so that the SQL knows each company's verdict
from its key, not from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.gazetteer import is_locating, locations, mentions_united_states
from ..operators.claims import profiles, read_claims
from ..operators.model_answers import claims_of, grounded, read_answers
from ..operators.qualify import Band, qualify
from ..shared import table

BAND = Band()
#: Pages of a company's kind, by its key modulo their number: (path or url, text); {n} is the key.
SITES = [
    [("/", "Firm{n} Care is a care coordination platform used by clinics, and it helps their patients."), ("/about", "Firm{n} Care is headquartered in Bengaluru, India.\nIt raised $2.4 million in a seed round."),
     ("/team", "Priya Raman, Co-founder & CEO, leads the company.\nContact Priya Raman at priya.raman [at] firm{n}.example.in.\nGeneral: info@firm{n}.example.in")],
    [("/", "Firm{n} Pay offers an embedded finance platform for payments and wallets in its markets."), ("/about", "Firm{n} Pay is based in Lagos, Nigeria.\nThe company raised $3.1 million in a pre-seed round."),
     ("/news", "Firm{n} Pay was valued at $28 million post-money."), ("/team", "Chidi Okonkwo, Founder, runs it.\nWrite to Chidi Okonkwo: chidi.okonkwo@firm{n}.example.ng")],
    [("/", "Firm{n} Sim builds a digital twin simulation platform for factories of every size."), ("/about", "Firm{n} Sim is headquartered in Warsaw, Poland and raised $2.2 million in seed funding.\nWe opened a New York office in 2024."),
     ("/team", "Marek Nowak, CEO, can be reached.\nMarek Nowak: marek.nowak@firm{n}.example.pl")],
    [("/", "Firm{n} Grid is an energy management software platform used by industrial sites."), ("/about", "Firm{n} Grid is headquartered in Munich, Germany. It raised EUR 2,6 Millionen in a seed round."), ("/team", "Lena Brandt, Co-founder, leads Firm{n} Grid."),
     ("/impressum", "Geschäftsführer: Lena Brandt\nKontakt: lena.brandt [at] firm{n}.example.de")],
    [("https://techcrunch.com/{n}/firm", "Bengaluru-based Other{n} raised $2.4 million in a seed round. Separately, Nairobi-based Flow{n} raised $3.5 million in a seed round.")],
    [("/", "We are a consulting firm with a dashboard for banks and their clients in Firm{n}."), ("/about", "Our head office is in Paris, France.")],
    [],
]
NAMES = ["Firm{n} Care", "Firm{n} Pay", "Firm{n} Sim", "Firm{n} Grid", "Flow{n}", "Firm{n} Advice", "Firm{n} Unknown"]
ENDINGS = ["in", "ng", "pl", "de", "ke", "fr", "dk"]


def _told(kind: int, text: str, n):
    return F.when(n % len(SITES) == kind, F.replace(F.lit(text), F.lit("{n}"), n.cast("string")))


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(n.alias("company_id"), F.coalesce(*[_told(i, x, n) for i, x in enumerate(NAMES)]).alias("name"), F.coalesce(*[_told(i, f"firm{{n}}.example.{x}", n) for i, x in enumerate(ENDINGS)]).alias("domain"))


def _sources(companies: DataFrame) -> DataFrame:
    n, home = F.col("company_id"), F.concat(F.lit("https://"), "domain")
    text = lambda t: F.replace(F.lit(t), F.lit("{n}"), n.cast("string"))
    page = lambda i, at, t: F.struct(F.lit(i).cast("long").alias("seq"), (F.concat(home, F.lit(at)) if at.startswith("/") else text(at)).alias("url"), text(t).alias("text"), F.lit("company_owned" if at.startswith("/") else "tier1_press").alias("authority"))
    pages = F.coalesce(*[F.when(n % len(SITES) == k, F.array(*[page(i, at, t) for i, (at, t) in enumerate(site)])) for k, site in enumerate(SITES) if site])
    return companies.select("company_id", F.explode(pages).alias("p")).select("company_id", "p.*")


def _checks(companies: DataFrame) -> DataFrame:
    person = F.coalesce(*[F.when(F.col("company_id") % len(SITES) == i, p) for i, p in enumerate(("priya.raman", "chidi.okonkwo", "marek.nowak", "lena.brandt"))])
    return companies.where(person.isNotNull()).select(F.concat(person, F.lit("@"), "domain").alias("address"), F.lit(True).alias("has_mx"), F.lit("deliverable").alias("deliverability"), F.lit(False).alias("catch_all"))


def text_to_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the texts of sites and articles to claims, profiles and verdicts."""
    companies = _companies(spark, sf_dir)
    known = profiles(read_claims(_sources(companies), companies), companies, _checks(companies), BAND)
    judged = qualify(known, BAND)
    return judged.select("company_id", F.round("usd", 2).alias("usd"), "country", "us_level", "founder", "sector", "email_status", "qualified", F.array_join("failed", ",").alias("failed"), F.size("facts.funding.evidence").alias("n_proofs"))


def claim_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims of each field the sites make, and by how many companies."""
    companies = _companies(spark, sf_dir)
    return read_claims(_sources(companies), companies).groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("company_id").alias("companies"))


#: Sentences and what they say of a company's country: (text, rung, country, whether it locates, whether the United States are meant).
PLACED = [
    ("Jakarta-based Firm{n} grows", 2, "Indonesia", True, False), ("Firm{n} is headquartered in the old town of Warsaw, Poland", 3, "Poland", True, False), ("a Kenyan payments startup, Firm{n}", 4, "Kenya", True, False),
    ("Little Talk in Slow French by Firm{n}", None, None, False, False), ("Firm{n} is based in London and New York", 3, "United States", True, False), ("contact us today at Firm{n}", None, None, False, False),
    ("Firm{n} sells in the US market", None, None, True, True), ("our office of Firm{n}", None, None, True, False), ("Firm{n} left Latin America", None, None, False, False), ("Firm{n} is located in Atlanta, Georgia", 3, "United States", True, False),
]


def country_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    text = F.coalesce(*[F.when(n % len(PLACED) == i, F.replace(F.lit(x[0]), F.lit("{n}"), n.cast("string"))) for i, x in enumerate(PLACED)])
    rows = table(spark, sf_dir, "customer").select(n, text.alias("text"))
    first = F.get(locations(F.col("text")), F.lit(0))
    return rows.select("c_custkey", first["rung"].cast("int").alias("rung"), first["country"].alias("country"), is_locating(F.col("text")).alias("locating"), mentions_united_states(F.col("text")).alias("us"))


QUERIES = {f.__name__: f for f in (text_to_verdict, claim_fields, country_evidence)}

_said = lambda values: "[" + ", ".join("null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'" for v in values) + "]"
#: Claims of each kind of site, by field.
CLAIMS = [
    {"page": 3, "technology": 1, "description": 1, "sector": 1, "country": 1, "amount": 1, "founder": 1, "email": 2}, {"page": 4, "technology": 1, "description": 1, "sector": 1, "country": 1, "amount": 2, "founder": 1, "email": 1},
    {"page": 3, "technology": 1, "description": 1, "sector": 1, "country": 1, "amount": 1, "founder": 1, "email": 1, "us_signal": 1}, {"page": 4, "technology": 1, "description": 1, "sector": 1, "country": 1, "amount": 1, "founder": 2, "email": 1},
    {"page": 1, "country": 2, "amount": 2}, {"page": 2, "technology": 1, "description": 1, "services": 1}, {},
]
_PICK = lambda values, n="c_custkey": f"({_said(values)})[{n} % {len(values)} + 1]"

SQL = {
    "text_to_verdict": f"""
        select c_custkey as company_id, cast({_PICK([2400000, 3100000, 2200000, 2808000, 3500000, None, None])} as double) as usd, {_PICK(["India", "Nigeria", "Poland", "Germany", "Kenya", "France", "Denmark"])} as country,
               {_PICK(["none", "none", "significant", "none", "none", "none", "none"])} as us_level, {_PICK(["Priya Raman", "Chidi Okonkwo", "Marek Nowak", "Lena Brandt", None, None, None])} as founder,
               {_PICK(["Healthtech / Digital health", "Fintech / Payments", "Digital twin / Industrial", "Climate / Energy", None, None, None])} as sector,
               {_PICK(["verified", "verified", "verified", "verified", "not_found", "not_found", "not_found"])} as email_status, c_custkey % 7 in (0, 1, 3) as qualified,
               {_PICK(["", "", "us_presence", "", "technology_platform,founder_identified,email_verified"] + ["funding_or_revenue,technology_platform,founder_identified,email_verified"] * 2)} as failed,
               {_PICK([1, 1, 1, 1, 1, None, None])} as n_proofs from customer""",
    "claim_fields": f"""
        with per(k, field, n) as (values {", ".join(f"({k}, '{f}', {n})" for k, own in enumerate(CLAIMS) for f, n in own.items())}),
        c as (select c_custkey % 7 as k, count(*) as customers from customer group by 1)
        select field, sum(n * customers)::bigint as n, sum(customers)::bigint as companies from per join c using (k) group by 1""",
    "country_evidence": f"""
        select c_custkey, {_PICK([x[1] for x in PLACED])} as rung, {_PICK([x[2] for x in PLACED])} as country, {_PICK([x[3] for x in PLACED])} as locating, {_PICK([x[4] for x in PLACED])} as us from customer""",
}


#: Answers of a model, by key modulo their number: fenced, amid prose with braces, broken, nested with braces in strings, one that makes things up.
ANSWERS = [
    '```json\n{"founders": [{"name": " Priya Raman ", "title": "CEO", "quote": "Priya Raman, Co-founder & CEO, leads the company.", "source": 2}], "country": {"value": "India", "quote": "is headquartered in Bengaluru, India", "source": "1"}}\n```',
    'Here {as asked}: {"hq_city": {"value": "Lagos", "quote": "Firm{n} Pay is based in Lagos, Nigeria.", "source": 0}, "other": 1} and more {"country": {}}',
    '{"founders": [{"name": "Marek Nowak", "quote": "Marek Nowak, CEO, can be reached."',
    '{"description": {"value": "a {curly} \\"quoted\\" platform", "quote": "an energy management software platform used by industrial sites", "source": 9}, "emails": [{"address": "Lena.Brandt@firm{n}.example.de", "quote": "nobody wrote this sentence"}], "is_tech_platform": {"value": true, "quote": "Firm{n} Grid is an energy management software platform", "source": 0}}',
    '{"funding_statements": [{"quote": "Flow{n} raised $40 million in a Series B led by a large fund", "source": 0}, {"text": "a seed round", "quote": "Nairobi-based Flow{n} raised $3.5 million in a seed round", "source": 0}]}',
    "I can't tell.",
    None,
]


def model_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model's answers say that their company's sources say too; malformed answers as rows of their own."""
    companies = _companies(spark, sf_dir)
    n = F.col("company_id")
    answers = companies.select("company_id", F.coalesce(*[_told(i, x, n) for i, x in enumerate(ANSWERS) if x]).alias("answer"))
    read, malformed = read_answers(answers)
    kept, dropped = grounded(claims_of(read), _sources(companies))
    rows = [
        kept.select("company_id", "field", "value", F.col("mode").alias("outcome"), "url"),
        dropped.select("company_id", "field", "value", F.lit("dropped").alias("outcome"), F.lit(None).cast("string").alias("url")),
        malformed.select("company_id", *[F.lit(None).cast("string").alias(c) for c in ("field", "value")], F.lit("malformed").alias("outcome"), F.lit(None).cast("string").alias("url")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES["model_claims"] = model_claims
SQL["model_claims"] = """
    with c as (select c_custkey as n, c_custkey % 7 as k from customer)
    select n as company_id, 'founder' as field, 'Priya Raman' as value, 'exact' as outcome, 'https://firm' || n || '.example.in/team' as url from c where k = 0
    union all select n, 'country', 'India', 'exact', 'https://firm' || n || '.example.in/about' from c where k = 0
    union all select n, 'hq_city', 'Lagos', 'exact', 'https://firm' || n || '.example.ng/about' from c where k = 1
    union all select n, 'description', 'a {curly} "quoted" platform', 'exact', 'https://firm' || n || '.example.de/' from c where k = 3
    union all select n, 'is_tech_platform', 'true', 'exact', 'https://firm' || n || '.example.de/' from c where k = 3
    union all select n, 'email', 'lena.brandt@firm' || n || '.example.de', 'dropped', null from c where k = 3
    union all select n, 'funding_statement', 'Flow' || n || ' raised $40 million in a Series B led by a large fund', 'dropped', null from c where k = 4
    union all select n, 'funding_statement', 'a seed round', 'exact', 'https://techcrunch.com/' || n || '/firm' from c where k = 4
    union all select n, null, null, 'malformed', null from c where k in (2, 5, 6)"""
