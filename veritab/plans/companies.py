"""Queries over figures, verdicts and entities. Sentences and profiles are derived from the sales tables, so that the SQL
knows every figure from a numeric column, not from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.money import rounded
from ..functions.people import company_from_headline, title_score
from ..operators.extract import amounts, persons, promise
from ..operators.fuse import best_amount, email
from ..operators.qualify import Band, confidence, qualify, recheck
from ..operators.report import address_outcomes, failed_only_on, gate_failures, kpis, near_misses, ruled_out
from ..operators.resolve import find, known_keys, merge, unknown
from ..shared import spread, table
from ..vocab import FX

BAND = Band()
_CURRENCIES = sorted(FX)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey, text: a sentence an order, in eight wordings by order key."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    v = F.format_string("%.2f", rounded(F.col("o_totalprice") / 100000, 2) + 0.01)
    name = F.concat(F.lit("Customer "), F.lit("Nr-"), "o_custkey")
    say = lambda *parts: F.concat(name, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    wordings = [
        say(" raised $", v, " million in a seed round."), say(" secured €", v, " million of funding to date."), say(" posted revenue of £", v, "m last year."),
        say(" was valued at $", v, " billion."), F.concat(F.lit("Indian startup "), say(" raised Rs ", v, " crore.")), say(" erhielt ", F.replace(v, F.lit("."), F.lit(",")), " Millionen Euro."),
        say(" signed a credit facility of AED ", v, " million."), say(" raised US$", F.format_number(F.floor("o_totalprice"), 0), " from friends."),
    ]
    text = F.coalesce(*[F.when(F.col("o_orderkey") % 8 == i, w) for i, w in enumerate(wordings)])
    return rows.select("o_orderkey", "o_custkey", text.alias("text"))


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _sentences(spark, sf_dir)
    return amounts(said, "o_orderkey").join(said.select("o_orderkey", "o_custkey"), "o_orderkey")


def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: rounded(F.col(c).cast("double"), 2).alias(c)
    return amounts(_sentences(spark, sf_dir), "o_orderkey").select("o_orderkey", "currency", d("amount_original"), d("amount_usd"), "amount_type", "is_cumulative")


def money_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts(_sentences(spark, sf_dir), "o_orderkey").groupBy("amount_type", "currency").agg(F.count("*").alias("n"), F.round(F.sum(F.col("amount_usd").cast("decimal(38,2)")).cast("double"), 0).alias("usd"))


def money_best_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_amount(_figures(spark, sf_dir).withColumn("seq", F.col("o_orderkey")), BAND.least, BAND.most, "o_custkey")
    usd = F.col("amount.amount_usd").cast("double")
    near = (F.abs(usd - BAND.least) / BAND.least <= BAND.tolerance) | (F.abs(usd - BAND.most) / BAND.most <= BAND.tolerance)
    return best.select("o_custkey", F.col("amount.o_orderkey").alias("o_orderkey"), rounded(usd, 2).alias("usd"), usd.between(BAND.least, BAND.most).alias("in_band"), near.alias("near_boundary"))


def fx_convert_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = spark.createDataFrame([(i, c, float(FX[c])) for i, c in enumerate(_CURRENCIES)], "i int, currency string, rate double")
    met = table(spark, sf_dir, "supplier").join(F.broadcast(fx), F.col("s_nationkey") == F.col("i"))
    return met.groupBy("s_nationkey", "currency").agg(F.count("*").alias("n"), F.round(F.sum(F.col("s_acctbal") * F.col("rate")), 4).alias("usd"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    pick = lambda m, *values: F.coalesce(*[F.when(c % m == i, F.lit(v)) for i, v in enumerate(values) if v is not None], F.lit(None).cast("string"))
    usd = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    nation = F.col("c_nationkey")
    countries = ["India", "France", "Kenya", "Peru", "Japan", "Germany", None]
    sector = F.coalesce(*[F.when(F.col("c_mktsegment") == s, v) for s, v in (("AUTOMOBILE", "mobility"), ("BUILDING", "construction"), ("HOUSEHOLD", "payments"), ("MACHINERY", "digital twin"))])
    return table(spark, sf_dir, "customer").join(usd, "c_custkey", "left").select(
        c.alias("company_id"), (F.col("cents") / 100).alias("usd"), pick(5, "revenue", "arr", "funding_raised", "valuation", "funding_raised").alias("amount_type"), (F.col("c_mktsegment") != "FURNITURE").alias("tech"),
        F.coalesce(*[F.when(nation % 5 == i, v) for i, v in enumerate(("none", "minimal", "none", "significant"))]).alias("us_level"), pick(6, "CEO", "Co-Founder", "Managing Director", "Founder & CEO", "Chair", None).alias("title"),
        pick(4, "verified", "source_verified", "verified", None).alias("email_status"), F.coalesce(*[F.when(nation % 7 == i, v) for i, v in enumerate(countries) if v]).alias("country"), sector.alias("sector"),
    )


def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = qualify(_profiles(spark, sf_dir), BAND)
    return judged.select("company_id", "qualified", F.size("failed").cast("long").alias("n_failed"), F.array_join("failed", ",").alias("failed"), "first_failure", "near_boundary", "fit_score")


def gate_failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_failures(qualify(_profiles(spark, sf_dir), BAND))


def near_miss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_misses(qualify(_profiles(spark, sf_dir), BAND))


def verdict_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = qualify(_profiles(spark, sf_dir), BAND)
    # one aggregate over the verdicts: totals and the entities that failed on their address alone
    return kpis(judged).withColumn("k", F.lit(1)).join(judged.agg(failed_only_on(judged, "email_verified").alias("only_email")).withColumn("k", F.lit(1)), "k").drop("k")


def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = qualify(_profiles(spark, sf_dir), BAND)
    known = lambda c, sure: F.when(F.col(c).isNotNull(), sure).otherwise(0.0)
    parts = [known("usd", 0.9), F.when(F.col("tech"), 0.8).otherwise(0.0), known("us_level", 0.7), known("title", 0.9), F.when(F.col("email_status") == "verified", 0.9).when(F.col("email_status").isNotNull(), 0.5).otherwise(0.0)]
    corroborated = F.when(F.col("company_id") % 3 == 0, 2).otherwise(0)
    return judged.select("company_id", F.round(confidence(parts, corroborated, F.size("failed")), 6).alias("confidence"))


def lead_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored leads in ten states, one customer each: the rule that each breaks, or none."""
    c = F.col("c_custkey")
    case = lambda default, **at: F.coalesce(*[F.when(c % 12 == int(k[1:]), F.lit(v)) for k, v in at.items()], F.lit(default))
    leads = table(spark, sf_dir, "customer").select(
        c.alias("company_id"), case("Lena Brandt", _0="", _1="Ex-Acme Founder").alias("founder"),
        case("lena.brandt@acme.io", _2="", _3="info@acme.io", _8="otto@elsewhere.io").alias("address"),
        case("acme.io", _4="acme.vc", _5="techcrunch.com", _6="linkedin.com", _7="daily-gazette.com").alias("domain"),
        F.when(c % 12 == 9, F.lit(None).cast("double")).when(c % 12 == 10, F.lit(5000001.0)).otherwise(F.lit(5000000.0)).alias("usd"),
        F.when(c % 24 == 11, "source_verified").otherwise("verified").alias("email_status"),
    )
    kept, lost = recheck(leads, BAND)
    return kept.select("company_id", F.lit(None).cast("string").alias("reason")).unionByName(lost.select("company_id", "reason"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    kind = F.coalesce(*[F.when(c % 5 == i, k) for i, k in enumerate(("headline", "company_site", "article", "link_hub", "unknown"))])
    return table(spark, sf_dir, "customer").select(
        c.alias("seq"), F.concat(F.lit("Firm "), (c % 500).cast("string"), F.lit(" Ltd")).alias("name"), F.when(c % 3 == 0, F.concat(F.lit("www.firm"), (c % 200).cast("string"), F.lit(".com"))).alias("domain"),
        F.col("c_mktsegment").alias("snippet"), kind.alias("source_kind"),
    )


def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(_candidates(spark, sf_dir)).select("entity", "name", "domain", "n_sources", "snippet", "source_kind", "seq")


def known_key_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("firm "), F.col("s_suppkey") * 2).alias("name"), F.concat(F.lit("firm"), F.col("s_suppkey") * 3, F.lit(".com")).alias("domain"))
    return unknown(_candidates(spark, sf_dir), known_keys(known)).select("seq", "name", "domain")


def find_company_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    companies = table(spark, sf_dir, "supplier").select(s.alias("company_id"), F.concat(F.lit("Firm "), s * 2).alias("name"), F.concat(F.lit("firm"), s * 3, F.lit(".com")).alias("domain"))
    aliases = table(spark, sf_dir, "supplier").select(s.alias("company_id"), F.concat(F.lit("Firm "), s * 5).alias("alias"))
    return find(_candidates(spark, sf_dir).withColumnRenamed("seq", "ask_id"), companies, aliases)


def _wording(rows: DataFrame, *texts) -> DataFrame:
    """c_custkey and text: one of the wordings for each customer, in which {n} is its key."""
    n = F.col("c_custkey")
    rows = spread(rows.select(n))
    text = F.coalesce(*[F.when(n % len(texts) == i, F.replace(F.lit(t), F.lit("{n}"), n.cast("string"))) for i, t in enumerate(texts)])
    return rows.select("c_custkey", text.alias("text"))


def headline_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _wording(table(spark, sf_dir, "customer"), "Indian fintech Firm{n} raises $2M", "Lagos-based Firm{n} Robotics secures seed", "Exclusive: Firm{n} closes round - Daily", "no verb beside Firm{n}")
    return said.select("c_custkey", company_from_headline(F.col("text")).alias("name"))


def people_in_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _wording(table(spark, sf_dir, "customer"), "Lena Brandt, co-founder and CEO of Firm{n}", "Geschäftsführer: Jan Weber, Nr {n}", "nobody at all at Firm{n}")
    return persons(said, "c_custkey").select("c_custkey", "name", "title", title_score(F.col("title")).cast("long").alias("title_score"))


def candidate_promise(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _wording(table(spark, sf_dir, "customer"), "Kenyan fintech startup raises $2 million", "Firm{n} raised $45 million in a Series B", "a CEO speaks")
    rows = said.select(F.col("c_custkey").alias("seq"), F.col("text").alias("snippet"), F.lit(None).cast("string").alias("domain"), F.lit("headline").alias("source_kind"))
    return promise(rows, BAND.least, BAND.most).select("seq", F.round("promise", 3).alias("promise"), F.col("hopeless").isNotNull().alias("is_hopeless"))


def email_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight states of a founder's address, one customer each."""
    n = F.col("c_custkey")
    domain = F.concat(F.lit("firm"), n, F.lit(".io"))
    rows = table(spark, sf_dir, "customer").select(n, domain.alias("domain"), (n % 8).alias("k"), F.when(n % 8 == 1, F.concat(F.lit("info@"), domain)).otherwise(F.concat(F.lit("lena.brandt@"), domain)).alias("address"))
    companies = rows.select(F.col("c_custkey").alias("company_id"), "domain", F.when(F.col("k") != 4, "Lena Brandt").alias("founder"))
    found = rows.where("k <> 0").select(F.col("c_custkey").alias("company_id"), F.lit(0).cast("long").alias("seq"), F.lit("email").alias("field"), F.col("address").alias("value"), F.concat(F.lit("https://"), "domain").alias("url"), F.lit("").alias("quote"), F.when(F.col("k") == 3, "unknown").otherwise("company_owned").alias("authority"))
    checks = rows.select("address", (F.col("k") != 5).alias("has_mx"), F.when(F.col("k") == 7, "risky").otherwise("deliverable").alias("deliverability"), (F.col("k") == 6).alias("catch_all"))
    return email(found, companies, checks).select("company_id", "address", "status")


def address_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_outcomes(_profiles(spark, sf_dir))


def ruled_out_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why candidates were ruled out by their excerpts: a top-3 report."""
    said = _wording(table(spark, sf_dir, "customer"), "Kenyan fintech startup raises $2 million", "Firm{n} raised $45 million in a Series B", "the US-based startup Firm{n}, an American software company")
    rows = said.select(F.col("c_custkey").alias("seq"), F.col("text").alias("snippet"), F.lit(None).cast("string").alias("domain"), F.lit("headline").alias("source_kind"))
    return ruled_out(promise(rows, BAND.least, BAND.most))


QUERIES = {f.__name__: f for f in (address_outcome_counts, ruled_out_reasons, headline_companies, people_in_sentences, candidate_promise, email_ladder, money_parse, money_by_type, money_best_per_company, fx_convert_by_nation, gate_verdicts, gate_failure_histogram, near_miss_reasons, verdict_kpis, confidence_scores, lead_recheck, candidate_merge, known_key_antijoin, find_company_precedence)}

_MONEY = f"""
    v as (select o_orderkey, o_custkey, o_orderkey % 8 as w, cast(round(round(o_totalprice / 100000, 2) + 0.01, 2) as decimal(18,2)) as x, cast(floor(o_totalprice) as decimal(18,2)) as whole from orders),
    dim(w, currency, factor, amount_type, is_cumulative, rate) as (values
        (0, 'USD', 1000000, 'funding_raised', false, {FX["USD"]}), (1, 'EUR', 1000000, 'funding_raised', true, {FX["EUR"]}), (2, 'GBP', 1000000, 'revenue', false, {FX["GBP"]}), (3, 'USD', 1000000000, 'valuation', false, {FX["USD"]}),
        (4, 'INR', 10000000, 'funding_raised', false, {FX["INR"]}), (5, 'EUR', 1000000, 'funding_raised', false, {FX["EUR"]}), (6, 'AED', 1000000, 'debt', false, {FX["AED"]}), (7, 'USD', 0, 'funding_raised', false, {FX["USD"]})),
    m as (select o_orderkey, o_custkey, currency, amount_type, is_cumulative, cast(case when w = 7 then whole else x * factor end as decimal(30,2)) as amount, rate from v join dim using (w)),
    figures as (select *, cast(amount * cast(rate as decimal(10,6)) as decimal(38,6)) as usd from m where amount > 0 and not (currency = 'USD' and amount < 1000))"""
_PROFILES = """
    s as (select o_custkey, cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as usd from orders group by 1),
    p as (select c_custkey as company_id, s.usd, (['revenue', 'arr', 'funding_raised', 'valuation', 'funding_raised'])[c_custkey % 5 + 1] as amount_type, c_mktsegment <> 'FURNITURE' as tech,
                 (['none', 'minimal', 'none', 'significant', null])[c_nationkey % 5 + 1] as us_level, (['CEO', 'Co-Founder', 'Managing Director', 'Founder & CEO', 'Chair', null])[c_custkey % 6 + 1] as title,
                 (['verified', 'source_verified', 'verified', null])[c_custkey % 4 + 1] as email_status, (['India', 'France', 'Kenya', 'Peru', 'Japan', 'Germany', null])[c_nationkey % 7 + 1] as country, c_mktsegment as seg
          from customer left join s on o_custkey = c_custkey),
    g as (select *, usd is not null and amount_type <> 'valuation' and usd between 1000000 and 5000000 as g1, tech as g2, coalesce(us_level in ('none', 'minimal'), false) as g3,
                 coalesce(title in ('CEO', 'Co-Founder', 'Managing Director', 'Founder & CEO'), false) as g4, coalesce(email_status = 'verified', false) as g5,
                 case seg when 'AUTOMOBILE' then 0.8 when 'HOUSEHOLD' then 1.0 when 'MACHINERY' then 1.0 else 0.0 end as w1,
                 case country when 'India' then 1.0 when 'France' then 1.0 when 'Kenya' then 0.8 when 'Peru' then 0.45 when 'Japan' then 0.5 when 'Germany' then 0.8 else 0.0 end as w2 from p),
    judged as (select *, list_filter([case when not g1 then 'funding_or_revenue' end, case when not g2 then 'technology_platform' end, case when not g3 then 'us_presence' end, case when not g4 then 'founder_identified' end, case when not g5 then 'email_verified' end], lambda x: x is not null) as failed,
                 case when usd is null then 'no figure was found' when amount_type = 'valuation' then 'the figure is of type valuation' when usd < 1000000 then 'below the band' when usd > 5000000 then 'above the band'
                      when not g2 then 'no platform was found' when us_level is null then 'the country is unknown' when not g3 then 'presence is significant'
                      when title is null then 'nobody was found' when not g4 then 'the office isn''t that of a founder or chief executive'
                      when email_status is null then 'no address was found' when not g5 then 'the address is ' || email_status end as first_failure,
                 coalesce(abs(usd - 1e6) / 1e6 <= 0.1 or abs(usd - 5e6) / 5e6 <= 0.1, false) as near_boundary,
                 round(least(1.0, 0.40 * w1::double + 0.30 * w2::double + 0.20 * (case when usd is null then 0.0 when usd between 1.5e6 and 4e6 then 1.0 else 0.7 end)::double + (case when g5 then 0.05 else 0 end)::double + (case when g4 then 0.05 else 0 end)::double), 3) as fit_score from g)"""
_CANDIDATES = """
    k as (select c_custkey as seq, 'Firm ' || (c_custkey % 500) || ' Ltd' as name, 'firm ' || (c_custkey % 500) as nn, case when c_custkey % 3 = 0 then 'www.firm' || (c_custkey % 200) || '.com' end as domain,
                 case when c_custkey % 3 = 0 then 'firm' || (c_custkey % 200) || '.com' end as dn, c_mktsegment as snippet, c_custkey % 5 as kind from customer)"""

SQL = {
    "address_outcome_counts": f"""
        with {_PROFILES}, states(rank, status) as (values (0, 'invalid'), (1, 'not_found'), (2, 'role_only'), (3, 'found_unverified'), (4, 'source_verified'), (5, 'verified'))
        select s.rank, s.status, count(p.email_status) as n from states s left join p on p.email_status = s.status group by 1, 2""",
    "ruled_out_reasons": "select (['its figure is outside the band', 'a company of the United States'])[c_custkey % 3] as reason, count(*) as n from customer where c_custkey % 3 > 0 group by 1",
    "headline_companies": "select c_custkey, case c_custkey % 4 when 1 then 'Firm' || c_custkey || ' Robotics' when 3 then null else 'Firm' || c_custkey end as name from customer",
    "people_in_sentences": "select c_custkey, case c_custkey % 3 when 0 then 'Lena Brandt' else 'Jan Weber' end as name, case c_custkey % 3 when 0 then 'co-founder and CEO' else 'Managing Director' end as title, cast(case c_custkey % 3 when 0 then 7 else 3 end as bigint) as title_score from customer where c_custkey % 3 < 2",
    "candidate_promise": "select c_custkey as seq, cast(case c_custkey % 3 when 0 then 5.0 when 1 then 0.0 else 0.9 end as double) as promise, c_custkey % 3 = 1 as is_hopeless from customer",
    "email_ladder": """
        select c_custkey as company_id, case when c_custkey % 8 > 1 then 'lena.brandt@firm' || c_custkey || '.io' end as address,
               (['not_found', 'role_only', 'verified', 'found_unverified', 'found_unverified', 'invalid', 'source_verified', 'source_verified'])[c_custkey % 8 + 1] as status from customer""",
    "money_parse": f"with {_MONEY} select o_orderkey, currency, round(cast(amount as double), 2) as amount_original, round(cast(usd as double), 2) as amount_usd, amount_type, is_cumulative from figures",
    "money_by_type": f"with {_MONEY} select amount_type, currency, count(*) as n, round(cast(sum(cast(usd as decimal(38,2))) as double), 0) as usd from figures group by 1, 2",
    "money_best_per_company": f"""
        with {_MONEY}, q as (select *, cast(usd as double) as u, max(cast(usd as double)) over (partition by o_custkey) as top from figures where amount_type in ('funding_raised', 'revenue', 'arr')),
        r as (select *, row_number() over (partition by o_custkey order by case when top > 5e6 then -u else 0 end, case when u between 1e6 and 5e6 then 0 else 1 end, case when is_cumulative then 0 else 1 end, case when amount_type = 'funding_raised' then 0 else 1 end, u desc, o_orderkey) as n from q)
        select o_custkey, o_orderkey, round(u, 2) as usd, u between 1e6 and 5e6 as in_band, abs(u - 1e6) / 1e6 <= 0.1 or abs(u - 5e6) / 5e6 <= 0.1 as near_boundary from r where n = 1""",
    "fx_convert_by_nation": f"with fx(i, currency, rate) as (values {', '.join(f'({i}, {chr(39)}{c}{chr(39)}, cast({FX[c]} as double))' for i, c in enumerate(_CURRENCIES))}) select s_nationkey, currency, count(*) as n, round(sum(s_acctbal * rate), 4) as usd from supplier join fx on i = s_nationkey group by 1, 2",
    "gate_verdicts": f"with {_PROFILES} select company_id, g1 and g2 and g3 and g4 and g5 as qualified, cast(len(failed) as bigint) as n_failed, array_to_string(failed, ',') as failed, first_failure, near_boundary, fit_score from judged",
    "gate_failure_histogram": f"with {_PROFILES} select gate, count(*) as n from (select unnest(failed) as gate from judged) group by 1",
    "near_miss_reasons": f"with {_PROFILES} select failed[1] as gate, substr(first_failure, 1, 90) as reason, count(*) as n from judged where len(failed) = 1 group by 1, 2 order by n desc, gate, reason limit 6",
    "verdict_kpis": f"with {_PROFILES} select count(*) filter (where len(failed) = 0) as leads, count(*) filter (where g5) as verified, count(distinct country) as countries, round(avg(fit_score), 6) as mean_fit, count(*) filter (where failed = ['email_verified']) as only_email from judged",
    "confidence_scores": f"""with {_PROFILES} select company_id, round(greatest(0.0::double, least(0.99::double, ((case when usd is not null then 0.9 else 0 end + case when tech then 0.8 else 0 end + case when us_level is not null then 0.7 else 0 end + case when title is not null then 0.9 else 0 end
        + case when g5 then 0.9 when email_status is not null then 0.5 else 0 end)::double) / 5 + 0.04::double * (case when company_id % 3 = 0 then 2 else 0 end) - 0.08::double * len(failed))), 6) as confidence from judged""",
    "lead_recheck": """
        select c_custkey as company_id, case when c_custkey % 24 = 11 then 'the address isn''t verified' else (['no founder on record', 'the founder is a job, not a person', 'no address on record', 'the address is a shared mailbox', 'the domain is an investor''s',
            'the domain is a publication''s', 'the domain is a social network''s', 'the domain names itself a publication', 'the address belongs to neither company nor founder', 'no figure on record', 'the figure is outside the band', null])[c_custkey % 12 + 1] end as reason from customer""",
    "candidate_merge": f"""
        with {_CANDIDATES}, n as (select nn, arg_min(dn, seq) as known from k where dn is not null group by 1),
        e as (select k.*, coalesce(dn, known, 'name:' || nn) as entity from k left join n using (nn))
        select entity, arg_min(name, seq) as name, any_value(dn) as domain, count(*) as n_sources, first(snippet order by length(snippet) desc, seq) as snippet,
               (['headline', 'company_site', 'article', 'link_hub', 'unknown'])[min(kind) + 1] as source_kind, min(seq) as seq from e group by 1""",
    "known_key_antijoin": f"with {_CANDIDATES} select seq, name, domain from k where not exists (select 1 from supplier where k.dn = 'firm' || s_suppkey * 3 || '.com') and not exists (select 1 from supplier where k.nn = 'firm ' || s_suppkey * 2)",
    "find_company_precedence": f"""
        with {_CANDIDATES}
        select seq as ask_id, coalesce(a.s_suppkey, b.s_suppkey, c.s_suppkey) as company_id, case when a.s_suppkey is not null then 'domain' when b.s_suppkey is not null then 'name' when c.s_suppkey is not null then 'alias' end as found_by
        from k left join supplier a on k.dn = 'firm' || a.s_suppkey * 3 || '.com' left join supplier b on k.nn = 'firm ' || b.s_suppkey * 2 left join supplier c on k.nn = 'firm ' || c.s_suppkey * 5""",
}
