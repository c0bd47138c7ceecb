"""From sources to profiles: one long table of claims, each with its quote, folded into all facts of a company at once.

sources: company_id, seq, url, text, authority. claims: company_id, seq, field, value, title, rung, hits, usd, currency,
amount_original, amount_type, is_cumulative, url, quote, authority. Fields: page (every source), founder, email, us_signal,
country, technology, services, description, sector, amount. A claim's seq orders it within its company: by source, then
by place. Every quote is a sentence or line of the source as it stands there.

A profile takes one aggregate over the usable claims of a company, whatever the number of fields, and one more pass for
the first three urls that state what was chosen. Only partial results of a company meet, so a company with a third of all
claims is one row a task.

Nulls: a source without text makes its page claim only; companies without claims have a profile of nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.companies import once
from ..functions.email import find_emails
from ..functions.gazetteer import locations, normalise_country
from ..functions.people import is_no_person, people, title_score
from ..functions.places import country_from_domain, us_level, us_signals
from ..functions.text import alternation, collapse, sentences
from ..shared import cut, growing, spread
from ..vocab import DESCRIBING_WORDS, HARD_US_SIGNALS, NO_DESCRIPTION, PRODUCT_PATHS, QUALIFYING_TYPES, SERVICES_TERMS
from .authority import rank
from .extract import amounts, platform_terms, sector
from .fuse import email, fact, first_urls, mentions
from .qualify import Band

_SOURCE = ["company_id", "source_seq", "url", "authority"]
_EXTRA = {"title": "string", "rung": "int", "hits": "int", "usd": "double", "currency": "string", "amount_original": "decimal(38,6)", "amount_type": "string", "is_cumulative": "boolean"}
#: Places of a source that its claims can take in the order of a company's claims.
PLACES = 1 << 32


def description_line(text: Column, name: Column, least: int = 45, most: int = 400) -> Column:
    """The first line of a text that describes the company, or null: neither short nor long, no menu or notice, with a word that
    describes and the company's first word or 'we'."""
    first = F.lower(F.get(F.split(F.coalesce(name, F.lit("")), " "), F.lit(0)))

    def describes(line: Column) -> Column:
        low = F.lower(line)
        starts = F.lit(False)
        for bad in NO_DESCRIPTION:
            starts = starts | low.startswith(bad)
        bars = lambda sign: F.length(line) - F.length(F.replace(line, F.lit(sign), F.lit("")))
        own = ((first != "") & F.contains(low, first)) | F.contains(F.concat(F.lit(" "), low), F.lit(" we "))
        return F.length(line).between(least, most) & ~starts & (bars("|") <= 2) & (bars("•") <= 2) & own & low.rlike(alternation(DESCRIBING_WORDS))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), collapse)
    return F.try_element_at(F.filter(lines, describes), F.lit(1))


def first_sentence(line: Column, least: int = 40) -> Column:
    """The first sentence of a line, or the line if that is too short."""
    s = F.get(sentences(line), F.lit(0))
    return F.when(F.length(s) >= least, s).otherwise(line)


def _claim(field: str, value: Column, quote: Column, **extra: Column) -> Column:
    more = [(extra[c] if c in extra else F.lit(None)).cast(t).alias(c) for c, t in _EXTRA.items()]
    return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), quote.alias("quote"), *more)


def _of_sentences(sources: DataFrame) -> DataFrame:
    """Claims that one sentence makes."""
    rows = sources.select(*_SOURCE, F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("place", "s"))
    s = F.col("s")
    services = F.regexp_extract(F.lower(s), rf"({alternation(SERVICES_TERMS)})", 1)
    made = F.concat(
        F.transform(find_emails(s), lambda a: _claim("email", a, s)),
        F.transform(us_signals(s), lambda k: _claim("us_signal", k, s)),
        F.transform(locations(s), lambda x: _claim("country", x["country"], s, rung=x["rung"])),
        F.transform(platform_terms(s), lambda t: _claim("technology", F.lit("true"), s, title=t)),
        F.when(services != "", F.array(_claim("services", services, s))).otherwise(F.array().cast(_array_type())),
    )
    return rows.select(*_SOURCE, "place", F.explode(made).alias("c"))


def _array_type() -> str:
    extra = ",".join(f"{c}:{t}" for c, t in _EXTRA.items())
    return f"array<struct<field:string,value:string,quote:string,{extra}>>"


def _of_texts(sources: DataFrame) -> DataFrame:
    """Claims that take a whole text: pages, persons, the description and the sector."""
    text = F.coalesce("text", F.lit(""))
    own = F.col("authority") == "company_owned"

    def persons(ss: Column) -> Column:
        holds = lambda name: F.coalesce(F.try_element_at(F.filter(ss, lambda s: F.contains(s, name)), F.lit(1)), name)
        return F.transform(people(text), lambda p: _claim("founder", p["name"], holds(p["name"]), title=p["title"]))

    line = F.when(own, description_line(text, F.col("name")))
    of_trade = F.when(own, sector(text))
    made = F.concat(
        F.array(_claim("page", F.col("url"), F.col("url"))),
        once(sentences(text), persons),
        once(line, lambda x: F.when(x.isNotNull(), F.array(_claim("description", first_sentence(x), x))).otherwise(F.array().cast(_array_type()))),
        once(of_trade, lambda x: F.when(x.isNotNull(), F.array(_claim("sector", x["sector"], x["sector"], hits=x["hits"]))).otherwise(F.array().cast(_array_type()))),
    )
    return sources.select(*_SOURCE, F.posexplode(made).alias("place", "c"))


def _of_figures(sources: DataFrame) -> DataFrame:
    keyed = sources.withColumn("key", F.concat_ws("#", "company_id", "source_seq"))
    found = amounts(keyed, "key", "text")
    claim = _claim("amount", F.col("raw"), F.col("sentence"), usd=F.col("amount_usd"), currency=F.col("currency"), amount_original=F.col("amount_original"), amount_type=F.col("amount_type"), is_cumulative=F.col("is_cumulative"))
    return found.join(growing(keyed.select("key", *_SOURCE)), "key").select(*_SOURCE, F.col("start").alias("place"), claim.alias("c"))


def read_claims(sources: DataFrame, companies: DataFrame) -> DataFrame:
    """The claims of all sources of companies (company_id, name, domain)."""
    rows = spread(sources.select("company_id", F.col("seq").alias("source_seq"), "url", "authority", "text")).join(growing(companies.select("company_id", "name")), "company_id")
    rows = cut(rows, "sources")  # read by each of the three
    every = _of_sentences(rows).unionByName(_of_texts(rows)).unionByName(_of_figures(rows))
    seq = F.col("source_seq") * PLACES + F.col("place")
    return every.select("company_id", seq.alias("seq"), "c.*", "url", "authority")


def stated(claims: DataFrame) -> DataFrame:
    """Claims of country and hq_city as countries: values that name none are left out; a country comes before a city."""
    is_place = F.col("field").isin("country", "hq_city") & F.col("rung").isNull()
    rung = F.when(is_place, 1).otherwise(F.col("rung"))
    value = F.when(is_place, normalise_country(F.col("value"))).otherwise(F.col("value"))
    hits = F.when(is_place, F.when(F.col("field") == "hq_city", -1).otherwise(0)).otherwise(F.col("hits"))
    out = claims.withColumns({"value": value, "rung": rung, "hits": hits, "field": F.when(is_place, "country").otherwise(F.col("field"))})
    return out.where(F.col("value").isNotNull() | (F.col("field") != "country"))


#: Fields of which one claim is chosen for a company.
CHOSEN = ["amount", "founder", "country", "technology", "sector", "description", "services"]


def _judged(claims: DataFrame, companies: DataFrame, band: Band) -> DataFrame:
    """The usable claims with `merit` (the greatest of a field is chosen) and `same` (what makes two claims one statement)."""
    rows = stated(claims).join(growing(companies.select("company_id", "name")), "company_id")
    f, usd = F.col("field"), F.col("usd")
    standing = rank(F.col("authority"))
    own = (F.col("authority") == "company_owned") | mentions(F.col("quote"), F.col("name"))
    said = F.greatest(title_score(F.col("title")), F.lit(0))
    score = F.when(said > 0, said).otherwise(title_score(F.col("quote")))
    usable = (
        F.when(f == "amount", (standing >= 3) & own & F.col("amount_type").isin(QUALIFYING_TYPES))
        .when(f == "founder", own & ~is_no_person(F.col("value")) & (score > 0)).when(f == "country", own | (F.col("rung") == 1))
        .when(f == "technology", standing >= 3).otherwise(True)
    )
    number = lambda *xs: F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in xs])
    over = usd > band.most
    merit = (
        F.when(f == "amount", number(over, F.when(over, usd), usd.between(band.least, band.most), F.col("is_cumulative"), F.col("amount_type") == "funding_raised", usd))
        .when(f == "founder", number(score * 10 + standing)).when(f == "country", number(-F.col("rung"), F.col("hits"))).when(f == "sector", number(F.col("hits"))).otherwise(number(F.lit(0)))
    )
    same = F.when(f == "amount", F.concat_ws(" ", "currency", F.col("amount_original").cast("string"))).when(f == "founder", F.lower("value")).otherwise(F.col("value"))
    return rows.where(F.coalesce(usable, F.lit(False))).withColumns({"merit": F.struct(merit.alias("m"), (-F.col("seq")).alias("seq")), "same": same})


def profiles(claims: DataFrame, companies: DataFrame, checks: DataFrame, band: Band = Band(), max_weak: int = 1, *, has_provider: bool = True) -> DataFrame:
    """A profile of each company (company_id, name, domain), as `qualify` takes it, with its facts.

    checks: address, has_mx, deliverability, catch_all. An inferred country (the domain's ending) is marked as such."""
    claims = cut(claims, "read")  # texts are read once: for the facts, and for the addresses
    rows = cut(_judged(claims, companies, band), "claims")
    kept = F.struct("value", "same", "title", "rung", "usd", "currency", "amount_original", "amount_type", "is_cumulative")
    one = rows.groupBy("company_id").agg(
        *[F.max_by(kept, F.when(F.col("field") == c, F.col("merit"))).alias(c) for c in CHOSEN],
        F.collect_set(F.when(F.col("field") == "us_signal", F.col("value"))).alias("kinds"),
        F.max((F.col("field") == "page") & F.col("url").rlike(alternation(PRODUCT_PATHS))).alias("product"),
    )
    winners = one.select("company_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}.same").alias("same")) for c in CHOSEN])).alias("w")).select("company_id", "w.*").where("same is not null")
    proof = first_urls(rows.join(growing(winners), ["company_id", "field", "same"]), ["company_id", "field"]).groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "evidence"))).alias("proof"))
    met = companies.select("company_id", "name", "domain").join(growing(one), "company_id", "left").join(growing(proof), "company_id", "left")
    ending = country_from_domain(F.col("domain"))
    inferred = F.array(F.struct(F.concat(F.lit("https://"), "domain").alias("url"), F.concat(F.lit("the domain ends as those of "), ending).alias("quote"), F.lit("unknown").alias("authority")))
    of = lambda c: F.coalesce(F.try_element_at("proof", F.lit(c)), F.array().cast("array<struct<url:string,quote:string,authority:string>>"))
    stays = F.col("services").isNull() | F.coalesce("product", F.lit(False))
    sure = F.round(F.least(F.lit(0.95), 0.55 + 0.10 * F.size(of("technology")) + F.when(F.col("product"), 0.15).otherwise(0.0)), 4)
    facts = F.struct(
        fact(F.when(F.col("amount").isNotNull(), F.struct("amount.usd", "amount.currency", "amount.amount_original", "amount.amount_type", "amount.is_cumulative")), of("amount")).alias("funding"),
        fact(F.when(stays & F.col("technology").isNotNull(), F.lit(True)), of("technology"), sure).alias("technology"),
        F.coalesce(fact(F.col("country.value"), of("country")), fact(ending, inferred, F.lit(0.45).cast("double"))).alias("country"),
        fact(F.when(F.col("founder").isNotNull(), F.struct(F.trim("founder.value").alias("name"), F.col("founder.title").alias("title"))), of("founder")).alias("founder"),
        fact(F.col("sector.value"), of("sector")).alias("sector"),
        fact(F.col("description.value"), of("description")).alias("description"),
    )
    known = met.select("company_id", "name", "domain", "kinds", facts.alias("facts"), F.when(F.col("country.value").isNull() & ending.isNotNull(), "INFERRED from the ending of the domain").alias("country_note"))
    known = known.select(
        "company_id", "name", "domain", "facts", "country_note", F.col("facts.funding.value.usd").alias("usd"), F.col("facts.funding.value.amount_type").alias("amount_type"), F.col("facts.technology.value").alias("tech"),
        F.col("facts.country.value").alias("country"), us_level(F.col("facts.country.value"), F.coalesce("kinds", F.array().cast("array<string>")), HARD_US_SIGNALS, max_weak).alias("us_level"),
        F.col("facts.founder.value.name").alias("founder"), F.coalesce("facts.founder.value.title", F.when(F.col("facts.founder").isNotNull(), "Founder")).alias("title"), F.col("facts.sector.value").alias("sector"), F.col("facts.description.value").alias("description"),
    )
    known = cut(known, "profiles")  # the address is judged by the founder
    addresses = email(claims.where("field = 'email'"), known, checks, has_provider=has_provider).select("company_id", "address", F.col("status").alias("email_status"), F.col("note").alias("email_note"))
    return known.join(growing(addresses), "company_id")
