"""Answers of a language model: JSON recovered from text, read by one schema, and grounded claim by claim.

An answer may stand in a fence, amid prose, or be followed by more text. `json_blocks` finds the outermost balanced braces,
with strings and escapes respected; the first block that the schema reads is the answer. Answers without one are kept
apart, never guessed at. No claim of a model counts before its quote is found in a source of its company: in the source
that it cites, or else in the first other one.

Nulls: a null or empty answer is malformed. Items without a value or a quote make no claim. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.companies import once
from ..shared import cut, growing
from .ground import ground_claims

_SAID = "struct<value:string,quote:string,source:string>"
#: All fields of an answer. Values are read as text, so that true, 3 and "3" are read alike.
ANSWER = (
    f"struct<description:{_SAID},sector:{_SAID},country:{_SAID},hq_city:{_SAID},is_tech_platform:{_SAID},"
    "funding_statements:array<struct<text:string,quote:string,source:string>>,founders:array<struct<name:string,title:string,quote:string,source:string>>,"
    "emails:array<struct<address:string,owner:string,quote:string,source:string>>,us_signals:array<struct<kind:string,quote:string,source:string>>>"
)
SINGLE = ["description", "sector", "country", "hq_city", "is_tech_platform"]


def json_blocks(text: Column) -> Column:
    """array<string> of the outermost balanced {...} of a text, in order. Braces inside JSON strings don't count."""

    def step(a: Column, c: Column, i: Column) -> Column:
        open_, close = c == "{", c == "}"
        depth, quoted, escaped = a["depth"], a["quoted"], a["escaped"]
        inside = depth > 0
        deeper = F.when(quoted, depth).when(open_, depth + 1).when(close & inside, depth - 1).otherwise(depth)
        ends = ~quoted & close & (depth == 1)
        return F.struct(
            deeper.alias("depth"), F.when(inside & (c == '"') & ~escaped, ~quoted).otherwise(quoted & (deeper > 0)).alias("quoted"), (quoted & (c == "\\") & ~escaped).alias("escaped"),
            F.when(~inside & open_, i).otherwise(a["from"]).alias("from"), F.when(ends, F.concat(a["found"], F.array(F.struct(a["from"].alias("at"), i.alias("to"))))).otherwise(a["found"]).alias("found"),
        )

    # only the signs that matter are walked through, each with its place
    body = F.coalesce(text, F.lit(""))
    parts = F.split(body, r'(?<=[{}"\\])|(?=[{}"\\])', -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(-1).alias("from"), F.array().cast("array<struct<at:int,to:int>>").alias("found"))

    def walk(ps: Column) -> Column:
        numbered = F.transform(ps, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        return F.transform(F.aggregate(numbered, start, lambda a, x: step(a, x["p"], x["i"]))["found"], lambda b: F.array_join(F.slice(ps, b["at"] + 1, b["to"] - b["at"] + 1), ""))

    return F.when(F.contains(body, F.lit("{")), once(parts, walk)).otherwise(F.array().cast("array<string>"))


def read_answer(text: Column) -> Column:
    """The first block of a text that is an answer: an object with at least one known field; null if there is none."""
    known = lambda a: F.to_json(a) != "{}"
    read = F.transform(json_blocks(text), lambda b: F.from_json(b, ANSWER, {"allowUnquotedControlChars": "true"}))
    return F.try_element_at(F.filter(read, lambda a: a.isNotNull() & F.coalesce(known(a), F.lit(False))), F.lit(1))


def read_answers(answers: DataFrame, text: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(rows with column `data`, malformed rows) of answers."""
    read = answers.withColumn("data", read_answer(F.col(text)))
    return read.where("data is not null"), read.where("data is null").drop("data")


def claims_of(answers: DataFrame) -> DataFrame:
    """company_id, claim_id, field, value, title, quote, source of answers (company_id, data): one row an item with a value and a
    quote, in the order of fields and items. source is the number of the cited source, or null."""
    item = lambda field, value, quote, source, title=None: F.struct(F.lit(field).alias("field"), F.trim(value).alias("value"), quote.alias("quote"), source.try_cast("int").alias("source"), (F.lit(None).cast("string") if title is None else F.trim(title)).alias("title"))
    d = F.col("data")
    listed = lambda name, fn: F.transform(F.coalesce(d[name], F.array()), fn)
    single = F.array(*[item(n, d[n]["value"], d[n]["quote"], d[n]["source"]) for n in SINGLE])
    every = F.concat(
        single,
        listed("funding_statements", lambda x: item("funding_statement", F.coalesce(x["text"], x["quote"]), x["quote"], x["source"])),
        listed("founders", lambda x: item("founder", x["name"], x["quote"], x["source"], x["title"])),
        listed("emails", lambda x: item("email", F.lower(x["address"]), x["quote"], x["source"], x["owner"])),
        listed("us_signals", lambda x: item("us_signal", F.lower(x["kind"]), x["quote"], x["source"])),
    )
    rows = answers.select("company_id", F.posexplode(every).alias("pos", "c")).where("c.value <> '' and c.quote <> ''")
    return rows.select("company_id", F.concat_ws("#", "company_id", "pos").alias("claim_id"), "c.*")


def grounded(claims: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept with mode, url, authority, seq; dropped) of claims_of, by sources (company_id, seq, url, text, authority), seq from 0."""
    cited = claims.join(growing(sources.select("company_id", F.col("seq").cast("int").alias("source"), "url")), ["company_id", "source"], "left")
    cited = cut(cited.withColumn("url", F.coalesce("url", F.lit(""))), "cited")  # answers are read once
    kept, dropped = ground_claims(cited, sources)
    there = sources.select("company_id", F.col("url").alias("grounded_in"), "authority", "seq")
    return kept.drop("url").join(growing(there), ["company_id", "grounded_in"]).withColumnRenamed("grounded_in", "url"), dropped
