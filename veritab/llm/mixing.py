"""Mixing sources to target weights by Poisson replication.

A source with n documents and target share t of an output of N documents has mean repetition rate t * N / n. Each
document draws its number of copies by inverting the Poisson distribution of its source's rate at a uniform number
made from md5(seed | key | part), so that any run, on any partitioning, draws the same. The key is the doc_id, or where
that is null the md5 of the text. Rates above `PART` are
split into equal parts, each with its own number: sums of Poisson draws are Poisson. Documents are exploded by their
count and dealt to partitions, and sorted inside them, by md5(seed | doc_id | copy): a global shuffle.

Nulls: a null source is the source '', a null text draws as an empty one where it has no doc_id. Repeated rows draw the
same count each, and are dealt apart by the shuffle. Texts are carried, and read only where the doc_id is null. A column
of docs that is called like the column of copy numbers keeps its name, and that of the copy numbers gets `_` appended. Target weights of sources that don't occur are ignored, sources without a weight get none. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Largest mean that one inversion takes, so that exp(-mean) keeps its precision.
PART = 500.0
#: Sources up to which the table of rates is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def _uniform(*parts: Column) -> Column:
    """52 bits of md5 as a number in [0, 1)."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None) -> DataFrame:
    """src, n, rate: mean repetitions of each source. Without weights, targets follow n ** temperature."""
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "src string, w double")
        weighed = counts.join(given, "src", "left").fillna(0.0, ["w"])
    whole = weighed.agg(F.sum("w").alias("sum_w"), F.sum("n").alias("sum_n"))
    size = F.lit(float(total)) if total is not None else F.col("sum_n").cast("double")
    return weighed.crossJoin(F.broadcast(whole)).select("src", "n", F.coalesce(size * F.col("w") / F.nullif("sum_w", F.lit(0.0)) / F.col("n"), F.lit(0.0)).alias("rate"))


def distributions(rated: DataFrame) -> DataFrame:
    """src, parts and cdf: P(X <= k) for k = 0, 1, ... of the mean rate / parts, up to where it is 1 in double precision."""
    parted = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    return parted.withColumn("top", F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int")).select(
        "src", "parts",
        F.expr("""aggregate(sequence(1, top), named_struct('p', exp(-mean), 'c', exp(-mean), 'all', array(exp(-mean))),
                  (a, k) -> named_struct('p', a.p * mean / k, 'c', a.c + a.p * mean / k, 'all', array_append(a.all, a.c + a.p * mean / k)), a -> a.all)""").alias("cdf"),
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, seed: int = 17, temperature: float = 0.5, total: int | None = None, name: str | None = "copy") -> DataFrame:
    """The rows of docs, each as often as drawn, globally shuffled; with their copy number in column `name`, if there is one."""
    while name in docs.columns:
        name += "_"
    table = cut(distributions(rates(docs, weights, temperature, total)), "rates")
    few = table.count() <= BROADCAST_SOURCES
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select(whole.alias("row"), key.alias("key"), F.coalesce("source", F.lit("")).alias("src"))
    joined = rows.join(F.broadcast(table) if few else table, "src")
    draws = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda part: _uniform(F.lit(seed), F.col("key"), part))
    drawn = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda c: c <= u)))
    counted = joined.select("row", "key", drawn.alias("n")).where("n > 0")
    copies = counted.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "key", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"))
    ordered = copies.withColumn("order", F.md5(F.concat_ws("|", F.lit(str(seed)), "key", F.col("copy").cast("string"))))
    shuffled = ordered.repartition("order", "salt").sortWithinPartitions("order")
    return shuffled.select("row.*", *([F.col("copy").alias(name)] if name else []))
