"""Planning: the space of searches, what each cell promises, and which to try next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import strings
from ..vocab import FIXED_WINDOWS, GEOGRAPHIES, PHRASINGS, ROLLING_WINDOWS, SECTORS, SHAPE_BONUS, SHAPES

DIMENSIONS = ["sector", "geography", "phrasing", "time_window", "shape"]


def cell_space(spark: SparkSession, sectors=None, geographies=None) -> DataFrame:
    """Every cell with its key: five constant lists exploded one inside the other. A filter that fits nothing is ignored."""
    pick = lambda asked, own: [x for x in own if x in (asked or own)] or own
    lists = [pick(sectors, SECTORS), pick(geographies, GEOGRAPHIES), PHRASINGS, ROLLING_WINDOWS + FIXED_WINDOWS, SHAPES]
    cells = spark.range(1)
    for name, values in zip(DIMENSIONS, lists):
        cells = cells.withColumn(name, F.explode(strings(values)))
    return cells.drop("id").withColumn("cell_key", F.substring(F.sha1(F.concat_ws("|", *DIMENSIONS)), 1, 12))


def sibling_yield(stats: DataFrame) -> DataFrame:
    """stats (sector, geography, used, found, qualified) with yield: (found + 3 qualified) / (1 + used) over all rows of the same
    sector or geography. Sums by sector and by geography, less those by both, stand for the join on either."""
    sums = lambda *keys: stats.groupBy(*keys).agg(*[F.sum(c).alias(f"{c}_{keys[0][0]}{len(keys)}") for c in ("used", "found", "qualified")])
    met = stats.join(sums("sector"), "sector").join(sums("geography"), "geography").join(sums("sector", "geography"), ["sector", "geography"])
    either = {c: F.col(f"{c}_s1") + F.col(f"{c}_g1") - F.col(f"{c}_s2") for c in ("used", "found", "qualified")}
    return met.select(*stats.columns, ((either["found"] + 3.0 * either["qualified"]) / (1.0 + either["used"])).alias("yield"))


def score(used: Column, promise: Column, window: Column, shape: Column, imprint: Column) -> Column:
    """Novelty, yield, recency, shape and imprint law; the caller may add a small random number."""
    recency = F.when(window.isin(ROLLING_WINDOWS), 0.45).when(window.isin("2026", "2026 Q1", "2026 Q2"), 0.25).otherwise(0.0)
    bonus = F.coalesce(*[F.when(shape == s, b) for s, b in SHAPE_BONUS.items()], F.lit(0.0))
    return 0.60 / (1.0 + used) + 0.30 * F.least(promise, F.lit(3.0)) / 3.0 + recency + bonus + F.when(imprint, 0.28).otherwise(0.0)


def diversified(cells: DataFrame, n: int) -> DataFrame:
    """n cells by score, at most half of them (rounded up) of one shape as long as others are left."""
    cap = (n + 1) // 2
    # of each shape only its first n can be chosen: partial top-n before the global one
    place = F.row_number().over(Window.partitionBy("shape").orderBy(F.desc("score"), "cell_key"))
    first = cells.withColumn("place", place).where(F.col("place") <= n)
    return first.orderBy(F.col("place") > cap, F.desc("score"), "cell_key").limit(n)


def render(cells: DataFrame, templates: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """cell_key, query of cells, from templates (phrasing, query); queries asked before are left out."""
    text = F.concat_ws(" ", "query", F.replace("sector", F.lit("_"), F.lit(" ")), F.replace("geography", F.lit("_"), F.lit(" ")), "time_window")
    # words said twice in a row are said once
    words = F.split(F.regexp_replace(text, r"\s+", " "), " ")
    once = F.array_join(F.filter(words, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(words, i - 1)))), " ")
    out = cells.join(F.broadcast(templates), "phrasing").select("cell_key", once.alias("query"))
    return out if asked is None else out.join(asked.select("query"), "query", "left_anti")
