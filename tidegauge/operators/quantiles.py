"""Exact quantiles of series by histograms, whose state doesn't grow with a series' distinct values.

A first pass counts the values of each series in buckets of like size (some hundreds, whatever the
rows) and keeps those that hold a wanted rank; only their rows are read further. Buckets of more than
``FEW`` different rows are cut into ``CUTS`` even parts until they are small, and ranks are read in
the small ones. Each step is an aggregate with partial sums, so one series keeps many tasks busy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.views import SERIES, stored

#: Buckets of an octave in the first pass, parts of a bucket in later ones, and rows that are sorted at once.
OCTAVE, CUTS, FEW = 16, 4096, 100_000


def size_class(x: Column) -> Column:
    """A whole number that never falls as ``x`` rises: the sign and logarithm of ``x``."""
    log = (F.floor(F.log2(F.abs(x)) * OCTAVE) + 1100 * OCTAVE).cast("long")
    return F.when(x > 0, log).when(x < 0, -log).otherwise(F.lit(0).cast("long"))


def even_part(x: Column, low: Column, high: Column) -> Column:
    """Which of ``CUTS`` even parts of [low, high] holds ``x``; the ends lie in the first and last, so each
    cut parts them. Both are of one size class, so their difference is finite."""
    return F.least(F.lit(CUTS - 1), F.floor((x - low) / (high - low) * CUTS)).cast("long")


def narrowed(rows: DataFrame, wanted: DataFrame, bucket: Column, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the buckets that hold a wanted rank, wanted with bucket, its rank there, and the bucket's
    n, low and high). ``rows``: keys and value; ``wanted``: keys, rank, place in the bucket."""
    counts = stored(rows.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")), "buckets")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = wanted.join(counts.withColumn("before", before), keys).filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
    own = stored(inside.withColumn("place", F.col("place") - F.col("before")).drop("before"), "wanted")
    kept = rows.withColumn("bucket", bucket).join(own.filter("low < high").select(*keys, "bucket", "low", "high", "n").distinct(), [*keys, "bucket"])
    return kept, own


def quantiles(df: DataFrame, points: dict[str, float], column: str = "value", keys: list[str] = SERIES) -> DataFrame:
    """``keys`` and a column for each of ``points`` (name: share from 0 to 1), with linear interpolation
    between neighbours. Nulls don't count; a series without values has no row. Values must be finite.

    Runs jobs while it is built, as the next cut depends on the last one's counts.
    """
    rows = df.select(*keys, F.col(column).cast("double").alias("value")).filter("value is not null")
    total = rows.groupBy(*keys).agg((F.count("*") - 1).alias("top"))
    at = F.array(*(F.struct(F.lit(name).alias("name"), (F.col("top") * F.lit(float(q))).alias("at")) for name, q in points.items()))
    asked = stored(total.select(*keys, F.explode(at).alias("p")).select(*keys, "p.*"), "asked")
    ranks = asked.select(*keys, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    rows, wanted = narrowed(rows, ranks.withColumn("place", F.col("rank")), size_class(F.col("value")), keys)
    group, found = [*keys, "trail"], []
    trail = lambda df: F.concat_ws("/", *(c for c in ("trail",) if c in df.columns), F.col("bucket"))
    while True:
        found.append(wanted.filter("low = high").select(*keys, "rank", F.col("low").alias("value")))
        rows = stored(rows.withColumn("trail", trail(rows)).drop("bucket"), "narrowed")
        wanted = wanted.filter("low < high").withColumn("trail", trail(wanted)).drop("bucket")
        small = rows.filter(F.col("n") <= FEW).withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("value")) - 1)
        found.append(wanted.filter(F.col("n") <= FEW).select(*group, "rank", "place").join(small.select(*group, "place", "value"), [*group, "place"]).select(*keys, "rank", "value"))
        large = wanted.filter(F.col("n") > FEW)
        if not large.take(1):
            break
        large = large.select(*group, "rank", "place")
        rows = rows.filter(F.col("n") > FEW)
        low, high = F.col("low"), F.col("high")
        part = rows.withColumn("part", even_part(F.col("value"), low, high)).drop("low", "high", "n")
        rows, wanted = narrowed(part, large, F.col("part"), group)
        rows = rows.drop("part")
    values = stored(reduce(DataFrame.union, found), "values")
    both = asked.withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    for side in ("low", "high"):
        both = both.join(values.select(*keys, F.col("rank").alias(side), F.col("value").alias(f"v_{side}")), [*keys, side])
    share = F.col("at") - F.col("low")
    value = F.when(F.col("low") == F.col("high"), F.col("v_low")).otherwise((1 - share) * F.col("v_low") + share * F.col("v_high"))
    return both.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, value)).alias(name) for name in points))
