"""Aggregates over series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.transforms import autocorrelation, spectrum  # noqa: F401
from tidegauge.operators.windows import along
from tidegauge.views import SERIES


def stats() -> dict[str, Column]:
    return {"min": F.min("value"), "max": F.max("value"), "avg": F.avg("value"), "sum": F.sum("value"), "count": F.count("value").cast("double"), "std": F.stddev_samp("value")}


def global_aggregate(df: DataFrame, function: Column | None = None, keys: list[str] = SERIES) -> DataFrame:
    """All statistics of each series, or, with ``function`` (a column of its name), the one asked for."""
    if function is None:
        return df.groupBy(*keys).agg(*(c.alias(n) for n, c in stats().items()))
    out = df.withColumn("function", function).groupBy(*keys, "function").agg(*(c.alias(n) for n, c in stats().items()))
    pick = F.lit(None).cast("double")
    for n in stats():
        pick = F.when(F.col("function") == n, F.col(n)).otherwise(pick)
    return out.select(*keys, pick.alias("answer"))


def window_stats(df: DataFrame, unit: str, keys: list[str] = SERIES) -> DataFrame:
    """min_val, max_val, avg_val and std_val of each calendar window; windows without a std go."""
    start = F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("window_start")
    out = df.groupBy(*keys, start).agg(F.min("value").alias("min_val"), F.max("value").alias("max_val"), F.avg("value").alias("avg_val"), F.stddev_samp("value").alias("std_val"))
    return out.filter("std_val is not null")


def slope(df: DataFrame, unit: str, keys: list[str] = SERIES) -> DataFrame:
    """Least-squares slope of each window's samples on even places in [0, 1]; 0 with one sample."""
    out = df.withColumn("window_start", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
    w = Window.partitionBy(*keys, "window_start")
    x = (F.row_number().over(w.orderBy("ts")) - 1) / F.nullif(F.count("*").over(w) - 1, F.lit(0))
    return out.withColumn("x", x).groupBy(*keys, "window_start").agg(F.coalesce(F.regr_slope("value", "x"), F.lit(0.0)).alias("slope"))


def steps(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """``df`` with gap: the seconds since the reading before, null for a series' first."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return df.withColumn("gap", (micros("ts") - F.lag(micros("ts")).over(along(keys))) / 1e6)


def median_step(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """step: the median gap between readings, in seconds. Keeps a series' distinct gaps, which are few
    in regular series; ``quantiles`` of ``steps`` doesn't."""
    return steps(df, keys).groupBy(*keys).agg(F.median("gap").alias("step"))


def samples_per(seconds: float, step: Column, least: int = 1) -> Column:
    """Samples in a span, rounded half to even, ``least`` at least."""
    return F.greatest(F.lit(least), F.bround(F.lit(float(seconds)) / step).cast("int"))


def ols(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """a and b of y = a + b x; b is 0 if x hardly varies."""
    sxx, sxy = F.var_pop(x) * F.count(x), F.covar_pop(y, x) * F.count(x)
    b = F.when(sxx <= 1e-9, 0.0).otherwise(sxy / sxx)
    return df.groupBy(*keys).agg(b.alias("b"), (F.avg(y) - b * F.avg(x)).alias("a"))


def segment_sse(sums: DataFrame, a: int, b: int, keys: list[str] = SERIES) -> DataFrame:
    """Squared error of the best line over rows a ... b, from prefix sums."""
    ends = sums.filter(F.col("pos").isin(a - 1, b)).groupBy(*keys).agg(*(F.sum(F.when(F.col("pos") == b, F.col(c)).otherwise(-F.col(c))).alias(c) for c in ("sum_y", "sum_yy", "sum_iy")))
    n = b - a + 1
    si, sii = sum(range(a, b + 1)), sum(i * i for i in range(a, b + 1))
    sxx = sii - si * si / n
    sxy = F.col("sum_iy") - F.col("sum_y") * si / n
    syy = F.col("sum_yy") - F.col("sum_y") * F.col("sum_y") / n
    return ends.select(*keys, F.greatest(F.lit(0.0), syy - sxy * sxy / sxx).alias("sse"))
