"""The feature index: statistics, slope and shape word of every calendar window at three scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import sax
from tidegauge.operators import windows
from tidegauge.views import SERIES, stored

#: Granularity -> (window, bin of a letter).
SCALES = {"yearly": ("year", "month"), "monthly": ("month", "day"), "daily": ("day", "hour")}


def hours(readings: DataFrame) -> DataFrame:
    """(series, window_start, n, total, least, most, squares, placed) of every hour with a reading: squares is
    the sum of squared deviations from its mean, placed that of each value times its place from 0.

    All that the features of coarser windows need can be merged from these, so readings are read once.
    """
    start = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    own = readings.withColumn("window_start", start)
    place = F.row_number().over(Window.partitionBy(*SERIES, "window_start").orderBy("ts")) - 1
    return own.withColumn("place", place).groupBy(*SERIES, "window_start").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"),
        (F.var_pop("value") * F.count("value")).alias("squares"), F.sum(F.col("value") * F.col("place")).alias("placed"),
    )


def coarser(parts: DataFrame, unit: str) -> DataFrame:
    """The same of the windows of ``unit`` that finer ``parts`` lie in: deviations are moved to the common mean,
    places by the readings before a part."""
    parts = parts.withColumnRenamed("window_start", "part").withColumn("window_start", F.date_trunc(unit, "part").cast("timestamp_ntz"))
    w = Window.partitionBy(*SERIES, "window_start")
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"before": before, "mean": F.sum("total").over(w) / F.sum("n").over(w)})
    off = F.col("total") / F.col("n") - F.col("mean")
    return parts.groupBy(*SERIES, "window_start").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.sum(F.col("squares") + F.col("n") * off * off).alias("squares"), F.sum(F.col("placed") + F.col("before") * F.col("total")).alias("placed"),
    )


def levels(readings: DataFrame, units: list[str]) -> dict[str, DataFrame]:
    """``hours`` and what they come to in each of ``units``, each made from the one before it."""
    out, last = {"hour": hours(readings)}, "hour"
    for unit in units:
        out[unit] = coarser(out[last], unit)
        last = unit
    return out


def words(bins: DataFrame, window: str, bin_: str) -> DataFrame:
    """(series, window_start, sax, sax_len): the letters of the window's bin means in order, ``bins`` being the
    level of ``bin_``.

    Bins run from the series' first reading to its last; empty ones are interpolated by their number
    before windows are cut, so a gap at a border is filled from both sides.
    """
    means = bins.select(*SERIES, F.col("window_start").alias("ts"), (F.col("total") / F.col("n")).alias("value"))
    filled = windows.densified(means, bin_).withColumn("window_start", F.date_trunc(window, "ts").cast("timestamp_ntz"))
    w = Window.partitionBy(*SERIES, "window_start")
    lettered = filled.withColumn("letter", sax.letter(F.col("value"), F.avg("value").over(w), F.stddev_pop("value").over(w)))
    word = F.array_sort(F.collect_list(F.struct("ts", "letter")))
    return lettered.groupBy(*SERIES, "window_start").agg(F.array_join(F.transform(word, lambda x: x["letter"]), "").alias("sax"), F.count("*").cast("int").alias("sax_len"))


def day_words(readings: DataFrame) -> DataFrame:
    """The shape words of days, a letter an hour."""
    return words(hours(readings), "day", "hour")


def statistics(level: DataFrame) -> DataFrame:
    """min_val, max_val, avg_val, std_val and slope (over even places in [0, 1]) of windows with two readings."""
    n = F.col("n").cast("double")
    tilt = 12 * (F.col("placed") - (n - 1) / 2 * F.col("total")) / (n * (n + 1))
    stats = {"min_val": F.col("least"), "max_val": F.col("most"), "avg_val": F.col("total") / n, "std_val": F.sqrt(F.col("squares") / (n - 1)), "slope": tilt}
    return level.filter("n > 1").select(*SERIES, "window_start", *(c.alias(k) for k, c in stats.items()))


def _scale(parts: dict[str, DataFrame], granularity: str) -> DataFrame:
    window, bin_ = SCALES[granularity]
    out = statistics(parts[window]).join(words(parts[bin_], window, bin_), [*SERIES, "window_start"])
    end = F.col("window_start") + F.expr(f"interval 1 {window}")
    return out.select(F.lit(granularity).alias("granularity"), *SERIES, "window_start", end.alias("window_end"), "min_val", "max_val", "avg_val", "std_val", "slope", "sax_len", "sax")


def scale(readings: DataFrame, granularity: str) -> DataFrame:
    """The features of one scale."""
    units = ["day", "month", "year"]
    return _scale(levels(readings, units[: units.index(SCALES[granularity][0]) + 1]), granularity)


def build(readings: DataFrame) -> DataFrame:
    """The feature table of all series at all scales.

    Hours are written to the shared folder, so readings are read and shuffled once, and months, years
    and all words are made from what is left of them.
    """
    parts = {"hour": stored(hours(readings), "hours")}
    for finer, unit in (("hour", "day"), ("day", "month"), ("month", "year")):
        parts[unit] = coarser(parts[finer], unit)
    out = None
    for g in SCALES:
        part = _scale(parts, g)
        out = part if out is None else out.unionByName(part)
    return out


def unbuilt(tasks: DataFrame, features: DataFrame) -> DataFrame:
    """Tasks that lack features at one of the scales."""
    done = features.groupBy("task_id").agg(F.countDistinct("granularity").alias("n")).filter(F.col("n") == len(SCALES))
    return tasks.join(done.select("task_id"), "task_id", "left_anti")
