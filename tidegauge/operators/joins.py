"""Joins of tasks, readings, features and companions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.views import SERIES


def task_readings(tasks: DataFrame, readings: DataFrame, unit: str = "month", least: str = "1900-01-01", most: str = "2199-12-31", keys: list[str] = SERIES) -> DataFrame:
    """Each task (task_id, channel_id, a, b and more) with its readings from a to b, both included.

    A range is spread over the calendar ``unit``s it touches, and meets readings of its series and unit by an
    equi-join, so a short range never meets a whole series. What lies before ``least`` or after ``most``
    is one unit each. Ranges with a null or reversed end have no readings.
    """
    inside = lambda t: F.greatest(F.least(t, F.lit(most).cast("timestamp_ntz")), F.lit(least).cast("timestamp_ntz"))
    part = lambda t: F.date_trunc(unit, inside(t)).cast("timestamp_ntz")
    units = F.explode(F.sequence(part(F.col("a")), part(F.col("b")), F.expr(f"interval 1 {unit}")))
    spread = tasks.filter("a <= b").withColumn("_unit", units)
    return spread.join(readings.withColumn("_unit", part(F.col("ts"))), [*keys, "_unit"]).filter(F.col("ts").between(F.col("a"), F.col("b"))).drop("_unit")


def with_companion(readings: DataFrame, suffix: str = "_hist_mean", name: str = "base") -> DataFrame:
    """Readings with their companion's value at the same instant; those without one go."""
    own = readings.filter(~F.col("channel_id").endswith(suffix))
    other = readings.filter(F.col("channel_id").endswith(suffix)).select("task_id", F.expr(f"left(channel_id, length(channel_id) - {len(suffix)})").alias("channel_id"), "ts", F.col("value").alias(name))
    return own.join(other, [*SERIES, "ts"])


def causal_pairs(readings: DataFrame) -> DataFrame:
    """task_id, channel_id (the pair's name), year, ts, up and down at the same instants."""
    pattern = r"^(.*)_(up|down)_(\d{4})$"
    part = lambda i: F.regexp_extract("channel_id", pattern, i)
    named = readings.filter(F.col("channel_id").rlike(pattern)).select("task_id", part(1).alias("pair"), part(2).alias("side"), part(3).alias("year"), "ts", "value")
    keys = ["task_id", "pair", "year", "ts"]
    up, down = (named.filter(F.col("side") == s).select(*keys, F.col("value").alias(s)) for s in ("up", "down"))
    return up.join(down, keys).withColumnRenamed("pair", "channel_id")


def nearest_reading(probes: DataFrame, readings: DataFrame, unit: str = "day") -> DataFrame:
    """Each probe (series, at) with the reading nearest in time, the earlier of two as near; of readings at one
    instant the least value, a null first.

    Probes and readings of a calendar ``unit`` are merged in sorted passes, one forwards and one backwards,
    without a range join; what lies next outside it comes from a scan over the units' first and last
    readings. Readings without a time and probes of a series without a name go; a probe without a time, or of
    a series without readings, finds nothing.
    """
    own = readings.filter("ts is not null").select(*SERIES, "ts", "value", F.lit(False).alias("probe"))
    asked = probes.dropna(subset=SERIES).select(*SERIES, F.col("at").alias("ts"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("probe"))
    both = own.unionByName(asked).withColumn("_block", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
    known = F.when(~F.col("probe"), F.struct("ts", "value"))
    back = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") - F.col("ts")  # least for the latest
    last = F.when(~F.col("probe"), F.struct(back.alias("back"), "value", "ts"))
    each = both.groupBy(*SERIES, "_block").agg(F.min(known).alias("first"), F.min(last).alias("last"))
    # a frame that runs on to the end is read anew for each row, so what comes after is what came before, backwards
    so_far = lambda c, keys, to, *order: F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, to))
    outside = each.select(*SERIES, "_block", so_far("last", SERIES, -1, "_block").alias("ahead"), so_far("first", SERIES, -1, F.col("_block").desc()).alias("behind"))
    value = F.col("value").desc()
    inside = [*SERIES, "_block"]
    found = both.withColumn("before", so_far(known, inside, 0, "ts", "probe", value)).withColumn("after", so_far(known, inside, 0, F.col("ts").desc(), "probe", value)).filter("probe")
    found = found.join(outside, inside, "left")
    pair = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.ts").alias("ts"), F.col(f"{c}.value").alias("value")))
    found = found.withColumns({"before": F.coalesce("before", pair("ahead")), "after": F.coalesce("after", pair("behind"))})
    gap = lambda c: F.abs(F.col(f"{c}.ts") - F.col("ts"))
    near = F.when(F.col("before").isNull() | (gap("after") < gap("before")), F.col("after")).otherwise(F.col("before"))
    return found.select(*SERIES, F.col("ts").alias("at"), near.alias("n")).select(*SERIES, "at", "n.ts", "n.value")


def flagged(days: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """``days`` with in_sax: whether their keys are among ``hits``."""
    return days.join(hits.select(*keys).distinct().withColumn("in_sax", F.lit(True)), keys, "left").withColumn("in_sax", F.coalesce("in_sax", F.lit(False)))


def with_predictions(tasks: DataFrame, predictions: DataFrame) -> DataFrame:
    """Tasks with their prediction; an empty text where there is none."""
    return tasks.join(predictions, "id", "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def pending(tasks: DataFrame, done: DataFrame) -> DataFrame:
    return tasks.join(done.select("id").distinct(), "id", "left_anti")


def all_if_none(hits: DataFrame, everything: DataFrame, keys: list[str]) -> DataFrame:
    """``hits``, and for keys without any all rows of ``everything`` (same columns)."""
    return hits.unionByName(everything.join(hits.select(*keys).distinct(), keys, "left_anti").select(*hits.columns))


def focused(readings: DataFrame, found: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Readings round each series' interval (keys, start, end): twice its width on both sides, three days
    if it has none; all of a series that has no interval or no reading there."""
    width = F.col("end") - F.col("start")
    pad = F.when(F.col("end") > F.col("start"), width * 2).otherwise(F.expr("interval 3 days"))
    spans = found.select(*keys, (F.col("start") - pad).alias("_a"), (F.col("end") + pad).alias("_b"))
    near = readings.join(spans, keys).filter(F.col("ts").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return all_if_none(near.select(*readings.columns), readings, keys)


def chosen_channels(readings: DataFrame, channels: list[str]) -> DataFrame:
    """Readings of the named channels. Raises if one is unknown, and names up to 100 that there are."""
    known = readings.select("channel_id").distinct()
    there = {r[0] for r in known.filter(F.col("channel_id").isin(channels)).collect()}  # as many as were asked for
    unknown = [c for c in channels if c not in there]
    if unknown:
        some = [r[0] for r in known.orderBy("channel_id").limit(100).collect()]
        raise ValueError(f"unknown channels {unknown}; there are {some}")
    return readings.filter(F.col("channel_id").isin(channels))
