"""Trend reports of a month: two to four segments with kind and adjective, and one outlier at most.

Smoothing, labels and z-scores are window expressions. Only the choice and refinement of cuts, where
each step depends on the last, runs per (series, month) in a grouped map; a month is a bounded group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import topk, windows
from tidegauge.views import SERIES, stored

#: Weight of a cut against squared error; how far and how often cuts are moved; rows kept at borders.
PENALTY, RADIUS, ROUNDS, MARGIN = 8.0, 8, 3, 4
STABLE, RAPID, FLUCTUATING, OUTLIER = 0.15, 0.60, 0.50, 3.0


class Lines:
    """Squared errors of best lines over stretches of a series, from prefix sums."""

    def __init__(self, y: np.ndarray):
        i = np.arange(len(y), dtype=float)
        self.sums = [np.concatenate([[0.0], np.cumsum(c)]) for c in (y, y * y, i * y, i, i * i)]

    def error(self, bounds: list[int]) -> float:
        out = 0.0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = b - a + 1
            if n < 2:
                continue
            y, yy, iy, i, ii = (s[b + 1] - s[a] for s in self.sums)
            sxx = ii - i * i / n
            out += max(0.0, yy - y * y / n - (iy - i * y / n) ** 2 / sxx)
        return out


def choose_cuts(smooth: np.ndarray, bend: np.ndarray, gap: int) -> list[int]:
    """The cheapest of one, two or three cuts at the strongest bends, then moved to fit better."""
    n, lines = len(smooth), Lines(smooth)
    order = [i for i in np.lexsort((-np.arange(n), -bend)) if gap <= i <= n - gap - 1]
    best, least = [], float("inf")
    for wanted in (1, 2, 3):
        cuts: list[int] = []
        for i in order:
            if len(cuts) == wanted:
                break
            if all(abs(i - c) > gap for c in cuts):
                cuts.append(int(i))
        cuts.sort()
        cost = lines.error([0, *cuts, n - 1]) + PENALTY * wanted * np.log(n) * float(np.var(smooth))
        if cost < least:
            best, least = cuts, cost
    for _ in range(ROUNDS):
        moved = False
        for k in range(len(best)):
            low = best[k - 1] + MARGIN if k else MARGIN
            high = best[k + 1] - MARGIN if k + 1 < len(best) else n - 1 - MARGIN
            spots = [p for p in range(best[k] - RADIUS, best[k] + RADIUS + 1) if p != best[k] and low <= p <= high]
            errors = [lines.error([0, *best[:k], p, *best[k + 1 :], n - 1]) for p in spots]
            if errors and min(errors) < lines.error([0, *best, n - 1]):
                best[k], moved = spots[int(np.argmin(errors))], True
        if not moved:
            break
    return best


def bounds(month: DataFrame, width: int, gap: int) -> DataFrame:
    """(series, month, seg, a, b): the segments' first and last places; neighbours share one."""
    keys = [*SERIES, "month"]
    smooth = windows.centred(windows.position(month, keys=keys), "smooth", F.avg, "value", width, keys)
    w = windows.along(keys)
    d1 = F.coalesce(F.col("smooth") - F.lag("smooth").over(w), F.lit(0.0))
    bent = smooth.withColumn("d1", d1).withColumn("bend", F.coalesce(F.abs(F.col("d1") - F.lag("d1").over(w)), F.lit(0.0)))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        y = pdf["smooth"].to_numpy(float)
        if len(y) < width or np.isnan(y).any():
            return pd.DataFrame({c: [] for c in [*keys, "seg", "a", "b"]})
        ends = [0, *choose_cuts(y, pdf["bend"].to_numpy(float), gap), len(y) - 1]
        rows = [(*pdf.iloc[0][keys], i, a, b) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
        return pd.DataFrame(rows, columns=[*keys, "seg", "a", "b"])

    return bent.select(*keys, "pos", "smooth", "bend").groupBy(*keys).applyInPandas(cut, "task_id string, channel_id string, month string, seg int, a int, b int")


def segments(readings: DataFrame, width: int, gap: int, cuts: DataFrame | None = None) -> DataFrame:
    """(series, month, seg, start, end, adj, kind) of the trend segments of each month; ``cuts`` are its
    ``bounds`` if these are known."""
    keys = [*SERIES, "month"]
    month = readings.withColumn("month", F.date_format("ts", "yyyy-MM"))
    smooth = windows.centred(windows.position(month, keys=keys), "smooth", F.avg, "value", width, keys)
    span = smooth.groupBy(*keys).agg(F.greatest(F.lit(1e-9), F.max("smooth") - F.min("smooth")).alias("span"))
    cuts = bounds(month, width, gap) if cuts is None else cuts
    own = smooth.join(cuts.filter(F.col("b") - F.col("a") >= MARGIN), keys).filter(F.col("pos").between(F.col("a"), F.col("b")))
    at = lambda c, p: F.max(F.when(F.col("pos") == F.col(p), F.col(c))).over(Window.partitionBy(*keys, "seg"))
    own = own.withColumn("v1", at("smooth", "a")).withColumn("v2", at("smooth", "b"))
    own = own.withColumn("off", F.col("smooth") - (F.col("v1") + (F.col("v2") - F.col("v1")) * (F.col("pos") - F.col("a")) / (F.col("b") - F.col("a"))))
    seg = own.groupBy(*keys, "seg").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.first(F.col("v2") - F.col("v1")).alias("rise"), F.stddev_pop("off").alias("rough")).join(span, keys)
    seg = seg.withColumn("rel_slope", F.abs("rise") / F.col("span")).withColumn("rel_std", F.col("rough") / F.col("span"))
    seg = seg.withColumn("kind", F.when(F.col("rel_slope") < STABLE, "stable").when(F.col("rise") > 0, "rise").otherwise("fall"))
    w = Window.partitionBy(*keys, F.col("kind") == "stable")
    adj = F.when(F.col("kind") == "stable", F.when(F.col("rel_std") >= FLUCTUATING * F.max("rel_std").over(w), "fluctuating").otherwise("steady")).otherwise(F.when(F.col("rel_slope") >= RAPID * F.max("rel_slope").over(w), "rapid").otherwise("gradual"))
    return seg.withColumn("adj", adj).select(*keys, "seg", "start", "end", "adj", "kind")


def outliers(readings: DataFrame, width: int, gap: int, cuts: DataFrame | None = None) -> DataFrame:
    """(series, month, timestamp, value): the point farthest out in its segment, if beyond 3 sigma;
    ``cuts`` are the ``bounds`` if these are known."""
    keys = [*SERIES, "month"]
    month = windows.position(readings.withColumn("month", F.date_format("ts", "yyyy-MM")), keys=keys)
    inside = month.join(bounds(month.drop("pos"), width, gap) if cuts is None else cuts, keys).filter(F.col("pos").between(F.col("a"), F.col("b")))
    w = Window.partitionBy(*keys, "seg")
    z = (F.col("value") - F.avg("value").over(w)) / F.when(F.stddev_pop("value").over(w) > 0, F.stddev_pop("value").over(w)).otherwise(1e-9)
    scored = inside.withColumn("z", z).groupBy(*keys, "pos").agg(F.max_by(F.struct("ts", "value", "z"), "seg").alias("r")).select(*keys, "r.*").withColumn("size", F.abs("z"))
    return topk.arg_extreme(scored, "size", True, keys).filter(F.col("size") > OUTLIER).select(*keys, F.col("ts").alias("timestamp"), "value")


def report(readings: DataFrame, width: int, gap: int, write: bool = False) -> DataFrame:
    """(series, month, trend_segments, outliers) as arrays of structs. With ``write`` the cuts, which
    both parts need, are chosen once and written while the plan is built."""
    keys = [*SERIES, "month"]
    cuts = bounds(readings.withColumn("month", F.date_format("ts", "yyyy-MM")), width, gap)
    cuts = stored(cuts, "cuts") if write else cuts
    seg = segments(readings, width, gap, cuts).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "adj", "kind"))).alias("trend_segments"))
    out = outliers(readings, width, gap, cuts).groupBy(*keys).agg(F.collect_list(F.struct("timestamp", "value")).alias("outliers"))
    return seg.join(out, keys, "left").withColumn("outliers", F.coalesce("outliers", F.array().cast("array<struct<timestamp:timestamp_ntz,value:double>>")))
