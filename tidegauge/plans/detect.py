"""Question operators: each takes readings of many series and gives a row a series.

``n`` arguments are numbers of samples. Series of one sampling step share a plan; ``by_step`` runs a
plan for each distinct step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import sax
from tidegauge.operators import aggregates, topk, transforms, windows
from tidegauge.views import SERIES, stored


def by_step(readings: DataFrame, plan: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """``plan(series, step in seconds)`` for the series of each median step; raises if there are over 100 steps.

    Series without two readings have no step, and no row.
    """
    steps = aggregates.median_step(readings).filter("step > 0")
    distinct = steps.select("step").distinct().limit(101).collect()
    if len(distinct) > 100:
        raise ValueError("series have more than 100 median steps; round their times, or ask in parts")
    out = None
    for (step,) in sorted(distinct):
        part = plan(readings.join(steps.filter(F.col("step") == step).select(*SERIES), SERIES, "left_semi"), step)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else plan(readings.filter(F.lit(False)), 1.0)


def by_width(readings: DataFrame, spans: list[tuple[float, int]], plan: Callable[..., DataFrame], most: int = 100) -> DataFrame:
    """``plan(series, *samples)`` for the series of each choice of samples in ``spans`` (seconds, least).

    Series whose steps come to the same numbers of samples share a plan, so there are few. Of the series
    beyond the ``most`` commonest choices, and those without two readings, there is no row; nothing is raised.
    """
    steps = aggregates.median_step(readings).filter("step > 0")
    numbers = F.array(*(aggregates.samples_per(seconds, F.col("step"), least) for seconds, least in spans))
    widths = steps.select(*SERIES, numbers.alias("_widths"))
    common = widths.groupBy("_widths").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_widths").limit(most).collect()
    out = None
    for own in sorted(r["_widths"] for r in common):
        part = plan(readings.join(widths.filter(F.col("_widths") == F.array(*map(F.lit, own))).select(*SERIES), SERIES, "left_semi"), *own)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else plan(readings.filter(F.lit(False)), *(least for _, least in spans))


def interval_discovery(readings: DataFrame, op: str, threshold: float) -> DataFrame:
    """The longest stretch where the value is above, or below, a threshold."""
    mask = {">": F.col("value") > threshold, "<": F.col("value") < threshold}[op]
    return windows.longest_run(windows.position(readings).withColumn("on", mask), "on")


def sliding_window(readings: DataFrame, n: int, metric: str, high: bool) -> DataFrame:
    """start, end and score of the ``n`` samples with the highest or lowest mean, range, var or std."""
    stat = {"mean": F.avg("value"), "var": F.var_samp("value"), "std": F.stddev_samp("value")}
    w = windows.along().rowsBetween(-(n - 1), 0)
    if metric == "range":
        score = F.when(F.count("value").over(w) == n, F.max("value").over(w) - F.min("value").over(w))
    else:
        score = windows.trailing(stat[metric], "value", n)
    scored = readings.withColumn("score", F.round(score, 6)).withColumn("start", F.lag("ts", n - 1).over(windows.along()))
    return topk.arg_extreme(scored, "score", high).select(*SERIES, "start", F.col("ts").alias("end"), "score")


def widest(readings: DataFrame, ranges: bool = True) -> DataFrame:
    """As ``sliding_window`` for series that each have an own ``n``, ``spread`` (mean, range, var or std) and
    ``high``.

    Windows of any width are differences of prefix sums of the values less the series' mean; a range is
    that of the two stretches of a power of two that cover the window. Both ends meet by an equi-join.
    Without ``ranges`` no ``spread`` may be range.
    """
    w = windows.along(order="pos")
    whole = Window.partitionBy(*SERIES)
    y = F.col("value") - F.col("middle")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = windows.position(readings).withColumn("middle", F.avg("value").over(whole))
    sums = placed.withColumns({"s1": F.sum(y).over(upto), "s2": F.sum(y * y).over(upto)})
    old = sums.select(*SERIES, F.col("pos").alias("before"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    start = sums.select(*SERIES, F.col("pos").alias("first"), F.col("ts").alias("start"))
    ends = sums.filter(F.col("pos") >= F.col("n") - 1).withColumns({"before": F.col("pos") - F.col("n"), "first": F.col("pos") - F.col("n") + 1})
    both = ends.join(old, [*SERIES, "before"], "left").join(start, [*SERIES, "first"])
    both = both.join(_reaches(placed), [*SERIES, "pos"], "left") if ranges else both.withColumn("reach", F.lit(None).cast("double"))
    m1, m2, n = F.col("s1") - F.coalesce("p1", F.lit(0.0)), F.col("s2") - F.coalesce("p2", F.lit(0.0)), F.col("n")
    var = F.when(n > 1, F.greatest(F.lit(0.0), m2 - m1 * m1 / n) / (n - 1))
    score = F.when(F.col("spread") == "range", F.col("reach")).when(F.col("spread") == "var", var).when(F.col("spread") == "std", F.sqrt(var)).otherwise(m1 / n + F.col("middle"))
    scored = both.withColumn("score", F.round(score, 6)).withColumn("size", F.when(F.col("high"), F.col("score")).otherwise(-F.col("score")))
    return topk.arg_extreme(scored, "size", True).select(*SERIES, "start", F.col("ts").alias("end"), "score")


def _reaches(placed: DataFrame) -> DataFrame:
    """(series, pos, reach): greatest less least of the last ``n`` rows, of series whose ``spread`` is range."""
    w = windows.along(order="pos")
    own = placed.filter("spread = 'range'").select(*SERIES, "pos", "n", F.col("value").alias("top0"), F.col("value").alias("low0"))
    # as many levels as the logarithm of the widest window
    levels = (own.agg(F.max("n")).head()[0] or 1).bit_length()
    for j in range(levels - 1):  # topj: the greatest of 2 ** j rows up to this one
        own = own.withColumns({
            f"top{j + 1}": F.greatest(f"top{j}", F.lag(f"top{j}", 1 << j).over(w)),
            f"low{j + 1}": F.least(f"low{j}", F.lag(f"low{j}", 1 << j).over(w)),
        })
    level = F.floor(F.log2("n") + 1e-12).cast("int")
    pick = lambda name: F.get(F.array(*(F.col(f"{name}{j}") for j in range(levels))), level)
    own = own.select(*SERIES, "pos", (F.col("pos") - F.col("n") + F.pow(F.lit(2), level).cast("int")).alias("half"), pick("top").alias("top"), pick("low").alias("low"))
    left = own.select(*SERIES, F.col("pos").alias("half"), F.col("top").alias("top_left"), F.col("low").alias("low_left"))
    return own.join(left, [*SERIES, "half"]).select(*SERIES, "pos", (F.greatest("top", "top_left") - F.least("low", "low_left")).alias("reach"))


def plateau(readings: DataFrame, depressed: bool = False, width: int = 4) -> DataFrame:
    """The longest flat stretch; only at or below the 30th percentile if ``depressed``."""
    rolled = windows.centred(windows.position(readings), "rolled", F.stddev_samp, "value", width)
    whole = readings.groupBy(*SERIES).agg(F.stddev_pop("value").alias("spread"), F.percentile("value", 0.3).alias("p30"))
    on = F.round("rolled", 9) <= F.round(0.10 * F.col("spread"), 9)
    if depressed:
        on = on & (F.col("value") <= F.col("p30"))
    return windows.longest_run(rolled.join(whole, SERIES).withColumn("on", on), "on")


def spike(readings: DataFrame) -> DataFrame:
    return windows.midline_walk(windows.position(readings), "value", True)


def valley(readings: DataFrame) -> DataFrame:
    return windows.midline_walk(windows.position(readings), "value", False)


def step(readings: DataFrame, width: int, up: bool) -> DataFrame:
    """From where to where the smoothed series rises (or drops) most."""
    smooth = windows.centred(windows.position(readings), "smooth", F.avg, "value", width).withColumn("smooth", F.round("smooth", 9))
    moved = windows.running_extreme(smooth, "smooth", up).withColumn("move", F.round("move", 9))
    best = topk.arg_extreme(moved, "move", True).select(*SERIES, F.col("since").alias("first"), F.col("pos").alias("last"), F.col("ts").alias("end"), "move")
    start = smooth.select(*SERIES, F.col("pos").alias("first"), F.col("ts").alias("start"))
    return best.join(start, [*SERIES, "first"]).select(*SERIES, "start", "end", "move")


def shape_search(features: DataFrame, shape: str, start: str, end: str) -> DataFrame:
    """Windows that touch the range and whose word has the shape."""
    touching = features.filter((F.col("window_start") <= F.lit(end).cast("timestamp_ntz")) & (F.col("window_end") >= F.lit(start).cast("timestamp_ntz")))
    return touching.filter(sax.matches(F.col("sax"), F.lit(sax.SHAPES[shape])))


def periodicity(readings: DataFrame, first_lags: int = 64) -> DataFrame:
    """period: the first lag from 2 on whose autocorrelation is above both neighbours' and 0.1,
    doubled if that at twice the lag is below -0.1; else from the largest Fourier term.

    Small lags come first; all lags only for series without a peak among them.
    """
    n = readings.groupBy(*SERIES).agg(F.count("*").alias("n"))
    half, all_ = F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int")), F.greatest(F.lit(1), F.col("n").cast("int") - 1)

    def peaks(some: DataFrame, most, upto) -> DataFrame:
        """The period of the series with a peak up to the lag ``most``, of the lags up to ``upto`` at once."""
        # rounded, so that equal neighbours aren't told apart by the transform's last digits
        acf = aggregates.autocorrelation(some, F.sequence(F.lit(1), upto)).withColumn("acf", F.round("acf", 12))
        rows = acf.groupBy(*SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("a")).join(n, SERIES).withColumn("most", most)
        at = lambda lag: F.get("a", lag - 1)
        good = F.filter(F.sequence(F.lit(2), F.greatest(F.col("most") - 1, F.lit(2))), lambda x: (x < F.col("most")) & (at(x) > at(x - 1)) & (at(x) > at(x + 1)) & (at(x) > 0.1))
        first = rows.withColumn("lag", F.get(good, F.lit(0))).filter("lag is not null")
        return first.select(*SERIES, F.when(at(F.col("lag") * 2) < -0.1, F.col("lag") * 2).otherwise(F.col("lag")).cast("long").alias("period"))

    early = stored(peaks(readings, F.least(F.lit(first_lags), half), F.least(F.lit(2 * first_lags), all_)), "periods")  # a row a series, used three times
    late = stored(peaks(readings.join(early, SERIES, "left_anti"), half, all_), "periods")
    found = peaked = early.unionByName(late)
    rest = readings.join(found, SERIES, "left_anti").join(n.filter("n >= 9"), SERIES)
    spectrum = aggregates.spectrum(rest, F.sequence(F.lit(3), F.floor(F.col("n") / 3).cast("int")))
    top = spectrum.filter("magnitude > 1e-9").groupBy(*SERIES).agg(F.max_by(F.struct("k", "n"), F.struct("magnitude", -F.col("k"))).alias("t"))
    return peaked.unionByName(top.select(*SERIES, F.bround(F.col("t.n") / F.col("t.k")).cast("long").alias("period")))


def subsequence(query: DataFrame, readings: DataFrame, top: int = 1) -> DataFrame:
    """start, end and distance of the ``top`` stretches of each series nearest its query."""
    return transforms.nearest(query, readings, top)


def dtw(query: DataFrame, readings: DataFrame, candidates: int = 10) -> DataFrame:
    """As ``subsequence``, by time warping: the best of all stretches, not of the ``candidates`` alone."""
    return transforms.nearest_warped(query, readings, candidates)


def day_metric(readings: DataFrame, kind: str, least: int = 8, width: int = 4) -> DataFrame:
    """(series, day, metric) of days with ``least`` samples: how far the longest rise or fall of the
    smoothed day goes, or how much the raw values vary in its longest quiet stretch."""
    keys = [*SERIES, "day"]
    days = readings.withColumn("day", F.to_date("ts")).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("n") >= least).drop("n")
    days = windows.position(days, keys=keys)
    smooth = windows.centred(days, "smooth", F.avg, "value", width, keys).withColumn("smooth", F.round("smooth", 9))
    ahead = (F.lead("smooth").over(windows.along(keys, "pos")) - F.col("smooth")).alias("step")
    moved = smooth.withColumn("step", F.round(ahead, 9))  # the difference at place i is that from i to i + 1
    if kind in ("rise", "fall"):
        on = F.col("step") > 0 if kind == "rise" else F.col("step") < 0
        best = windows.longest_run(moved.withColumn("on", F.coalesce(on, F.lit(False))), "on", keys)
        ends = best.join(smooth.select(*keys, F.col("pos").alias("first"), F.col("smooth").alias("v1")), [*keys, "first"]).join(smooth.select(*keys, F.col("pos").alias("last"), F.col("smooth").alias("v2")), [*keys, "last"])
        return ends.select(*keys, F.round(F.col("v2") - F.col("v1") if kind == "rise" else F.col("v1") - F.col("v2"), 8).alias("metric"))
    steps = moved.filter("step is not null")
    quiet = windows.centred(steps, "quiet", F.stddev_samp, "step", width, keys).withColumn("quiet", F.round("quiet", 9))
    middle = quiet.groupBy(*keys).agg(F.median("quiet").alias("middle"))
    best = windows.longest_run(quiet.join(middle, keys).withColumn("on", F.coalesce(F.col("quiet") < F.col("middle"), F.lit(False))), "on", keys)
    inside = days.join(best.select(*keys, "first", "last"), keys).filter(F.col("pos").between(F.col("first"), F.col("last")))
    return inside.groupBy(*keys).agg(F.round(F.stddev_pop("value"), 8).alias("metric"))


def composite_trend(readings: DataFrame, features: DataFrame, kinds: list[str], target: str, descending: bool, k: int = 5) -> DataFrame:
    """The ``k`` days that best match a sequence of kinds, ranked by the target segment's metric."""
    pattern = ".*".join(sax.KINDS[x] for x in kinds)
    hits = features.filter((F.col("granularity") == "daily") & sax.matches(F.col("sax"), F.lit(pattern))).select(*SERIES, F.to_date("window_start").alias("day"))
    days = day_metric(readings, target)
    floor = days.groupBy(*SERIES).agg(F.percentile("metric", 0.5 if descending else 0.8).alias("floor"))
    tall = days.join(floor, SERIES).filter(F.round("metric", 6) >= F.round("floor", 6))
    flags = tall.join(hits.withColumn("in_sax", F.lit(True)), [*SERIES, "day"], "left").withColumn("in_sax", F.coalesce("in_sax", F.lit(False)))
    return topk.pool_first(flags, "metric", descending, k).select(*SERIES, "rank", "day", "metric", "in_sax")


def _or_around_peak(found: DataFrame, scored: DataFrame, value: str, days: int) -> DataFrame:
    """``found``, and for series without a row the days round the largest ``value``."""
    top = topk.arg_extreme(scored.withColumn("_size", F.abs(F.col(value))), "_size", True).join(found, SERIES, "left_anti")
    ends = scored.groupBy(*SERIES).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = F.expr(f"interval {days} days")
    last = top.join(ends, SERIES).select(*SERIES, F.greatest(F.col("ts") - span, F.col("a")).alias("start"), F.least(F.col("ts") + span, F.col("b")).alias("end"), F.lit("fallback").alias("rule"))
    return found.unionByName(last)


def contextual_anomaly(paired: DataFrame, n_day: int, sign: int, least_days: int = 30) -> DataFrame:
    """start, end and rule of the longest stretch where value less base, smoothed over a day, is
    beyond k sigma in the direction ``sign``; ``paired`` has value and base."""
    resid = windows.position(paired).withColumn("resid", F.col("value") - F.col("base"))
    smooth = windows.centred(resid, "smooth", F.avg, "resid", n_day) if n_day > 1 else resid.withColumn("smooth", F.col("resid"))
    spread = smooth.groupBy(*SERIES).agg(F.stddev_pop("smooth").alias("sp"), F.stddev_samp("value").alias("raw"))
    sigma = F.when(F.col("sp") < 1e-9, F.coalesce(F.nullif(0.1 * F.col("raw"), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("sp"))
    scored = smooth.join(spread, SERIES).withColumn("sigma", sigma)
    masks = [F.round(sign * F.col("smooth"), 6) > F.round(k * F.col("sigma"), 6) for k in (2.0, 1.5, 1.0, 0.75, 0.5, 0.3)]
    found = windows.threshold_walk(scored, masks, F.lit(least_days * n_day)).select(*SERIES, "start", "end", F.concat(F.lit("k"), F.col("rank").cast("string")).alias("rule"))
    if sign < 0:
        low = low_variance(paired.join(found, SERIES, "left_anti"), max(n_day, 2)).filter(F.col("length") >= least_days * n_day)
        found = found.unionByName(low.select(*SERIES, "start", "end", F.lit("low_variance").alias("rule")))
    return _or_around_peak(found, scored, "smooth", 30)


def low_variance(readings: DataFrame, n: int) -> DataFrame:
    """The longest stretch whose rolling std is under 0.3 of the mean rolling std."""
    rolled = windows.centred(windows.position(readings), "rolled", F.stddev_samp, "value", n)
    mean = rolled.groupBy(*SERIES).agg(F.avg("rolled").alias("mean"))
    return windows.longest_run(rolled.join(mean, SERIES).withColumn("on", F.round("rolled", 6) < F.round(0.3 * F.col("mean"), 6)), "on")


def causal_inverse(pairs: DataFrame, n: int, least: int) -> DataFrame:
    """The longest stretch where down, less its regression on up, smoothed, is beyond k sigma."""
    fit = aggregates.ols(pairs, "down", "up", SERIES)
    resid = windows.position(pairs.join(fit, SERIES)).withColumn("resid", F.col("down") - F.col("a") - F.col("b") * F.col("up"))
    smooth = windows.centred(resid, "smooth", F.avg, "resid", n)
    spread = smooth.groupBy(*SERIES).agg(F.stddev_pop("smooth").alias("sp"), F.stddev_samp("down").alias("raw"))
    sigma = F.when(F.col("sp") < 1e-9, F.coalesce(F.nullif(0.05 * F.col("raw"), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("sp"))
    masks = [F.round(F.abs("smooth"), 4) > F.round(k * F.col("sigma"), 4) for k in (3.0, 2.5, 2.0, 1.5, 1.0)]
    found = windows.threshold_walk(smooth.join(spread, SERIES).withColumn("sigma", sigma), masks, F.lit(least))
    return _or_middle(found.select(*SERIES, "start", "end", "rank"), pairs, 3)


def causal_flatline(pairs: DataFrame, n: int, least: int) -> DataFrame:
    """The longest stretch where down hardly varies while up does; then without the test of up."""
    rolled = windows.centred(windows.centred(windows.position(pairs), "rd", F.stddev_samp, "down", n), "ru", F.stddev_samp, "up", n)
    spread = rolled.groupBy(*SERIES).agg(F.median("rd").alias("md"), F.percentile("ru", 0.75).alias("p75"))
    still = lambda q: F.round("rd", 4) < F.round(q * F.col("md"), 4)
    masks = [still(lo) & (F.round("ru", 4) > F.round(2 * hi * F.col("p75"), 4)) for lo, hi in ((0.2, 0.5), (0.3, 0.4), (0.4, 0.3), (0.5, 0.2))]
    masks += [still(q) for q in (0.2, 0.3, 0.5, 0.8)]
    found = windows.threshold_walk(rolled.join(spread, SERIES), masks, F.lit(least))
    return _or_middle(found.select(*SERIES, "start", "end", "rank"), pairs, 3)


def _or_middle(found: DataFrame, pairs: DataFrame, days: int) -> DataFrame:
    """``found``, and for series without a row the days round the middle sample."""
    n = F.count("*").over(Window.partitionBy(*SERIES))
    middle = windows.position(pairs).withColumn("n", n).filter(F.col("pos") == F.floor(F.col("n") / 2)).join(found, SERIES, "left_anti")
    ends = pairs.groupBy(*SERIES).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = F.expr(f"interval {days} days")
    return found.unionByName(middle.join(ends, SERIES).select(*SERIES, F.greatest(F.col("ts") - span, F.col("a")).alias("start"), F.least(F.col("ts") + span, F.col("b")).alias("end"), F.lit(-1).alias("rank")))
