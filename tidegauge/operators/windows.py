"""Window operators over series: columns task_id, channel_id, ts, value unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.views import SERIES


def along(keys: list[str] = SERIES, order: str = "ts") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def position(df: DataFrame, name: str = "pos", keys: list[str] = SERIES) -> DataFrame:
    """0-based place of each row in its series."""
    return df.withColumn(name, F.row_number().over(along(keys)) - 1)


def full(stat: Column, value: str, w: Window, n: int) -> Column:
    """``stat`` over a frame, null unless it holds ``n`` values."""
    return F.when(F.count(value).over(w) == n, stat.over(w))


def trailing(stat: Column, value: str, n: int, keys: list[str] = SERIES) -> Column:
    """Over the last ``n`` rows up to this one."""
    return full(stat, value, along(keys).rowsBetween(-(n - 1), 0), n)


def leading(stat: Column, value: str, n: int, keys: list[str] = SERIES) -> Column:
    """Over ``n`` rows from this one on."""
    return full(stat, value, along(keys).rowsBetween(0, n - 1), n)


def filled(df: DataFrame, name: str, keys: list[str] = SERIES, order: str = "ts") -> DataFrame:
    """Nulls of ``name`` take the next value, else the last one."""
    w = Window.partitionBy(*keys).orderBy(order)
    # backwards, as a frame that runs on to the end is read anew for each row
    back = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    later = F.last(name, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn(name, later)
    return df.withColumn(name, F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def centred(df: DataFrame, name: str, stat: Callable[[str], Column], value: str, n: int, keys: list[str] = SERIES) -> DataFrame:
    """``name``: ``stat`` of ``value`` over rows i - n//2 ... i + (n-1)//2, its edges filled."""
    w = along(keys).rowsBetween(-(n // 2), (n - 1) // 2)
    return filled(df.withColumn(name, full(stat(value), value, w, n)), name, keys)


def difference(value: str = "value", keys: list[str] = SERIES) -> Column:
    return F.col(value) - F.lag(value).over(along(keys))


def prefix_sums(df: DataFrame, value: str = "value", keys: list[str] = SERIES) -> DataFrame:
    """pos, and the running sums of y, y*y and i*y."""
    df = position(df, keys=keys)
    w = along(keys, "pos").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    return df.withColumns({"sum_y": F.sum(v).over(w), "sum_yy": F.sum(v * v).over(w), "sum_iy": F.sum(v * F.col("pos")).over(w)})


def runs(df: DataFrame, mask: str, keys: list[str] = SERIES) -> DataFrame:
    """(keys, first, last, start, end, length) of every stretch of rows where ``mask`` is true.

    ``df`` needs pos and ts. length is last - first: one row has length 0.
    """
    hit = df.filter(F.col(mask))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return hit.withColumn("island", island).groupBy(*keys, "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("ts").alias("start"), F.max("ts").alias("end")).withColumn("length", F.col("last") - F.col("first")).drop("island")


def longest_run(df: DataFrame, mask: str, keys: list[str] = SERIES) -> DataFrame:
    """The longest run of each series, the first of equals."""
    best = F.max_by(F.struct("first", "last", "start", "end", "length"), F.struct("length", -F.col("first")))
    return runs(df, mask, keys).groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def threshold_walk(df: DataFrame, masks: list[Column], least: Column, keys: list[str] = SERIES) -> DataFrame:
    """The longest run under the first of ``masks`` whose longest run is at least ``least`` long.

    Adds rank (which mask). Rows are repeated once a mask, so masks should be few.
    """
    each = df.withColumn("mask", F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), m.alias("on")) for i, m in enumerate(masks)))))
    each = each.select(*df.columns, F.col("mask.rank").alias("rank"), F.col("mask.on").alias("on"))
    best = longest_run(each, "on", [*keys, "rank"]).filter(F.col("length") >= least)
    pick = F.min_by(F.struct("rank", "first", "last", "start", "end", "length"), "rank")
    return best.groupBy(*keys).agg(pick.alias("r")).select(*keys, "r.*")


def running_extreme(df: DataFrame, value: str, low: bool, keys: list[str] = SERIES) -> DataFrame:
    """move: rise above the least value so far (``low``) or drop below the greatest; since: its pos."""
    w = along(keys, "pos").rowsBetween(Window.unboundedPreceding, 0)
    if low:
        at = F.min(F.struct(F.col(value).alias("v"), F.col("pos").alias("i"))).over(w)
        return df.withColumn("at", at).withColumn("move", F.col(value) - F.col("at.v")).withColumn("since", F.col("at.i")).drop("at")
    at = F.max(F.struct(F.col(value).alias("v"), (-F.col("pos")).alias("i"))).over(w)
    return df.withColumn("at", at).withColumn("move", F.col("at.v") - F.col(value)).withColumn("since", -F.col("at.i")).drop("at")


def midline_walk(df: DataFrame, value: str, high: bool, keys: list[str] = SERIES) -> DataFrame:
    """start, end: the stretch round each series' extreme (first of equals) on its side of the midline
    between extreme and median."""
    sign = F.lit(1 if high else -1)
    top = df.groupBy(*keys).agg(F.max_by("pos", F.struct(sign * F.col(value), -F.col("pos"))).alias("peak"), (F.max if high else F.min)(value).alias("extreme"), F.median(value).alias("middle"))
    both = df.join(top, keys).withColumn("mid", (F.col("extreme") + F.col("middle")) / 2)
    off = (F.col(value) < F.col("mid")) if high else (F.col(value) > F.col("mid"))
    limits = both.groupBy(*keys).agg(F.max(F.when(off & (F.col("pos") < F.col("peak")), F.col("pos"))).alias("below"), F.min(F.when(off & (F.col("pos") > F.col("peak")), F.col("pos"))).alias("above"))
    inside = both.join(limits, keys).filter((F.col("pos") > F.coalesce("below", F.lit(-1))) & (F.col("pos") < F.coalesce("above", F.lit(1 << 30))))
    return inside.groupBy(*keys).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def interpolated(df: DataFrame, unit: str, keys: list[str] = SERIES) -> DataFrame:
    """One row for each ``unit`` (hour, day, month) from the first to the last reading, its mean value;
    bins without readings are filled linearly by the number of bins."""
    bins = df.withColumn("ts", F.date_trunc(unit, "ts").cast("timestamp_ntz")).groupBy(*keys, "ts").agg(F.avg("value").alias("value"))
    return densified(bins, unit, keys)


def densified(bins: DataFrame, unit: str, keys: list[str] = SERIES) -> DataFrame:
    grid = bins.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(*keys, F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("ts"))
    all_ = position(grid.join(bins, [*keys, "ts"], "left"))
    w = along(keys, "pos")
    known = F.when(F.col("value").isNotNull(), F.struct("pos", "value"))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.col("pos").desc())
    after = F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    out = all_.withColumn("before", before).withColumn("after", after)
    slope = (F.col("after.value") - F.col("before.value")) / (F.col("after.pos") - F.col("before.pos"))
    line = F.col("before.value") + slope * (F.col("pos") - F.col("before.pos"))
    return out.withColumn("value", F.coalesce("value", line, "before.value", "after.value")).drop("before", "after")
