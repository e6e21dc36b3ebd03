"""Long series cut into blocks: scans of two levels, and blocks that overlap.

A scan numbers or sums up the rows of each calendar block on its own, scans the blocks' summaries (a
row a block), and adds what came before to each row; so a series of many blocks keeps many tasks busy.
Results equal those of a window over the whole series. Blocks that overlap hold the rows that a computation
over neighbouring rows needs besides its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.views import SERIES


def _with_before(df: DataFrame, unit: str, keys: list[str], summary: dict[str, Column], before: Column) -> DataFrame:
    """``df`` with _block, and _before: ``before`` of the blocks ahead of a row's, over their ``summary``."""
    df = df.withColumn("_block", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
    each = df.groupBy(*keys, "_block").agg(*(c.alias(n) for n, c in summary.items()))
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(each.select(*keys, "_block", before.over(ahead).alias("_before")), [*keys, "_block"])


def _inside(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy("ts")


def position(df: DataFrame, name: str = "pos", unit: str = "month", keys: list[str] = SERIES) -> DataFrame:
    """0-based place of each row in its series, as a long."""
    out = _with_before(df, unit, keys, {"n": F.count("*")}, F.sum("n"))
    place = F.coalesce("_before", F.lit(0)) + F.row_number().over(_inside(keys)) - 1
    return out.withColumn(name, place.cast("long")).select(*(c for c in df.columns if c != name), name)


def prefix_sums(df: DataFrame, value: str = "value", unit: str = "month", keys: list[str] = SERIES) -> DataFrame:
    """pos, and the running sums of y, y*y and i*y, i being the place."""
    v = F.col(value)
    placed = position(df, "pos", unit, keys)
    parts = {"sum_y": v, "sum_yy": v * v, "sum_iy": v * F.col("pos")}
    placed = placed.withColumn("_block", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
    each = placed.groupBy(*keys, "_block").agg(*(F.sum(c).alias(n) for n, c in parts.items()))
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*keys, "_block", *(F.sum(n).over(ahead).alias(f"_{n}") for n in parts))
    w = _inside(keys).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(each, [*keys, "_block"]).withColumns({n: F.coalesce(f"_{n}", F.lit(0.0)) + F.sum(c).over(w) for n, c in parts.items()})
    return out.drop("_block", *(f"_{n}" for n in parts))


def running_extreme(df: DataFrame, value: str, low: bool, unit: str = "month", keys: list[str] = SERIES) -> DataFrame:
    """move: rise above the least value so far (``low``) or drop below the greatest; since: its pos. ``df``
    needs pos."""
    best = F.min if low else F.max
    # of equal values the first place counts
    own = F.struct(F.col(value).alias("v"), (F.col("pos") if low else -F.col("pos")).alias("i"))
    out = _with_before(df, unit, keys, {"best": best(own)}, best("best"))
    pick = F.least if low else F.greatest
    at = pick(best(own).over(_inside(keys).rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    out = out.withColumn("_at", at)
    move = F.col(value) - F.col("_at.v") if low else F.col("_at.v") - F.col(value)
    since = F.col("_at.i") if low else -F.col("_at.i")
    return out.withColumns({"move": move, "since": since}).drop("_block", "_before", "_at")


def runs(df: DataFrame, mask: str, unit: str = "month", keys: list[str] = SERIES) -> DataFrame:
    """(keys, first, last, start, end, length) of every stretch of rows where ``mask`` is true; ``df``
    needs pos. Runs are found in each block; those that touch a block's border, two a block at
    most, are then joined to the ones next to them."""
    df = df.withColumn("_block", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
    island = F.col("pos") - F.row_number().over(_inside(keys))
    own = df.filter(F.col(mask)).withColumn("_island", island).groupBy(*keys, "_block", "_island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    borders = df.groupBy(*keys, "_block").agg(F.min("pos").alias("_low"), F.max("pos").alias("_high"))
    own = own.join(borders, [*keys, "_block"])
    columns = ["first", "last", "start", "end"]
    touching = (F.col("first") == F.col("_low")) | (F.col("last") == F.col("_high"))
    w = Window.partitionBy(*keys).orderBy("first")
    opens = F.coalesce((F.col("first") != F.lag("last").over(w) + 1).cast("int"), F.lit(1))
    edge = own.filter(touching).select(*keys, *columns).withColumn("_new", opens).withColumn("_run", F.sum("_new").over(w))
    edge = edge.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    return own.filter(~touching).select(*keys, *columns).unionByName(edge.select(*keys, *columns)).withColumn("length", F.col("last") - F.col("first"))


def longest_run(df: DataFrame, mask: str, unit: str = "month", keys: list[str] = SERIES) -> DataFrame:
    """The longest run of each series, the first of equals."""
    best = F.max_by(F.struct("first", "last", "start", "end", "length"), F.struct("length", -F.col("first")))
    return runs(df, mask, unit, keys).groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def overlapping(df: DataFrame, size: Column, more: Column, columns: list[str], extra: list[Column], keys: list[str] = SERIES) -> DataFrame:
    """(keys, block, rows, extra): blocks of ``size`` rows of a series and up to ``more`` that follow them, in
    order, as arrays of structs of pos and ``columns``. ``df`` needs pos; ``size`` is at least ``more``."""
    block = F.floor(F.col("pos") / size).cast("long")
    both = F.when((F.col("pos") - block * size < more) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    dealt = df.withColumn("block", F.explode(both))
    rows = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    return dealt.groupBy(*keys, "block").agg(rows.alias("rows"), *extra)
