"""Extremes, top-k, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.views import SERIES


def arg_extreme(df: DataFrame, value: str, high: bool, keys: list[str] = SERIES, order: str = "ts") -> DataFrame:
    """The row of each series where ``value`` is greatest or least, nulls aside, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc() if high else F.col(value).asc(), F.col(order))
    return df.filter(F.col(value).isNotNull()).withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def pool_first(df: DataFrame, metric: str, descending: bool, k: int, keys: list[str] = SERIES, order: str = "day") -> DataFrame:
    """``k`` rows of each key by ``metric``, those in the preferred pool (in_sax) before the others."""
    m = F.col(metric).desc() if descending else F.col(metric).asc()
    w = Window.partitionBy(*keys).orderBy(F.col("in_sax").desc(), m, F.col(order))
    return df.filter(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def min_gap(candidates: Column, gap: Column | int, k: int) -> Column:
    """Greedy choice of ``k`` positions from an array in order of preference, each more than ``gap``
    from those chosen before."""
    far = lambda chosen, p: F.forall(chosen, lambda c: F.abs(c - p) > gap)
    empty = F.array().cast("array<int>")
    return F.aggregate(candidates, empty, lambda s, p: F.when((F.size(s) < k) & far(s, p), F.array_append(s, p)).otherwise(s))


def spaced(df: DataFrame, k: int, gap: int, value: str = "value", keys: list[str] = SERIES) -> DataFrame:
    """(keys, chosen): the greedy choice of ``k`` places by the greatest ``value``, each more than ``gap`` from those
    before, the first of equals; fewer where no more fit. ``df`` needs pos; null values don't count.

    Rows are cut into buckets of ``gap`` + 1 places, of which each holds one chosen place at most. A chosen
    place rules out the best of its own bucket and of the two beside it alone, so while fewer than k are
    chosen, one of the 3k - 2 best buckets still has its best. Rows below the last of these are
    never chosen: what is sorted is (3k - 2)(gap + 1) rows a series at most, however long it is.
    """
    buckets = 3 * k - 2
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.struct(F.col(value).alias("v"), (-F.col("pos")).cast("long").alias("p")).alias("row"), F.floor(F.col("pos") / (gap + 1)).alias("bucket"))
    best = rows.groupBy(*keys, "bucket").agg(F.max("row").alias("best"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("best")))
    tall = best.withColumn("nth", nth).filter(F.col("nth") <= buckets)
    # a series of fewer buckets has no floor
    floor = F.min(F.when(F.col("nth") == buckets, F.col("best"))).over(Window.partitionBy(*keys))
    near = rows.join(tall.select(*keys, "bucket", floor.alias("floor")), [*keys, "bucket"]).filter(F.col("floor").isNull() | (F.col("row") >= F.col("floor")))
    order = F.transform(F.sort_array(F.collect_list("row"), asc=False), lambda r: (-r["p"]).cast("int"))
    return near.groupBy(*keys).agg(order.alias("order")).select(*keys, min_gap(F.col("order"), gap, k).alias("chosen"))


def examples(scores: DataFrame, worst: int = 6, best: int = 2, low: float = 0.5, high: float = 0.7) -> DataFrame:
    """Of each subtask: the worst scores below ``low`` and the best at or above ``high``."""
    up, down = (Window.partitionBy("subtask").orderBy(c, "id") for c in (F.col("score"), F.col("score").desc()))
    ranked = scores.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down))
    bad, good = (F.col("score") < low) & (F.col("up") <= worst), (F.col("score") >= high) & (F.col("down") <= best)
    return ranked.filter(bad | good).withColumn("kind", F.when(bad, "low").otherwise("high")).drop("up", "down")


def one_per_group(df: DataFrame, group: str, answered: Column, seed: int) -> DataFrame:
    """A repeatable pick of one row of each group, from the answered ones if there are any."""
    w = Window.partitionBy(group).orderBy(F.when(answered, 0).otherwise(1), F.xxhash64("id", F.lit(seed)), "id")
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def stride(df: DataFrame, target: int, keys: list[str] = SERIES, order: str = "ts") -> DataFrame:
    """Every floor(n / target)-th row of a series with more than ``target`` rows."""
    w = Window.partitionBy(*keys)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    return df.withColumn("_n", n).withColumn("_i", i).filter(F.col("_i") % step == 0).drop("_n", "_i")


def first_of_subtask(tasks: DataFrame, subtask: str, n: int) -> DataFrame:
    """The first ``n`` tasks of a subtask by id; ids stay those of the whole list."""
    return tasks.filter(F.col("subtask") == subtask).orderBy("id").limit(n)


def pooled(preferred: DataFrame, all_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The preferred rows (pool 0), then all other rows (pool 1)."""
    rest = all_rows.join(preferred.select(*keys).distinct(), keys, "left_anti")
    return preferred.select(*all_rows.columns, F.lit(0).alias("pool")).unionByName(rest.select(*all_rows.columns, F.lit(1).alias("pool")))
