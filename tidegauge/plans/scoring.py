"""Scores of predictions against truth: five metrics, their report parts, and summaries."""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import answers, text

WEIGHTS = {"trend": 0.4, "interval": 0.3, "adjective": 0.2, "outlier": 0.1}
TOLERANCE_HOURS = 4


def seconds(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / 1e6


def rel_acc(p: Column, g: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(p - g) / (F.abs(g) + 1e-9)), F.lit(0.0))


def hit(p: Column, g: Column, delta_seconds: float = 0.0) -> Column:
    return F.when(F.abs(seconds(p) - seconds(g)) <= delta_seconds, 1.0).otherwise(0.0)


def overlap(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Seconds that [a, b] and [c, d] share, and that they cover together."""
    inter = F.greatest(F.lit(0.0), F.least(seconds(b), seconds(d)) - F.greatest(seconds(a), seconds(c)))
    return inter, seconds(b) - seconds(a) + seconds(d) - seconds(c) - inter


def iou(a: Column, b: Column, c: Column, d: Column) -> Column:
    inter, union = overlap(a, b, c, d)
    same = (a == c) & (b == d)
    return F.coalesce(F.when(union > 0, inter / union).when(same, 1.0), F.lit(0.0))


def set_f1(p: Column, g: Column) -> Column:
    """F1 of two arrays of distinct dates; two empty ones agree."""
    both = F.size(F.array_intersect(p, g))
    total = F.size(p) + F.size(g)
    return F.when(total == 0, 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2.0 * both / total)


def aligned(g: Column, p: Column) -> Column:
    """Pairs of places (g, p) of equal kinds in order, by longest equal blocks.

    Reports have few segments of few kinds, so equal pairs of arrays are aligned once a batch.
    """
    @F.arrow_udf("array<struct<g:int,p:int>>")
    def align(gk: pa.Array, pk: pa.Array) -> pa.Array:
        # kinds as numbers, so that a row's kinds are a slice of bytes
        codes = pa.concat_arrays([gk.values, pk.values]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
        cut = lambda a, first: [codes[i:j] for i, j in pairwise(((a.offsets.to_numpy() + first) * 4).tolist())]
        places: dict[tuple, int] = {}
        rows = [places.setdefault(key, len(places)) for key in zip(cut(gk, 0), cut(pk, len(gk.values)), strict=True)]
        numbers = lambda key: np.frombuffer(key, np.int32).tolist()
        blocks = [[{"g": m.a + i, "p": m.b + i} for m in SequenceMatcher(None, numbers(a), numbers(b)).get_matching_blocks() for i in range(m.size)] for a, b in places]
        return pa.array(blocks, pa.list_(pa.struct([("g", pa.int32()), ("p", pa.int32())]))).take(pa.array(rows, pa.int32()))

    kinds = lambda c: F.transform(c, lambda x: x["kind"])
    return align(kinds(g), kinds(p))


def report_parts(df: DataFrame, prediction: str, truth: str) -> DataFrame:
    """``df`` with breakdown: overall, trend, interval, adjective and outlier scores."""
    ps, po = text.parse_report(F.replace(F.col(prediction), F.lit("\n"), F.lit(" ")))
    gs, go = answers.read_report_truth(F.col(truth))
    df = df.withColumns({"_ps": ps, "_gs": gs, "_po": po, "_go": go}).withColumn("_m", aligned(F.col("_gs"), F.col("_ps")))
    hits, total = F.size("_m"), F.size("_gs") + F.size("_ps")

    def pair_iou(m: Column) -> Column:
        pair = F.struct(F.get("_gs", m["g"]).alias("g"), F.get("_ps", m["p"]).alias("p"))
        both = text.bound(pair, lambda x: F.struct(*(c.alias(n) for n, c in zip(("inter", "union"), overlap(x["g"]["start"], x["g"]["end"], x["p"]["start"], x["p"]["end"]), strict=True))))
        return text.bound(both, lambda x: F.when(x["union"] > 0, x["inter"] / x["union"]).otherwise(0.0))

    mean = lambda f: F.when(hits > 0, F.aggregate(F.transform("_m", f), F.lit(0.0), lambda s, x: s + x) / hits).otherwise(0.0)
    adj = mean(lambda m: F.when(F.get("_gs", m["g"])["adj"] == F.get("_ps", m["p"])["adj"], 1.0).otherwise(0.0))
    # each predicted time takes the first true one within reach that is still free
    free = F.transform("_go", lambda t: seconds(t))
    start = F.struct(free.alias("left"), F.lit(0).alias("n"))

    def take(s: Column, t: Column) -> Column:
        near = F.array_position(F.transform(s["left"], lambda g: F.abs(g - seconds(t)) <= TOLERANCE_HOURS * 3600), True).cast("int")
        rest = lambda k: F.filter(s["left"], lambda _, i: i != k - 1)
        return text.bound(near, lambda k: F.when(k > 0, F.struct(rest(k).alias("left"), (s["n"] + 1).alias("n"))).otherwise(s))

    tp = F.aggregate("_po", start, take)["n"]
    n_out = F.size("_po") + F.size("_go")
    outlier = F.when(n_out == 0, 1.0).when((F.size("_po") == 0) | (F.size("_go") == 0), 0.0).otherwise(2.0 * tp / n_out)
    df = df.withColumns({"_t": F.when(total == 0, 1.0).otherwise(2.0 * hits / total), "_i": mean(pair_iou), "_a": adj, "_o": outlier})
    overall = sum((w * F.col(f"_{k[0]}") for k, w in WEIGHTS.items()), F.lit(0.0))
    out = df.withColumn("breakdown", F.struct(overall.alias("overall"), F.col("_t").alias("trend"), F.col("_i").alias("interval"), F.col("_a").alias("adjective"), F.col("_o").alias("outlier")))
    return out.drop("_ps", "_gs", "_po", "_go", "_m", "_t", "_i", "_a", "_o")


def score(df: DataFrame) -> DataFrame:
    """``df`` (eval_metric, prediction, ground_truth and more) with score and breakdown.

    What can't be parsed, and an unknown metric, scores 0.
    """
    p, g = F.col("prediction"), F.col("ground_truth")
    # each text is parsed once, as its metric asks; the scores then name what was found as often as they like
    of = lambda m, f: F.when(F.col("eval_metric") == m, F.struct(f(p).alias("p"), f(g).alias("g")))
    found = {"_rel_acc": of("rel_acc", text.parse_float), "_hit": of("hit", text.parse_timestamp), "_iou": of("iou", text.interval), "_set_f1": of("set_f1", text.parse_date_set)}
    pair = lambda n: (F.col(f"{n}.p"), F.col(f"{n}.g"))
    ends = [c[e] for c in pair("_iou") for e in ("start", "end")]
    plain = F.when(F.col("eval_metric") == "rel_acc", rel_acc(*pair("_rel_acc"))).when(F.col("eval_metric") == "hit", hit(*pair("_hit"))).when(F.col("eval_metric") == "iou", iou(*ends)).when(F.col("eval_metric") == "set_f1", set_f1(*pair("_set_f1")))
    is_report = F.coalesce(F.col("eval_metric") == "report", F.lit(False))
    parts = "struct<overall:double,trend:double,interval:double,adjective:double,outlier:double>"
    # only rows of reports go through their parsers and the alignment
    others = df.filter(~is_report).withColumns(found).withColumns({"score": F.coalesce(plain, F.lit(0.0)), "breakdown": F.lit(None).cast(parts)})
    reports = report_parts(df.filter(is_report), "prediction", "ground_truth")
    reports = reports.withColumns({"score": F.coalesce("breakdown.overall", F.lit(0.0)), "breakdown": F.col("breakdown").cast(parts)})
    columns = [*(c for c in df.columns if c not in ("score", "breakdown")), "score", "breakdown"]
    return others.select(columns).unionByName(reports.select(columns))


def summary(scores: DataFrame, group: str, names: list[str]) -> DataFrame:
    """n and avg of each of ``names`` in their order; 0 and 0 for absent ones."""
    spark = scores.sparkSession
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "place int, name string")
    own = scores.groupBy(F.col(group).cast("string").alias("name")).agg(F.count("*").alias("n"), F.avg("score").alias("avg"))
    return rows.join(own, "name", "left").select("place", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("avg", F.lit(0.0)).alias("avg"))


def grouped(scores: DataFrame) -> DataFrame:
    """n and mean score by subtask, category, level and overall, in one pass."""
    out = scores.groupingSets([["subtask"], ["category"], ["level"], []], "subtask", "category", "level")
    return out.agg(F.count("*").alias("n"), F.avg("score").alias("avg"))


def gain_by_round(rounds: DataFrame, least: float = 0.01) -> DataFrame:
    """(subtask, round, mean, gain, best_round, stop) over (subtask, round, task_id, score)."""
    means = rounds.groupBy("subtask", "round").agg(F.avg("score").alias("mean"))
    w = Window.partitionBy("subtask").orderBy("round")
    best = F.first("round").over(Window.partitionBy("subtask").orderBy(F.col("mean").desc(), "round"))
    out = means.withColumn("gain", F.col("mean") - F.lag("mean").over(w)).withColumn("best_round", best)
    return out.withColumn("stop", F.coalesce(F.col("gain") < least, F.lit(False)))
