"""Scoring over tasks and predictions derived from the supplied tables.

Every order is a task: the truth is an answer made from it, the prediction is the truth altered by a
fixed rule of its key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import views as V
from tidegauge.functions import text as T
from tidegauge.operators import topk as K
from tidegauge.plans import scoring as C
from tidegauge.sources import files as S

ENTRIES: dict = {}
METRICS = ["rel_acc", "hit", "iou", "set_f1"]
SUBTASKS = ["Global Aggregation", "Temporal Localization", "Sliding Window", "Composite Trend"]


def add(name: str, f, sql: str | None = None) -> None:
    ENTRIES[name] = (f, sql)


def pick(items: list[str]):
    return F.element_at(F.array(*map(F.lit, items)), F.col("o_orderkey").cast("int") % len(items) + 1)


def orders(s, d):
    """Orders dealt over all cores, as each makes texts that are parsed and scored."""
    return V.spread(V.table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"), "o_orderkey", "o_orderdate")


def tasks(s, d):
    o = orders(s, d)
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    shift = lambda h: t + F.expr(f"interval {h} hours")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    truth = F.when(k % 4 == 0, T.fmt_scalar(F.col("o_totalprice"))).when(k % 4 == 1, T.fmt_timestamp(t)).when(k % 4 == 2, T.fmt_interval(t, shift(48))).otherwise(T.fmt_date_set(F.array(day, F.lit("2030-01-01"))))
    answer = F.when(k % 4 == 0, T.fmt_scalar(F.col("o_totalprice") * 0.75)).when(k % 4 == 1, T.fmt_timestamp(F.when(k % 8 == 1, t).otherwise(shift(1)))).when(k % 4 == 2, T.fmt_interval(shift(60), shift(24))).otherwise(T.fmt_date_set(F.array(day, F.lit("2031-01-01"), day)))
    return o.select(k.alias("id"), (k % 4 + 1).cast("int").alias("level"), F.col("o_orderpriority").alias("category"), pick(SUBTASKS).alias("subtask"), pick(METRICS).alias("eval_metric"), truth.alias("ground_truth"), F.when(k % 9 == 0, "").otherwise(answer).alias("prediction"))


#: The score of each task: an interval [t+24h, t+60h] against [t, t+48h] shares 24 of 60 hours.
SCORES = "sc AS (SELECT o_orderkey AS id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS level, o_orderpriority AS category, CASE o_orderkey % 4 WHEN 0 THEN 'Global Aggregation' WHEN 1 THEN 'Temporal Localization' WHEN 2 THEN 'Sliding Window' ELSE 'Composite Trend' END AS subtask, CASE WHEN o_orderkey % 9 = 0 THEN 0.0 WHEN o_orderkey % 4 = 0 THEN greatest(0, 1 - abs(o_totalprice * 0.75 - o_totalprice) / (abs(o_totalprice) + 1e-9)) WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 8 = 1 THEN 1.0 ELSE 0.0 END WHEN o_orderkey % 4 = 2 THEN 0.4 ELSE 0.5 END AS score FROM orders)"
scored = lambda s, d: C.score(tasks(s, d))
for name, i in (("score_rel_acc", 0), ("score_hit", 1), ("score_iou", 2), ("score_set_f1", 3)):
    add(name, lambda s, d, i=i: scored(s, d).filter(F.col("eval_metric") == METRICS[i]).select("id", F.round("score", 6).alias("score")), f"WITH {SCORES} SELECT id, round(score, 6) AS score FROM sc WHERE id % 4 = {i}")
add("score_tasks", lambda s, d: scored(s, d).select("id", "subtask", F.round("score", 6).alias("score")), f"WITH {SCORES} SELECT id, subtask, round(score, 6) AS score FROM sc")
add("agg_scores", lambda s, d: C.grouped(scored(s, d)).select("subtask", "category", "level", "n", F.round("avg", 6).alias("avg")), f"WITH {SCORES} SELECT subtask, category, level, count(*) AS n, round(avg(score), 6) AS avg FROM sc GROUP BY GROUPING SETS ((subtask), (category), (level), ())")
NAMES = ["Global Aggregation", "Periodicity Detection", "Temporal Localization"]
add("score_summary", lambda s, d: C.summary(scored(s, d), "subtask", NAMES).select("place", "name", "n", F.round("avg", 6).alias("avg")), f"WITH {SCORES} SELECT CAST(p.place AS INTEGER) AS place, p.name, count(sc.id) AS n, round(coalesce(avg(score), 0), 6) AS avg FROM (VALUES (0, 'Global Aggregation'), (1, 'Periodicity Detection'), (2, 'Temporal Localization')) p(place, name) LEFT JOIN sc ON sc.subtask = p.name GROUP BY 1, 2")
add("top_examples", lambda s, d: K.examples(scored(s, d).withColumn("score", F.round("score", 9))).select("id", "subtask", "kind", F.round("score", 6).alias("score")), f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY subtask ORDER BY round(score, 9), id) AS u, row_number() OVER (PARTITION BY subtask ORDER BY round(score, 9) DESC, id) AS w FROM sc) SELECT id, subtask, CASE WHEN score < 0.5 AND u <= 6 THEN 'low' ELSE 'high' END AS kind, round(score, 6) AS score FROM r WHERE (score < 0.5 AND u <= 6) OR (score >= 0.7 AND w <= 2)")
rounds = lambda s, d: V.table(s, d, "lineitem").select(F.col("l_returnflag").alias("subtask"), F.col("l_linenumber").alias("round"), F.col("l_orderkey").alias("task_id"), (F.col("l_discount") * 10).alias("score"))
add("score_gain_by_round", lambda s, d: C.gain_by_round(rounds(s, d)).select("subtask", "round", F.round("mean", 8).alias("mean"), F.round("gain", 8).alias("gain"), "best_round", "stop"), "WITH m AS (SELECT l_returnflag AS subtask, l_linenumber AS round, avg(l_discount * 10) AS mean FROM lineitem GROUP BY 1, 2), g AS (SELECT *, mean - lag(mean) OVER (PARTITION BY subtask ORDER BY round) AS gain, first_value(round) OVER (PARTITION BY subtask ORDER BY mean DESC, round) AS best_round FROM m) SELECT subtask, round, round(mean, 8) AS mean, round(gain, 8) AS gain, best_round, coalesce(gain < 0.01, false) AS stop FROM g")


def reports(s, d):
    o = orders(s, d)
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    at = lambda h: t + F.expr(f"interval {h} hours")
    seg = lambda a, b, adj, kind: F.struct(at(a).alias("start"), at(b).alias("end"), F.lit(adj).alias("adj"), F.lit(kind).alias("kind"))
    truth = F.array(seg(0, 100, "rapid", "rise"), seg(100, 200, "steady", "stable"), seg(200, 300, "gradual", "fall"))
    guess = F.when(k % 3 == 0, truth).when(k % 3 == 1, F.array(seg(0, 80, "gradual", "rise"), seg(80, 300, "gradual", "fall"))).otherwise(F.slice(truth, 2, 1))
    spike = lambda h: F.array(F.struct(at(h).alias("timestamp"), F.lit(1.5).alias("value")))
    none = F.array().cast("array<struct<timestamp:timestamp_ntz,value:double>>")
    p = T.fmt_report(guess, F.when(k % 5 == 0, none).when(k % 5 == 1, spike(60)).otherwise(spike(53)))
    return o.select(k.alias("id"), T.fmt_report(truth, spike(50)).alias("ground_truth"), p.alias("prediction"))


# the guesses are whole, two segments without the middle one, or the middle one alone
REPORTS = """rp AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.5 END AS trend,
CASE o_orderkey % 3 WHEN 1 THEN (80.0 / 100 + 100.0 / 220) / 2 ELSE 1.0 END AS interval_, CASE o_orderkey % 3 WHEN 1 THEN 0.5 ELSE 1.0 END AS adjective, CASE WHEN o_orderkey % 5 < 2 THEN 0.0 ELSE 1.0 END AS outlier FROM orders)"""
report = lambda s, d: C.report_parts(reports(s, d), "prediction", "ground_truth")
for name, column in (("trend", "trend"), ("interval", "interval_"), ("adjective", "adjective"), ("outlier", "outlier")):
    add(f"score_report_{name}", lambda s, d, name=name: report(s, d).select("id", F.round(f"breakdown.{name}", 6).alias("score")), f"WITH {REPORTS} SELECT id, round(CAST({column} AS DOUBLE), 6) AS score FROM rp")
add("score_report", lambda s, d: report(s, d).select("id", F.round("breakdown.overall", 6).alias("score")), f"WITH {REPORTS} SELECT id, round(CAST(0.4 * trend + 0.3 * interval_ + 0.2 * adjective + 0.1 * outlier AS DOUBLE), 6) AS score FROM rp")
kinds = lambda c: T.parse_report(F.replace(F.col(c), F.lit("\n"), F.lit(" ")))[0]
# a plain explode puts a filter on the arrays first, and so aligns twice
add("join_segment_align", lambda s, d: reports(s, d).select("id", C.aligned(kinds("ground_truth"), kinds("prediction")).alias("m")).select("id", F.explode_outer("m").alias("m")).filter("m is not null").select("id", "m.g", "m.p"), "SELECT o_orderkey AS id, CAST(g AS INTEGER) AS g, CAST(p AS INTEGER) AS p FROM orders JOIN (VALUES (0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0), (1, 2, 1), (2, 1, 0)) v(k, g, p) ON o_orderkey % 3 = k")


def stored(s, d):
    at = V.scratch(s, "scores")
    S.write_json(scored(s, d).select("id", "subtask", "score"), at)
    return s.read.schema("id long, subtask string, score double").json(at).groupBy("subtask").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg"))


add("sink_scores", stored, f"WITH {SCORES} SELECT subtask, count(*) AS n, round(avg(score), 6) AS avg FROM sc GROUP BY 1")
