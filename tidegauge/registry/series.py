"""Window operators and scalar functions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import views as V
from tidegauge.functions import answers as A2
from tidegauge.functions import sax
from tidegauge.functions import text as T
from tidegauge.operators import aggregates as A
from tidegauge.operators import blocks as L
from tidegauge.operators import windows as W
from tidegauge.registry.basics import CH, TS, WORDS, daily_words, sax_sql

ENTRIES: dict = {}


def add(name: str, f, sql: str | None = None) -> None:
    ENTRIES[name] = (f, sql)


def over(n0: int, n1: int) -> str:
    side = lambda n, word: f"{n} {word}" if n else "CURRENT ROW"
    return f"(PARTITION BY channel_id ORDER BY ts ROWS BETWEEN {side(n0, 'PRECEDING')} AND {side(n1, 'FOLLOWING')})"


def centred_sql(src: str, out: str, stat: str, value: str, n: int, keys: str = "channel_id", digits: int = 9) -> str:
    """``out``: ``src`` with r, the centred statistic with filled edges."""
    part = f"PARTITION BY {keys} ORDER BY ts"
    frame = f"({part} ROWS BETWEEN {n // 2} PRECEDING AND {(n - 1) // 2} FOLLOWING)"
    return f"""{out}_0 AS (SELECT *, CASE WHEN count({value}) OVER {frame} = {n} THEN round({stat}({value}) OVER {frame}, {digits}) END AS r0 FROM {src}),
{out}_1 AS (SELECT *, first_value(r0 IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r1 FROM {out}_0),
{out} AS (SELECT * EXCLUDE (r0, r1), last_value(r1 IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM {out}_1)"""


def longest_sql(src: str, mask: str, out: str = "lr", keys: str = "channel_id") -> str:
    """``out``: the longest run of ``mask`` over ``src`` (keys, pos, ts), the first of equals."""
    return f"""{out}_i AS (SELECT {keys}, pos, ts, pos - row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS g FROM {src} WHERE {mask}),
{out}_r AS (SELECT {keys}, min(pos) AS a, max(pos) AS b, min(ts) AS s, max(ts) AS e FROM {out}_i GROUP BY {keys}, g),
{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY b - a DESC, a) AS nth FROM {out}_r) WHERE nth = 1)"""


POS = "ps AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts) - 1 AS pos FROM hr)"
out = lambda df, *c: df.select(CH, TS, *(F.round(x, 6).alias(x) for x in c))
add("win_trailing", lambda s, d: V.hourly(s, d).withColumn("v", W.trailing(F.avg("value"), "value", 24)).select(CH, TS, F.round("v", 9).alias("v")), V.sql("hr") + f" SELECT channel_id, ts, round(CASE WHEN count(*) OVER w = 24 THEN avg(value) OVER w END, 9) AS v FROM hr WINDOW w AS {over(23, 0)}")
add("win_left_aligned", lambda s, d: out(V.hourly(s, d).withColumn("v", W.leading(F.stddev_samp("value"), "value", 12)), "v"), V.sql("hr") + f" SELECT channel_id, ts, round(CASE WHEN count(*) OVER w = 12 THEN stddev_samp(value) OVER w END, 6) AS v FROM hr WINDOW w AS {over(0, 11)}")
for name, stat, f, n in (("win_centred_mean", "avg", F.avg, 5), ("win_centred_std", "stddev_samp", F.stddev_samp, 4)):
    add(name, lambda s, d, f=f, n=n: out(W.centred(V.hourly(s, d), "v", f, "value", n), "v"), V.sql("hr") + ", " + centred_sql("hr", "c", stat, "value", n, digits=12) + " SELECT channel_id, ts, round(r, 6) AS v FROM c")
add("win_diff1", lambda s, d: out(V.hourly(s, d).withColumn("v", W.difference()), "v"), V.sql("hr") + " SELECT channel_id, ts, round(value - lag(value) OVER (PARTITION BY channel_id ORDER BY ts), 6) AS v FROM hr")
add("win_diff2", lambda s, d: out(V.hourly(s, d).withColumn("a", F.coalesce(W.difference(), F.lit(0.0))).withColumn("v", F.coalesce(F.abs(W.difference("a")), F.lit(0.0))), "v"), V.sql("hr") + ", a AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY channel_id ORDER BY ts), 0) AS a FROM hr) SELECT channel_id, ts, round(coalesce(abs(a - lag(a) OVER (PARTITION BY channel_id ORDER BY ts)), 0), 6) AS v FROM a")
add("win_running_extreme", lambda s, d: L.running_extreme(L.position(V.hourly(s, d), unit="day"), "value", True, "day").select(CH, TS, F.round("move", 6).alias("move")), V.sql("hr") + " SELECT channel_id, ts, round(value - min(value) OVER (PARTITION BY channel_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS move FROM hr")
add("win_longest_run", lambda s, d: L.longest_run(L.position(V.hourly(s, d), unit="day").withColumn("on", F.col("value") > 20), "on", "day").select(CH, "start", "end", F.col("length").cast("long").alias("length")), V.sql("hr") + f", {POS}, " + longest_sql("ps", "value > 20") + ' SELECT channel_id, s AS start, e AS "end", b - a AS length FROM lr')
WALK = (60.0, 40.0, 20.0, 10.0, 1.0)
add("win_threshold_walk", lambda s, d: W.threshold_walk(W.position(V.hourly(s, d)), [F.col("value") > t for t in WALK], F.lit(12)).select(CH, "rank", "start", "end"), V.sql("hr") + f", {POS}, " + f"th AS (SELECT ps.*, t.rank, t.cut FROM ps, (VALUES " + ", ".join(f"({i}, {t})" for i, t in enumerate(WALK)) + ") t(rank, cut)), " + longest_sql("th", "value > cut", keys="channel_id, rank") + ", q AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY rank) AS k FROM lr WHERE b - a >= 12) SELECT channel_id, CAST(rank AS INTEGER) AS rank, s AS start, e AS \"end\" FROM q WHERE k = 1")


def midline_sql(high: bool) -> str:
    agg, order, off = ("max", "DESC", "<") if high else ("min", "ASC", ">")
    return V.sql("hr") + f""", {POS}, pk AS (SELECT channel_id, pos AS peak FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY value {order}, pos) AS r FROM ps) WHERE r = 1),
md AS (SELECT channel_id, ({agg}(value) + median(value)) / 2 AS mid FROM ps GROUP BY 1), j AS (SELECT ps.*, peak, mid FROM ps JOIN pk USING (channel_id) JOIN md USING (channel_id)),
lm AS (SELECT channel_id, max(CASE WHEN value {off} mid AND pos < peak THEN pos END) AS lo, min(CASE WHEN value {off} mid AND pos > peak THEN pos END) AS hi FROM j GROUP BY 1)
SELECT j.channel_id, min(ts) AS start, max(ts) AS "end" FROM j JOIN lm USING (channel_id) WHERE pos > coalesce(lo, -1) AND pos < coalesce(hi, 1e9) GROUP BY 1"""


add("win_midline_walk", lambda s, d: W.midline_walk(L.position(V.hourly(s, d), unit="day"), "value", True).select(CH, "start", "end"), midline_sql(True))
add("win_interpolate", lambda s, d: out(W.interpolated(V.hourly(s, d), "hour"), "value"), V.sql("hr") + ", " + sax_sql("hr", "day", "hour") + " SELECT channel_id, ts, round(value, 6) AS value FROM gi")
add("win_znorm", lambda s, d: V.hourly(s, d).withColumn("m", F.avg("value").over(W.Window.partitionBy(CH))).withColumn("p", F.stddev_pop("value").over(W.Window.partitionBy(CH))).select(CH, TS, F.round((F.col("value") - F.col("m")) / F.col("p"), 6).alias("z")), V.sql("hr") + " SELECT channel_id, ts, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM hr WINDOW w AS (PARTITION BY channel_id)")
add("win_position", lambda s, d: L.position(V.hourly(s, d), unit="day").select(CH, TS, "pos"), V.sql("hr") + f", {POS} SELECT channel_id, ts, pos FROM ps")
add("win_prefix_sums", lambda s, d: L.prefix_sums(V.hourly(s, d), unit="day").select(CH, TS, F.round("sum_y", 5).alias("sum_y"), F.round("sum_yy", 6).alias("sum_yy")), V.sql("hr") + " SELECT channel_id, ts, round(sum(value) OVER w, 5) AS sum_y, round(sum(value * value) OVER w, 6) AS sum_yy FROM hr WINDOW w AS (PARTITION BY channel_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
add("win_relative_rank", lambda s, d: V.daily(s, d).withColumn("label", F.when(F.col("value") >= 0.6 * F.max("value").over(W.Window.partitionBy(CH)), "rapid").otherwise("gradual")).groupBy(CH, "label").agg(F.count("*").alias("n")), V.sql("dy") + ", x AS (SELECT channel_id, CASE WHEN value >= 0.6 * max(value) OVER (PARTITION BY channel_id) THEN 'rapid' ELSE 'gradual' END AS label FROM dy) SELECT channel_id, label, count(*) AS n FROM x GROUP BY 1, 2")
add("win_segment_zscore", lambda s, d: V.hourly(s, d).withColumn("seg", F.floor(F.dayofmonth(TS) / 8).cast("int")).withColumn("m", F.avg("value").over(W.Window.partitionBy(CH, "seg"))).withColumn("p", F.stddev_pop("value").over(W.Window.partitionBy(CH, "seg"))).select(CH, TS, "seg", F.round((F.col("value") - F.col("m")) / F.col("p"), 6).alias("z")), V.sql("hr") + ", x AS (SELECT *, CAST(day(ts) // 8 AS INTEGER) AS seg FROM hr) SELECT channel_id, ts, seg, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM x WINDOW w AS (PARTITION BY channel_id, seg)")

# scalar functions
part = lambda s, d: V.table(s, d, "part")
orders = lambda s, d: V.table(s, d, "orders")
STAMP = "strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
stamp = lambda: T.fmt_timestamp(F.col("o_orderdate"))
B = sax.breakpoints()
def below(s, d):
    """How many standard scores of each channel lie at or under each breakpoint."""
    w = W.Window.partitionBy(CH)
    z = V.hourly(s, d).withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w))
    return z.groupBy(CH).agg(*(F.count_if(F.col("z") <= b).alias(f"b{i}") for i, b in enumerate(B)))


add("fn_sax_breakpoints", below, V.sql("hr") + ", z AS (SELECT channel_id, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM hr WINDOW w AS (PARTITION BY channel_id)) SELECT channel_id, count(*) FILTER (z <= -0.8416212335729143) AS b0, count(*) FILTER (z <= -0.2533471031357997) AS b1, count(*) FILTER (z <= 0.2533471031357997) AS b2, count(*) FILTER (z <= 0.8416212335729143) AS b3 FROM z GROUP BY 1")
add("fn_sax_letter", lambda s, d: V.hourly(s, d).withColumn("m", F.avg("value").over(W.Window.partitionBy(CH))).withColumn("p", F.stddev_pop("value").over(W.Window.partitionBy(CH))).select(CH, TS, sax.letter(F.col("value"), F.col("m"), F.col("p")).alias("letter")), V.sql("hr") + ", z AS (SELECT channel_id, ts, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM hr WINDOW w AS (PARTITION BY channel_id)) SELECT channel_id, ts, CASE WHEN z > 0.8416212335729143 THEN 'e' WHEN z > 0.2533471031357997 THEN 'd' WHEN z > -0.2533471031357997 THEN 'c' WHEN z > -0.8416212335729143 THEN 'b' ELSE 'a' END AS letter FROM z")
kinds = lambda: F.when(F.col("p_size") % 3 == 0, F.array(F.lit("rise"), F.lit("fall"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("stable"))).otherwise(F.array(F.lit("fall"), F.lit("stable"), F.lit("rise")))
add("fn_kind_regex", lambda s, d: part(s, d).select("p_partkey", sax.kind_pattern(kinds()).alias("pattern")), r"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '[ab]+.*[de]+.*[de]+.*[ab]+' WHEN 1 THEN '(.)\1{3,}' ELSE '[de]+.*[ab]+.*(.)\1{3,}.*[ab]+.*[de]+' END AS pattern FROM part")
shape = lambda: F.element_at(F.array(*map(F.lit, sax.SHAPES)), F.col("p_partkey").cast("int") % 6 + 1)
add("fn_shape_regex", lambda s, d: part(s, d).select("p_partkey", sax.shape_pattern(shape()).alias("pattern")), "SELECT p_partkey, CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(sax.SHAPES.values())) + " END AS pattern FROM part")
question = lambda: F.concat(F.lit("Days with a "), F.when(F.col("p_size") % 2 == 0, "rapid rise, then slow fall").otherwise("steady stable, then rapid rise"), F.lit(" then gentle fall"))
QUESTION = "'Days with a ' || CASE WHEN p_size % 2 = 0 THEN 'rapid rise, then slow fall' ELSE 'steady stable, then rapid rise' END || ' then gentle fall'"
add("fn_parse_pattern", lambda s, d: part(s, d).select("p_partkey", F.array_join(T.trend_kinds(question()), ">").alias("kinds")), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'rise>fall>fall' ELSE 'stable>rise>fall' END AS kinds FROM part")
target = lambda: F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("such that the slow fall segment is the "), F.split("p_name", " ")[0])).otherwise(F.col("p_name"))
add("fn_parse_target", lambda s, d: part(s, d).select("p_partkey", T.trend_target(target()).alias("t")).select("p_partkey", "t.*"), "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'slow' ELSE 'rapid' END AS adj, CASE WHEN p_size % 3 = 0 THEN 'fall' ELSE 'rise' END AS kind, CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE 'fastest' END AS superlative FROM part")
sup = lambda: F.element_at(F.array(*map(F.lit, ["fastest", "slowest", "steepest", "calmest"])), F.col("p_partkey").cast("int") % 4 + 1)
add("fn_superlative_dir", lambda s, d: part(s, d).select("p_partkey", T.descending(sup(), F.when(F.col("p_size") % 2 == 0, "stable").otherwise("rise"), F.when(F.col("p_size") % 4 == 0, "steady").otherwise("rapid")).alias("descending")), "SELECT p_partkey, p_partkey % 4 IN (0, 2) AND NOT (p_size % 4 = 0) AS descending FROM part")
words = lambda: F.element_at(F.array(*map(F.lit, ["a flood", "a drought and a dip", "nothing", "wet, dry, low water"])), F.col("p_partkey").cast("int") % 4 + 1)
add("fn_direction_words", lambda s, d: part(s, d).select("p_partkey", T.direction(words()).alias("sign")), "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 2) THEN 1 ELSE -1 END AS sign FROM part")
add("fn_anomaly_mode", lambda s, d: part(s, d).select("p_partkey", T.anomaly_mode(F.when(F.col("p_size") % 2 == 0, "stays Flat").otherwise("moves")).alias("mode")), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'flat' ELSE 'inverse' END AS mode FROM part")
ask = lambda: F.concat(F.lit("between "), stamp(), F.lit(" and "), stamp(), F.lit(" of the month"))
add("fn_question_times", lambda s, d: orders(s, d).select("o_orderkey", F.array_join(T.question_times(ask()), "|").alias("times"), T.question_month(ask()).alias("month")), f"SELECT o_orderkey, {STAMP} || '|' || {STAMP} AS times, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS month FROM orders")
add("fn_parse_float", lambda s, d: orders(s, d).select("o_orderkey", T.parse_float(F.concat(F.lit("about 17, so "), F.format_string("%.2f", "o_totalprice"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(" in 2020-09-11")).otherwise(" units"))).alias("x")), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -11.0 ELSE round(o_totalprice, 2) END AS x FROM orders")
add("fn_parse_timestamp", lambda s, d: orders(s, d).select("o_orderkey", T.parse_timestamp(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("'"), F.replace(stamp(), F.lit(" "), F.lit("T")), F.lit("Z'"))).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("never")).alias("t")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS TIMESTAMP) END AS t FROM orders")
later = lambda: T.fmt_timestamp(F.col("o_orderdate") + F.expr("interval 36 hours"))
spoken = lambda: F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("["), later(), F.lit(", "), stamp(), F.lit("]"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("from "), stamp())).otherwise(F.concat(F.lit("["), stamp(), F.lit(", "), later(), F.lit("]")))
add("fn_parse_interval", lambda s, d: orders(s, d).select("o_orderkey", T.parse_interval(spoken())[0].alias("a"), T.parse_interval(spoken())[1].alias("b")), "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN CAST(o_orderdate AS TIMESTAMP) END AS a, CASE WHEN o_orderkey % 4 <> 1 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 36 HOUR END AS b FROM orders")
dates = lambda: F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("2001-01-01"), F.date_format("o_orderdate", "yyyy-MM-dd"))
add("fn_parse_date_set", lambda s, d: orders(s, d).select("o_orderkey", F.array_join(T.parse_date_set(T.fmt_date_set(dates())), ",").alias("days")), "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) = DATE '2001-01-01' THEN '2001-01-01' ELSE strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') || ',2001-01-01' END AS days FROM orders")
seg = lambda: F.array(F.struct(F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 36 hours")).alias("end"), F.lit("rapid").alias("adj"), F.lit("rise").alias("kind")))
spikes = lambda: F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("value"))))
REPORT = f"""'1. Trend Segmentation: from ' || {STAMP} || ' to ' || strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') || ', the trend showed a rapid rise.' || chr(10) || '2. Outlier Audit: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'A significant spike was detected at ' || {STAMP} || ' (value: ' || printf('%.2f', o_totalprice) || ').' ELSE 'None.' END"""
aliased = lambda: F.to_json(F.struct(F.array(F.struct(spans()[0].alias("start"), spans()[1].alias("end"), F.lit("Rapid").alias("adjective"), F.lit("rise").alias("type"))).alias("segments"), F.when(key(2) == 0, F.array(F.struct(spans()[0].alias("at"), F.col("o_totalprice").alias("value")))).alias("anomalies")))
add("fn_fmt_report", lambda s, d: orders(s, d).select("o_orderkey", F.when(key(3) == 0, A2.report_text(aliased())).otherwise(T.fmt_report(seg(), spikes())).alias("report")), f"SELECT o_orderkey, {REPORT} AS report FROM orders")
parsed = lambda: T.parse_report(F.col("r"))
add("fn_parse_report", lambda s, d: orders(s, d).select("o_orderkey", T.fmt_report(seg(), spikes()).alias("r")).select("o_orderkey", parsed()[0][0]["start"].alias("start"), parsed()[0][0]["end"].alias("end"), parsed()[0][0]["kind"].alias("kind"), F.get(parsed()[1], F.lit(0)).alias("outlier")), "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS start, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 36 HOUR AS \"end\", 'rise' AS kind, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS outlier FROM orders")
key = lambda n: F.col("o_orderkey") % n
SHOWN = "strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d')"
read_metric = lambda: F.element_at(F.array(*map(F.lit, ["rel_acc", "hit", "iou", "set_f1"])), key(4).cast("int") + 1)
# a number after a number, a time inside words, an interval that ends on a date, dates
said = lambda: F.when(key(4) == 0, F.concat(F.lit("3 of "), F.col("o_custkey").cast("string"))).when(key(4) == 1, F.concat(F.lit("at "), stamp(), F.lit(" or so"))).when(key(4) == 2, F.concat(F.lit("["), stamp(), F.lit(", "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("]"))).otherwise(T.fmt_date_set(dates()))
add("fn_parse_viz", lambda s, d: orders(s, d).select("o_orderkey", A2.read_prediction(read_metric(), said()).alias("r")).select("o_orderkey", "r.number", "r.time", "r.start", "r.end", F.array_join("r.dates", "|").alias("dates")), f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS DOUBLE) END AS number, CASE WHEN o_orderkey % 4 = 1 THEN {STAMP} END AS time, CASE WHEN o_orderkey % 4 = 2 THEN {STAMP} END AS start, CASE WHEN o_orderkey % 4 = 2 THEN {SHOWN} END AS \"end\", CASE WHEN o_orderkey % 4 = 3 THEN {SHOWN} || '|2001-01-01|' || {SHOWN} END AS dates FROM orders")
quarter = lambda: (F.col("o_totalprice") / 4).cast("string")
boxed = lambda: F.when(key(4) == 0, quarter()).when(key(4) == 1, F.concat(F.lit("["), quarter(), F.lit("]"))).when(key(4) == 2, F.when(key(8) == 2, "true").otherwise("false")).otherwise(F.col("o_custkey").cast("string"))
add("fn_fmt_scalar", lambda s, d: orders(s, d).select("o_orderkey", A2.scalar_text(boxed()).alias("x")), "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN regexp_replace(regexp_replace(printf('%.6f', o_totalprice / 4), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') WHEN o_orderkey % 4 = 3 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 8 = 2 THEN '1' ELSE '0' END AS x FROM orders")
add("fn_fmt_timestamp", lambda s, d: orders(s, d).select("o_orderkey", stamp().alias("t")), f"SELECT o_orderkey, {STAMP} AS t FROM orders")
iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
spans = lambda: (iso("o_orderdate"), iso(F.col("o_orderdate") + F.expr("interval 36 hours")))
named = lambda a, b: F.to_json(F.struct(spans()[0].alias(a), spans()[1].alias(b)))
add("fn_fmt_interval", lambda s, d: orders(s, d).select("o_orderkey", F.when(key(4) == 0, A2.interval_text(F.to_json(F.array(*spans())))).when(key(4) == 1, A2.interval_text(named("begin", "stop"))).when(key(4) == 2, A2.interval_text(named("from", "to"))).otherwise(T.fmt_interval(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 36 hours"))).alias("i")), f"SELECT o_orderkey, '[' || {STAMP} || ', ' || strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') || ']' AS i FROM orders")
add("fn_fmt_date_set", lambda s, d: orders(s, d).select("o_orderkey", T.fmt_date_set(F.when(F.col("o_orderkey") % 2 == 0, F.slice(dates(), 1, 2))).alias("t")), "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '[''' || strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') || ''', ''2001-01-01'']' ELSE '[]' END AS t FROM orders")
metric = lambda: F.element_at(F.array(*map(F.lit, ["rel_acc", "hit", "iou", "none"])), F.col("o_orderkey").cast("int") % 4 + 1)
add("fn_fmt_dispatch", lambda s, d: orders(s, d).select("o_orderkey", T.fmt_answer(metric(), F.lit(2.5), F.col("o_orderdate"), F.col("o_orderdate"), F.col("o_orderdate"), F.array().cast("array<string>"), F.lit("r")).alias("t")), f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2.5' WHEN 1 THEN {STAMP} WHEN 2 THEN '[' || {STAMP} || ', ' || {STAMP} || ']' ELSE '' END AS t FROM orders")
# an answer in the shape of each metric; the upper half of the keys gets that of the next metric
five = lambda: F.element_at(F.array(*map(F.lit, A2.SHAPES)), key(5).cast("int") + 1)
quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
forms = lambda: F.array(quarter(), quoted(stamp()), F.to_json(F.array(*spans())), F.to_json(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.date_format(F.date_add("o_orderdate", i), "yyyy-MM-dd"))), F.to_json(F.struct(F.array().alias("trend_segments"))))
given = lambda: F.get(forms(), ((key(5) + F.when(key(2) == 0, 0).otherwise(1)) % 5).cast("int"))
add("fn_validate_result", lambda s, d: orders(s, d).select("o_orderkey", A2.shape_problem(A2.shape_of(five()), given()).alias("problem"), T.result_status(metric(), F.when(key(8) == 0, "12.5").when(key(8) == 1, stamp()).when(key(8) == 2, T.fmt_interval(F.col("o_orderdate"), F.col("o_orderdate"))).otherwise("?")).alias("status")).select("o_orderkey", "status", F.regexp_replace("problem", ":.*$", "").alias("problem")), "SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1, 2) THEN 'ok' ELSE 'shape_mismatch' END AS status, CASE WHEN o_orderkey % 5 = 3 AND o_orderkey % 2 = 0 THEN 'more dates than 50' WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'a number is needed, not text' WHEN o_orderkey % 5 = 1 THEN 'a time is needed, not list' WHEN o_orderkey % 5 = 2 THEN 'a list of two times is needed, not list' WHEN o_orderkey % 5 = 3 THEN 'a list of dates is needed, not object' ELSE 'a report with trend_segments, or a text, is needed, not number' END AS problem FROM orders")
add("fn_window_end", lambda s, d: daily_words(s, d).select(CH, "window_start", "window_end"), WORDS + " SELECT channel_id, window_start, window_start + INTERVAL 1 DAY AS window_end FROM ft")
add("fn_calendar_floor", lambda s, d: V.events(s, d).select(CH, TS, *(F.date_trunc(u, TS).cast("timestamp_ntz").alias(u) for u in ("year", "month", "day", "hour"))), V.sql("ev") + " SELECT channel_id, ts, CAST(date_trunc('year', ts) AS TIMESTAMP) AS year, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM ev")
add("fn_samples_per", lambda s, d: A.median_step(V.daily(s, d)).select(CH, A.samples_per(86400 * 2.5, F.col("step"), 2).alias("n")), V.sql("dy") + " SELECT DISTINCT channel_id, CAST(2 AS INTEGER) AS n FROM dy")
add("udf_regexp", lambda s, d: daily_words(s, d).select(CH, "window_start", F.expr("sax regexp '[ab]{3,}'").alias("hit")), WORDS + " SELECT channel_id, window_start, regexp_matches(sax, '[ab]{3,}') AS hit FROM ft")
add("udf_regexp_like", lambda s, d: daily_words(s, d).select(CH, "window_start", F.regexp_like("sax", F.lit("[de]+.*[ab]+")).alias("hit")), WORDS + " SELECT channel_id, window_start, regexp_matches(sax, '[de]+.*[ab]+') AS hit FROM ft")
