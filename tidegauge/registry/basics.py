"""Sources, filters, joins, aggregates, top-k and set operations over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge import views as V
from tidegauge.functions import sax
from tidegauge.operators import aggregates as A
from tidegauge.operators import blocks as L
from tidegauge.operators import joins as J
from tidegauge.operators import quantiles as Q
from tidegauge.operators import topk as K
from tidegauge.operators import windows as W
from tidegauge.plans import features as P
from tidegauge.sources import files as S
from tidegauge.sources import store as B

CH, TS = "channel_id", "ts"
ENTRIES: dict = {}


def add(name: str, f, sql: str | None = None) -> None:
    ENTRIES[name] = (f, sql)


def wide(spark, d) -> DataFrame:
    """Hourly readings as a wide table with text cells, as a CSV file would have them."""
    hr = V.hourly(spark, d).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    kinds = ["click", "error", "login", "purchase", "view"]
    return hr.groupBy("timestamp").pivot("channel_id", kinds).agg(F.first(F.format_string("%.9f", "value")))


def csv_readings(spark, d) -> DataFrame:
    at = V.scratch(spark, "csv")
    wide(spark, d).write.option("header", True).csv(at)
    return S.csv_readings(spark, at)


KINDS_SQL = "channel_id IN ('click', 'error', 'login', 'purchase', 'view')"
add("src_csv_readings", lambda s, d: csv_readings(s, d).agg(F.count("*").alias("n_rows"), F.count("click").alias("n_click"), F.count("error").alias("n_error")), V.sql("hr") + f" SELECT count(DISTINCT ts) AS n_rows, count(*) FILTER (channel_id = 'click') AS n_click, count(*) FILTER (channel_id = 'error') AS n_error FROM hr")
add("src_normalise_ts", lambda s, d: S.normal_times(V.events(s, d).select(CH, "value", F.col(TS).cast("string").alias("timestamp")))[0].select(CH, TS, "value"), V.sql("ev") + " SELECT channel_id, date_trunc('second', ts) AS ts, value FROM ev")
add("src_coerce_numeric", lambda s, d: V.table(s, d, "events").select("event_id", S.numeric(F.when(F.col("event_id") % 7 == 0, "bad").when(F.col("event_id") % 7 == 1, "NaN").otherwise(F.col("value").cast("string"))).alias("value")), "SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS value FROM events")
add("src_key_check", lambda s, d: S.key_violations(V.events(s, d).select(CH, F.date_trunc("hour", TS).cast("timestamp_ntz").alias(TS)), [CH, TS]), V.sql("ev") + " SELECT channel_id, date_trunc('hour', ts) AS ts, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) > 1")
add("src_wide_to_long", lambda s, d: S.long_readings(wide(s, d).select(F.lit("t").alias("task_id"), F.col("timestamp").cast("timestamp_ntz").alias(TS), "click", "error", "login", "purchase", "view")).select(CH, TS, F.round("value", 8).alias("value")), V.sql("hr") + f" SELECT channel_id, ts, round(value, 8) AS value FROM hr WHERE {KINDS_SQL}")


def task_file(spark, d) -> str:
    """A task list as one JSON array, with a task for each order priority."""
    at = V.scratch(spark, "tasks")
    rows = V.daily(spark, d).groupBy(CH).agg(F.round(F.max("value"), 2).alias("v")).select(F.struct(F.col(CH).alias("id"), F.lit(1).alias("level"), F.lit("Global Aggregation").alias("subtask"), F.lit("rel_acc").alias("eval_metric"), F.col("v").cast("string").alias("ground_truth")).alias("t"))
    rows.agg(F.to_json(F.array_sort(F.collect_list("t"))).alias("value")).coalesce(1).write.text(at)
    return at


add("src_tasks_json", lambda s, d: S.tasks_json(s, task_file(s, d)).select("id", "task_id", "level", "subtask", "eval_metric"), "SELECT CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS id, o_orderpriority AS task_id, CAST(1 AS INTEGER) AS level, 'Global Aggregation' AS subtask, 'rel_acc' AS eval_metric FROM (SELECT DISTINCT o_orderpriority FROM orders)")


def prediction_rows(spark, d) -> DataFrame:
    c = V.table(spark, d, "customer")
    key = F.col("c_custkey")
    return c.select((key % 50).alias("n"), F.when(key % 11 == 0, "x").otherwise((key % 50).cast("string")).alias("id"), F.col("c_name").alias("prediction"), key.alias("k"))


def predictions(spark, d) -> DataFrame:
    at = V.scratch(spark, "predictions")
    prediction_rows(spark, d).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "id", "prediction"))), lambda x: F.struct(x["id"].alias("id"), x["prediction"].alias("prediction")))).alias("value")).coalesce(1).write.text(at)
    return S.predictions_json(spark, at)


def checkpoint(spark, d) -> DataFrame:
    at = V.scratch(spark, "checkpoint")
    rows = prediction_rows(spark, d).select("k", F.when(F.col("k") % 13 == 0, "").when(F.col("k") % 13 == 1, '{"id": 3, "pred').otherwise(F.to_json(F.struct("id", "prediction"))).alias("value"))
    rows.coalesce(1).sortWithinPartitions("k").select("value").write.text(at)
    return S.jsonl_checkpoint(spark, at)


add("src_predictions_json", predictions, "SELECT CAST(c_custkey % 50 AS BIGINT) AS id, arg_max(c_name, c_custkey) AS prediction FROM customer WHERE c_custkey % 11 <> 0 GROUP BY 1")
add("src_jsonl_checkpoint", checkpoint, "SELECT CAST(c_custkey % 50 AS BIGINT) AS id, arg_max(c_name, c_custkey) AS prediction FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 > 1 GROUP BY 1")


def stored_features(spark, d) -> DataFrame:
    at = V.scratch(spark, "features")
    B.add_features(P.scale(V.hourly(spark, d), "monthly"), at)
    B.add_features(P.scale(V.hourly(spark, d), "daily"), at)
    return B.read_features(spark, at)


add("sink_features", lambda s, d: stored_features(s, d).groupBy("granularity", CH).agg(F.count("*").alias("n"), F.round(F.sum("max_val"), 6).alias("top")), V.sql("hr") + " SELECT 'daily' AS granularity, channel_id, count(*) AS n, round(sum(m), 6) AS top FROM (SELECT channel_id, date_trunc('day', ts) AS w, max(value) AS m FROM hr GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 2 UNION ALL SELECT 'monthly', channel_id, count(*), round(sum(m), 6) FROM (SELECT channel_id, date_trunc('month', ts) AS w, max(value) AS m FROM hr GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 2")
add("sink_predictions_dense", lambda s, d: S.dense_predictions(prediction_rows(s, d).filter("n < 40").groupBy(F.col("n").alias("id")).agg(F.max("prediction").alias("prediction")), 50), "SELECT i.id, coalesce(p.prediction, '') AS prediction FROM (SELECT CAST(range AS BIGINT) AS id FROM range(50)) i LEFT JOIN (SELECT c_custkey % 50 AS id, max(c_name) AS prediction FROM customer WHERE c_custkey % 50 < 40 GROUP BY 1) p ON i.id = p.id")
add("meta_channels", lambda s, d: V.events(s, d).select("task_id", CH).distinct(), V.sql("ev") + " SELECT DISTINCT 'events' AS task_id, channel_id FROM ev")


def counts(spark, d) -> DataFrame:
    V.events(spark, d).createOrReplaceTempView("tg_readings")
    return S.row_counts(spark, ["tg_readings", "tg_absent"])


add("meta_counts", counts, "SELECT 'tg_readings' AS \"table\", count(*) AS n FROM events WHERE value IS NOT NULL UNION ALL SELECT 'tg_absent', 0")
builds = lambda s, d: V.table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "created").when(F.col("o_orderstatus") == "F", "skipped").otherwise("error").alias("status"), F.col("o_orderkey").alias("n"))
add("meta_status_totals", lambda s, d: S.status_totals(builds(s, d)), "SELECT CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'F' THEN 'skipped' ELSE 'error' END AS status, count(*) AS tasks, CAST(sum(o_orderkey) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (1)")


def unbuilt(spark, d) -> DataFrame:
    tasks = V.table(spark, d, "supplier").select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("task_id"), "s_suppkey")
    parts = tasks.select("task_id", "s_suppkey", F.explode(F.array(*map(F.lit, ["daily", "monthly", "yearly"]))).alias("granularity")).filter("not (s_suppkey % 3 = 0 and granularity = 'daily')")
    return P.unbuilt(tasks.select("task_id"), parts)


add("incremental_build", unbuilt, "SELECT 't' || CAST(s_suppkey AS VARCHAR) AS task_id FROM supplier WHERE s_suppkey % 3 = 0")

# filters
RANGE = lambda: (F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-09 12:00:00").cast("timestamp_ntz"))
RANGE_SQL = "ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'"
add("proj_channels", lambda s, d: J.chosen_channels(V.events(s, d), ["click", "error"]).select(CH, TS, "value"), V.sql("ev") + " SELECT channel_id, ts, value FROM ev WHERE channel_id IN ('click', 'error')")
add("flt_closed_range", lambda s, d: V.events(s, d).filter(F.col(TS).between(*RANGE())).select(CH, TS, "value").orderBy(TS), V.sql("ev") + f" SELECT channel_id, ts, value FROM ev WHERE {RANGE_SQL}")
add("flt_halfopen_year", lambda s, d: V.daily(s, d).filter((F.col(TS) >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col(TS) < F.lit("1998-01-01").cast("timestamp_ntz"))).select(CH, TS, "value"), V.sql("dy") + " SELECT channel_id, ts, value FROM dy WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01'")
add("flt_halfopen_month", lambda s, d: V.daily(s, d).filter((F.col(TS) >= F.lit("1997-02-01").cast("timestamp_ntz")) & (F.col(TS) < F.lit("1997-02-01").cast("timestamp_ntz") + F.expr("interval 1 month"))).select(CH, TS, "value"), V.sql("dy") + " SELECT channel_id, ts, value FROM dy WHERE ts >= TIMESTAMP '1997-02-01' AND ts < TIMESTAMP '1997-03-01'")
daily_words = lambda s, d: P.scale(V.hourly(s, d), "daily")
STATS_SQL = "st AS (SELECT channel_id, date_trunc('day', ts) AS window_start, min(value) AS min_val, max(value) AS max_val, avg(value) AS avg_val, stddev_samp(value) AS std_val FROM hr GROUP BY 1, 2 HAVING count(*) > 1)"
B1, B2 = (repr(b) for b in sax.breakpoints()[2:])


def sax_sql(src: str, window: str, bin_: str) -> str:
    """The shape words of ``src`` as common table expressions; the last is sx."""
    return f"""bn AS (SELECT channel_id, date_trunc('{bin_}', ts) AS ts, avg(value) AS value FROM {src} GROUP BY 1, 2),
gr AS (SELECT channel_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 {bin_})) AS ts FROM bn GROUP BY 1),
gp AS (SELECT gr.channel_id, gr.ts, bn.value, row_number() OVER (PARTITION BY gr.channel_id ORDER BY gr.ts) AS pos FROM gr LEFT JOIN bn ON gr.channel_id = bn.channel_id AND gr.ts = bn.ts),
gf AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY channel_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0, min(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY channel_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM gp),
gi AS (SELECT g.channel_id, g.ts, date_trunc('{window}', g.ts) AS window_start, CASE WHEN g.value IS NOT NULL THEN g.value ELSE a.value + (b.value - a.value) / (b.pos - a.pos) * (g.pos - a.pos) END AS value FROM gf g JOIN gp a ON g.channel_id = a.channel_id AND g.p0 = a.pos JOIN gp b ON g.channel_id = b.channel_id AND g.p1 = b.pos),
gz AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM gi WINDOW w AS (PARTITION BY channel_id, window_start)),
gl AS (SELECT *, CASE WHEN s < 1e-9 OR s IS NULL THEN 'c' WHEN (value - m) / s > {B2} THEN 'e' WHEN (value - m) / s > {B1} THEN 'd' WHEN (value - m) / s > -{B1} THEN 'c' WHEN (value - m) / s > -{B2} THEN 'b' ELSE 'a' END AS letter FROM gz),
sx AS (SELECT channel_id, window_start, string_agg(letter, '' ORDER BY ts) AS sax, CAST(count(*) AS INTEGER) AS sax_len FROM gl GROUP BY 1, 2)"""


WORDS = V.sql("hr") + ", " + STATS_SQL + ", " + sax_sql("hr", "day", "hour") + ", ft AS (SELECT st.*, sx.sax, sx.sax_len FROM st JOIN sx ON st.channel_id = sx.channel_id AND st.window_start = sx.window_start)"
add("flt_window_overlap", lambda s, d: daily_words(s, d).filter((F.col("window_start") <= RANGE()[1]) & (F.col("window_end") >= RANGE()[0])).select(CH, "window_start", "sax"), WORDS + " SELECT channel_id, window_start, sax FROM ft WHERE window_start <= TIMESTAMP '2024-01-09 12:00:00' AND window_start + INTERVAL 1 DAY >= TIMESTAMP '2024-01-05'")
add("flt_sax_regexp", lambda s, d: daily_words(s, d).filter(sax.matches(F.col("sax"), F.lit(r"(.)\1{3,}"))).select(CH, "window_start", "sax"), WORDS + " SELECT channel_id, window_start, sax FROM ft WHERE regexp_matches(sax, 'a{4,}|b{4,}|c{4,}|d{4,}|e{4,}')")
add("flt_sax_like", lambda s, d: daily_words(s, d).filter(F.col("sax").like("%aaa%")).select(CH, "window_start", "sax"), WORDS + " SELECT channel_id, window_start, sax FROM ft WHERE sax LIKE '%aaa%'")
add("flt_feature_threshold", lambda s, d: daily_words(s, d).filter((F.round("std_val", 6) > 20) & (F.col("max_val") > 60)).select(CH, "window_start", F.round("std_val", 6).alias("std_val")), WORDS + " SELECT channel_id, window_start, round(std_val, 6) AS std_val FROM ft WHERE round(std_val, 6) > 20 AND max_val > 60")


def fallback(spark, d) -> DataFrame:
    all_ = V.hourly(spark, d).select(CH, F.to_date(TS).alias("day")).distinct()
    hits = all_.filter(F.col(CH).isin("click", "error") & (F.dayofmonth("day") % 9 == 0))
    return J.all_if_none(hits, all_, [CH])


add("flt_search_fallback", fallback, V.sql("hr") + " SELECT DISTINCT channel_id, CAST(ts AS DATE) AS day FROM hr WHERE channel_id NOT IN ('click', 'error') OR day(ts) % 9 = 0")
add("flt_sparse_window", lambda s, d: A.window_stats(V.hourly(s, d), "day").select(CH, "window_start"), V.sql("hr") + " SELECT channel_id, date_trunc('day', ts) AS window_start FROM hr GROUP BY 1, 2 HAVING count(*) > 1")
add("flt_min_samples", lambda s, d: V.hourly(s, d).groupBy(CH, F.to_date(TS).alias("day")).agg(F.count("*").alias("n")).filter("n >= 8"), V.sql("hr") + " SELECT channel_id, CAST(ts AS DATE) AS day, count(*) AS n FROM hr GROUP BY 1, 2 HAVING count(*) >= 8")
add("flt_subtask_limit", lambda s, d: K.first_of_subtask(V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("subtask")), "BUILDING", 10), "SELECT c_custkey AS id, c_mktsegment AS subtask FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 10")


def focus(spark, d) -> DataFrame:
    """Readings round each series' greatest one, taken as an interval of six hours, or of none."""
    peak = K.arg_extreme(V.hourly(spark, d), "value", True).select(*V.SERIES, F.col(TS).alias("start"), F.when(F.length(CH) % 2 == 0, F.col(TS) + F.expr("interval 6 hours")).otherwise(F.col(TS)).alias("end"))
    return J.focused(V.hourly(spark, d), peak).select(CH, TS, F.round("value", 6).alias("value"))


add("flt_focus_window", focus, V.sql("hr") + ", pk AS (SELECT channel_id, ts AS peak FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY value DESC, ts) AS r FROM hr) WHERE r = 1) SELECT hr.channel_id, hr.ts, round(hr.value, 6) AS value FROM hr JOIN pk ON hr.channel_id = pk.channel_id WHERE hr.ts BETWEEN CASE WHEN length(hr.channel_id) % 2 = 0 THEN peak - INTERVAL 12 HOUR ELSE peak - INTERVAL 3 DAY END AND CASE WHEN length(hr.channel_id) % 2 = 0 THEN peak + INTERVAL 18 HOUR ELSE peak + INTERVAL 3 DAY END")

# joins
ranges = lambda s, d: V.events(s, d).groupBy(*V.SERIES).agg(F.min(TS).alias("lo")).select(*V.SERIES, (F.col("lo") + F.expr("interval 2 days")).alias("a"), (F.col("lo") + F.expr("interval 5 days")).alias("b"))
RANGES_SQL = "rg AS (SELECT channel_id, min(ts) + INTERVAL 2 DAY AS a, min(ts) + INTERVAL 5 DAY AS b FROM ev GROUP BY 1)"
add("join_task_readings", lambda s, d: J.task_readings(ranges(s, d), V.events(s, d)).select(CH, TS, "value"), V.sql("ev") + f", {RANGES_SQL} SELECT ev.channel_id, ts, value FROM ev JOIN rg ON ev.channel_id = rg.channel_id WHERE ts BETWEEN a AND b")
add("join_features_sax", lambda s, d: daily_words(s, d).select(CH, "window_start", F.round("avg_val", 6).alias("avg_val"), "sax"), WORDS + " SELECT channel_id, window_start, round(avg_val, 6) AS avg_val, sax FROM ft")
add("join_baseline", lambda s, d: J.with_companion(V.baseline(s, d)).select(CH, TS, "value", "base"), V.sql("dy", "hm") + " SELECT dy.channel_id, ts, value, base FROM dy JOIN hm ON dy.channel_id = hm.channel_id AND strftime(ts, '%m-%d') = hm.d")
add("join_causal_pair", lambda s, d: J.causal_pairs(V.pair(s, d)).select(CH, "year", TS, "up", "down"), V.sql("pr") + " SELECT 'orders' AS channel_id, '1996' AS year, ts, up, down FROM pr")
add("join_sax_flag", lambda s, d: J.flagged(V.hourly(s, d).select(CH, F.to_date(TS).alias("day")).distinct(), daily_words(s, d).filter(F.col("sax").contains("aa")).select(CH, F.to_date("window_start").alias("day")), [CH, "day"]), WORDS + ", dd AS (SELECT DISTINCT channel_id, CAST(ts AS DATE) AS day FROM hr) SELECT dd.channel_id, dd.day, coalesce(ft.sax LIKE '%aa%', false) AS in_sax FROM dd LEFT JOIN ft ON dd.channel_id = ft.channel_id AND dd.day = CAST(ft.window_start AS DATE)")
add("join_lag_self", lambda s, d: A.autocorrelation(V.daily(s, d), F.sequence(F.lit(1), F.lit(8))).select(CH, "lag", F.round("acf", 8).alias("acf")), V.sql("dy") + ", c AS (SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY ts) AS i, value - avg(value) OVER (PARTITION BY channel_id) AS y FROM dy), p AS (SELECT channel_id, sum(y * y) AS s FROM c GROUP BY 1) SELECT a.channel_id, CAST(l.range AS INTEGER) AS lag, round(sum(a.y * b.y) / any_value(p.s), 8) AS acf FROM c a JOIN range(1, 9) l ON true JOIN c b ON a.channel_id = b.channel_id AND b.i = a.i + l.range JOIN p ON a.channel_id = p.channel_id GROUP BY 1, 2")
probes = lambda s, d: V.events(s, d).select(*V.SERIES).distinct().select(*V.SERIES, F.explode(F.sequence(F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), F.expr("interval 17 hours"))).alias("at"))
add("join_nearest_reading", lambda s, d: J.nearest_reading(probes(s, d), V.events(s, d)).select(CH, F.col("at").alias("probe"), TS, "value"), V.sql("ev") + ", pb AS (SELECT channel_id, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-20', INTERVAL 17 HOUR)) AS p FROM (SELECT DISTINCT channel_id FROM ev)), x AS (SELECT pb.channel_id, p, ts, value, row_number() OVER (PARTITION BY pb.channel_id, p ORDER BY abs(epoch_us(ts) - epoch_us(p)), ts) AS r FROM pb JOIN ev ON pb.channel_id = ev.channel_id) SELECT channel_id, p AS probe, ts, value FROM x WHERE r = 1")
task_rows = lambda s, d: V.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("task"))
answers = lambda s, d: task_rows(s, d).filter("id % 3 != 0").select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prediction"))
add("join_pred_truth", lambda s, d: J.with_predictions(task_rows(s, d), answers(s, d)), "SELECT s_suppkey AS id, s_name AS task, CASE WHEN s_suppkey % 3 <> 0 THEN 'p' || CAST(s_suppkey AS VARCHAR) ELSE '' END AS prediction FROM supplier")
add("anti_pending", lambda s, d: J.pending(task_rows(s, d), answers(s, d)), "SELECT s_suppkey AS id, s_name AS task FROM supplier WHERE s_suppkey % 3 = 0")
add("set_except_done", lambda s, d: task_rows(s, d).select("id").exceptAll(answers(s, d).select("id")), "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 0")
add("agg_missing", lambda s, d: J.pending(task_rows(s, d), answers(s, d)).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM supplier WHERE s_suppkey % 3 = 0")

# aggregates
add("agg_global", lambda s, d: A.global_aggregate(V.events(s, d)).select(CH, "min", "max", F.round("avg", 8).alias("avg"), F.round("sum", 4).alias("sum"), "count", F.round("std", 8).alias("std")), V.sql("ev") + " SELECT channel_id, min(value) AS min, max(value) AS max, round(avg(value), 8) AS avg, round(sum(value), 4) AS sum, CAST(count(*) AS DOUBLE) AS count, round(stddev_samp(value), 8) AS std FROM ev GROUP BY 1")
add("agg_window_stats", lambda s, d: P.statistics(P.coarser(P.hours(V.events(s, d)), "day")).select(CH, "window_start", "min_val", "max_val", F.round("avg_val", 8).alias("avg_val"), F.round("std_val", 8).alias("std_val")), V.sql("ev") + " SELECT channel_id, date_trunc('day', ts) AS window_start, min(value) AS min_val, max(value) AS max_val, round(avg(value), 8) AS avg_val, round(stddev_samp(value), 8) AS std_val FROM ev GROUP BY 1, 2 HAVING count(*) > 1")
SLOPE_SQL = "sl AS (SELECT channel_id, window_start, coalesce(regr_slope(value, x), 0) AS slope FROM (SELECT channel_id, value, date_trunc('{u}', ts) AS window_start, (row_number() OVER (PARTITION BY channel_id, date_trunc('{u}', ts) ORDER BY ts) - 1) / CAST(nullif(count(*) OVER (PARTITION BY channel_id, date_trunc('{u}', ts)) - 1, 0) AS DOUBLE) AS x FROM {src}) GROUP BY 1, 2)"
add("agg_slope", lambda s, d: A.slope(V.hourly(s, d), "day").select(CH, "window_start", F.round("slope", 6).alias("slope")), V.sql("hr") + ", " + SLOPE_SQL.format(u="day", src="hr") + " SELECT channel_id, window_start, round(slope, 6) AS slope FROM sl")
add("agg_paa", lambda s, d: V.events(s, d).groupBy(CH, F.date_trunc("hour", TS).cast("timestamp_ntz").alias("bin")).agg(F.round(F.avg("value"), 8).alias("value")), V.sql("ev") + " SELECT channel_id, date_trunc('hour', ts) AS bin, round(avg(value), 8) AS value FROM ev GROUP BY 1, 2")
add("agg_multiscale", lambda s, d: P.build(V.daily(s, d)).groupBy("granularity", CH).agg(F.count("*").alias("n"), F.round(F.sum("max_val"), 2).alias("top")), V.sql("dy") + " " + " UNION ALL ".join(f"SELECT '{g}' AS granularity, channel_id, count(*) AS n, round(sum(m), 2) AS top FROM (SELECT channel_id, max(value) AS m FROM dy GROUP BY 1, date_trunc('{u}', ts) HAVING count(*) > 1) GROUP BY 2" for g, u in (("yearly", "year"), ("monthly", "month"))) + " UNION ALL SELECT 'daily', channel_id, 0, 0.0 FROM dy WHERE false")
add("agg_sax_word", lambda s, d: P.day_words(V.hourly(s, d)).select(CH, "window_start", "sax", "sax_len"), V.sql("hr") + ", " + sax_sql("hr", "day", "hour") + " SELECT channel_id, window_start, sax, sax_len FROM sx")
add("agg_median_step", lambda s, d: Q.quantiles(A.steps(V.events(s, d)), {"step": 0.5}, "gap").select(CH, F.round("step", 6).alias("step")), V.sql("ev") + " SELECT channel_id, round(median(gap), 6) AS step FROM (SELECT channel_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY channel_id ORDER BY ts)) / 1e6 AS gap FROM ev) GROUP BY 1")
add("agg_quantile", lambda s, d: Q.quantiles(V.events(s, d), {"p30": 0.3, "p50": 0.5, "p75": 0.75, "p80": 0.8}).select(CH, *(F.round(n, 8).alias(n) for n in ("p30", "p50", "p75", "p80"))), V.sql("ev") + " SELECT channel_id, " + ", ".join(f"round(quantile_cont(value, {q}), 8) AS {n}" for n, q in (("p30", 0.3), ("p50", 0.5), ("p75", 0.75), ("p80", 0.8))) + " FROM ev GROUP BY 1")
add("agg_std_pop", lambda s, d: V.events(s, d).groupBy(CH).agg(F.round(F.stddev_pop("value"), 8).alias("std")), V.sql("ev") + " SELECT channel_id, round(stddev_pop(value), 8) AS std FROM ev GROUP BY 1")
add("agg_ols", lambda s, d: A.ols(J.causal_pairs(V.pair(s, d)), "down", "up", [CH]).select(CH, F.round("b", 8).alias("b"), F.round("a", 3).alias("a")), V.sql("pr") + " SELECT 'orders' AS channel_id, round(regr_slope(down, up), 8) AS b, round(regr_intercept(down, up), 3) AS a FROM pr")
add("agg_acf", lambda s, d: A.autocorrelation(V.hourly(s, d), F.array(*map(F.lit, (1, 6, 12, 24)))).select(CH, "lag", F.round("acf", 8).alias("acf")), V.sql("hr") + ", c AS (SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY ts) AS i, value - avg(value) OVER (PARTITION BY channel_id) AS y FROM hr), p AS (SELECT channel_id, sum(y * y) AS s FROM c GROUP BY 1) SELECT a.channel_id, CAST(l.lag AS INTEGER) AS lag, round(sum(a.y * b.y) / any_value(p.s), 8) AS acf FROM c a JOIN (VALUES (1), (6), (12), (24)) l(lag) ON true JOIN c b ON a.channel_id = b.channel_id AND b.i = a.i + l.lag JOIN p ON a.channel_id = p.channel_id GROUP BY 1, 2")
add("agg_dft", lambda s, d: A.spectrum(V.daily(s, d), F.sequence(F.lit(3), F.lit(9))).select(CH, "k", F.round("magnitude", 1).alias("magnitude")), V.sql("dy") + ", c AS (SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY channel_id) AS n, value - avg(value) OVER (PARTITION BY channel_id) AS y FROM dy) SELECT channel_id, CAST(k.range AS INTEGER) AS k, round(sqrt(power(sum(y * cos(2 * pi() * k.range * i / n)), 2) + power(sum(y * sin(2 * pi() * k.range * i / n)), 2)), 1) AS magnitude FROM c JOIN range(3, 10) k ON true GROUP BY 1, 2")
add("agg_segment_sse", lambda s, d: A.segment_sse(W.prefix_sums(V.hourly(s, d)), 10, 40).select(CH, F.round("sse", 4).alias("sse")), V.sql("hr") + ", c AS (SELECT channel_id, value, row_number() OVER (PARTITION BY channel_id ORDER BY ts) - 1 AS i FROM hr) SELECT channel_id, round(regr_syy(value, i) - power(regr_sxy(value, i), 2) / regr_sxx(value, i), 4) AS sse FROM c WHERE i BETWEEN 10 AND 40 GROUP BY 1")
add("agg_status", lambda s, d: V.table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")

# top-k, samples, sets
add("srt_time", lambda s, d: V.hourly(s, d).select(CH, TS, F.round("value", 6).alias("value")).orderBy(CH, TS), V.sql("hr") + " SELECT channel_id, ts, round(value, 6) AS value FROM hr")
add("top_argextreme", lambda s, d: K.arg_extreme(V.events(s, d), "value", True).select(CH, TS, "value"), V.sql("ev") + " SELECT channel_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY value DESC, ts) AS r FROM ev) WHERE r = 1")
pools = lambda s, d: V.hourly(s, d).groupBy(CH, F.to_date(TS).alias("day")).agg(F.round(F.max("value"), 6).alias("metric")).withColumn("in_sax", F.dayofmonth("day") % 5 == 0)
add("top_k_pool_first", lambda s, d: K.pool_first(pools(s, d), "metric", True, 8, [CH]), V.sql("hr") + ", x AS (SELECT channel_id, CAST(ts AS DATE) AS day, round(max(value), 6) AS metric, day(ts) % 5 = 0 AS in_sax FROM hr GROUP BY ALL), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY in_sax DESC, metric DESC, day) AS INTEGER) AS rank FROM x) SELECT * FROM y WHERE rank <= 8")
GREEDY = """ps AS (SELECT channel_id, value, row_number() OVER (PARTITION BY channel_id ORDER BY ts) - 1 AS pos FROM hr),
g AS (SELECT channel_id, CAST([] AS BIGINT[]) AS chosen FROM ps GROUP BY 1 UNION ALL
SELECT g.channel_id, list_append(chosen, arg_min(pos, {'v': -value, 'p': pos})) FROM g JOIN ps ON g.channel_id = ps.channel_id
WHERE len(chosen) < 5 AND len(list_filter(chosen, lambda c: abs(c - pos) <= 24)) = 0 GROUP BY g.channel_id, chosen)"""
add("top_k_min_gap", lambda s, d: K.spaced(L.position(V.hourly(s, d)), 5, 24).select(CH, F.explode(F.col("chosen").cast("array<long>")).alias("pos")), V.sql("hr").replace("WITH ", "WITH RECURSIVE ") + f", {GREEDY} SELECT channel_id, unnest(arg_max(chosen, len(chosen))) AS pos FROM g GROUP BY 1")
add("top_best_score", lambda s, d: V.table(s, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best")), "SELECT p_brand, arg_min(p_partkey, p_retailprice * 1e7 + p_partkey) AS best FROM part GROUP BY 1")
add("downsample_stride", lambda s, d: K.stride(V.events(s, d), 100).select(CH, TS, "value"), V.sql("ev") + " SELECT channel_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY channel_id) AS n FROM ev) WHERE i % greatest(1, n // 100) = 0")
add("sample_per_group", lambda s, d: K.one_per_group(V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_acctbal"), "c_mktsegment", F.col("c_acctbal") > 9000, 7).select("c_mktsegment", "id"))
add("set_union_pools", lambda s, d: K.pooled(pools(s, d).filter("in_sax").select(CH, "day", "metric"), pools(s, d).select(CH, "day", "metric"), [CH, "day"]), V.sql("hr") + " SELECT channel_id, CAST(ts AS DATE) AS day, round(max(value), 6) AS metric, CAST(CASE WHEN day(CAST(ts AS DATE)) % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS pool FROM hr GROUP BY 1, 2")
add("set_union_channels", lambda s, d: V.events(s, d).select(CH, TS).unionByName(V.daily(s, d).select(CH, TS)), V.sql("ev", "dy") + " SELECT channel_id, ts FROM ev UNION ALL SELECT channel_id, ts FROM dy")
days_of = lambda s, d, r: V.events(s, d).filter(r).select(F.to_date(TS).alias("day"))
add("set_intersection", lambda s, d: days_of(s, d, "channel_id = 'click' and value > 90").intersect(days_of(s, d, "channel_id = 'error' and value > 90")), V.sql("ev") + " SELECT CAST(ts AS DATE) AS day FROM ev WHERE channel_id = 'click' AND value > 90 INTERSECT SELECT CAST(ts AS DATE) FROM ev WHERE channel_id = 'error' AND value > 90")
add("set_distinct_dates", lambda s, d: V.events(s, d).groupBy(CH).agg(F.count_distinct(F.to_date(TS)).alias("n")), V.sql("ev") + " SELECT channel_id, count(DISTINCT CAST(ts AS DATE)) AS n FROM ev GROUP BY 1")
