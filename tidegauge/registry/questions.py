"""The question operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import views as V
from tidegauge.functions import sax
from tidegauge.functions import text as T
from tidegauge.operators import aggregates as A
from tidegauge.operators import joins as J
from tidegauge.operators import topk as K
from tidegauge.operators import windows as W
from tidegauge.plans import detect as D
from tidegauge.plans import features as P
from tidegauge.plans import insight as I
from tidegauge.plans import tasks as Q
from tidegauge.registry.basics import CH, SLOPE_SQL, TS, WORDS, daily_words, probes, ranges, sax_sql
from tidegauge.registry.series import POS, centred_sql, longest_sql, midline_sql

ENTRIES: dict = {}
HR, DAY = 1, 24  # hourly samples in an hour and a day


def add(name: str, f, sql: str | None = None) -> None:
    ENTRIES[name] = (f, sql)


RG = "rg AS (SELECT channel_id, min(ts) + INTERVAL 2 DAY AS a, min(ts) + INTERVAL 5 DAY AS b FROM ev GROUP BY 1)"
asked = lambda: F.element_at(F.array(*map(F.lit, ["min", "max", "avg"])), F.length(CH) % 3 + 1)
add("q_global_aggregation", lambda s, d: A.global_aggregate(J.task_readings(ranges(s, d), V.events(s, d)), asked()).select(CH, F.round("answer", 8).alias("answer")), V.sql("ev") + f", {RG}, j AS (SELECT ev.* FROM ev JOIN rg USING (channel_id) WHERE ts BETWEEN a AND b) SELECT channel_id, round(CASE length(channel_id) % 3 WHEN 0 THEN min(value) WHEN 1 THEN max(value) ELSE avg(value) END, 8) AS answer FROM j GROUP BY 1")
add("q_temporal_localization", lambda s, d: K.arg_extreme(J.task_readings(ranges(s, d), V.events(s, d)), "value", True).select(CH, TS), V.sql("ev") + f", {RG}, j AS (SELECT ev.*, row_number() OVER (PARTITION BY channel_id ORDER BY value DESC, ts) AS r FROM ev JOIN rg USING (channel_id) WHERE ts BETWEEN a AND b) SELECT channel_id, ts FROM j WHERE r = 1")
add("q_interval_discovery", lambda s, d: D.interval_discovery(V.hourly(s, d), "<", 60.0).select(CH, "start", "end"), V.sql("hr") + f", {POS}, " + longest_sql("ps", "value < 60") + ' SELECT channel_id, s AS start, e AS "end" FROM lr')


def sliding(s, d):
    """Each series by its own number of samples in 30 days."""
    n = A.median_step(V.daily(s, d)).filter("step > 0").select(*V.SERIES, A.samples_per(30 * 86400, F.col("step")).alias("n"))
    asked = V.daily(s, d).join(n, V.SERIES).withColumns({"spread": F.lit("mean"), "high": F.lit(True)})
    return D.widest(asked, ranges=False).select(CH, "start", "end", "score")


SLIDE = V.sql("dy") + ", x AS (SELECT channel_id, ts, CASE WHEN count(*) OVER w = 30 THEN round(avg(value) OVER w, 6) END AS score, first_value(ts) OVER w AS start FROM dy WINDOW w AS (PARTITION BY channel_id ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), y AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY score DESC, ts) AS r FROM x WHERE score IS NOT NULL) "
add("q_sliding_window", sliding, SLIDE + 'SELECT channel_id, start, ts AS "end", score FROM y WHERE r = 1')
add("q_sliding_width_check", lambda s, d: sliding(s, d).select(CH, (F.abs(F.timestamp_diff("SECOND", "start", "end") + 86400 - 30 * 86400) <= 3600).alias("ok")), SLIDE + "SELECT channel_id, abs(epoch(ts) - epoch(start) + 86400 - 30 * 86400) <= 3600 AS ok FROM y WHERE r = 1")
add("q_shape_plateau", lambda s, d: D.plateau(V.hourly(s, d)).select(CH, "start", "end"), V.sql("hr") + f", {POS}, " + centred_sql("ps", "c", "stddev_samp", "value", 4, digits=12) + ", wh AS (SELECT channel_id AS ch, stddev_pop(value) AS sp FROM hr GROUP BY 1), j AS (SELECT c.*, sp FROM c JOIN wh ON channel_id = ch), " + longest_sql("j", "round(r, 9) <= round(0.10 * sp, 9)") + ' SELECT channel_id, s AS start, e AS "end" FROM lr')
add("q_shape_depression", lambda s, d: D.plateau(V.hourly(s, d), True).select(CH, "start", "end"), V.sql("hr") + f", {POS}, " + centred_sql("ps", "c", "stddev_samp", "value", 4, digits=12) + ", wh AS (SELECT channel_id AS ch, stddev_pop(value) AS sp, quantile_cont(value, 0.3) AS p30 FROM hr GROUP BY 1), j AS (SELECT c.*, sp, p30 FROM c JOIN wh ON channel_id = ch), " + longest_sql("j", "round(r, 9) <= round(0.10 * sp, 9) AND value <= p30") + ' SELECT channel_id, s AS start, e AS "end" FROM lr')


def spike(s, d):
    """Days whose word holds a spike, then the midline walk on their readings."""
    hits = daily_words(s, d).filter(sax.matches(F.col("sax"), F.lit(sax.SHAPES["spike"]))).select(*V.SERIES, F.to_date("window_start").alias("day"))
    raw = V.hourly(s, d).withColumn("day", F.to_date(TS)).join(hits, [*V.SERIES, "day"], "left_semi")
    return D.spike(raw).select(CH, "start", "end", T.fmt_interval(F.col("start"), F.col("end")).alias("answer"))


SPIKE = WORDS + ", sp AS (SELECT channel_id AS ch, CAST(window_start AS DATE) AS day FROM ft WHERE regexp_matches(sax, '[a-c]+[de][a-c]+')), raw AS (SELECT hr.* FROM hr JOIN sp ON channel_id = ch AND CAST(ts AS DATE) = day)" + midline_sql(True)[len(V.sql("hr")) :].replace("FROM hr)", "FROM raw)")
add("q_shape_spike", spike, SPIKE.replace('SELECT j.channel_id, min(ts) AS start, max(ts) AS "end"', "SELECT j.channel_id, min(ts) AS start, max(ts) AS \"end\", '[' || strftime(min(ts), '%Y-%m-%d %H:%M:%S') || ', ' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') || ']' AS answer"))
add("q_shape_valley", lambda s, d: D.valley(V.hourly(s, d)).select(CH, "start", "end"), midline_sql(False))


def step_sql(up: bool) -> str:
    fn, other = ("min", "-") if up else ("max", "-")
    move = "round(r - min(r) OVER w, 9)" if up else "round(max(r) OVER w - r, 9)"
    order = "r, pos" if up else "r DESC, pos"
    return V.sql("hr") + f", {POS}, " + centred_sql("ps", "c", "avg", "value", 8) + f", m AS (SELECT *, {move} AS move FROM c WINDOW w AS (PARTITION BY channel_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), b AS (SELECT channel_id AS ch, pos AS bp, ts AS bt, move AS bm FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY move DESC, ts) AS k FROM m) WHERE k = 1), a AS (SELECT channel_id, c.ts, bt, bm, row_number() OVER (PARTITION BY channel_id ORDER BY {order}) AS k FROM c JOIN b ON channel_id = ch AND pos <= bp) SELECT channel_id, ts AS start, bt AS \"end\", round(bm, 6) AS move FROM a WHERE k = 1"


for name, up in (("q_shape_step_up", True), ("q_shape_step_down", False)):
    add(name, lambda s, d, up=up: D.step(V.hourly(s, d), max(8, 3 * HR), up).select(CH, "start", "end", F.round("move", 6).alias("move")), step_sql(up))
add("q_shape_search", lambda s, d: D.shape_search(daily_words(s, d), "step_up", "2024-01-03 00:00:00", "2024-01-20 00:00:00").select(CH, "window_start", "sax"), WORDS + " SELECT channel_id, window_start, sax FROM ft WHERE window_start <= TIMESTAMP '2024-01-20' AND window_start + INTERVAL 1 DAY >= TIMESTAMP '2024-01-03' AND regexp_matches(sax, '[ab]{3,}.*[de]{3,}')")
ACF = V.sql("hr") + """, c AS (SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY channel_id) AS n, value - avg(value) OVER (PARTITION BY channel_id) AS y FROM hr),
p AS (SELECT channel_id AS ch, sum(y * y) AS s, any_value(n) AS n FROM c GROUP BY 1),
f AS (SELECT a.channel_id, l.range AS lag, sum(a.y * b.y) / any_value(p.s) AS acf, any_value(p.n) AS n FROM c a JOIN range(1, 700) l ON l.range <= a.n JOIN c b ON a.channel_id = b.channel_id AND b.i = a.i + l.range JOIN p ON a.channel_id = ch GROUP BY 1, 2),
g AS (SELECT *, lag(acf) OVER w AS x, lead(acf) OVER w AS z FROM f WHERE lag <= n // 2 WINDOW w AS (PARTITION BY channel_id ORDER BY lag)),
k AS (SELECT channel_id, min(lag) AS lag FROM g WHERE lag >= 2 AND acf > x AND acf > z AND acf > 0.1 GROUP BY 1)"""
SPEC = """, sp AS (SELECT channel_id, q.range AS k, any_value(n) AS n, sqrt(power(sum(y * cos(2 * pi() * q.range * (i - 1) / n)), 2) + power(sum(y * sin(2 * pi() * q.range * (i - 1) / n)), 2)) AS m FROM c JOIN range(3, 300) q ON q.range <= n // 3 WHERE channel_id NOT IN (SELECT channel_id FROM k) GROUP BY 1, 2), tp AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY m DESC, k) AS r FROM sp)"""
add("q_periodicity", lambda s, d: D.periodicity(V.hourly(s, d)).select(CH, "period"), ACF + SPEC + " SELECT k.channel_id, CAST(CASE WHEN f.acf < -0.1 THEN 2 * k.lag ELSE k.lag END AS BIGINT) AS period FROM k LEFT JOIN f ON f.channel_id = k.channel_id AND f.lag = 2 * k.lag UNION ALL SELECT channel_id, CAST(round_even(n / k, 0) AS BIGINT) FROM tp WHERE r = 1")


def query(s, d, n: int = 12):
    pos = W.position(V.hourly(s, d)).filter((F.col("pos") >= 30) & (F.col("pos") < 30 + n))
    return pos.select(*V.SERIES, (F.col("pos") - 30).alias("offset"), F.col("value").alias("q"))


later = lambda s, d: W.position(V.hourly(s, d)).filter("pos >= 60").drop("pos")
SUB = V.sql("hr") + f""", {POS}, q0 AS (SELECT channel_id AS ch, pos - 30 AS o, value AS q FROM ps WHERE pos BETWEEN 30 AND 41),
z AS (SELECT ch, o, (q - avg(q) OVER (PARTITION BY ch)) / stddev_pop(q) OVER (PARTITION BY ch) AS z FROM q0), r AS (SELECT channel_id, ts, value, pos - 60 AS pos FROM ps WHERE pos >= 60),
w AS (SELECT channel_id, pos - o AS first, count(*) AS n, min(ts) AS s, max(ts) AS e, avg(value) AS m, stddev_samp(value) AS sd, sum(z * value) AS zv, sum(z) AS zs, sum(z * z) AS zz FROM r JOIN z ON channel_id = ch GROUP BY 1, 2),
d AS (SELECT *, round(sqrt(greatest(0, zz + 11 - 2 * (zv - m * zs) / sd)), 6) AS dist FROM w WHERE n = 12 AND first >= 0 AND sd >= 1e-9), b AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY dist, first) AS k FROM d)"""
add("q_subsequence_zed", lambda s, d: D.subsequence(query(s, d), later(s, d)).select(CH, "start", "end", "distance"), SUB + ' SELECT channel_id, s AS start, e AS "end", dist AS distance FROM b WHERE k = 1')
add("join_candidate_offsets", lambda s, d: D.subsequence(query(s, d), later(s, d), 5).select(CH, F.col("rank").cast("long").alias("rank"), "start", "distance"), SUB + " SELECT channel_id, k AS rank, s AS start, dist AS distance FROM b WHERE k <= 5")
add("q_subsequence_dtw", lambda s, d: D.dtw(query(s, d), later(s, d)).select(CH, "start", "end", "distance"))

DAYS = V.sql("hr") + ", d0 AS (SELECT *, CAST(ts AS DATE) AS day, count(*) OVER (PARTITION BY channel_id, CAST(ts AS DATE)) AS n FROM hr), dp AS (SELECT channel_id, day, ts, value, row_number() OVER (PARTITION BY channel_id, day ORDER BY ts) - 1 AS pos FROM d0 WHERE n >= 8), " + centred_sql("dp", "sm", "avg", "value", 4, "channel_id, day") + ", st AS (SELECT *, round(lead(r) OVER (PARTITION BY channel_id, day ORDER BY pos) - r, 9) AS step FROM sm)"


def metric_sql(kind: str) -> str:
    if kind == "stable":
        return DAYS + ", s0 AS (SELECT channel_id, day, ts, pos, step FROM st WHERE step IS NOT NULL), " + centred_sql("s0", "qu", "stddev_samp", "step", 4, "channel_id, day") + ", md AS (SELECT channel_id AS ch, day AS dy, median(r) AS md FROM qu GROUP BY 1, 2), qj AS (SELECT qu.*, md FROM qu JOIN md ON channel_id = ch AND day = dy), " + longest_sql("qj", "r < md", keys="channel_id, day") + " SELECT lr.channel_id, lr.day, round(stddev_pop(value), 8) AS metric FROM lr JOIN dp ON lr.channel_id = dp.channel_id AND lr.day = dp.day AND pos BETWEEN a AND b GROUP BY 1, 2"
    sign, diff = (">", "y.r - x.r") if kind == "rise" else ("<", "x.r - y.r")
    return DAYS + ", " + longest_sql("st", f"step {sign} 0", keys="channel_id, day") + f" SELECT lr.channel_id, lr.day, round({diff}, 8) AS metric FROM lr JOIN sm x ON lr.channel_id = x.channel_id AND lr.day = x.day AND x.pos = a JOIN sm y ON lr.channel_id = y.channel_id AND lr.day = y.day AND y.pos = b"


for kind in ("rise", "fall", "stable"):
    add(f"q_day_metric_{kind}", lambda s, d, kind=kind: D.day_metric(V.hourly(s, d), kind).select(CH, "day", "metric"), metric_sql(kind))
add("q_composite_trend", lambda s, d: D.composite_trend(V.hourly(s, d), daily_words(s, d), ["rise", "fall"], "rise", True).select(CH, F.col("rank").cast("long").alias("rank"), "day", "metric", "in_sax"), metric_sql("rise").replace(" SELECT lr.channel_id, lr.day", ", mt AS (SELECT lr.channel_id, lr.day") + "), " + WORDS[len(V.sql("hr")) + 2 :].replace("st AS (SELECT channel_id, date_trunc", "st2 AS (SELECT channel_id, date_trunc").replace("ft AS (SELECT st.*, sx.sax, sx.sax_len FROM st JOIN sx ON st.channel_id = sx.channel_id AND st.window_start = sx.window_start)", "ft AS (SELECT st2.*, sx.sax, sx.sax_len FROM st2 JOIN sx ON st2.channel_id = sx.channel_id AND st2.window_start = sx.window_start)") + ", fl AS (SELECT channel_id AS ch, quantile_cont(metric, 0.5) AS fl FROM mt GROUP BY 1), j AS (SELECT mt.*, EXISTS (SELECT 1 FROM ft WHERE ft.channel_id = mt.channel_id AND CAST(ft.window_start AS DATE) = mt.day AND regexp_matches(sax, '[ab]+.*[de]+.*[de]+.*[ab]+')) AS in_sax FROM mt JOIN fl ON mt.channel_id = ch WHERE round(metric, 6) >= round(fl, 6)), k AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY in_sax DESC, metric DESC, day) AS rank FROM j) SELECT channel_id, rank, day, metric, in_sax FROM k WHERE rank <= 5")

# anomalies
CTX = V.sql("dy", "hm") + ", pr0 AS (SELECT dy.channel_id, ts, value, value - base AS v, row_number() OVER (PARTITION BY dy.channel_id ORDER BY ts) - 1 AS pos FROM dy JOIN hm ON dy.channel_id = hm.channel_id AND strftime(ts, '%m-%d') = hm.d)"
week = lambda s, d: J.with_companion(V.baseline(s, d))
CTX_WALK = CTX + ", " + centred_sql("pr0", "c", "avg", "v", 7, digits=9) + ", sg AS (SELECT channel_id AS ch, stddev_pop(r) AS sg FROM c GROUP BY 1), th AS (SELECT c.*, sg, t.rank, t.k FROM c JOIN sg ON channel_id = ch, (VALUES (0, 2.0), (1, 1.5), (2, 1.0), (3, 0.75), (4, 0.5), (5, 0.3)) t(rank, k)), " + longest_sql("th", "round(r, 6) > round(k * sg, 6)", keys="channel_id, rank") + ", q AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY rank) AS k FROM lr WHERE b - a >= 7), top AS (SELECT channel_id, ts, row_number() OVER (PARTITION BY channel_id ORDER BY abs(r) DESC, ts) AS k FROM c), ends AS (SELECT channel_id AS ch, min(ts) AS a, max(ts) AS b FROM c GROUP BY 1) SELECT channel_id, s AS start, e AS \"end\", 'k' || CAST(rank AS VARCHAR) AS rule FROM q WHERE k = 1 UNION ALL SELECT top.channel_id, greatest(ts - INTERVAL 30 DAY, a), least(ts + INTERVAL 30 DAY, b), 'fallback' FROM top JOIN ends ON top.channel_id = ch WHERE k = 1 AND top.channel_id NOT IN (SELECT channel_id FROM q)"
add("q_contextual_anomaly", lambda s, d: D.contextual_anomaly(week(s, d), 7, 1, least_days=1).select(CH, "start", "end", "rule"), CTX_WALK)
add("q_contextual_low_variance", lambda s, d: D.low_variance(V.daily(s, d), 7).select(CH, "start", "end"), V.sql("dy") + ", ps AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts) - 1 AS pos FROM dy), " + centred_sql("ps", "c", "stddev_samp", "value", 7) + ", m AS (SELECT channel_id AS ch, avg(r) AS m FROM c GROUP BY 1), j AS (SELECT c.*, m FROM c JOIN m ON channel_id = ch), " + longest_sql("j", "round(r, 6) < round(0.3 * m, 6)") + ' SELECT channel_id, s AS start, e AS "end" FROM lr')
PRP = V.sql("pr") + ", pp AS (SELECT 'orders' AS channel_id, ts, up, down, row_number() OVER (ORDER BY ts) - 1 AS pos FROM pr)"
cp = lambda s, d: J.causal_pairs(V.pair(s, d))
INV = PRP + ", ft AS (SELECT regr_slope(down, up) AS b, regr_intercept(down, up) AS a FROM pp), rs AS (SELECT pp.*, down - a - b * up AS v FROM pp, ft), " + centred_sql("rs", "c", "avg", "v", 4) + ", sg AS (SELECT stddev_pop(r) AS sg FROM c), th AS (SELECT c.*, sg, t.rank, t.k FROM c, sg, (VALUES (0, 3.0), (1, 2.5), (2, 2.0), (3, 1.5), (4, 1.0)) t(rank, k)), " + longest_sql("th", "round(abs(r), 4) > round(k * sg, 4)", keys="channel_id, rank")
MID = " SELECT channel_id, s AS start, e AS \"end\", CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY rank) AS k FROM lr WHERE b - a >= {least}) WHERE k = 1 UNION ALL SELECT channel_id, greatest(ts - INTERVAL 3 DAY, (SELECT min(ts) FROM pp)), least(ts + INTERVAL 3 DAY, (SELECT max(ts) FROM pp)), -1 FROM pp WHERE pos = (SELECT count(*) // 2 FROM pp) AND NOT EXISTS (SELECT 1 FROM lr WHERE b - a >= {least})"
add("q_causal_inverse", lambda s, d: D.causal_inverse(cp(s, d), 4, 3).select(CH, "start", "end", "rank"), INV + MID.format(least=3))
FLAT = PRP + ", " + centred_sql("pp", "c", "stddev_samp", "down", 4, digits=6).replace("AS r1 FROM", "AS r1 FROM").replace("AS r FROM c_1)", "AS rd FROM c_1)") + ", " + centred_sql("c", "e", "stddev_samp", "up", 4, digits=6).replace("AS r FROM e_1)", "AS ru FROM e_1)") + ", q AS (SELECT median(rd) AS md, quantile_cont(ru, 0.75) AS p75 FROM e), th AS (SELECT e.*, md, p75, t.rank, t.lo, t.hi FROM e, q, (VALUES (0, 0.2, 0.5), (1, 0.3, 0.4), (2, 0.4, 0.3), (3, 0.5, 0.2), (4, 0.2, NULL), (5, 0.3, NULL), (6, 0.5, NULL), (7, 0.8, NULL)) t(rank, lo, hi)), " + longest_sql("th", "round(rd, 4) < round(lo * md, 4) AND (hi IS NULL OR round(ru, 4) > round(2 * hi * p75, 4))", keys="channel_id, rank")
add("q_causal_flatline", lambda s, d: D.causal_flatline(cp(s, d), 4, 2).select(CH, "start", "end", "rank"), FLAT + MID.format(least=2))

# insight
add("q_insight_segments", lambda s, d: I.segments(V.hourly(s, d), 4 * HR, 5 * DAY).select(CH, "month", "seg", "start", "end", "adj", "kind"))
add("q_insight_outlier", lambda s, d: I.outliers(V.hourly(s, d), 4 * HR, 5 * DAY).select(CH, "month", "timestamp", "value"))
add("q_insight_report", lambda s, d: I.report(V.hourly(s, d), 4 * HR, 5 * DAY, write=True).select(CH, "month", T.fmt_report(F.col("trend_segments"), F.col("outliers")).alias("report")))

# features, slices
FEAT = "SELECT '{g}' AS granularity, st.channel_id, st.window_start, st.window_start + INTERVAL 1 {u} AS window_end, min_val, max_val, round(avg_val, 7) AS avg_val, round(std_val, 6) AS std_val, round(slope, 4) AS slope, sax_len, sax FROM st JOIN sl ON st.channel_id = sl.channel_id AND st.window_start = sl.window_start JOIN sx ON st.channel_id = sx.channel_id AND st.window_start = sx.window_start"


def feature_sql(granularity: str) -> str:
    u, b = P.SCALES[granularity]
    stats = f"st AS (SELECT channel_id, CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS window_start, min(value) AS min_val, max(value) AS max_val, avg(value) AS avg_val, stddev_samp(value) AS std_val FROM dy GROUP BY 1, 2 HAVING count(*) > 1)"
    return "SELECT * FROM (" + V.sql("dy") + f", {stats}, " + SLOPE_SQL.format(u=u, src="dy") + ", " + sax_sql("dy", u, b) + " " + FEAT.format(g=granularity, u=u) + ")"


shown = lambda: ("granularity", CH, "window_start", "window_end", "min_val", "max_val", F.round("avg_val", 7).alias("avg_val"), F.round("std_val", 6).alias("std_val"), F.round("slope", 4).alias("slope"), "sax_len", "sax")
add("q_feature_build", lambda s, d: P.build(V.daily(s, d)).select(*shown()), feature_sql("yearly") + " UNION ALL " + feature_sql("monthly"))
add("q_period_gridlines", lambda s, d: W.position(V.hourly(s, d)).filter((F.col("pos") % 24 == 0) & (F.col("pos") < 24 * 20)).select(CH, TS), V.sql("hr") + f", {POS} SELECT channel_id, ts FROM ps WHERE pos % 24 = 0 AND pos < 480")


def slices(s, d):
    best = K.pool_first(V.hourly(s, d).groupBy(*V.SERIES, F.to_date(TS).alias("day")).agg(F.round(F.max("value"), 6).alias("m")).withColumn("in_sax", F.lit(False)), "m", True, 6).select(*V.SERIES, "day")
    return V.events(s, d).withColumn("day", F.to_date(TS)).join(best, [*V.SERIES, "day"]).select(CH, "day", TS, "value")


add("q_day_slices", slices, V.sql("hr") + ", b AS (SELECT channel_id, day FROM (SELECT channel_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY channel_id ORDER BY round(max(value), 6) DESC, CAST(ts AS DATE)) AS k FROM hr GROUP BY 1, 2) WHERE k <= 6) SELECT event_type AS channel_id, day, ts, value FROM events JOIN b ON event_type = channel_id AND CAST(ts AS DATE) = day WHERE value IS NOT NULL")


def question_table(s, d):
    """A question of each of four subtasks for each channel; their parameters differ by channel."""
    series = V.hourly(s, d).groupBy("task_id", CH).agg(F.max(F.to_date(TS)).alias("last"))
    n = F.length(CH)
    day = lambda i: T.fmt_timestamp(F.date_sub("last", i).cast("timestamp_ntz"))
    span = F.concat(F.lit(" between "), day(n + 10), F.lit(" and "), day(n), F.lit("?"))
    asks = {
        "Global Aggregation": F.concat(F.lit("What is the "), F.element_at(F.array(*map(F.lit, ["minimum", "maximum", "average"])), n % 3 + 1), F.lit(" value"), span),
        "Temporal Localization": F.concat(F.lit("When is the "), F.when(n % 2 == 0, "highest").otherwise("lowest"), F.lit(" value"), span),
        "Interval Discovery": F.concat(F.lit("Where does it stay longest "), F.when(n % 2 == 0, "above ").otherwise("below "), (n * 10).cast("string"), span),
        "Sliding Window": F.concat(F.lit("Which "), (n % 3 + 1).cast("string"), F.lit("-day window has the "), F.when(n % 2 == 0, "highest").otherwise("lowest"), F.lit(" mean"), span),
    }
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("subtask"), q.alias("question")) for name, q in asks.items())))
    return series.select("task_id", F.col(CH).alias("channel"), each.alias("q")).select(F.concat_ws("/", "channel", "q.subtask").alias("id"), "task_id", "channel", "q.subtask", "q.question")


ASKED = V.sql("hr") + ", ls AS (SELECT channel_id, length(channel_id) AS n, CAST(max(CAST(ts AS DATE)) AS TIMESTAMP) AS l FROM hr GROUP BY 1), rs AS (SELECT hr.*, n FROM hr JOIN ls USING (channel_id) WHERE ts BETWEEN l - (n + 10) * INTERVAL 1 DAY AND l - n * INTERVAL 1 DAY), ps AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts) - 1 AS pos FROM rs), " + longest_sql("ps", "CASE WHEN n % 2 = 0 THEN value > n * 10 ELSE value < n * 10 END") + """,
sp AS (SELECT channel_id, median(gap) AS step FROM (SELECT channel_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY channel_id ORDER BY ts)) / 1e6 AS gap FROM rs) GROUP BY 1),
wd AS (SELECT ps.*, CAST(greatest(1, round_even(86400.0 * (n % 3 + 1) / step, 0)) AS BIGINT) AS k FROM ps JOIN sp USING (channel_id)),
sl AS (SELECT a.channel_id, a.n, min(b.ts) AS s, a.ts AS e, round(avg(b.value), 6) AS score FROM wd a JOIN wd b ON a.channel_id = b.channel_id AND b.pos BETWEEN a.pos - a.k + 1 AND a.pos WHERE a.pos >= a.k - 1 GROUP BY a.channel_id, a.n, a.ts),
sb AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY CASE WHEN n % 2 = 0 THEN -score ELSE score END, e) AS r FROM sl),
tl AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY CASE WHEN n % 2 = 0 THEN -value ELSE value END, ts) AS r FROM rs),
an AS (SELECT channel_id || '/Global Aggregation' AS id, regexp_replace(regexp_replace(printf('%.6f', CASE any_value(n) % 3 WHEN 0 THEN min(value) WHEN 1 THEN max(value) ELSE avg(value) END), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS p FROM rs GROUP BY channel_id
UNION ALL SELECT channel_id || '/Temporal Localization', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM tl WHERE r = 1
UNION ALL SELECT channel_id || '/Interval Discovery', '[' || strftime(s, '%Y-%m-%d %H:%M:%S') || ', ' || strftime(e, '%Y-%m-%d %H:%M:%S') || ']' FROM lr
UNION ALL SELECT channel_id || '/Sliding Window', '[' || strftime(s, '%Y-%m-%d %H:%M:%S') || ', ' || strftime(e, '%Y-%m-%d %H:%M:%S') || ']' FROM sb WHERE r = 1)
SELECT channel_id || '/' || name AS id, coalesce(p, '') AS prediction FROM ls JOIN (VALUES ('Global Aggregation'), ('Temporal Localization'), ('Interval Discovery'), ('Sliding Window')) v(name) ON true LEFT JOIN an ON an.id = channel_id || '/' || name"""
add("answer_tasks", lambda s, d: Q.answer(question_table(s, d), V.hourly(s, d)), ASKED)
