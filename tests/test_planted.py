"""Signals planted in series, found where they are; properties of scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import sax
from tidegauge.functions import text as T
from tidegauge.operators import joins, topk, windows
from tidegauge.plans import detect, insight, scoring
from tidegauge.sources import files
from tidegauge.streaming import features as streaming


def series(spark, values, step_hours=1, channel="c", start="2023-01-01 00:00:00"):
    rows = [(i, float(v)) for i, v in enumerate(values) if v is not None]
    df = spark.createDataFrame(rows, "i int, value double")
    ts = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("i") * step_hours)
    return df.select(F.lit("t").alias("task_id"), F.lit(channel).alias("channel_id"), ts.alias("ts"), "value")


def hours(a, b):
    return round((b - a).total_seconds() / 3600)


def test_period_of_a_sine(spark):
    i = np.arange(400)
    y = np.sin(2 * np.pi * i / 17) + 0.2 * np.sin(4 * np.pi * i / 17)
    assert detect.periodicity(series(spark, y)).first().period == 17


def test_constant_series_has_no_period(spark):
    assert detect.periodicity(series(spark, [1.0] * 60)).count() == 0


def test_plateau_spike_and_step(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(0, 1, 120)
    y[40:60] = 0.5
    flat = detect.plateau(series(spark, y)).first()
    assert abs(hours(flat.start, flat.end) - 17) <= 3
    y = np.zeros(100)
    y[50:53] = [6, 10, 6]
    found = detect.spike(series(spark, y)).first()
    assert hours(found.start, found.end) == 2
    y = np.concatenate([np.zeros(50), np.linspace(0, 10, 20), np.full(50, 10.0)])
    up = detect.step(series(spark, y), 8, True).first()
    assert abs(up.move - 10) < 1e-6


def test_copied_shape_is_found(spark):
    rng = np.random.default_rng(2)
    q = rng.normal(0, 1, 12)
    y = rng.normal(0, 1, 150)
    y[90:102] = 3 * q + 7
    query = spark.createDataFrame([("t", "c", i, float(v)) for i, v in enumerate(q)], "task_id string, channel_id string, offset int, q double")
    assert detect.subsequence(query, series(spark, y)).first()["first"] == 90
    assert detect.dtw(query, series(spark, y)).first()["first"] == 90


def test_longest_run_equals_a_scan(spark):
    rng = np.random.default_rng(3)
    mask = rng.random(500) < 0.7
    best, at, run = (-1, 0), 0, 0
    for i, m in enumerate([*mask, False]):
        if m:
            run += 1
        elif run:
            if run - 1 > best[0]:
                best = (run - 1, i - run)
            run = 0
    df = windows.position(series(spark, mask.astype(float))).withColumn("on", F.col("value") > 0)
    row = windows.longest_run(df, "on").first()
    assert (row.length, row["first"]) == best


@pytest.mark.parametrize("n", [4, 5, 24])
def test_centred_mean_equals_pandas(spark, n):
    import pandas as pd

    y = np.random.default_rng(n).normal(0, 1, 80)
    want = pd.Series(y).rolling(n, center=True).mean().bfill().ffill()
    got = [r.v for r in windows.centred(series(spark, y), "v", F.avg, "value", n).orderBy("ts").collect()]
    assert np.allclose(got, want)


def test_contextual_and_causal(spark):
    base = np.sin(np.arange(365) / 58.0)
    y = base.copy()
    y[100:170] += 5
    df = series(spark, y, 24).withColumn("base", F.lit(0.0))
    row = detect.contextual_anomaly(df, 1, 1).first()
    assert abs((row.start - df.select(F.min("ts")).first()[0]).days - 100) <= 2
    assert 65 <= (row.end - row.start).days <= 75
    rng = np.random.default_rng(5)
    up = rng.normal(0, 1, 480)
    down = 2 * up + 1
    down[200:320] += 20
    pair = series(spark, up).withColumnRenamed("value", "up").join(series(spark, down).withColumnRenamed("value", "down"), ["task_id", "channel_id", "ts"])
    row = detect.causal_inverse(pair, 6, 48).first()
    assert 105 <= hours(row.start, row.end) <= 125


def test_insight_finds_stages_and_spike(spark):
    y = np.concatenate([np.linspace(0, 20, 240), np.full(240, 20.0), np.linspace(20, 5, 240)]) + 0.01 * np.sin(np.arange(720))
    kinds = [r.kind for r in insight.segments(series(spark, y), 4, 120).orderBy("seg").collect()]
    assert kinds == ["rise", "stable", "fall"]
    y = 0.01 * np.sin(np.arange(720))
    y[360] = 9
    assert insight.outliers(series(spark, y), 4, 120).first().value == pytest.approx(y[360])


def test_interpolation_fills_gaps(spark):
    y = [1.0, None, None, 4.0, 5.0]
    got = [r.value for r in windows.interpolated(series(spark, y), "hour").orderBy("ts").collect()]
    assert got == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_min_gap_and_nearest(spark):
    row = spark.range(1).select(topk.min_gap(F.array(*map(F.lit, [10, 12, 30, 31, 50])), 5, 3).alias("c")).first()
    assert row.c == [10, 30, 50]
    readings = series(spark, [1.0, 2.0, 3.0])
    probe = readings.limit(1).select("task_id", "channel_id", (F.lit("2023-01-01 00:30:00").cast("timestamp_ntz")).alias("at"))
    assert joins.nearest_reading(probe, readings).first().value == 1.0


def test_perfect_submission_scores_one(spark):
    text = "1. Trend Segmentation: from 2022-01-01 00:00:00 to 2022-01-09 00:00:00, the trend showed a rapid rise.\n2. Outlier Audit: A significant spike was detected at 2022-01-03 00:00:00 (value: 9.99)."
    rows = [("rel_acc", "0.479"), ("hit", "2022-09-21 03:00:00"), ("iou", "[2022-09-11 19:15:00, 2022-09-20 13:00:00]"), ("set_f1", "['2023-07-31', '2023-11-08']"), ("report", text)]
    df = spark.createDataFrame([(m, t, t) for m, t in rows], "eval_metric string, prediction string, ground_truth string")
    assert [round(r.score, 9) for r in scoring.score(df).collect()] == [1.0] * 5
    empty = df.withColumn("prediction", F.lit("")).filter("eval_metric != 'set_f1'")
    assert all(r.score == 0 for r in scoring.score(empty).collect())


def test_parsers(spark):
    row = spark.range(1).select(T.parse_float(F.lit("2022-09-11")).alias("a"), T.parse_float(F.lit("1e5")).alias("b"), T.parse_float(F.lit("none")).alias("c")).first()
    assert (row.a, row.b, row.c) == (-11.0, 5.0, None)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "task7.csv").write_text("timestamp,67,a-b\n2023-01-01 00:00:00,1.5,bad\n2023-01-01 01:00:00.9,NaN,2\nnever,1,1\n")
    wide = files.csv_readings(spark, str(tmp_path / "task7.csv"))
    good, bad = files.normal_times(wide)
    assert bad.count() == 1
    rows = {(r.task_id, r.channel_id, r.value) for r in files.long_readings(good).collect()}
    assert rows == {("task7", "67", 1.5), ("task7", "a-b", 2.0)}
    (tmp_path / "x.csv").write_text("when,a\n1,2\n")
    with pytest.raises(ValueError):
        files.csv_readings(spark, str(tmp_path / "x.csv"))


def test_streaming_daily_stats(spark, tmp_path):
    rows = series(spark, range(72)).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.daily_stats(stream).writeStream.format("memory").queryName("daily_stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("daily_stats").orderBy("window_start").collect()
    assert [(r.min_val, r.max_val) for r in got] == [(0.0, 23.0), (24.0, 47.0), (48.0, 71.0)]


def test_distinct_dates_gathers_no_rows(spark):
    from tidegauge import registry

    out = registry.queries()["set_distinct_dates"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert out.count() > 0 and dict(out.dtypes)["n"] == "bigint" and out.agg(F.max("n")).first()[0] <= events.count()


def test_more_steps_than_the_bound_raise(spark):
    rows = [(f"t{i}", "c", i, k * (1000 + i), 1.0) for i in range(101) for k in range(2)]
    df = spark.createDataFrame(rows, "task_id string, channel_id string, i int, s int, value double")
    readings = df.withColumn("ts", F.lit("2023-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s"))).drop("i", "s")
    with pytest.raises(ValueError, match="100 median steps"):
        detect.by_step(readings, lambda series, step: series)
    assert detect.by_step(readings.filter("task_id in ('t1', 't2')"), lambda series, step: series).count() == 4


def test_times_within_text(spark):
    rows = [("at 2022-09-21 03:00:00", "2022-09-21 03:00:00"), ("2022-09-21T03:00:00+00:00", "2022-09-21 03:00:00"), ("2022-09-21 03:00:00.750", "2022-09-21 03:00:00.750000"), ("'2022-09-21'", "2022-09-21 00:00:00"), ("2022-09-21 03:00", "2022-09-21 03:00:00"), ("never", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    got = df.select("t", "want", T.parse_timestamp(F.col("t")).alias("got")).collect()
    assert [(r.t, None if r.got is None else str(r.got)) for r in got] == rows


def test_interval_with_fractions(spark):
    rows = [("[2022-01-01 00:00:00.750, 2022-01-01 00:00:02.250]", "[2022-01-01 00:00:00, 2022-01-01 00:00:02]")]
    df = spark.createDataFrame(rows, "p string, g string")
    iou = scoring.iou(*T.parse_interval(F.col("p")), *T.parse_interval(F.col("g")))
    assert abs(df.select(iou.alias("x")).first().x - 1.25 / 2.25) < 1e-6


def test_invalid_pattern_is_held_by_no_word(spark):
    df = spark.createDataFrame([("abc",)], "w string")
    assert [tuple(r) for r in df.select(sax.matches(F.col("w"), "b("), sax.matches(F.col("w"), "b")).collect()] == [(False, True)]
