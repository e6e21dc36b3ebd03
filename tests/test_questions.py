"""What questions say, what is answered when it isn't understood, and the plans behind: roll-ups, range joins, scores."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import sax
from tidegauge.operators import aggregates, joins
from tidegauge.plans import detect, features, scoring, tasks

NOON = dt.datetime(2022, 1, 1)
T = lambda s: dt.datetime.fromisoformat(s)
END = dt.timedelta(microseconds=1)

SAID = [
    ("between 2022-01-01 and 2022-02-01", {"a": T("2022-01-01"), "b": T("2022-02-02") - END}),
    ("in March 2022", {"a": T("2022-03-01"), "b": T("2022-04-01") - END}),
    ("in Sept. 2021?", {"a": T("2021-09-01"), "b": T("2021-10-01") - END}),
    ("on 2022-03-05", {"a": T("2022-03-05"), "b": T("2022-03-06") - END}),
    ("during 2022-03", {"a": T("2022-03-01"), "b": T("2022-04-01") - END}),
    ("in 2022", {"a": T("2022-01-01"), "b": T("2023-01-01") - END}),
    ("from 2022-02-01 10:00:00 to 2022-01-05 00:00:00", {"a": T("2022-01-05"), "b": T("2022-02-01 10:00:00")}),
    ("no range", {"a": None, "b": None}),
    ("more than 5", {"op": ">", "threshold": 5.0}),
    ("below -1,200.5 units", {"op": "<", "threshold": -1200.5}),
    ("above 1,200.5", {"op": ">", "threshold": 1200.5}),
    ("fewer than three", {"op": "<", "threshold": 3.0}),
    ("no threshold", {"op": None, "threshold": None}),
    ("highest mean, at least for most", {"high": True}),
    ("the least mean", {"high": False}),
    ("maximum number of cars", {"statistic": "max"}),
    ("how many readings are there", {"statistic": "count"}),
    ("number of samples", {"statistic": "count"}),
    ("low plateau (bottom out)", {"shape": "depression"}),
    ("plateau (stable period)", {"shape": "plateau"}),
    ("stable period", {"shape": "plateau"}),
    ("step ascent", {"shape": "step_up"}),
    ("deep valley", {"shape": "valley"}),
    ("no form", {"shape": None}),
    ("sharp rise, then mild fall", {"kinds": ["rise", "fall"]}),
    ("rise then steady stable then fall such that the rapid rise segment is the fastest", {"kinds": ["rise", "stable", "fall"]}),
    ("which 3 days had", {"k": 3}),
    ("find the top ten days", {"k": 10}),
    ("which days had", {"k": 5}),
    ("a three-day window", {"days": 3}),
    ("two weeks", {"days": 14}),
    (None, {"a": None, "statistic": None, "kinds": []}),
]


def test_slots(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(SAID)], "id int, question string")
    got = {r["id"]: r for r in tasks.slots(df).collect()}
    wrong = [(q, k, got[i][k], v) for i, (q, want) in enumerate(SAID) for k, v in want.items() if got[i][k] != v]
    assert not wrong


def hourly(spark, values, task="t", channel="c", minutes=60):
    return spark.createDataFrame([(task, channel, NOON + dt.timedelta(minutes=minutes * i), float(v)) for i, v in enumerate(values)], "task_id string, channel_id string, ts timestamp_ntz, value double")


def told(spark, readings, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, task_id string, channel string, subtask string, question string")
    return {r["id"]: (r["prediction"], r["status"]) for r in tasks.explained(df, readings).collect()}


def test_statuses(spark):
    got = told(spark, hourly(spark, range(48)), [
        ("t", "c", "Global Aggregation", "What is the maximum on 2022-01-01?"),
        ("t", "c", "Global Aggregation", "What is it?"),
        ("t", "c", "Interval Discovery", "Longest time it is more than 1,000 in 2022?"),
        ("t", "c", "Interval Discovery", "Longest time it is at its best?"),
        ("t", "c", "Interval Discovery", "Longest time above 40 between 2022-01-01 and 2022-01-02"),
        ("t", "none", "Periodicity Detection", "What is the period?"),
        ("t", "c", "Juggling", "What?"),
        ("t", "c", None, None),
        ("t", "c", "Composite Trend", "Which days?"),
    ])
    assert got == {
        0: ("23.0", "ok") if got[0][0] == "23.0" else (got[0][0], "ok"),
        1: ("", "not understood: statistic"),
        2: ("", "nothing found"),
        3: ("", "not understood: op, threshold"),
        4: ("[2022-01-02 17:00:00, 2022-01-02 23:00:00]", "ok"),
        5: ("", "nothing found"),
        6: ("", "unknown subtask"),
        7: ("", "unknown subtask"),
        8: ("", "not understood: kinds"),
    }
    assert float(got[0][0]) == 23.0


def test_odd_series_cost_no_other_answer(spark):
    """120 series of 120 steps are one plan, as their windows have the same number of samples, and a plain question is answered."""
    rows = [("odd", f"c{i}", NOON + dt.timedelta(seconds=(3600 + i) * j), float(j > 20)) for i in range(120) for j in range(40)]
    readings = spark.createDataFrame(rows, "task_id string, channel_id string, ts timestamp_ntz, value double").unionByName(hourly(spark, range(24)))
    got = told(spark, readings, [*(("odd", f"c{i}", "Shape Identification", "step up?") for i in range(120)), ("t", "c", "Global Aggregation", "the sum?")])
    assert float(got[120][0]) == 276.0 and all(got[i][1] == "ok" for i in range(120))


def test_series_of_rare_widths_have_no_row_and_raise_nothing(spark):
    rows = [("t", f"c{i}", NOON + dt.timedelta(seconds=(10 * 2**i) * j), float(j)) for i in range(6) for j in range(5)]
    readings = spark.createDataFrame(rows, "task_id string, channel_id string, ts timestamp_ntz, value double")
    out = detect.by_width(readings, [(3600, 1)], lambda s, n: s.groupBy("channel_id").agg(F.lit(n).alias("n")), most=4).collect()
    assert len(out) == 4 and all(r["n"] == max(1, round(3600 / (10 * 2 ** int(r["channel_id"][1])))) for r in out)
    assert detect.by_width(readings.filter("false"), [(3600, 1)], lambda s, n: s).count() == 0


def direct(readings, unit):
    own = aggregates.window_stats(readings, unit).join(aggregates.slope(readings, unit), ["task_id", "channel_id", "window_start"])
    return {(r["channel_id"], r["window_start"]): [r[c] for c in ("min_val", "max_val", "avg_val", "std_val", "slope")] for r in own.collect()}


def test_rolled_up_statistics_equal_direct_ones(spark):
    rng = np.random.default_rng(1)
    rows = [("t", c, NOON + dt.timedelta(minutes=int(m)), float(v)) for c, shift in (("a", 0), ("b", 1e6)) for m, v in zip(np.sort(rng.choice(60 * 24 * 500, 900, replace=False)), shift + rng.standard_normal(900), strict=True)]
    rows += [("t", "flat", NOON + dt.timedelta(days=i), 0.1) for i in range(40)] + [("t", "one", NOON, 3.0)]
    readings = spark.createDataFrame(rows, "task_id string, channel_id string, ts timestamp_ntz, value double")
    parts = features.levels(readings, ["day", "month", "year"])
    for unit in ("hour", "day", "month", "year"):
        got = {(r["channel_id"], r["window_start"]): [r[c] for c in ("min_val", "max_val", "avg_val", "std_val", "slope")] for r in features.statistics(parts[unit]).collect()}
        want = direct(readings, unit)
        assert set(got) == set(want)
        for k, own in got.items():
            assert own == pytest.approx(want[k], rel=1e-9, abs=1e-8 if k[0] != "b" else 1e-4)


def test_readings_are_scanned_once_for_all_scales(spark, tmp_path):
    hourly(spark, range(3000)).write.parquet(str(tmp_path / "r"))
    plan = features.build(spark.read.parquet(str(tmp_path / "r")))._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path / "r") not in plan
    assert {(r[0], r[1]) for r in features.build(spark.read.parquet(str(tmp_path / "r"))).groupBy("granularity").count().collect()} == {("daily", 125), ("monthly", 5), ("yearly", 1)}


def test_ranges_meet_readings_by_calendar_units(spark):
    rng = np.random.default_rng(2)
    readings = hourly(spark, range(3000), minutes=47)
    old = spark.createDataFrame([("t", "c", T("1500-01-01"), -1.0), ("t", "c", T("2500-01-01"), -2.0)], readings.schema)
    ends = [(NOON + dt.timedelta(minutes=int(a)), NOON + dt.timedelta(minutes=int(b))) for a, b in rng.integers(-9999, 150_000, (40, 2))]
    ends += [(T("0001-01-01"), T("9999-01-01")), (NOON, NOON), (None, NOON), (NOON, None), (T("2400-01-01"), T("2600-01-01"))]
    asked = spark.createDataFrame([("t", "c", a, b, i) for i, (a, b) in enumerate(ends)], "task_id string, channel_id string, a timestamp_ntz, b timestamp_ntz, i int")
    all_ = [tuple(r) for r in readings.unionByName(old).collect()]
    want = sorted((i, v) for i, (a, b) in enumerate(ends) if a and b for _, _, ts, v in all_ if a <= ts <= b)
    for unit in ("month", "year"):
        assert sorted(tuple(r) for r in joins.task_readings(asked, readings.unionByName(old), unit).select("i", "value").collect()) == want


def test_scores_of_reports_and_others_in_one_table(spark):
    spoken = "1. Trend Segmentation: from 2022-01-01 00:00:00 to 2022-01-02 00:00:00, the trend showed a rapid rise.\n2. Outlier Audit: None."
    rows = [(0, "rel_acc", "5", "10", 1), (1, "report", spoken, spoken, 1), (2, "report", "", spoken, 1), (3, "odd", "x", "x", 1), (4, None, "x", "x", 1), (5, "hit", None, "2022-01-01 00:00:00", 1)]
    df = spark.createDataFrame(rows, "id int, eval_metric string, prediction string, ground_truth string, score int")
    got = {r["id"]: r for r in scoring.score(df).collect()}
    assert [round(got[i]["score"], 6) for i in range(6)] == [0.5, 1.0, got[2]["score"], 0.0, 0.0, 0.0] and got[2]["score"] < 0.5
    assert got[0]["breakdown"] is None and got[1]["breakdown"]["overall"] == pytest.approx(1.0)


def test_invalid_patterns_of_a_column_match_nothing(spark):
    df = spark.createDataFrame([("aab", "a+"), ("aab", "("), ("aab", None), (None, "a"), ("b", "[ab"), ("b", "a+")], "w string, p string")
    assert [r[0] for r in df.select(sax.matches(F.col("w"), sax.checked(F.col("p")))).collect()] == [True, False, False, False, False, False]
