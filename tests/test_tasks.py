"""A table of questions against the detectors called one by one, and answers in JSON."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge import views
from tidegauge.functions import answers, text
from tidegauge.operators import joins, windows
from tidegauge.plans import detect, features, insight, tasks

SF = "/root/testdata/sf0.01"


def ask(spark, rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    table = spark.createDataFrame(full, "id int, task_id string, channel string, subtask string, question string")
    return table


def told(spark, rows, readings):
    return {r["id"]: r["prediction"] for r in tasks.answer(ask(spark, rows), readings).collect()}


def span(row):
    return f"[{row['start']:%Y-%m-%d %H:%M:%S}, {row['end']:%Y-%m-%d %H:%M:%S}]"


def test_shapes_periods_and_matches(spark):
    hours = views.hourly(spark, SF).cache()
    within = "between 2024-01-05 00:00:00 and 2024-01-12 00:00:00"
    own = hours.filter("channel_id = 'click' and ts between '2024-01-05' and '2024-01-12'")
    rows = [("events", "click", "Shape Identification", f"Where is the {w} {within}?") for w in ("plateau", "deepest valley", "highest spike", "step up", "depression", "step down")]
    rows += [("events", "click", "Periodicity Detection", f"What is the cycle {within}?"), ("events", "click", "Subsequence Matching", "What is most like 2024-01-02 00:00:00 to 2024-01-02 10:00:00 within 2024-01-05 00:00:00 to 2024-01-12 00:00:00?"), ("events", "none", "Periodicity Detection", within), ("events", "click", "Unknown", within), (None, None, None, None)]
    got = told(spark, rows, hours)
    query = windows.position(hours.filter("channel_id = 'click' and ts between '2024-01-02 00:00:00' and '2024-01-02 10:00:00'")).select(*views.SERIES, F.col("pos").alias("offset"), F.col("value").alias("q"))
    plain = [detect.plateau(own), detect.valley(own), detect.spike(own), detect.step(own, 8, True), detect.plateau(own, True), detect.step(own, 8, False)]
    for i, found in enumerate(plain):
        one = found.collect()
        assert got[i] == (span(one[0]) if one else "")
    assert got[6] == str(detect.periodicity(own).head()["period"])
    assert got[7] == span(detect.subsequence(query, own).head())
    assert [got[i] for i in (8, 9, 10)] == ["", "", ""]


def test_trends_anomalies_and_reports(spark):
    hours = views.hourly(spark, SF)
    readings = hours.unionByName(views.baseline(spark, SF)).unionByName(views.pair(spark, SF)).cache()
    rows = [
        ("events", "view", "Composite Trend", "Days of 2024 with a rapid rise then slow fall, such that the rapid rise segment is the fastest"),
        ("orders", "1-URGENT", "Contextual Anomaly", "When was the flood of 1997?"),
        ("orders", "orders", "Causal Anomaly", "Where is the inverse trend in 1996?"),
        ("orders", "orders", "Causal Anomaly", "Where is it flat in 1996?"),
        ("events", "view", "Insight Synthesis", "Sum up 2024-01."),
    ]
    got = told(spark, rows, readings)
    view = hours.filter("channel_id = 'view'")
    best = detect.composite_trend(view, features.scale(view, "daily"), ["rise", "fall"], "rise", True).orderBy("rank").collect()
    assert got[0] == "[" + ", ".join(f"'{r['day']}'" for r in best) + "]"
    year = views.baseline(spark, SF).filter("channel_id like '1-URGENT%' and year(ts) = 1997")
    assert got[1] == span(detect.by_step(joins.with_companion(year), lambda s, step: detect.contextual_anomaly(s, max(1, round(86400 / step)), 1)).head())
    pairs = joins.causal_pairs(views.pair(spark, SF).filter("year(ts) = 1996")).withColumn("value", F.col("down"))
    assert got[2] == span(detect.causal_inverse(pairs, 4, 2).head())
    assert got[3] == span(detect.causal_flatline(pairs, 4, 2).head())
    month = insight.report(view.filter("date_format(ts, 'yyyy-MM') = '2024-01'"), 4, 120)
    assert got[4] == month.select(text.fmt_report(F.col("trend_segments"), F.col("outliers"))).head()[0]


def test_no_questions_no_answers(spark):
    hours = views.hourly(spark, "/root/testdata/sf0.001")
    assert told(spark, [], hours) == {}
    assert told(spark, [("events", "click", "Shape Identification", "no shape named")], hours) == {0: ""}


@pytest.mark.parametrize("spread", ["mean", "range", "var", "std"])
def test_widest_equals_frames(spark, spread):
    days = views.daily(spark, SF).filter("year(ts) = 1996")
    for n, high in ((2, True), (7, False), (30, True)):
        own = {r["channel_id"]: r for r in detect.widest(days.withColumns({"n": F.lit(n), "spread": F.lit(spread), "high": F.lit(high)})).collect()}
        for r in detect.sliding_window(days, n, spread, high).collect():
            assert (own[r["channel_id"]]["start"], own[r["channel_id"]]["end"]) == (r["start"], r["end"])
            assert own[r["channel_id"]]["score"] == pytest.approx(r["score"], rel=1e-9)


JSON = [
    ("rel_acc", "1.2500000", "1.25", None), ("rel_acc", "true", "1", "number"), ("rel_acc", "[2.50]", "2.5", "number"), ("rel_acc", None, "", "number"),
    ("hit", '"2022-09-21T03:00:00"', "2022-09-21 03:00:00", None), ("hit", "never", "never", "time"),
    ("iou", '["2022-09-21 03:00:00", "2022-09-22"]', "[2022-09-21 03:00:00, 2022-09-22 00:00:00]", None),
    ("iou", '{"begin": "2022-09-21 03:00:00", "to": "2022-09-21 05:00:00"}', "[2022-09-21 03:00:00, 2022-09-21 05:00:00]", "two times"),
    ("set_f1", '{"topk": ["2022-09-21 03:00:00"]}', "['2022-09-21']", "list of dates"), ("set_f1", None, "[]", "list of dates"), ("set_f1", "[]", "[]", None),
    ("report", '"free text"', "free text", None), ("report", '{"outliers": []}', "1. Trend Segmentation: None.\n2. Outlier Audit: None.", "trend_segments"),
    ("report", '{"segments": [{"start": "2022-01-01", "end": "2022-01-02", "adjective": " Rapid", "trend": "rise"}, {"start": "2022-01-01"}], "anomalies": [{"at": "2022-01-05", "value": 2}, {"time": "2022-01-06"}]}', "1. Trend Segmentation: from 2022-01-01 00:00:00 to 2022-01-02 00:00:00, the trend showed a rapid rise.\n2. Outlier Audit: A significant spike was detected at 2022-01-05 00:00:00 (value: 2.00). A significant spike was detected at 2022-01-06 00:00:00.", None),
]


def test_answers_in_json(spark):
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(JSON)], "i int, m string, v string")
    m, v = F.col("m"), F.col("v")
    for r in df.select("i", answers.answer_text(m, v).alias("t"), answers.shape_problem(answers.shape_of(m), v).alias("p")).collect():
        assert r["t"] == JSON[r["i"]][2]
        assert r["p"] is None if JSON[r["i"]][3] is None else JSON[r["i"]][3] in r["p"]


def test_true_reports_as_objects(spark):
    spoken = "from 2022-09-21 03:00:00 to 2022-09-21 05:00:00, the trend showed a rapid rise"
    df = spark.createDataFrame([(0, '{"trend_segments": ["%s"], "significant_anomaly": {"timestamp": "2022-09-21 04:00:00"}}' % spoken), (1, None), (2, "{}"), (3, spoken)], "i int, t string")
    got = {r["i"]: (len(r["s"]), r["o"]) for r in df.select("i", *(c.alias(n) for c, n in zip(answers.read_report_truth(F.col("t")), "so"))).collect()}
    assert got == {0: (1, [dt.datetime(2022, 9, 21, 4)]), 1: (0, []), 2: (0, []), 3: (1, [])}


def test_unknown_channel_is_named(spark):
    hours = views.hourly(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="unknown channels \\['nope'\\].*click"):
        joins.chosen_channels(hours, ["click", "nope"])


def test_focus_falls_back_to_all(spark):
    hours = views.hourly(spark, "/root/testdata/sf0.001")
    far = hours.select(*views.SERIES).distinct().withColumns({"start": F.lit("1990-01-01").cast("timestamp_ntz"), "end": F.lit("1990-01-02").cast("timestamp_ntz")})
    assert joins.focused(hours, far).count() == hours.count()
