"""CSV files by their own headers, and the store that grows task by task, on small planted files."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.plans import features
from tidegauge.sources import csv, files, store


def put(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


def rows(df):
    return sorted((r.task_id, r.channel_id, str(r.ts), r.value) for r in df.collect())


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    at = put(
        tmp_path,
        one="timestamp,flow,level\n2024-01-01 00:00:00,1,10\n2024-01-01 01:00:00,,bad\n",
        two="timestamp,temp,flow\n2024-01-01 00:00:00,77,2\n",
        three="temp,timestamp\r\n55,2024-01-01 00:00:00\r\n\r\nnan,2024-01-01 01:00:00\r\n",
        four='﻿"a, b", timestamp ,c\n1.5,2024-01-01 00:00:00\n"2",2024-01-01 01:00:00,3,4\n"a, b", timestamp ,c\n5,never,6\n',
    )
    readings, unreadable = csv.csv_long(spark, at)
    zero, one = "2024-01-01 00:00:00", "2024-01-01 01:00:00"
    assert rows(readings) == sorted([("one", "flow", zero, 1.0), ("one", "level", zero, 10.0), ("two", "temp", zero, 77.0), ("two", "flow", zero, 2.0), ("three", "temp", zero, 55.0), ("four", "a, b", zero, 1.5), ("four", "a, b", one, 2.0), ("four", "c", one, 3.0)])
    assert {(r.task_id, r.channel_id, r.cell) for r in unreadable.filter("task_id = 'four' and timestamp = 'never'").collect()} == {("four", "a, b", "5"), ("four", "c", "6")}


def test_files_with_a_problem_are_named_and_leave_others_alone(spark, tmp_path):
    at = put(tmp_path, good="timestamp,x\n2024-01-01 00:00:00,1\n", none="time,x\n2024-01-01 00:00:00,1\n", only="timestamp\n2024-01-01 00:00:00\n", empty="", blank="\n \n", twice="timestamp,x,x\n2024-01-01 00:00:00,1,2\n", **{"a b+c%20": "timestamp,x\n2024-01-01 00:00:00,9\n"})
    found = {r.task_id: r.problem for r in csv.csv_headers(spark, at).collect()}
    assert found == {"good": None, "none": "no timestamp column", "only": "no channel column", "blank": "no line", "twice": "a channel twice", "a b+c%20": None}
    assert [(r[0], r[3]) for r in rows(csv.csv_long(spark, at)[0])] == [("a b+c%20", 9.0), ("good", 1.0)]
    with pytest.raises(ValueError, match="none.csv: no timestamp column"):
        csv.csv_long(spark, at, strict=True)


def test_a_file_of_many_blocks_keeps_its_header(spark, tmp_path):
    hour = lambda i: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=i)
    at = put(tmp_path, long="y,timestamp,x\n" + "".join(f"{i},{hour(i)},{-i}\n" for i in range(4000)), short="timestamp,y\n2020-01-01 00:00:00,5\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        readings = csv.csv_long(spark, at)[0]
        assert csv._lines(spark, at).rdd.getNumPartitions() > 4
        got = readings.groupBy("task_id", "channel_id").agg(F.count("*"), F.sum("value")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {tuple(r) for r in got} == {("long", "x", 4000, -7998000.0), ("long", "y", 4000, 7998000.0), ("short", "y", 1, 5.0)}


def test_wide_reader_refuses_different_headers(spark, tmp_path):
    at = put(tmp_path, one="timestamp,flow\n2024-01-01 00:00:00,1\n", two="timestamp,temp\n2024-01-01 00:00:00,2\n")
    with pytest.raises(ValueError, match="different headers"):
        files.csv_readings(spark, at)


@pytest.fixture
def readings(spark):
    hour = lambda i: datetime.datetime(2020, 12, 30) + datetime.timedelta(hours=i)
    own = [(t, "x", hour(i), float(k * i % 7)) for k, t in enumerate(("a", "b", "c"), 1) for i in range(72)]
    return spark.createDataFrame([*own, ("d", "x", hour(0), 1.0)], "task_id string, channel_id string, ts timestamp_ntz, value double")


def tasks(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "task_id string")


def status(df):
    return {r.task_id: r.status for r in df.collect()}


def content(df):
    return sorted(tuple(r) for r in df.select("task_id", "granularity", "channel_id", "window_start", F.round("avg_val", 9), "sax").collect())


def test_store_grows_and_others_stay(spark, readings, tmp_path):
    at = str(tmp_path / "s")
    assert store.read_features(spark, at).count() == 0
    assert status(store.build(readings, tasks(spark, "a"), at)) == {"a": "built"}
    assert status(store.build(readings, tasks(spark, "a", "b", "d", "none"), at)) == {"a": "skipped", "b": "built", "d": "empty", "none": "empty"}
    want = features.build(readings.filter("task_id in ('a', 'b')"))
    assert content(store.read_features(spark, at)) == content(want)
    builds = spark.read.parquet(f"{at}/rows").select("build").distinct().count()
    assert status(store.build(readings, tasks(spark, "a", "b"), at)) == {"a": "skipped", "b": "skipped"}
    assert spark.read.parquet(f"{at}/rows").select("build").distinct().count() == builds


def test_rebuild_replaces_its_tasks_alone(spark, readings, tmp_path):
    at, to = str(tmp_path / "s"), str(tmp_path / "compact")
    store.build(readings, tasks(spark, "a", "b", "c"), at)
    moved = readings.withColumn("value", F.col("value") * 2)
    assert status(store.build(moved, tasks(spark, "b"), at, rebuild=True)) == {"b": "built"}
    want = content(features.build(readings.filter("task_id in ('a', 'c')").unionByName(moved.filter("task_id = 'b'"))))
    assert content(store.read_features(spark, at)) == want
    store.build(readings.filter("task_id <> 'c'"), tasks(spark, "c"), at, rebuild=True)  # its readings are gone
    assert {r[0] for r in content(store.read_features(spark, at))} == {"a", "b"}
    store.compact(spark, at, to)
    assert content(store.read_features(spark, to)) == [r for r in want if r[0] != "c"]
    assert status(store.build(readings, tasks(spark, "a", "b"), to)) == {"a": "skipped", "b": "skipped"}


def test_a_failed_build_is_not_seen_and_is_done_again(spark, readings, tmp_path):
    at = str(tmp_path / "s")
    store.build(readings, tasks(spark, "a"), at)
    half = features.build(readings.filter("task_id = 'b'")).filter("granularity = 'daily'")
    half.write.partitionBy("granularity").parquet(f"{at}/rows/build=00000000000000099-dead")  # rows without a manifest
    assert {r[0] for r in content(store.read_features(spark, at))} == {"a"}
    store.add_features(half, at)  # one scale alone isn't complete
    assert status(store.build(readings, tasks(spark, "a", "b"), at)) == {"a": "skipped", "b": "built"}
    assert content(store.read_features(spark, at)) == content(features.build(readings.filter("task_id in ('a', 'b')")))
