"""Steps whose work must grow no faster than their input."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidegauge.operators import joins, windows
from tidegauge.registry import scores


def test_nearest_reading_of_long_series_against_brute_force(spark):
    rng = np.random.default_rng(5)
    start = dt.datetime(2023, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=int(s))
    # days without readings, readings at one instant, probes on readings, halfway, and before and after all
    seconds = np.concatenate([rng.integers(0, 3 * 86400, 60_000), rng.integers(20 * 86400, 22 * 86400, 60_000)])
    values = rng.integers(0, 1000, len(seconds)).astype(float)
    spots = [-90_000, *seconds[:40], *rng.integers(0, 30 * 86400, 300), (3 + 20) * 43200, 40 * 86400]
    least = {}
    for s, v in zip(seconds.tolist(), values.tolist(), strict=True):
        least[s] = min(v, least.get(s, v))
    known = np.array(sorted(least))
    want = {}
    for p in map(int, spots):
        gaps = np.abs(known - p)
        s = int(known[gaps == gaps.min()].min())
        want[at(p)] = (at(s), least[s])
    readings = spark.createDataFrame(pd.DataFrame({"task_id": "t", "channel_id": "c", "ts": [at(s) for s in seconds], "value": values})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    probes = spark.createDataFrame(pd.DataFrame({"task_id": "t", "channel_id": "c", "at": sorted(want)})).withColumn("at", F.col("at").cast("timestamp_ntz"))
    began = time.monotonic()
    found = joins.nearest_reading(probes, readings).collect()
    assert {r.at: (r.ts, r.value) for r in found} == want and len(found) == len(want)
    assert time.monotonic() - began < 60  # a frame read anew for each row takes minutes


def test_fill_of_long_series_takes_no_square(spark):
    n = 150_000
    df = spark.range(n).select(F.lit("t").alias("task_id"), F.lit("c").alias("channel_id"), F.expr("timestamp_ntz '2023-01-01 00:00:00' + make_dt_interval(0, id, 0, 0)").alias("ts"), F.when(F.col("id") % 50_000 == 1, F.col("id").cast("double")).alias("value"))
    began = time.monotonic()
    got = {r.value: r["count"] for r in windows.filled(df, "value").groupBy("value").count().collect()}
    assert got == {1.0: 2, 50_001.0: 50_000, 100_001.0: 99_998}
    bins = windows.densified(df, "hour").agg(F.count("value").alias("n"), F.sum("value").alias("s")).first()
    assert bins.n == n and bins.s == pytest.approx(1 + sum(range(1, 100_002)) + 100_001.0 * (n - 100_002))
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("name", ["score_tasks", "score_report", "join_segment_align"])
def test_tasks_of_one_row_group_are_scored_by_many(spark, name):
    """The orders lie in one file of one row group, which one task reads; the scoring is dealt over all cores."""
    scored = scores.ENTRIES[name][0](spark, SF).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(scored) >= 8 and max(r["count"] for r in scored) < 0.4 * sum(r["count"] for r in scored)
