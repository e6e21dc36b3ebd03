"""Scans of two levels, transforms and exact time warping against plain windows and brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import aggregates, blocks, quantiles, topk, transforms, windows
from tidegauge.plans import detect

START = datetime.datetime(2020, 1, 1)


def series(spark, *ys, hours=1):
    rows = [("t", f"c{k}", START + datetime.timedelta(hours=hours * i), float(v)) for k, y in enumerate(ys) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "task_id string, channel_id string, ts timestamp_ntz, value double").repartition(5)


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(3)
    return series(spark, rng.integers(0, 4, 700), np.cumsum(rng.standard_normal(500)), [5.0])


def same(a, b, *columns):
    keys = ("task_id", "channel_id", *columns)
    cell = lambda v: round(float(v), 6) if isinstance(v, float) else str(v)
    of = lambda df: sorted(tuple(cell(r[k]) for k in keys) for r in df.collect())
    assert of(a) == of(b)


@pytest.mark.parametrize("unit", ["day", "month", "hour"])
def test_scans_of_two_levels_equal_windows(three, unit):
    placed, plain = blocks.position(three, unit=unit), windows.position(three)
    same(placed, plain, "ts", "pos", "value")
    same(blocks.prefix_sums(three, unit=unit), windows.prefix_sums(three), "pos", "sum_y", "sum_yy", "sum_iy")
    for low in (True, False):
        same(blocks.running_extreme(placed, "value", low, unit), windows.running_extreme(plain, "value", low), "pos", "move", "since")
    for mask in ("value >= 1", "value >= 0", "value > 1000"):
        ours, theirs = (df.withColumn("on", F.expr(mask)) for df in (placed, plain))
        same(blocks.runs(ours, "on", unit), windows.runs(theirs, "on"), "first", "last", "start", "end", "length")
        same(blocks.longest_run(ours, "on", unit), windows.longest_run(theirs, "on"), "first", "last")


def test_a_long_series_is_many_tasks(spark):
    """No partition of a window over rows holds more than a block."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = blocks.position(series(spark, range(3000)), unit="day")
        held = placed.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(held) > 4 and sum(r[1] for r in held) == 3000 and max(r[1] for r in held) < 1500


def acf(y, lag):
    y = np.asarray(y, float) - np.mean(y)
    return float((y[:-lag] * y[lag:]).sum() / (y @ y))


@pytest.mark.parametrize("block", [transforms.BLOCK, 16])
def test_autocorrelation_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(transforms, "BLOCK", block)
    rng = np.random.default_rng(4)
    ys = [1000 + rng.standard_normal(333), np.sin(np.arange(50) / 3), [2.0, 2.0, 2.0], [1.0]]
    got = {(r.channel_id, r.lag): r.acf for r in aggregates.autocorrelation(series(spark, *ys), F.array(*map(F.lit, (1, 2, 7, 40, 200)))).collect()}
    want = {(f"c{k}", lag): acf(y, lag) for k, y in enumerate(ys[:2]) for lag in (1, 2, 7, 40, 200) if lag < len(y)}
    assert {k for k, v in got.items() if v is not None} == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {k for k, v in got.items() if v is None} == {("c2", 1), ("c2", 2)}


def test_spectrum_equals_sums(spark):
    rng = np.random.default_rng(5)
    ys = [rng.standard_normal(101), rng.standard_normal(64) + 50]
    got = {(r.channel_id, r.k): r.magnitude for r in aggregates.spectrum(series(spark, *ys), F.sequence(F.lit(3), F.floor(F.col("n") / 3).cast("int"))).collect()}
    for c, y in enumerate(ys):
        y = y - y.mean()
        for k in range(3, len(y) // 3 + 1):
            assert abs(got[f"c{c}", k] - abs((y * np.exp(-2j * np.pi * k * np.arange(len(y)) / len(y))).sum())) < 1e-8
    assert len(got) == sum(len(y) // 3 - 2 for y in ys)


def test_period_of_a_long_series_without_an_early_peak(spark):
    n = 200_000
    y = np.sin(2 * np.pi * np.arange(n) / 7919)
    df = spark.range(n).select(F.lit("t").alias("task_id"), F.lit("c").alias("channel_id"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id"))).alias("ts"), F.sin(2 * np.pi * F.col("id") / 7919).alias("value"))
    near = [acf(y, lag) for lag in range(7800, 8000)]  # the number of pairs falls with the lag, so the peak is a little early
    assert abs(detect.periodicity(df).first().period - (7800 + int(np.argmax(near)))) <= 1


def zed(q, v):
    z = (q - q.mean()) / q.std()
    out = []
    for i in range(len(v) - len(q) + 1):
        w = v[i : i + len(q)]
        s = w.std(ddof=1)
        if s >= 1e-9:
            out.append((round(float(np.sqrt(max(0, z @ z + len(q) - 1 - 2 * (z @ (w - w.mean())) / s))), 6), i))
    return sorted(out)


def asked(spark, *qs):
    return spark.createDataFrame([("t", f"c{k}", i, float(v)) for k, q in enumerate(qs) for i, v in enumerate(q)], "task_id string, channel_id string, offset int, q double")


@pytest.mark.parametrize("block", [transforms.BLOCK, 40])
def test_nearest_stretches_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(transforms, "BLOCK", block)
    rng = np.random.default_rng(6)
    ys = [np.cumsum(rng.standard_normal(400)) + 1e6, np.concatenate([np.zeros(60), rng.integers(0, 3, 90), np.zeros(30)]), np.tile([1.0, 2.0, 4.0, 3.0], 50)]
    qs = [ys[0][100:120] * 3 - 7, rng.standard_normal(9), np.array([1.0, 2.0, 4.0, 3.0, 1.0])]
    got = {}
    for r in detect.subsequence(asked(spark, *qs), series(spark, *ys), 4).collect():
        got.setdefault(r.channel_id, []).append((r["rank"], r.first, r.start, r.end, r.distance))
    for k, (q, y) in enumerate(zip(qs, ys, strict=True)):
        want = zed(q, y)[:4]
        found = sorted(got[f"c{k}"])
        assert [f[1] for f in found] == [i for _, i in want]
        assert all(abs(f[4] - d) < 2e-6 for f, (d, _) in zip(found, want, strict=True))
        hour = lambda i: START + datetime.timedelta(hours=i)
        assert all(f[2:4] == (hour(i), hour(i + len(q) - 1)) for f, (_, i) in zip(found, want, strict=True))


def warp(a, b):
    a, b = ((x - np.mean(x)) / (np.std(x) if np.std(x) > 1e-9 else 1.0) for x in (a, b))
    table = np.full((len(a) + 1, len(b) + 1), np.inf)
    table[0, 0] = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = (x - y) ** 2 + min(table[i - 1, j], table[i, j - 1], table[i - 1, j - 1])
    return round(float(np.sqrt(table[-1, -1])), 6)


def test_lower_bounds_are_below_warping():
    rng = random.Random(7)
    for n in (1, 2, 3, 8):
        q = transforms.normalised(np.array([rng.gauss(0, 1) for _ in range(n)]))
        rows = transforms.normalised(np.array([[rng.choice((0, 1, rng.gauss(0, 2))) for _ in range(n)] for _ in range(60)], float))
        exact = transforms.warped(rows, q, np.inf)
        assert (transforms.lower_bounds(rows, q) <= exact + 1e-9).all()
        assert np.isinf(transforms.warped(rows, q, float(np.median(exact)))).sum() <= 30


@pytest.mark.parametrize("block", [transforms.BLOCK, 48])
def test_warping_is_exact_where_the_best_is_not_among_the_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(transforms, "BLOCK", block)
    rng = np.random.default_rng(8)
    q = np.array([0, 0, 0, 5, 0, 0, 0, 0, 0, 3, 0, 0.0])
    late = np.array([0, 5, 0, 0, 0, 0, 0, 0, 0, 0, 3, 0.0])  # the same turns, earlier and later
    # many stretches with the same places but other heights lie nearer without warping
    y = np.concatenate([*(q + rng.normal(0, 0.9, 12) for _ in range(14)), late, rng.normal(0, 1, 40), [1.0] * 20])
    readings, query = series(spark, y, np.cumsum(rng.standard_normal(150))), asked(spark, q, rng.standard_normal(7))
    near = {r["first"] for r in detect.subsequence(query, readings, 10).filter("channel_id = 'c0'").collect()}
    got = {r.channel_id: r for r in detect.dtw(query, readings).collect()}
    for k, (values, own) in enumerate(((y, q), (np.array([r.value for r in readings.filter("channel_id = 'c1'").orderBy("ts").collect()]), np.array([r.q for r in query.filter("channel_id = 'c1'").orderBy("offset").collect()])))):
        want = min((warp(values[i : i + len(own)], own), i) for i in range(len(values) - len(own) + 1))
        assert (got[f"c{k}"].distance, got[f"c{k}"]["first"]) == want
    assert got["c0"]["first"] not in near


@pytest.mark.parametrize(("k", "gap", "kinds"), [(5, 3, 4), (3, 10, 50), (1, 5, 9), (4, 0, 3), (8, 40, 1000)])
def test_spaced_choice_equals_greedy(spark, k, gap, kinds):
    """Also with many ties, series shorter than the gap, and fewer places than asked for."""
    rng = random.Random(k)
    ys = [[rng.randrange(kinds) for _ in range(n)] for n in (1, 2, 7, 60, 300)] + [[5] * 90, list(range(120)), list(range(120, 0, -1))]
    got = {r.channel_id: r.chosen for r in topk.spaced(windows.position(series(spark, *ys)), k, gap).collect()}
    for c, y in enumerate(ys):
        chosen = []
        for p in sorted(range(len(y)), key=lambda i: (-y[i], i)):
            if len(chosen) < k and all(abs(p - q) > gap for q in chosen):
                chosen.append(p)
        assert got[f"c{c}"] == chosen


@pytest.mark.parametrize("few", [3, 100_000])
def test_quantiles_equal_percentiles(spark, monkeypatch, few):
    """Values of all sizes and signs, ties, one value, one row and nulls, by sorting and by repeated cuts."""
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(3)
    own = {"normal": rng.normal(size=400), "near": 1e6 + rng.random(300) * 1e-3, "sizes": np.exp(rng.normal(0, 60, 301)) * rng.choice([-1, 1], 301), "ties": rng.integers(-2, 3, 200).astype(float), "same": np.full(50, -7.25), "one": np.array([3.5]), "huge": np.array([-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, -5e-324])}
    rows = [("t", k, float(x)) for k, v in own.items() for x in v] + [("t", "ties", None), ("t", "none", None)]
    df = spark.createDataFrame(rows, "task_id string, channel_id string, value double").repartition(5)
    points = {"least": 0.0, "p30": 0.3, "p50": 0.5, "p75": 0.75, "most": 1.0}
    got = {r.channel_id: r for r in quantiles.quantiles(df, points).collect()}
    assert set(got) == set(own)
    for k, v in own.items():
        v = np.sort(v)
        for name, q in points.items():
            at = q * (len(v) - 1)
            low, high, share = int(np.floor(at)), int(np.ceil(at)), at - np.floor(at)
            wanted = v[low] if low == high else (1 - share) * v[low] + share * v[high]
            assert got[k][name] == wanted, (k, name)
    assert quantiles.quantiles(df.limit(0), points).count() == 0
