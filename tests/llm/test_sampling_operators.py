"""Toxicity, hard negatives and importance resampling against brute force, SQL and held-out labels."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import negatives, queries, resampling, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    wanted = con.sql(queries.oracle_sql()[name])
    at = [wanted.columns.index(c) for c in columns]
    key = lambda r: [(x is None, x or 0) for x in r]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in wanted.fetchall()), key=key)


# Importance resampling


def plain(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def resampled(rows, target, n, percent, least, buckets=10000):
    grams = lambda t: [b" ".join(w[i : i + k]) for w in [plain(t)] for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    of = lambda t: [zlib.crc32(g) % buckets for g in grams(t)]
    s, t = (np.bincount(np.array([b for x in xs for b in of(x)], int), minlength=buckets) for xs in ([r[1] for r in rows], target))
    gain = [math.floor(1000 * math.log((b + 1.0) * (s.sum() + buckets) / ((a + 1.0) * (t.sum() + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = {}
    for d, text in rows:
        found = of(text)
        weight = sum(gain[b] for b in found) // max(len(found), 1)
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None]
    fit = sorted((d for d, text in rows if len(plain(text)) >= least), key=lambda d: (-out[d][2], d))
    for rank, d in enumerate(fit[: len(fit) * percent // 100], 1):
        out[d][3] = rank
    return out


def test_resampling_equals_brute_force(spark):
    odd = [(10**6 + i, t) for i, t in enumerate(["", None, " \t", "Ä ä É", "a" * 3000, "x\x00y\x7fz 日本 １２", "One, one; ONE: two-two", "w " * 30000])]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + odd
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, score string, n_words int").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for n, percent, least in ((1, 10, 20), (3, 37, 1), (2, 100, 0), (1, 0, 20)):
        found = {r.doc_id: [r.n_features, r.weight, r.score, r.rank] for r in resampling.resample(docs, goal, n, percent=percent, least=least).collect()}
        assert found == resampled(rows, target, n, percent, least)


def test_resampling_of_repeated_null_and_empty_tables(spark):
    text = "one two three " * 10
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    goal = spark.createDataFrame([("two",), (None,)], "text string")
    out = resampling.resample(docs, goal, 1, percent=100, least=1)
    rows = out.collect()
    assert sorted(r.rank for r in rows if r.rank is not None) == [1, 2, 3]
    assert [(r.score, r.rank) for r in rows if r.doc_id is None] == [(None, None)]
    assert len({r.weight for r in rows if r.doc_id != 3}) == 1 and [r.weight for r in rows if r.doc_id == 3] == [0]
    ones = [r.rank for r in rows if r.doc_id == 1]
    assert abs(ones[0] - ones[1]) == 1
    assert resampling.drawn(docs, out).count() == 3
    nothing = docs.filter("false")
    assert resampling.resample(nothing, goal).count() == 0
    assert resampling.resample(docs, goal.filter("false"), 1, percent=50, least=1).filter("rank is not null").count() == 1


# Hard negatives


def mined(rows, positives=5, negatives_=10):
    rows = [(i, label, np.floor(256 * np.array(v, float)).astype(int)) for i, v, label in rows]
    out = set()
    for a, label, v in rows:
        if a % 100 == 0:
            near = sorted((-int(v @ w), i) for i, other, w in rows if other == label and i != a)[:positives]
            for score, p in ((-s, i) for s, i in near):
                far = sorted((-int(v @ w), i) for i, other, w in rows if other != label and 30 * score <= 100 * int(v @ w) <= 90 * score)[:negatives_]
                out |= {(a, p, rank, i, score, -s) for rank, (s, i) in enumerate(far, 1)}
    return out


def asked(df):
    return {tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0).collect()}


@pytest.mark.parametrize(("width", "n", "spread"), [(64, 900, 1.0), (7, 500, 0.02), (100, 400, 3.0), (1, 60, 1.0)])
def test_negatives_equal_brute_force(spark, width, n, spread):
    """Also with many ties (small spread), widths that aren't a multiple of 64, and clustered vectors."""
    rng = np.random.default_rng(width)
    centres = rng.standard_normal((5, width))
    rows = [(i * 20, (spread * (centres[i % 5] * (i % 3) + rng.standard_normal(width))).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    assert asked(df) == mined(rows)


def test_negatives_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = np.random.default_rng(5)
    rows = [(i * 25, rng.standard_normal(16).tolist(), 0 if i % 3 else 1) for i in range(3000)]
    df = spark.createDataFrame(rows[:400], "vec_id long, embedding array<float>, label int")
    assert asked(df) == mined([(i, np.float32(v), label) for i, v, label in rows[:400]])


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(100, [1.0, 0.5], 1), (101, [1.0, 0.25], 1), (102, [0.5, 0.0], 2), (200, [0.0, 0.0], 3)]
    odd = [(None, [1.0, 1.0], 1), (300, None, 1), (400, [1.0, None], 1), (500, [nan, 1.0], 2), (103, [inf, 1.0], 2), (104, [0.5, 0.1], None), (600, [], 1), (105, [0.6], 2), (102, [0.5, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x") for r in good + odd], "vec_id long, embedding array<float>, label int, rank string")
    assert asked(df) == mined(good) == {(100, 101, 1, 102, 73728, 32768)}
    assert asked(df.filter("false")) == set()


def test_intervals_hold_the_scores():
    """The interval of every level holds the exact score, and the last ones leave few rows."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((2000, 64)) / 8).astype(np.int64)
    codes, alignments, left = negatives.encode(x)
    anchor = negatives.Anchor(x[0])
    estimate, slack, scores, halves = np.zeros(2000), np.zeros(2000), x @ x[0], []
    for level in range(negatives.LEVELS):
        estimate = estimate + alignments[:, level] * anchor.aligned(level, codes[:, level])
        slack = slack + alignments[:, level] * anchor.off[level]
        half = left[:, level + 1] * anchor.norm + slack
        assert (np.abs(scores - estimate) <= half * (1 + 1e-9)).all()
        halves.append(half.mean())
    assert halves[-1] < 0.15 * halves[0]


# Toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op11_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = ([s for s, y in held if y == k] for k in (1, 0))
    better = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert better >= 0.95
    assert np.mean([s >= 0.5 for s in toxic]) >= 0.85 and np.mean([s >= 0.5 for s in clean]) <= 0.01


def test_toxicity_learns_from_its_fold_alone(spark):
    """Labels outside the fold change nothing; nor do languages and sources."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = toxicity.fold(F.col("doc_id")) != 0
    turned = labels.withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = toxicity.train(docs, labels, learn), toxicity.train(docs.select("doc_id", "text"), turned, learn)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_toxicity_of_odd_texts(spark):
    rows = [(1, "you fool", 1), (2, None, 2), (3, "", 3), (None, "you fool", 4), (1, "you fool", 5), (4, "fool " * 200_000 + "x" * 200_000, 6), (5, "日本語のテキスト ΣΑΣ", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    weights = np.zeros(toxicity.WIDTH)
    weights[toxicity.word_features("fool")] = 1.0
    found = {(r.doc_id, round(r.score, 6)) for r in toxicity.score(docs, toxicity.Model(weights, -1.0)).collect()}
    low, high = (round(1 / (1 + math.exp(-z)), 6) for z in (-1.0, float(len(set(toxicity.word_features("fool"))) - 1)))
    assert found == {(1, high), (2, low), (3, low), (None, high), (4, high), (5, low)}
    assert toxicity.score(docs.filter("false"), toxicity.Model(weights, 0.0)).count() == 0


def test_toxicity_without_examples_gives_the_prior(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None if i == 3 else 0) for i in range(9)], "doc_id long, toxic int")
    for known in (labels, labels.filter("false"), labels.withColumn("doc_id", F.col("doc_id") + 1000)):
        scores = {r.score for r in toxicity.score(docs, toxicity.train(docs, known, F.lit(True))).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() < 0.5
    assert toxicity.score(docs, toxicity.train(docs.filter("false"), labels, F.lit(True))).count() == 30


def test_risk_is_not_negative():
    """Even with positives among the unlabelled, the two kinds are told apart."""
    rng = np.random.default_rng(0)
    text = lambda toxic: np.unique(np.concatenate([rng.integers(100, 400, 12), rng.integers(0, 8, 3) if toxic else rng.integers(8, 60, 3)]))
    model = toxicity.fit([text(True) for _ in range(300)], [text(i % 8 == 0) for i in range(2000)], 0.125)
    logit = lambda x: model.bias + model.weights[x].sum()
    assert np.mean([logit(text(True)) > 0 for _ in range(300)]) > 0.9 and np.mean([logit(text(False)) > 0 for _ in range(300)]) < 0.02
