"""Fast Fourier transforms over series: autocorrelation, spectrum, and the distances of subsequences.

Series are cut into blocks that overlap by the largest lag, or the query's length, and each block is one row for a
vectorised transform; blocks are added up, or their best merged, exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import blocks
from tidegauge.views import SERIES

#: Rows of a block at least.
BLOCK = 65_536
#: How near to the best an estimate must be to be looked at exactly, and distances that count as equal.
NEAR, EQUAL = 1e-4, 1e-6


def correlations(core: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Sums of core[i] * whole[i + lag] for every lag from 0 to the length of ``whole`` less one."""
    n = 1 << (len(core) + len(whole) - 1).bit_length()
    return np.fft.irfft(np.conj(np.fft.rfft(core, n)) * np.fft.rfft(whole, n), n)[: len(whole)]


def _spread(batch: pa.RecordBatch, keys: list[str], n: list[int]) -> list[pa.Array]:
    at = pa.array(np.repeat(np.arange(len(n)), n))
    return [batch.column(k).take(at) for k in keys]


def _field(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    rows = batch.column("rows")
    return rows.values.field(name)[rows.offsets[i].as_py() : rows.offsets[i + 1].as_py()].to_numpy(zero_copy_only=False)


def autocorrelation(df: DataFrame, lags: Column, keys: list[str] = SERIES, more: DataFrame | None = None) -> DataFrame:
    """(keys, lag, acf) for each of ``lags``, of the series less its mean; lags without a pair of rows
    have no row, and acf is null for a flat series.

    ``lags`` is an array made from a series' number of readings n, or from its columns in ``more``
    (keys and others; series that aren't there have no lags). Blocks are four times as long as the
    largest lag, so that a few lags of a long series are the work of many tasks, and all lags of a
    series that of one transform.
    """
    whole = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("_mean"), (F.var_pop("value") * F.count("value")).alias("power"))
    asked = (whole if more is None else whole.join(more.drop("n"), keys)).withColumn("lags", lags).filter(F.size("lags") > 0)
    size = F.greatest(F.lit(BLOCK), 4 * F.array_max("lags").cast("long"))
    asked = asked.select(*keys, "_mean", "lags", F.array_max("lags").cast("long").alias("most"), size.alias("size"))
    placed = blocks.position(df, "pos", keys=keys).join(asked.drop("lags"), keys).withColumn("y", F.col("value") - F.col("_mean"))
    rows = blocks.overlapping(placed, F.col("size"), F.col("most"), ["y"], [], keys).join(asked.select(*keys, "lags", "size"), keys)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (core, asked) in enumerate(zip(batch.column("core").to_pylist(), batch.column("lags"), strict=True)):
                y, asked = _field(batch, i, "y"), np.unique(asked.values.to_numpy())
                asked = asked[(asked >= 0) & (asked < len(y))]
                found.append((asked, correlations(y[:core], y)[asked]))
            joined = [np.concatenate([f[k] for f in found]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*_spread(batch, keys, [len(a) for a, _ in found]), pa.array(joined[0].astype(np.int32)), pa.array(joined[1].astype(float))], [*keys, "lag", "s"])

    sums = rows.select(*keys, F.least("size", F.size("rows").cast("long")).alias("core"), "rows", "lags").mapInArrow(run, f"{kinds}, lag int, s double")
    return sums.groupBy(*keys, "lag").agg(F.sum("s").alias("s")).join(whole, keys).select(*keys, "lag", F.when(F.col("power") > 1e-12, F.col("s") / F.col("power")).alias("acf"))


def spectrum(df: DataFrame, bins: Column, keys: list[str] = SERIES) -> DataFrame:
    """(keys, k, magnitude, n) of the Fourier sum at each of ``bins``, an array that may be made from a
    series' number of readings n.

    A series is one row here, and one transform: 8 bytes a reading.
    """
    own = F.array_sort(F.collect_list(F.struct("ts", F.col("value").cast("double").alias("y"))))
    rows = df.groupBy(*keys).agg(own.alias("rows"), F.count("*").alias("n")).withColumn("bins", bins)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, asked in enumerate(batch.column("bins")):
                y = _field(batch, i, "y")
                x, k = np.abs(np.fft.fft(y - y.mean())), asked.values.to_numpy()
                found.append((k, x[k % len(y)], np.full(len(k), len(y))))
            joined = [np.concatenate([f[j] for f in found]) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*_spread(batch, keys, [len(f[0]) for f in found]), pa.array(joined[0].astype(np.int32)), pa.array(joined[1]), pa.array(joined[2].astype(np.int64))], [*keys, "k", "magnitude", "n"])

    return rows.mapInArrow(run, f"{kinds}, k int, magnitude double, n long")


def _blocks_of(query: DataFrame, readings: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(series, rows, qs): overlapping blocks of the readings with their series' query in order."""
    qs = query.groupBy(*SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "q"))), lambda x: x["q"].cast("double")).alias("qs"))
    n = F.size("qs").cast("long")
    placed = blocks.position(readings).join(qs.select(*SERIES, n.alias("_len")), SERIES)
    rows = blocks.overlapping(placed, F.greatest(F.lit(BLOCK), 4 * F.col("_len")), F.col("_len") - 1, ["ts", "value"], [])
    out = rows.join(qs, SERIES)
    return out if extra is None else out.join(extra, SERIES)


def _stretches(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample standard deviation of every stretch of ``n`` values, anew where sums could mislead."""
    shift = values.mean()
    y = values - shift
    s1, s2 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (y, y * y))
    m = (s1[n:] - s1[:-n]) / n
    var = np.maximum((s2[n:] - s2[:-n]) - n * m * m, 0) / max(n - 1, 1)
    small = np.flatnonzero(var <= 1e-6 * max(float(np.mean(y * y)), 1e-300))
    if len(small):
        var[small] = np.lib.stride_tricks.sliding_window_view(y, n)[small].var(axis=1) * n / max(n - 1, 1)
    return m + shift, np.sqrt(var)


def nearest(query: DataFrame, readings: DataFrame, top: int = 1) -> DataFrame:
    """rank, first, start, end and distance of the ``top`` stretches of each series nearest its query
    (task_id, channel_id, offset, q), both z-normalised: the query by population, the stretch by sample std.

    Inside a block all stretches are compared by one convolution, which picks those that may be among the
    best; these are computed exactly, and the blocks' best merged. Flat stretches don't count.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, q in enumerate(batch.column("qs")):
                q, v, ts, pos = q.values.to_numpy(), _field(batch, i, "value"), _field(batch, i, "ts"), _field(batch, i, "pos")
                n, std = len(q), q.std()
                none = (np.zeros(0, np.int64), ts[:0], ts[:0], np.zeros(0))
                if len(v) < n or n < 2 or std < 1e-9:
                    found.append(none)
                    continue
                z = (q - q.mean()) / std
                mean, spread = _stretches(v, n)
                rough = correlations(z, v - v.mean())[: len(v) - n + 1]
                sound = np.flatnonzero(spread >= 1e-9)
                zz, zs = float(z @ z), float(z.sum())
                d = np.sqrt(np.maximum(zz + n - 1 - 2 * rough[sound] / spread[sound], 0))
                if len(d) > top:
                    sound = sound[d <= np.partition(d, top - 1)[top - 1] + NEAR]
                exact = np.lib.stride_tricks.sliding_window_view(v, n)[sound]
                m, s = exact.mean(axis=1), exact.std(axis=1, ddof=1)
                cross = (exact @ z - m * zs) / s
                d = np.round(np.sqrt(np.maximum(zz + n - 1 - 2 * cross, 0)), 6)
                best = np.lexsort((sound, d))[:top]
                at = sound[best]
                found.append((pos[at], ts[at], ts[at + n - 1], d[best]))
            joined = [np.concatenate([f[k] for f in found]) for k in range(4)]
            times = [pa.array(x.astype("datetime64[us]"), pa.timestamp("us")) for x in joined[1:3]]
            yield pa.RecordBatch.from_arrays([*_spread(batch, SERIES, [len(f[0]) for f in found]), pa.array(joined[0].astype(np.int64)), *times, pa.array(joined[3])], [*SERIES, "first", "start", "end", "distance"])

    own = _blocks_of(query, readings).mapInArrow(run, "task_id string, channel_id string, first long, start timestamp_ntz, end timestamp_ntz, distance double")
    w = Window.partitionBy(*SERIES).orderBy("distance", "first")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(*SERIES, "rank", "first", "start", "end", "distance")


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows less their mean by their population std; flat rows less their mean."""
    std = x.std(axis=-1, keepdims=True)
    return (x - x.mean(axis=-1, keepdims=True)) / np.where(std > 1e-9, std, 1.0)


def lower_bounds(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What warping to ``q`` costs each row at least: both ends meet, and every other value meets some value of the
    other side, so none costs less than its distance to the nearest."""
    held = np.sort(q)
    i = np.clip(np.searchsorted(held, rows), 1, len(held) - 1) if len(held) > 1 else np.zeros(rows.shape, int)
    near = np.minimum(np.abs(rows - held[i]), np.abs(rows - held[i - 1])) ** 2
    ends = (rows[:, 0] - q[0]) ** 2 + ((rows[:, -1] - q[-1]) ** 2 if len(q) > 1 else 0)
    inner = near[:, 1:-1].sum(axis=1) if len(q) > 1 else 0
    low, high = rows.min(axis=1, keepdims=True), rows.max(axis=1, keepdims=True)
    beyond = (np.maximum(q[1:-1] - high, 0) + np.maximum(low - q[1:-1], 0)) ** 2
    return ends + np.maximum(inner, beyond.sum(axis=1))


def warped(rows: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Squared cost of warping each row to ``q``, all rows side by side; rows beyond ``most`` are given up and infinite."""
    out, alive = np.full(len(rows), np.inf), np.arange(len(rows))
    last = np.full((len(q) + 1, len(rows)), np.inf)
    last[0] = 0.0
    for i in range(rows.shape[1]):
        row = np.full_like(last, np.inf)
        for j in range(1, len(q) + 1):
            row[j] = (rows[alive, i] - q[j - 1]) ** 2 + np.minimum(np.minimum(last[j], last[j - 1]), row[j - 1])
        keep = row.min(axis=0) <= most
        alive, last = alive[keep], row[:, keep]
    out[alive] = last[-1]
    return out


def best_warped(values: np.ndarray, q: np.ndarray, bound: float, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of all stretches as near to ``q`` by time warping as the best one, ``bound`` at
    most: the likeliest by their lower bounds first, until no bound is below the best."""
    n, q = len(q), normalised(q)
    views = np.lib.stride_tricks.sliding_window_view(values, n)
    low = np.concatenate([lower_bounds(normalised(views[i : i + 4096]), q) for i in range(0, len(views), 4096)])
    order, best, places, costs = np.argsort(low, kind="stable"), bound, [], []
    for i in range(0, len(order), batch):
        some = order[i : i + batch]
        most = (best + EQUAL) ** 2
        some = some[low[some] <= most * (1 + 1e-12)]
        if not len(some):
            break
        d = np.sqrt(warped(normalised(views[some]), q, most))
        best = min(best, float(d.min()))
        places.append(some[np.isfinite(d)])
        costs.append(d[np.isfinite(d)])
    places, costs = (np.concatenate([*x, np.zeros(0)]) for x in (places, costs))
    good = costs <= best + EQUAL
    return places[good].astype(np.int64), costs[good]


def nearest_warped(query: DataFrame, readings: DataFrame, candidates: int = 10) -> DataFrame:
    """first, start, end and distance of the stretch of each series nearest its query by dynamic time warping
    without a band, both z-normalised by population; the first of equals.

    Exact over all stretches. The best of the ``candidates`` nearest without warping gives each series a
    bound; stretches whose lower bound is above it, or the best found so far in a block, aren't warped.
    """

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (q, bound) in enumerate(zip(batch.column("qs"), batch.column("bound").to_pylist(), strict=True)):
                q, v, ts, pos = q.values.to_numpy(), _field(batch, i, "value"), _field(batch, i, "ts"), _field(batch, i, "pos")
                at, d = best_warped(v, q, np.inf if bound is None else bound) if 0 < len(q) <= len(v) else (np.zeros(0, np.int64), np.zeros(0))
                d = np.round(d, 6)
                best = np.lexsort((at, d))[:1]
                found.append((pos[at[best]], ts[at[best]], ts[at[best] + len(q) - 1], d[best]))
            joined = [np.concatenate([f[k] for f in found]) for k in range(4)]
            times = [pa.array(x.astype("datetime64[us]"), pa.timestamp("us")) for x in joined[1:3]]
            yield pa.RecordBatch.from_arrays([*_spread(batch, SERIES, [len(f[0]) for f in found]), pa.array(joined[0].astype(np.int64)), *times, pa.array(joined[3])], [*SERIES, "first", "start", "end", "distance"])

    schema = "task_id string, channel_id string, first long, start timestamp_ntz, end timestamp_ntz, distance double"
    near = nearest(query, readings, candidates)
    n = query.groupBy(*SERIES).agg(F.count("*").alias("_len"))
    spans = near.join(n, SERIES).select(*SERIES, "first", F.explode(F.sequence("first", F.col("first") + F.col("_len") - 1)).alias("pos"))
    values = blocks.position(readings).join(spans, [*SERIES, "pos"])
    rows = F.array_sort(F.collect_list(F.struct("pos", "ts", "value"))).alias("rows")
    qs = query.groupBy(*SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "q"))), lambda x: x["q"].cast("double")).alias("qs"))
    few = values.groupBy(*SERIES, "first").agg(rows).drop("first").join(qs, SERIES).withColumn("bound", F.lit(None).cast("double"))
    bounds = few.mapInArrow(search, schema).groupBy(*SERIES).agg((F.min("distance") + EQUAL).alias("bound"))
    every = query.select(*SERIES).distinct().join(bounds, SERIES, "left")
    own = _blocks_of(query, readings, every).mapInArrow(search, schema)
    w = Window.partitionBy(*SERIES).orderBy("distance", "first")
    return own.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
