"""Importance resampling: documents drawn so that their n-grams look like those of a target text.

Texts are brought to words with single spaces between them, an overlapped regex scan gives the spans
of all n-grams, and spans are counted by the CRC of their bytes. A document's weight is the mean log
ratio of target to corpus over its n-grams; Gumbel noise on the weights makes the highest scores a
draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.tables import settle, small_batches

#: Bytes that aren't of words become spaces, A-Z become a-z; bytes from 0x80 on are of words.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def span_patterns(n: int) -> list:
    """For each length up to ``n``, what matches that many words between two borders."""
    return [regex.compile(rb"(?<!\S)\S+(?: \S+){%d}(?!\S)" % (k - 1)) for k in range(1, n + 1)]


def bucket_counts(text: str | None, patterns: list, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, distinct buckets, features of each) of a whole text."""
    words = (text or "").encode().translate(PLAIN).split()
    spaced, crc = b" ".join(words), zlib.crc32
    found = np.concatenate([np.fromiter((crc(m[0]) for m in p.finditer(spaced, overlapped=True)), np.uint32) for p in patterns])
    return len(words), *np.unique((found % np.uint32(buckets)).astype(np.int32), return_counts=True)


def hashed(docs: DataFrame, id_col: str, text_col: str, n: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, and the distinct buckets of a document with their counts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = span_patterns(n)
        for batch in batches:
            rows = [bucket_counts(text.as_py(), patterns, buckets) for text in batch.column("text")]
            ends = np.concatenate([[0], np.cumsum([len(b) for _, b, _ in rows])]).astype(np.int32)
            joined = lambda k: np.concatenate([r[k] for r in rows] or [np.zeros(0)]).astype(np.int32)  # noqa: B023, E731
            lists = [pa.ListArray.from_arrays(ends, joined(k)) for k in (1, 2)]
            sizes = [pa.array([f(r) for r in rows], pa.int64()) for f in (lambda r: r[0], lambda r: int(r[2].sum()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *sizes, *lists], ["doc_id", "n_words", "n_features", "buckets", "counts"])

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>")


def bucket_totals(features: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket. A task adds up its rows first, so at most ``buckets`` rows
    of each are shuffled, and ``buckets`` rows come to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in features.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of each bucket, both with one added to each bucket."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(h: int) -> int:
    """Gumbel noise in thousandths of 32 uniform bits."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gains: np.ndarray, seed: str) -> DataFrame:
    """doc_id, n_words, n_features, weight and score; the score of a null id is null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column("buckets"), batch.column("n_features").to_numpy()
            sums = np.concatenate([[0], np.cumsum(gains[lists.flatten().to_numpy()] * batch.column("counts").flatten().to_numpy())])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            score = [None if h is None else w + noise(h) for w, h in zip(weight.tolist(), batch.column("h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return features.withColumn("h", bits).select("doc_id", "n_words", "n_features", "buckets", "counts", "h").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scores: DataFrame, percent: int, least: int) -> DataFrame:
    """``scores`` with rank: 1, 2, 3, ... for the floor(percent * N / 100) highest of the N rows that have
    ``least`` words and an id, ties to the smaller id; null for the others.

    Scores are integers in a range that doesn't grow with the table (weights are bounded by the
    logarithm of the totals, noise lies between -3.2 and 22.9 thousands), so their counts are few rows, which
    give each score its first rank. What is left to sort is one score's rows, at most 0.04 % of ids by
    the noise's density. The drawn scores are joined by a broadcast of that bounded table.
    """
    spark = scores.sparkSession
    fit = (F.col("n_words") >= least) & F.col("score").isNotNull()
    levels = sorted(scores.filter(fit).groupBy("score").agg(F.count("*")).collect(), reverse=True)
    drawn, above, firsts = sum(n for _, n in levels) * percent // 100, 0, []
    for score, n in levels:
        if above >= drawn:
            break
        firsts.append((score, above))
        above += n
    table = F.broadcast(spark.createDataFrame(firsts, "score long, above long"))
    near = scores.filter(fit).join(table, "score")
    rank = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    near = near.withColumn("rank", rank.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    far = scores.filter(fit).join(table, "score", "left_anti").unionByName(scores.filter(~fit)).withColumn("rank", F.lit(None).cast("long"))
    return near.drop("above").unionByName(far)


def resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10000, percent: int = 10, least: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document: rank is null unless it is drawn.

    Features are all runs of 1 to ``n`` words of whole texts. Null and empty texts have none and weight
    0. Rows with a null id have a weight, but no score and no rank, and don't count for the share that
    is drawn. Rows that repeat an id with its text have the same score and ranks of their own, next to
    each other. Columns other than id and text are ignored. An empty corpus gives no row; an empty
    target makes weights prefer what is rare. Texts are scanned once: their bucket counts are written
    and read for the totals and for the weights.
    """
    features = settle(hashed(docs, id_col, text_col, n, buckets), "ngrams")
    wanted = hashed(target.withColumn("_", F.lit(None)), "_", target_col, n, buckets)
    gains = bucket_gains(bucket_totals(features, buckets), bucket_totals(wanted, buckets))
    return ranked(settle(scored(features, gains, seed), "weights"), percent, least).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The drawn documents themselves, all their columns."""
    return docs.join(ranks.filter("rank is not null").select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_semi").select(docs.columns)
