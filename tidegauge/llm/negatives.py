"""Hard-negative mining: for each anchor and positive, the highest-scoring rows of other labels in a band.

Vectors are coded by randomly rotated one-bit codes: the signs of the rotated vector, the alignment of the
vector with its code, and what the code leaves over, which is coded again by the next rotation. Inner
products are estimated by popcounts of the codes with the bit planes of the rotated anchor. The Cauchy-
Schwarz inequality on the rest gives an interval that surely holds the score, so rows whose interval
can't reach the first k go; only those left are scored, in integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.tables import settle, small_batches

#: Codes of each vector, one after another; bits of a rotated anchor's components.
LEVELS, PLANES = 6, 8
#: Rows and anchors that meet in one task.
ROWS, ANCHORS = 32_768, 1024
#: Share of the norms' product by which intervals are widened for rounding.
ROUNDING = 1e-9


@lru_cache(maxsize=8)
def rotations(width: int) -> np.ndarray:
    rng = np.random.default_rng(width)
    return np.stack([np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(LEVELS)])


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits of the last axis as 64-bit words."""
    raw = np.packbits(bits, axis=-1)
    short = -raw.shape[-1] % 8
    return np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, short)]).view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes: row, level, word; alignments: row, level; norms of what is left: row, level from 0)."""
    n, width = vectors.shape
    rest, codes, alignments, left = vectors.astype(float), [], [], [np.linalg.norm(vectors.astype(float), axis=1)]
    for turn in rotations(width):
        y = rest @ turn.T
        on = y >= 0
        a = np.abs(y).sum(1) / np.sqrt(width)
        rest = (y - np.where(on, a[:, None], -a[:, None]) / np.sqrt(width)) @ turn
        codes.append(packed(on))
        alignments.append(a)
        left.append(np.linalg.norm(rest, axis=1))
    return np.stack(codes, 1).reshape(n, LEVELS, -1), np.stack(alignments, 1), np.stack(left, 1)


class Anchor:
    """A rotated anchor: the bit planes of its components at every level, and how far they are off."""

    def __init__(self, vector: np.ndarray):
        z = rotations(len(vector)) @ vector.astype(float)
        self.low = z.min(1)
        self.unit = np.maximum((z.max(1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        u = np.rint((z - self.low[:, None]) / self.unit[:, None]).astype(np.int64)
        near = self.low[:, None] + self.unit[:, None] * u
        self.off, self.sum, self.width = np.linalg.norm(z - near, axis=1), near.sum(1), len(vector)
        self.planes = packed(((u[:, None, :] >> np.arange(PLANES)[:, None]) & 1).astype(bool))
        self.norm = float(np.linalg.norm(vector.astype(float)))

    def aligned(self, level: int, codes: np.ndarray) -> np.ndarray:
        """Estimated inner product of the anchor with each code, as unit vectors, by popcounts."""
        on = self.low[level] * np.bitwise_count(codes).sum(1, dtype=np.int64)
        for p in range(PLANES):
            on = on + self.unit[level] * (1 << p) * np.bitwise_count(codes & self.planes[level, p]).sum(1, dtype=np.int64)
        return (2 * on - self.sum[level]) / np.sqrt(self.width)


class Block:
    """Rows of one task: ids, labels, integer vectors and codes, by label."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table["label"].to_numpy(), kind="stable")
        get = lambda name: table[name].to_numpy()[order]
        wide = lambda name: table[name].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        self.ids, self.labels, self.vectors = get("vec_id"), get("label"), wide("vector")
        self.codes = wide("codes").view(np.uint64).reshape(len(order), LEVELS, -1)
        self.alignments, self.left = wide("alignments"), wide("left")

    def survivors(self, anchor: Anchor, rows: np.ndarray, k: int, bands: list[tuple[float, float]]) -> np.ndarray:
        """Of ``rows``, all that can be among the first ``k`` of a band (least, most score)."""
        estimate, slack = np.zeros(len(rows)), np.zeros(len(rows))
        for level in range(LEVELS + 1):
            half = self.left[rows, level] * anchor.norm + slack + ROUNDING * self.left[rows, 0] * anchor.norm
            low, high = estimate - half, estimate + half
            keep = np.zeros(len(rows), bool)
            for least, most in bands:
                may, sure = (high >= least) & (low <= most), low[(low >= least) & (high <= most)]
                if len(sure) >= k:  # k rows surely in the band have at least this score
                    may &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                keep |= may
            rows, estimate, slack = rows[keep], estimate[keep], slack[keep]
            if level == LEVELS or not len(rows):
                return rows
            a = self.alignments[rows, level]
            estimate = estimate + a * anchor.aligned(level, self.codes[rows, level])
            slack = slack + a * anchor.off[level]

    def first(self, vector: np.ndarray, rows: np.ndarray, k: int, bands: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the first ``k`` of the rows of each band, given by 100 * score."""
        found = self.survivors(Anchor(vector), rows, k, [(least / 100, most / 100) for least, most in bands])
        scores, ids, out = self.vectors[found] @ vector, self.ids[found], []
        for least, most in bands:
            on = np.flatnonzero((100 * scores >= least) & (100 * scores <= most))
            best = on[np.lexsort((ids[on], -scores[on]))[:k]]
            out.append((ids[best], scores[best]))
        return out


def prepared(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and integer vector of the rows that take part, each once."""
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vector = F.transform(x, lambda v: F.floor(F.lit(256.0) * v.cast("double")))
    return embeddings.filter(sound & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), vector.alias("vector")).distinct()


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` with codes, alignments and left; computed once and stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for width in np.unique(sizes):
                part = batch.filter(pa.array(sizes == width))
                codes, alignments, left = encode(part.column("vector").flatten().to_numpy().reshape(-1, width))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v[0].size).cast(pa.list_(kind)) for v, kind in ((codes.view(np.int64), pa.int64()), (alignments, pa.float64()), (left, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(part), width), pa.int32()), *lists], [*part.schema.names, "width", "codes", "alignments", "left"])

    return rows.mapInArrow(run, "vec_id long, label int, vector array<long>, width int, codes array<long>, alignments array<double>, left array<double>")


def met(rows: DataFrame, anchors: DataFrame, n: int, n_anchors: int, run, schema: str) -> DataFrame:
    """``run(rows, anchors)`` over every block of rows with every block of anchors of the same width.

    Blocks are dealt by a hash of the id, so that no label, however common, is one. Rows go once to
    each block of ANCHORS anchors, anchors once to each block of at most ROWS rows.
    """
    spark = rows.sparkSession
    by_row = max(-(-n // ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    by_anchor = max(-(-n_anchors // ANCHORS), 1)
    part = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("r", part(1, by_row)).withColumn("a", every(by_anchor))
    right = anchors.withColumn("a", part(2, by_anchor)).withColumn("r", every(by_row))
    keys = ["r", "a", "width"]
    right = right.toDF(*right.columns)  # names of its own, as both sides come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def first_of(df: DataFrame, keys: list[str], score: str, id_: str, k: int) -> DataFrame:
    """The first ``k`` of each key with rank, from the first of each block."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), id_)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def columns(rows: list[tuple], names: list[str]) -> pa.Table:
    """Rows of (scalars ..., ids, scores) as a table of longs."""
    n = [len(r[-1]) for r in rows]
    values = [np.repeat(np.array([r[i] for r in rows], np.int64), n) for i in range(len(names) - 2)]
    values += [np.concatenate([*(r[i] for r in rows), np.zeros(0, np.int64)]).astype(np.int64) for i in (-2, -1)]
    return pa.table([pa.array(v, pa.int64()) for v in values], names)


WHOLE = 1 << 62


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            block = Block(rows)
            for anchor, label, vector in zip(anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), anchors["vector"], strict=True):
                like = np.arange(*np.searchsorted(block.labels, [label, label + 1]))
                like = like[block.ids[like] != anchor]
                out.append((anchor, *block.first(vector.values.to_numpy(), like, k, [(-WHOLE, WHOLE)])[0]))
        return columns(out, ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, least: int, most: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            block = Block(rows)
            for anchor, label, vector, positives in zip(anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), anchors["vector"], anchors["positives"].to_pylist(), strict=True):
                a, b = np.searchsorted(block.labels, [label, label + 1])
                unlike = np.concatenate([np.arange(a), np.arange(b, len(block.labels))])
                bands = [(least * p["positive_score"], most * p["positive_score"]) for p in positives]
                for p, found in zip(positives, block.first(vector.values.to_numpy(), unlike, k, bands), strict=True):
                    out.append((anchor, p["positive_id"], p["positive_score"], *found))
        return columns(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def mine(embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` and ``label`` are conditions on vec_id and label: which rows are anchors, and the
    label that counts. An anchor's positives are the first ``positives`` other rows of its label, its
    negatives for each of them the first ``negatives`` rows of other labels whose score is from ``least``
    to ``most`` percent of the positive's. Higher scores come first, ties by the smaller id.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no
    part; rows repeated whole count once; other columns are ignored. Vectors meet those of their own
    width. An anchor alone with its label has no positives and so no rows; an empty table gives none.
    Scores must fit in 56 bits (256 times the components, multiplied and added up).
    """
    spark = embeddings.sparkSession
    small_batches(spark, 4096)
    rows = prepared(embeddings, id_col, vector_col, label_col)
    if label is not None:
        rows = rows.withColumn("label", label.cast("int"))
    rows = settle(coded(rows), "codes")
    anchors = rows.filter(is_anchor).select("vec_id", "label", "vector", "width")
    n, n_anchors = rows.count(), anchors.count()
    found = met(rows, anchors, n, n_anchors, _positives(positives), "anchor_id long, positive_id long, positive_score long")
    found = settle(first_of(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    lists = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    out = met(rows, anchors.join(lists, "vec_id"), n, n_anchors, _negatives(negatives, least, most), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    first = first_of(out, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return first.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
