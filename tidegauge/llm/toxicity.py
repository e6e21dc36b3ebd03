"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positive, all others are unlabelled, whatever their label. The risk of a
classifier f is pi R+(positive) + max(0, R-(unlabelled) - pi R-(positive)), where the class prior pi is
the share of toxic labels; where the second part is negative, a step is taken that raises it. Features are
words and beginnings of words; each is scaled by the lower confidence bound of its log ratio between positive
and unlabelled texts, so that chance finds weigh nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.tables import keyed, small_batches

#: Hashed features, and the lengths of word beginnings besides whole words.
WIDTH, BEGINNINGS = 1 << 18, (4, 5, 6, 7)
#: Rows that the classifier is fitted on at most: positive ones, and unlabelled ones.
POSITIVE, UNLABELLED = 4096, 8192
#: Words that a worker remembers at most, and their longest.
KNOWN, LONG = 200_000, 40
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, positive boolean, held array<int>, counts array<int>"


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def fold(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5


def word_features(word: str) -> list[int]:
    """Hashes of a word with both borders, and of its beginnings with the left one."""
    bordered = f"^{word}$"
    return [zlib.crc32(x.encode()) % WIDTH for x in {bordered, *(bordered[:k] for k in BEGINNINGS)}]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class Remembered(dict):
    """What ``of`` makes of short words; ``trim`` empties it when it has grown too large."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word):
        out = self.of(word)
        if len(word) <= LONG:
            self[word] = out
        return out

    def trim(self) -> None:
        if len(self) > KNOWN:
            self.clear()


def sampled(docs: DataFrame, labels: DataFrame, learn: F.Column) -> DataFrame:
    """(doc_id, positive) of the rows to fit on, the first by a hash of the id; only ids are shuffled."""
    order = F.xxhash64("doc_id", F.lit(11))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & learn)
    toxic = labels.filter((F.col("toxic") == 1) & learn).select("doc_id").distinct()
    known = toxic.join(ids, "doc_id", "left_semi").orderBy(order).limit(POSITIVE)
    return known.withColumn("positive", F.lit(True)).unionByName(ids.distinct().orderBy(order).limit(UNLABELLED).withColumn("positive", F.lit(False)))


def sample_features(docs: DataFrame, picked: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features of the distinct positive and of the distinct unlabelled texts: in how many of a text's
    words each is. The picked ids are at most POSITIVE + UNLABELLED, so they are broadcast and features collected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(word_features)
        for batch in batches:
            held = [np.unique(np.array([f for w in words_of(t.as_py()) for f in known[w]], np.int32), return_counts=True) for t in batch.column("text")]
            known.trim()
            lists = [pa.array([x[k].astype(np.int32) for x in held], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), *lists], ["doc_id", "positive", "held", "counts"])

    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "positive").mapInArrow(run, SCHEMA)
    seen, out = set(), ([], [])
    for batch in rows.toArrow().sort_by("doc_id").to_batches():
        for positive, held, counts in zip(batch.column("positive").to_pylist(), batch.column("held"), batch.column("counts"), strict=True):
            held, counts = (x.values.to_numpy() for x in (held, counts))
            if (key := (positive, held.tobytes(), counts.tobytes())) not in seen:
                seen.add(key)
                out[0 if positive else 1].append(held)
    return out


class Rows:
    """A sparse 0/1 matrix by rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the rows, feature) of each entry of the chosen rows."""
        n = self.ends[rows + 1] - self.ends[rows]
        own = np.repeat(np.arange(len(rows)), n)
        return own, self.at[np.repeat(self.ends[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, sure: float = 2.0, runs: int = 3) -> Model:
    """The mean of ``runs`` linear classifiers of the non-negative risk with the sigmoid loss, by Adam."""
    p, u = Rows(positive), Rows(unlabelled)
    if not len(p) or not len(u) or not 0 < prior < 1:  # nothing to tell toxic texts by: the prior for all
        q = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(WIDTH), float(np.log(q / (1 - q))))
    in_p, in_u = (np.bincount(m.at, minlength=WIDTH) + 0.5 for m in (p, u))
    scale = np.maximum(np.log(in_p / (len(p) + 1) / (in_u / (len(u) + 1))) - sure * np.sqrt(1 / in_p + 1 / in_u), 0)
    kept = np.flatnonzero(scale)
    place, scale = np.full(WIDTH, -1), scale[kept]
    place[kept] = np.arange(len(kept))
    p, u = (Rows([(x := place[r])[x >= 0] for r in rows]) for rows in (positive, unlabelled))
    total, bias = np.zeros(len(kept)), 0.0
    for run in range(runs):
        rng, w = np.random.default_rng(run), np.append(np.zeros(len(kept)), -1.0)  # the bias is last
        first, second = np.zeros_like(w), np.zeros_like(w)
        for k in range(1, steps + 1):
            (own_p, at_p), (own_u, at_u) = p.take(rng.integers(0, len(p), batch // 2)), u.take(rng.integers(0, len(u), batch))
            f_p, f_u = (np.bincount(own, w[at] * scale[at], n) + w[-1] for own, at, n in ((own_p, at_p, batch // 2), (own_u, at_u, batch)))
            s_p, s_u = sigmoid(f_p), sigmoid(f_u)
            slope_p, slope_u = s_p * (1 - s_p) / len(f_p), s_u * (1 - s_u) / len(f_u)
            if s_u.mean() >= prior * s_p.mean():
                g_p, g_u = -2 * prior * slope_p, slope_u
            else:  # the risk of negatives is below zero: away from it
                g_p, g_u = prior * slope_p, -slope_u
            g = decay * w
            g[:-1] += scale * (np.bincount(at_p, g_p[own_p], len(kept)) + np.bincount(at_u, g_u[own_u], len(kept)))
            g[-1] = g_p.sum() + g_u.sum()
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        total, bias = total + w[:-1] * scale / runs, bias + w[-1] / runs
    weights = np.zeros(WIDTH)
    weights[kept] = total
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the labels (doc_id, toxic) for whose rows ``learn``, a condition on doc_id, holds.

    The class prior is the share of toxic labels among all of them; of several labels of an id, one
    that says toxic confirms it. The classifier is fitted on at most POSITIVE confirmed and UNLABELLED
    other rows, chosen by a hash of the id; texts that repeat count once.
    """
    small_batches(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    toxic, all_ = labels.filter(learn & F.col("toxic").isNotNull()).agg(F.count_if(F.col("toxic") == 1), F.count("*")).head()
    texts = keyed(docs, id_col, text_col)
    return fit(*sample_features(texts, sampled(texts, labels, learn)), toxic / max(all_, 1))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) of every document.

    A text's score sums its distinct words' weights. Null and empty texts have no words, so the bias
    alone; repeated rows give a row each, with equal scores; null ids are no exception; other columns
    are ignored. Texts of any length are read whole. Scripts without spaces between words are told by the
    beginnings of their runs alone. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    weights, bias = model.weights, model.bias

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda word: float(weights[word_features(word)].sum()))
        for batch in batches:
            # sorted, so that equal texts have equal scores to the last bit
            logits = [bias + sum(sorted(map(known.__getitem__, words_of(text.as_py())))) for text in batch.column("text")]
            known.trim()
            scores = sigmoid(np.array(logits))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
