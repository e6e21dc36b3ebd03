"""Sequence packing along a space-filling curve.

A document's token counts, hashed to a vector, are projected to a few dimensions; the Hilbert key
of that point is the sort key. Documents are range-partitioned by (key, id), so neighbours in a
partition are near each other in content, and each partition's stream of tokens is cut into
sequences. The last, shorter stretch of a partition is cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.tables import keyed, mixed, settle, small_batches
from tidegauge.llm.wordbpe import encoder, model_of, shared_file

#: Width of the hashed vector, dimensions it is projected to, bits of the curve in each.
WIDTH, DIMS, BITS = 256, 3, 16
#: Sequence ids of a partition start at its index times this.
PER_PARTITION = 1 << 40


def projection() -> np.ndarray:
    """WIDTH x DIMS signs from a fixed hash: the same projection in every task."""
    cells = np.arange(WIDTH * DIMS, dtype=np.uint64) + np.uint64(1)
    return (((mixed(cells * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) & np.uint64(1)).astype(np.float64) * 2 - 1).reshape(WIDTH, DIMS)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position along the Hilbert curve of each row of whole numbers below 2**bits.

    Skilling's transform (2004): undo the excess of each bit level, Gray-code, then interleave.
    """
    x = [c.astype(np.int64).copy() for c in points.T]
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(up, x[0] ^ (q - 1), x[0]) ^ swap
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ flip) >> b & 1)
    return key


def curve_keys(bags: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each array of token ids."""
    signs = projection()
    vectors = np.stack([np.bincount(b % WIDTH, minlength=WIDTH).astype(np.float64) for b in bags])
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    points = np.sqrt(3.0) * (vectors / np.maximum(norms, 1e-12)) @ signs  # each coordinate is about 1 in size
    return hilbert(np.clip((np.tanh(points / 2) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64))


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, hkey and tokens (ids with ``end_id`` after them, two bytes each) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    data, end = shared_file(spark, path), struct.pack("<H", end_id)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = model_of(("ids",), encoder, data)
        for batch in batches:
            bags = []
            for text in batch.column("text"):
                known.trim()
                model.packed_of.trim()
                parts = ((struct.pack("<H", model.special[p]),) if isinstance(p, str) else map(known.__getitem__, p) for p in model.stretches(text.as_py()))
                bags.append(np.frombuffer(b"".join(chain(chain.from_iterable(parts), (end,))), "<u2"))
            keys = curve_keys(bags) if bags else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array([b.tobytes() for b in bags], pa.binary())], ["doc_id", "hkey", "tokens"])

    return keyed(docs).mapInArrow(run, "doc_id long, hkey long, tokens binary")


class Packer:
    """Cuts a stream of documents into full sequences; ``close`` cuts the rest into powers of two."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence, self.fill = size, first_sequence, 0
        self.open: list[tuple[int, int, np.ndarray, int]] = []
        self.rows: list[tuple] = []

    def add(self, doc: int, tokens: np.ndarray) -> None:
        at, n = 0, len(tokens)
        while at < n:
            take = min(n - at, self.size - self.fill)
            self.open.append((doc, at, tokens[at : at + take], n))
            at, self.fill = at + take, self.fill + take
            if self.fill == self.size:
                self._emit(self.size)

    def close(self) -> None:
        while self.fill:
            self._emit(1 << (self.fill.bit_length() - 1))

    def _emit(self, length: int) -> None:
        """The first ``length`` tokens of the open stretch become a sequence."""
        at = 0
        while at < length:
            doc, start, tokens, n = self.open.pop(0)
            take = min(len(tokens), length - at)
            self.rows.append((doc, start, take, zlib.crc32(tokens[:take].astype("<u4").tobytes()), n, self.sequence, at, tokens[:take]))
            if take < len(tokens):
                self.open.insert(0, (doc, start + take, tokens[take:], n))
            at += take
        self.fill -= length
        self.sequence += 1

    def take(self, keep_ids: bool) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        if keep_ids:
            names, arrays = [*names, "ids"], [*arrays, pa.array([t.astype(np.int32) for t in columns[7]], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, path: str, size: int = 4096, end_id: int = 2, partitions: int | None = None, keep_ids: bool = False) -> DataFrame:
    """Every document's pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, if ``keep_ids``, ids (the piece itself as an array of int).

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty text is the end id
    alone. Repeated rows are packed each for itself; equal keys are ordered by id, then length. No
    documents give no pieces. The text is tokenised once and written to the shared folder; a range
    partition on (key, id) is the only shuffle, and documents with one key are split by id.
    ``partitions`` bounds a task's share; unset, it is one for about 8 MB of tokens.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    bags = settle(tokenized(docs, path, end_id), "packing")
    if partitions is None:
        stored = bags.select(F.sum(F.length("tokens"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored >> 23, 1)
    ordered = bags.repartitionByRange(partitions, "hkey", "doc_id").sortWithinPartitions("hkey", "doc_id", F.length("tokens"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, TaskContext.get().partitionId() * PER_PARTITION)
        for batch in batches:
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("tokens"), strict=True):
                packer.add(doc, np.frombuffer(tokens.as_py(), np.uint16))
            yield packer.take(keep_ids)
        packer.close()
        yield packer.take(keep_ids)

    return ordered.select("doc_id", "tokens").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids)
