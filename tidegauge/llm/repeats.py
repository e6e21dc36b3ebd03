"""Removal of repeated byte strings by anchored span hashing, in place of bucket-pointer refinement.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in the corpus.

Sorting every suffix of the corpus isn't affordable, and only strings that occur twice matter, so the
buckets are refined on a content-defined subset of positions. Each start i points to its owner: among
the positions i ... i+length-gram, the one with the least gram hash (the last of equals). That choice
depends on the string alone, so equal strings have equal owners at equal distances. The initial
buckets are the grams of ``gram`` bytes at owners. A bucket of one is final: its strings occur once.
Other buckets are refined by the identifiers of longer strings round the owner: first of the whole
stretch of starts that share it, which settles all of them at once if the stretch occurs again; what
is left is refined by halves of the stretch, the identifiers of the former level being reused as the
bucket of the next, down to single starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.minhash import among
from tidegauge.llm.tables import keyed, mixed, settle, small_batches

#: Starts treated at a time; places within such a segment fit 24 bits.
SEGMENT = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of ``gram`` bytes, from a rolling sum by doubling."""
    h = mixed(data.astype(np.uint64) + np.uint64(1))
    out, done, span, block = None, 0, 1, h
    n = len(data) - gram + 1
    while True:
        if gram & span:
            part = block[done : done + n]
            out = part.copy() if out is None else mixed(out * BASE + part)
            done += span
        if span * 2 > gram:
            return out
        block = mixed(block[: len(block) - span] * BASE + block[span:])
        span *= 2


def owners(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each start of ``length`` bytes in ``data``: the place of its owner."""
    reach = length - gram + 1
    h = gram_hashes(data, gram)
    key = (h & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(len(h), dtype=np.uint64))
    n = len(key) - reach + 1
    pad = -len(key) % reach
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n])
    return (np.uint64(0xFFFFFF) - (least & np.uint64(0xFFFFFF))).astype(np.int64)


def stretches(text: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(first start, last start, owner) of each run of starts with one owner, whole at segment ends."""
    held = None
    for at in range(0, len(text) - length + 1, SEGMENT):
        data = np.frombuffer(text, np.uint8, min(SEGMENT + length - 1, len(text) - at), at)
        own = owners(data, length, gram)
        edges = np.flatnonzero(np.diff(own)) + 1
        first = np.concatenate([[0], edges])
        runs = zip((first + at).tolist(), (np.concatenate([edges, [len(own)]]) - 1 + at).tolist(), (own[first] + at).tolist(), strict=True)
        for s, e, a in runs:
            if held is None or held[2] != a:
                if held:
                    yield held
                held = s, e, a
            else:
                held = held[0], e, a
    if held:
        yield held


def signed64(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


#: A place of the refinement: what it shares with others, and where it is.
PLACES = "bucket long, whole long, doc_id long, s int, e int, a int, mine boolean"


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    bucket, whole, doc, s, e, a, mine = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(whole, pa.int64()), pa.array(doc, pa.int64()), *(pa.array(x, pa.int32()) for x in (s, e, a)), pa.array(mine, pa.bool_())], ["bucket", "whole", "doc_id", "s", "e", "a", "mine"])


def first_level(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A place for each stretch: bucket by the owner's gram, whole by the span of all its strings."""
    small_batches(docs.sparkSession, rows=200, mb=2)
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = text.as_py().encode()
                out += [(signed64(digest(data[a : a + gram])), signed64(digest(data[s : e + length], a - s)), doc, s, e, a, True) for s, e, a in stretches(data, length, gram)]
            yield table_of(out)

    return docs.mapInArrow(run, PLACES)


def next_level(open_: DataFrame, docs: DataFrame, length: int, width: int) -> DataFrame:
    """Each place cut into blocks of ``width`` distances from the owner.

    A block's bucket is its former one with the core that all its strings share; its whole is the
    span of all its strings, null if that reaches beyond the text.
    """
    own = settle(open_.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "s", "e", "a", "mine")).alias("places")), "places")
    texts = among(docs, own.select(F.col("doc_id").alias("id"))).dropDuplicates(["doc_id"])
    small_batches(docs.sparkSession, rows=100, mb=2)
    digest = xxhash.xxh3_64_intdigest

    def blocks(doc: int, data: bytes, place: dict) -> Iterator[tuple]:
        s, e, a, bucket = place["s"], place["e"], place["a"], place["bucket"] & (1 << 64) - 1
        for j in range((a - e) // width, (a - s) // width + 1):
            last = a - j * width
            first = last - width + 1
            core = digest(data[last : first + length], digest(j.to_bytes(4, "little"), bucket))
            whole = signed64(digest(data[first : last + length])) if first >= 0 and last + length <= len(data) else None
            yield signed64(core), whole, doc, max(s, first), min(e, last), a, place["mine"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("places"), strict=True):
                data = text.as_py().encode()
                yield table_of([row for place in places.as_py() for row in blocks(doc, data, place)])

    return texts.join(own, "doc_id").select("doc_id", "text", "places").mapInArrow(run, PLACES)


def decided(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places whose whole occurs again, and those that must be refined.

    The latter come with one place of each repeated whole in their bucket (mine: false), against
    which they can still be found. Counts are aggregates and tags are joined back by key, so a hot
    bucket is pre-aggregated before the shuffle and split by the join.
    """
    spot = F.struct("doc_id", "s", "e", "a")
    wholes = places.groupBy("bucket", "whole").agg(F.count("*").alias("n"), F.min(spot).alias("spot"))
    totals = wholes.groupBy("bucket").agg(F.sum("n").alias("total"), F.sum(F.when((F.col("n") == 1) | F.col("whole").isNull(), 1).otherwise(0)).alias("single"))
    tags = settle(wholes.join(totals.filter("total > 1"), "bucket"), "tags")
    again = F.col("whole").isNotNull() & (F.col("n") > 1)
    known = tags.filter(again).select("bucket", "whole")
    repeated = places.filter("mine").join(known, ["bucket", "whole"], "left_semi").select("doc_id", "s", "e")
    others = tags.filter(again & (F.col("single") > 0)).select("bucket", "whole", "spot.*", F.lit(False).alias("mine"))
    unique = tags.filter(F.col("whole").isNotNull() & (F.col("n") == 1)).select("bucket", "whole", "spot.*")
    outside = places.filter("whole is null").join(tags.filter("whole is null").select("bucket"), "bucket", "left_semi")
    mine = places.filter("whole is not null").join(unique.select("bucket", "whole"), ["bucket", "whole"], "left_semi")
    return repeated, mine.select(*others.columns).union(outside.select(*others.columns)).union(others)


def without_repeats(docs: DataFrame, length: int = 400, gram: int = 200, widths: tuple[int, ...] = (32, 1), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``keep_text``, kept (the remaining
    bytes) of every document.

    Removed is each byte covered by a ``length``-byte string of the UTF-8 text that also starts
    anywhere else, in the same document or another; overlaps count and matches never cross
    documents. Null and empty texts have nothing to remove. Different texts should have different
    ids; rows that repeat an id and its text are copies of each other. Other columns are ignored.
    """
    docs = keyed(docs, id_col, text_col)
    places = settle(first_level(docs.filter(F.octet_length("text") >= length), length, gram), "places")
    spans = None
    for level, width in enumerate((0, *widths)):
        if level:
            places = settle(next_level(left, docs, length, width), "places")  # noqa: F821
        repeated, left = decided(places)
        if level < len(widths):
            left = settle(left, "left")
        repeated = repeated.select("doc_id", F.struct("s", (F.col("e") + length).alias("e")).alias("span"))
        spans = repeated if spans is None else spans.union(repeated)
        if level < len(widths) and not left.filter("mine").take(1):
            break
    own = spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    small_batches(docs.sparkSession, rows=200, mb=4)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, cut in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
                data, kept, at, runs = text.as_py().encode(), [], 0, 0
                for s, e in sorted((x["s"], x["e"]) for x in cut.as_py() or ()):
                    if s > at or not runs:
                        kept.append(data[at:s])
                        runs += 1
                    at = max(at, e)
                kept = b"".join((*kept, data[at:]))
                out.append((doc, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            rows = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=False)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text]
    return docs.join(own, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
