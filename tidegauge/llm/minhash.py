"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

Documents with equal shingle sets are one class. A class is posted under each (coordinate, value)
pair of its signature. Two classes that agree in at least ``MATCHES`` of ``COORDINATES`` places must
meet in a list of their prefix, the rarest ``COORDINATES - MATCHES + 1`` of their pairs; the longer
lists are skipped and their collisions counted by comparing the signatures. What reaches the
threshold is confirmed on the full shingle sets. Within long lists, members that aren't in one
component yet are compared block by block inside tasks, which give only links between components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.inverted import resolve
from tidegauge.llm.tables import keyed, mixed, settle, settle_once, signed, small_batches
from tidegauge.llm.wordbpe import Memo
from tidegauge.llm.words import minima, words

#: Signature length, and agreeing places a candidate needs. Of pairs with similarity 0.8, fewer than
#: 27 of 48 places agree with probability 5e-5.
COORDINATES, MATCHES = 48, 27
PREFIX = COORDINATES - MATCHES + 1
#: At most so many ids are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members of a block, and shingles in all of them, about.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
ODD = np.uint64(0x9E3779B97F4A7C15)
#: White space between words is ASCII; A-Z are taken in lower case.
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_memo() -> Memo:
    """The 64-bit hash of a word (bytes), for operators that go word by word."""
    return Memo(xxhash.xxh3_64_intdigest)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-word shingles; of all words if they are fewer."""
    data = [t.as_py().encode() for t in texts]
    # a gap between texts, so that no word crosses
    starts, _, hashes = words(np.frombuffer(b" ".join(data).translate(_LOWER), np.uint8), _GAP)
    ends = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in data]))
    out = []
    for h in np.split(hashes, ends[:-1]):
        m = min(n, len(h))
        s = np.full(len(h) - m + 1 if m else 0, m, np.uint64)
        for i in range(m):
            s = mixed(s * ODD + h[i : i + len(s)])
        out.append(np.unique(s))
    return out


def signed_documents(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a 128-bit hash of the set) and tokens, a number for each
    coordinate and its value, of every document."""
    small_batches(docs.sparkSession, mb=4)
    place = np.arange(COORDINATES, dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), n)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            tokens = pa.nulls(len(sets), pa.list_(pa.int64()))
            if len(full):
                flat = np.concatenate(sets)
                found = minima(flat, (np.cumsum(sizes) - sizes)[full], COORDINATES).astype(np.int64) * 64 + place
                offsets = np.concatenate([[0], np.cumsum(sizes > 0)]) * COORDINATES
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.reshape(-1)))
            digest = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets]
            a, b = (signed(np.array([d[i] for d in digest], np.uint64)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(a), pa.array(b), tokens], ["doc_id", "n_shingles", "set_a", "set_b", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, tokens array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, shingles): the sets of the documents in ``ids`` (column id), eight bytes a shingle."""
    small_batches(docs.sparkSession, mb=4)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), n)], pa.binary())], ["id", "shingles"])

    return settle_once(among(docs, ids.select("id").distinct()).mapInArrow(run, "id long, shingles binary"), "sets")


def prefixes(classes: DataFrame) -> DataFrame:
    """(token, id, df): the postings of each class's rarest tokens that occur in two classes at least.

    Tokens that only one class has are the rarest of all: they fill the prefix, but give no list.
    """
    posted = classes.select("id", F.explode("tokens").alias("token"))
    counted = posted.join(posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "token")
    of_one = Window.partitionBy("id")
    nth = F.row_number().over(of_one.orderBy("df", "token")) + COORDINATES - F.count("*").over(of_one)
    return counted.withColumn("nth", nth).filter(F.col("nth") <= PREFIX).select("token", "id", "df")


def coordinates(column: pa.Array) -> np.ndarray:
    """A row of ``COORDINATES`` numbers for each (non-null) list of tokens."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)


def matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of ``pairs`` (a < b), the distinct ones whose signatures agree often enough, with ``matches``."""
    small_batches(pairs.sparkSession, rows=5000)
    side = lambda x: classes.select(F.col("id").alias(x), F.col("tokens").alias(f"of_{x}"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (coordinates(batch.column("of_a")) == coordinates(batch.column("of_b"))).sum(axis=1)
            on = n >= MATCHES
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("a").to_numpy()[on]), pa.array(batch.column("b").to_numpy()[on]), pa.array(n[on].astype(np.int32))], ["a", "b", "matches"])

    return pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long, matches int")


def among(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (column id, distinct), or is not ("left_anti")."""
    ids = settle(ids.select(F.col("id").alias("doc_id")), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those with 100 * intersection >= percent * union of the full sets."""
    small_batches(pairs.sparkSession, rows=1000, mb=8)
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"of_{x}"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # merges the two sorted runs
                n = int((both[1:] == both[:-1]).sum())
                keep.append(100 * n >= percent * (len(both) - n))
            on = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(on) for c in ("a", "b")], ["a", "b"])

    sized = lambda x: F.octet_length(f"of_{x}")
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    fits = 100 * F.least(sized("a"), sized("b")) >= percent * F.greatest(sized("a"), sized("b"))
    return both.filter(fits).select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def in_blocks(outside: DataFrame, members: DataFrame, columns: list[str], parts: Column) -> DataFrame:
    """Rows of a block x of ``outside`` and a block y of ``members`` of one list, both packed.

    ``parts`` is the number of blocks of the row's list; members are dealt to blocks by a hash, so a
    block's size is bounded whatever the list's, and so is a task's work.
    """
    block = F.pmod(F.xxhash64("id"), F.col("parts"))
    pack = lambda df, x: df.withColumn("parts", parts).withColumn("block", block).groupBy("token", "parts", "block").agg(F.collect_list(F.struct(*columns)).alias(x))
    x = pack(outside, "x").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("token", "to", "x")
    return x.join(pack(members, "y").select("token", F.col("block").alias("to"), "y"), ["token", "to"]).select("token", "x", "y")


def alike(x: np.ndarray, y: np.ndarray, c_x: np.ndarray, c_y: np.ndarray) -> np.ndarray:
    """Which pairs of signatures agree often enough and lie in different components."""
    n = np.zeros((len(x), len(y)), np.uint8)
    for k in range(COORDINATES):
        n += x[:, k, None] == y[None, :, k]
    return (n >= MATCHES) & (c_x[:, None] != c_y[None, :])


def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a set of ``x`` with one of ``y``: a product of 0/1 matrices
    over the elements that both sides have, a few thousand at a time."""
    a, b = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(a, b)
    out = np.zeros((len(x), len(y)), np.float32)
    rows = [(np.repeat(np.arange(len(s)), [len(v) for v in s]), f) for s, f in ((x, a), (y, b))]
    places = []
    for row, flat in rows:
        at = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
        on = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[on], kind="stable")
        places.append((row[on][order], at[on][order]))
    for lo in range(0, len(common), 4096):
        m = []
        for (row, at), size in zip(places, (len(x), len(y)), strict=True):
            i, j = np.searchsorted(at, [lo, lo + 4096])
            one = np.zeros((size, min(4096, len(common) - lo)), np.float32)
            one[row[i:j], at[i:j] - lo] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out


def between(outside: DataFrame, members: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (a, b) that join the components c of lists' members, compared in blocks inside tasks.

    First signatures only, to find the members that have a candidate in another component of their
    list; then the full sets of these. A task gives at most a link for each component it sees.
    """
    spark = outside.sparkSession
    small_batches(spark, rows=4, mb=4)
    signs = classes.select("id", "tokens")
    by_count = F.ceil(F.col("df") / BLOCK).cast("long")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, last = set(), None
        for batch in batches:
            for token, x, y in zip(batch.column("token").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if token != last:  # rows of a list come one after the other
                    told, last = set(), token
                x, y = x.values, y.values
                on = alike(coordinates(x.field("tokens")), coordinates(y.field("tokens")), x.field("c").to_numpy(), y.field("c").to_numpy())
                new = {*x.field("id").to_numpy()[on.any(axis=1)].tolist(), *y.field("id").to_numpy()[on.any(axis=0)].tolist()} - told
                told |= new
                yield pa.RecordBatch.from_arrays([pa.array([token] * len(new), pa.int64()), pa.array(list(new), pa.int64())], ["token", "id"])

    columns = ["id", "c", "tokens"]
    involved = in_blocks(outside.join(signs, "id"), members.join(signs, "id"), columns, by_count).mapInArrow(meet, "token long, id long").distinct()
    out = outside.select("token", "id", F.lit(True).alias("out"))
    involved = settle(involved.join(members.select("token", "id", "c"), ["token", "id"]).join(out, ["token", "id"], "left"), "involved")
    if not involved.take(1):
        return spark.createDataFrame([], "a long, b long")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                found = links(x.values, y.values, percent)
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    full = sets_of(involved)
    rows = involved.join(full, "id").join(signs, "id")
    load = involved.join(full.select("id", (F.octet_length("shingles") / 8).alias("size")), "id").groupBy("token").agg(F.count("*").alias("df"), F.sum("size").alias("all"))
    rows = settle(rows.join(load, "token"), "members")
    by_size = F.ceil(F.greatest(F.col("df") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("long")
    return in_blocks(rows.filter("out"), rows, [*columns, "shingles"], by_size).mapInArrow(link, "a long, b long").distinct()


def links(x: pa.StructArray, y: pa.StructArray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links between members of two blocks, enough to join all components that have one."""
    ids, own = [s.field("id").to_numpy() for s in (x, y)], [s.field("c").to_numpy() for s in (x, y)]
    sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in s.field("shingles")] for s in (x, y)]
    sizes = [np.array([len(v) for v in s], np.int64) for s in sets]
    on = alike(coordinates(x.field("tokens")), coordinates(y.field("tokens")), *own)
    both = shared(*sets) if on.any() else np.zeros(on.shape, np.float32)
    on &= 100 * both.astype(np.int64) >= percent * (sizes[0][:, None] + sizes[1][None, :] - both.astype(np.int64))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in np.argwhere(on).tolist():
        a, b = root(int(own[0][i])), root(int(own[1][j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[0][i]), int(ids[1][j])))
    return out


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if the Jaccard similarity of their sets of n-word shingles is at least
    ``percent`` hundredths; component_id is the least doc_id reachable by links, and kept says that
    it is the document's own. Texts with fewer words have their whole sequence as the one shingle.
    Null and empty texts have no shingles and are linked with nothing. Rows that repeat an id and its
    text get equal rows. A null id is a class member like others, but never the least: it gets the
    least id of its group, null if there is none, and isn't kept. Other columns are ignored.
    """
    docs = keyed(docs, id_col, text_col)
    rows = settle(signed_documents(docs, n), "signatures")
    full = rows.filter("n_shingles > 0")
    classes = full.filter("doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("tokens").alias("tokens"))
    classes = settle(classes, "classes")
    lists = settle(prefixes(classes.select("id", "tokens")), "postings")
    sets_of = lambda ids: full_sets(docs, ids, n)

    found = resolve(
        [lists],
        candidates=lambda pairs: matching(pairs, classes),
        fetch=sets_of,
        confirm=lambda pairs, own: confirmed(pairs, own, percent),
        cross=lambda outside, members: between(outside, members, classes, sets_of, percent),
    )
    merged = classes.select("set_a", "set_b", "id").join(found, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component_id"))
    linked = full.select("doc_id", "n_shingles", "set_a", "set_b").join(merged, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
