"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves a whole pre-token in one probe.
Second tier: pre-tokens outside the vocabulary are merged with a heap over their linked bytes.
Ids and decoded bytes equal those of the ``tiktoken`` library for the same ranks.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from tidegauge.llm import merging
from tidegauge.llm.tables import keyed, small_batches
from tidegauge.llm.wordbpe import Memo, model_of, shared_file


class PerfectHash:
    """n distinct byte strings on n slots, by hash and displace.

    Keys fall into n/2 buckets. Larger buckets first, each gets the first seed that sends all its
    keys to free slots; a bucket of one key gets a free slot outright (stored as -slot-1).
    """

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.n, self.r = n, max(1, n // 2)
        self.shift = np.zeros(self.r, np.int64)
        self.keys: list[bytes | None] = [None] * n
        buckets: dict[int, list[bytes]] = {}
        for k in keys:
            buckets.setdefault(xxhash.xxh3_64_intdigest(k, 0) % self.r, []).append(k)
        singles = []
        for b, own in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                singles.append((b, own[0]))
                continue
            seed = 1
            while True:
                slots = {xxhash.xxh3_64_intdigest(k, seed) % n for k in own}
                if len(slots) == len(own) and all(self.keys[s] is None for s in slots):
                    break
                seed += 1
            self.shift[b] = seed
            for k in own:
                self.keys[xxhash.xxh3_64_intdigest(k, seed) % n] = k
        free = (i for i, k in enumerate(self.keys) if k is None)
        for b, k in singles:
            slot = next(free)
            self.shift[b] = -slot - 1
            self.keys[slot] = k
        self.shift = self.shift.tolist()

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 if it isn't one of the keys."""
        s = self.shift[xxhash.xxh3_64_intdigest(key, 0) % self.r]
        s = -s - 1 if s < 0 else xxhash.xxh3_64_intdigest(key, s) % self.n
        return s if self.keys[s] == key else -1


class ByteBpe:
    """A vocabulary of ranks, from the bytes of its ``tiktoken`` file and a pre-token pattern."""

    def __init__(self, data: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.words = regex.compile(pattern)
        self.whole = PerfectHash(list(ranks))
        self.rank_at = [-1 if k is None else ranks[k] for k in self.whole.keys]
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for k, r in ranks.items():
            self.bytes_of[r] = k
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: every way to make a token of two tokens; its rank and its id are the same number
        self.pairs = {ranks[k[:i]] << merging.SHIFT | ranks[k[i:]]: r for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
        self.made = range(len(self.bytes_of))
        self.known = Memo(self.word_ids)
        self.decimal = list(map(str, self.made))

    def word_ids(self, word: str) -> list[int]:
        data = word.encode()
        if (s := self.whole.slot(data)) >= 0:
            return [self.rank_at[s]]
        return merging.merge([self.single[b] for b in data], self.pairs, self.made, True)[1]

    def encode(self, text: str) -> list[int]:
        """The ids of all matches of the pattern in ``text``."""
        self.known.trim()
        return list(chain.from_iterable(map(self.known.__getitem__, self.words.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def packed(self, text: str) -> bytes:
        """The ids of ``text``, four bytes each."""
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def after_space(self, piece: str) -> bytes | None:
        """The packed ids of a space and ``piece``; None if white space at a border of the piece
        could join white space beyond it."""
        return self.packed(" " + piece) if piece and not piece[0].isspace() and not piece[-1].isspace() else None


def ids_of(model: ByteBpe, known: Memo, text: str) -> list[int]:
    """The ids of ``text``.

    A match of the pattern never holds a space behind its first character unless white space lies
    on both sides, so a text can be cut before single spaces; one that has longer runs of white
    space at such a cut is encoded whole.
    """
    first, *rest = text.split(" ")
    if not first or first[-1].isspace():
        return model.encode(text)
    known.trim()
    parts = list(map(known.__getitem__, rest))
    if None in parts:
        return model.encode(text)
    return np.frombuffer(b"".join((model.packed(first), *parts)), "<u4").tolist()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (the bytes that the ids stand for) of every document.

    Null and empty texts give no ids and no bytes; repeated ids give a row each; other columns are
    ignored. One pass over the input, without a shuffle.
    """

    def columns(model: ByteBpe, ids: list[int]) -> tuple:
        return ids, model.decode(ids)

    return _mapped(docs, path, pattern, id_col, text_col, columns, [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())], "ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with n_tokens, ids_sha256 (of the decimal ids, joined by commas) and
    decoded_sha256 in place of the ids and bytes."""

    def columns(model: ByteBpe, ids: list[int]) -> tuple:
        return len(ids), hashlib.sha256(",".join(map(model.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids)).hexdigest()

    return _mapped(docs, path, pattern, id_col, text_col, columns, [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def unicode_white(pattern: str) -> str:
    """``pattern`` with \\s as Unicode's White_Space, whatever the regex library takes it for."""
    return pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")


def _mapped(docs, path, pattern, id_col, text_col, columns, fields, schema) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark, mb=4)
    data = shared_file(spark, path)

    def build(raw: bytes) -> tuple[ByteBpe, Memo]:
        model = ByteBpe(raw, unicode_white(pattern))
        return model, Memo(model.after_space)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = model_of(("bytes", pattern), build, data)
        for batch in batches:
            out = [columns(model, ids_of(model, known, text.as_py())) for text in batch.column("text")]
            rows = list(zip(*out, strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, (_, t) in zip(rows, fields, strict=True))], ["doc_id", *(n for n, _ in fields)])

    return keyed(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {schema}")
