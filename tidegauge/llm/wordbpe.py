"""Token counts by heap-and-linked-list byte-pair merging, for a BPE vocabulary with word ends.

A document's count is the number of its initial symbols less the number of merges; no identifiers
are produced. The counts equal those of the ``tokenizers`` library for the same file.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidegauge.llm import merging
from tidegauge.llm.tables import keyed, small_batches

#: Results kept in a task's memory before it starts afresh; it bounds memory, not what is counted.
KNOWN = 500_000
#: Longer strings are worked out each time.
LONG = 64


#: Python's str.split takes these for white space; Unicode doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")


@cache
def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is a visible
    Latin-1 character, else the next code point from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return {b: chr(b if b in seen else next(rest)) for b in range(256)}


class WordBpe:
    """A vocabulary of BPE with word ends, from the bytes of its ``tokenizers`` JSON file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ", 1) for x in model["merges"]):
            self.pairs[self.vocab[a] << merging.SHIFT | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab[symbols[b]] for b in range(256)]
        self.last = [self.vocab[symbols[b] + end] for b in range(256)]
        self.any = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.ascii = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
        self.white = regex.compile(r"\p{White_Space}+")
        self.count_of, self.library, self.symbol_of = Memo(self.count_word), None, byte_symbols()
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))

    def stretches(self, text: str) -> Iterator[list[str] | str]:
        """The chunks between white space of each stretch of text between special strings (a list),
        and the special strings. No word crosses white space, so chunks can be treated alone."""
        at = 0
        for m in self.marks.finditer(text) if "<|" in text else ():
            yield self._chunks(text[at : m.start()])
            yield m.group()
            at = m.end()
        yield self._chunks(text[at:] if at else text)

    def _chunks(self, text: str) -> list[str]:
        return self.white.split(text) if SEPARATORS.search(text) else text.split()

    def words(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return self.ascii.findall(chunk.lower())
        # lower-casing is by character: no final form of sigma
        return self.any.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def symbols(self, word: str) -> list[int]:
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return ids

    def count_word(self, word: str) -> int:
        ids = self.symbols(word)
        return len(ids) - merging.merge(ids, self.pairs, self.made, False)[0]

    def count(self, chunk: str) -> int:
        """Tokens of a chunk: initial symbols less merges, word by word."""
        self.count_of.trim()
        return sum(map(self.count_of.__getitem__, self.words(chunk)))


class WordIds(WordBpe):
    """The same vocabulary, for ids, which the ``tokenizers`` library's model gives word by word."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        super().__init__(data)
        self.library = Tokenizer.from_str(data.decode()).model
        self.pairs, self.made = {}, []
        #: Chunks differ by case and punctuation more than words do.
        self.packed_of = Memo(self.packed_word, 2 * KNOWN)

    def packed_word(self, word: str) -> bytes:
        own = word if word.isascii() and word.isprintable() else "".join(map(self.symbol_of.__getitem__, word.encode()))
        ids = [t.id for t in self.library.tokenize(own)]
        return struct.pack(f"<{len(ids)}H", *ids)

    def packed(self, chunk: str) -> bytes:
        """A chunk's ids, two bytes each."""
        if chunk.isascii() and chunk.isalpha():
            return self.packed_of[chunk.lower()]
        return b"".join(map(self.packed_of.__getitem__, self.words(chunk)))


class Memo(dict):
    """Results by string; ``trim`` empties it when it has grown too large."""

    def __init__(self, of, most: int = KNOWN):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word):
        out = self.of(word)
        if len(word) <= LONG:
            self[word] = out
        return out

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


_models: dict = {}


def model_of(key: tuple, build, data):
    """What ``build`` makes of a broadcast file, kept in the worker from task to task."""
    key = (*key, data.value[0])
    if key not in _models:
        _models[key] = build(data.value[1])
    return _models[key]


def counter(data: bytes) -> tuple[WordBpe, Memo]:
    model = WordBpe(data)
    return model, Memo(model.count)


def encoder(data: bytes) -> tuple[WordIds, Memo]:
    model = WordIds(data)
    return model, Memo(model.packed, 2 * KNOWN)


def shared_file(spark, path: str):
    """The file as a broadcast: a vocabulary file, whose size doesn't depend on the tables."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((path, f.read()))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document.

    Null and empty texts have 0 tokens; repeated ids give a row each; other columns are ignored.
    A text of any length is one row: its longest run without a word border is merged in
    O(n log n). One pass over the input, without a shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    data = shared_file(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = model_of(("count",), counter, data)
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column("text"):
                text = text.as_py()
                known.trim()
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                counts.append(sum(1 if isinstance(part, str) else sum(map(known.__getitem__, part)) for part in model.stretches(text)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
