"""Media columns as baseline JPEG.

Writing: any bytes become the luminance DC terms of a grey baseline JPEG, one 8x8 block a byte, 64
blocks a row, with quantiser step 8, so that a block's mean is the byte itself. Each row of blocks
is a restart interval. Reading parses the markers, Huffman-decodes the scan of any baseline JPEG
(grey or colour, with or without AC terms and restarts) and rebuilds the DC-only luminance
thumbnail, a sample a block. Restart intervals don't depend on each other, so numpy decodes all of
them side by side, one symbol a step.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.tables import keyed, small_batches

#: Blocks in a row; bytes are padded to whole rows.
ROW = 64
#: Rows of blocks in an image: 65,535 lines of samples at most. More bytes go on in a next image.
MOST_ROWS = 8191
#: Rows encoded or decoded at a time.
CHUNK = 1 << 13
# The luminance DC code of the JPEG standard (ITU T.81, annex K.3), as the number of
# codes of each length from 1 to 16 and the symbols in order.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The only AC symbol that is written is "end of block", so its code is one bit.
AC_LENGTHS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)
# The zig-zag scan isn't needed for DC terms, so only its first place is used.


def codes(lengths: Iterable[int], symbols: Iterable[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical Huffman table."""
    out, code, rest = {}, 0, iter(symbols)
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[next(rest)] = (code, n)
            code += 1
        code <<= 1
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(4096)
def header(rows: int) -> bytes:
    table = lambda kind, lengths, symbols: segment(0xC4, bytes([kind, *lengths, *symbols]))
    return b"".join([
        b"\xff\xd8",
        segment(0xDB, bytes([0]) + bytes([8] * 64)),
        segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
        table(0x00, DC_LENGTHS, DC_SYMBOLS),
        table(0x10, AC_LENGTHS, AC_SYMBOLS),
        segment(0xDD, struct.pack(">H", ROW)),
        segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _writer_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: its bits with the end of block, and how many they are."""
    dc, (eob, eob_n) = codes(DC_LENGTHS, DC_SYMBOLS), codes(AC_LENGTHS, AC_SYMBOLS)[0]
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = dc[s]
        value = code << s | (d if d >= 0 else d + (1 << s) - 1)
        bits[d + 255], sizes[d + 255] = value << eob_n | eob, n + s + eob_n
    return bits, sizes


BITS, SIZES = _writer_tables()


def scan_rows(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded segment, stuffed and padded with ones, of each row of ``ROW`` bytes."""
    level = samples.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.int16(0)) + 255
    values, sizes = BITS[diff].T.astype(np.uint64), SIZES[diff].T
    total = sizes.sum(axis=0)
    out = np.zeros((len(samples), int(total.max()) // 32 + 1), ">u4")
    held, n, word = np.zeros(len(samples), np.uint64), np.zeros(len(samples), np.int64), np.zeros(len(samples), np.int64)
    for value, size in zip(values, sizes, strict=True):  # all rows side by side, a byte a step
        held = held << size.astype(np.uint64) | value
        n += size
        full = np.flatnonzero(n >= 32)
        n[full] -= 32
        out[full, word[full]] = (held[full] >> n[full].astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        word[full] += 1
    pad = (32 - n).astype(np.uint64)
    out[np.arange(len(samples)), word] = (held << pad | (np.uint64(1) << pad) - np.uint64(1)) & np.uint64(0xFFFFFFFF)
    packed, wide = out.tobytes(), out.shape[1] * 4
    return [packed[i * wide : i * wide + (n + 7) // 8].replace(b"\xff", b"\xff\x00") for i, n in enumerate(total.tolist())]


def write(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of ``ROW`` bytes) as one image or several after each other."""
    parts: list[bytes] = []
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    for at in range(0, len(samples), CHUNK):
        parts += scan_rows(samples[at : at + CHUNK])
    marks = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
    out, row = [], 0
    for payload in payloads:
        images = []
        end = row + len(payload) // ROW
        while row < end:
            n = min(MOST_ROWS, end - row)
            images += [header(n), *chain.from_iterable(zip(parts[row : row + n - 1], cycle(marks))), parts[row + n - 1], b"\xff\xd9"]  # noqa: B905
            row += n
        out.append(b"".join(images))
    return out


class Image:
    """The parsed markers of one baseline JPEG and its entropy-coded segments."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.quant: dict[int, int] = {}
        self.tables: dict[int, np.ndarray] = {}
        self.restart, self.parts, at = 0, [], at + 2
        self.marks = b""  # the tables as they were read
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xD9:
                self.end = at + 2
                return
            if marker == 0xFF:  # fill byte
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                self.marks += body
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = lookup(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                at = self._segments(data, at)

    def _segments(self, data: bytes, at: int) -> int:
        """Cut the scan at its restart markers and take out the stuffed zeros; where it ends."""
        end = at
        while True:
            end = data.find(b"\xff", end)
            if end < 0:
                raise ValueError("the scan has no end")
            if data[end + 1] == 0:
                end += 2
            elif 0xD0 <= data[end + 1] <= 0xD7:
                self.parts.append(data[at:end].replace(b"\xff\x00", b"\xff"))
                at = end = end + 2
            else:
                self.parts.append(data[at:end].replace(b"\xff\x00", b"\xff"))
                return end

    def luminance(self, dc: np.ndarray) -> np.ndarray:
        """The thumbnail from all DC terms of the scan, in its order."""
        blocks, across, down, total = self.layout()
        h, v, q = self.components[self.scan[0][0]]
        wide, high = (max(c[i] for c in self.components.values()) for i in (0, 1))
        cols, rows = -(-self.width * h // (8 * wide)), -(-self.height * v // (8 * high))
        if len(self.scan) == 1:
            h = v = 1
        luma = dc.reshape(total, len(blocks))[:, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        # the mean of a block is an eighth of its DC term
        return np.clip(np.floor(luma[:rows, :cols] * self.quant[q] / 8 + 128.5), 0, 255).astype(np.uint8)

    def layout(self) -> tuple[list[int], int, int, int]:
        """The scan's component of each block of a unit, units in a row and column, units in all."""
        if len(self.scan) == 1:  # not interleaved: a unit is a block
            return [0], -(-self.width // 8), -(-self.height // 8), -(-self.width // 8) * -(-self.height // 8)
        h, v = (max(c[i] for c in self.components.values()) for i in (0, 1))
        blocks = [i for i, (c, _, _) in enumerate(self.scan) for _ in range(self.components[c][0] * self.components[c][1])]
        across, down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        return blocks, across, down, across * down


@lru_cache(64)
def lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits: the code's length << 8 | symbol; 0 where no code begins so."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, (code, n) in codes(lengths, symbols).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return out


def decode_dc(parts: list[bytes], blocks: list[int], tables: list[tuple[np.ndarray, np.ndarray]], units: np.ndarray) -> np.ndarray:
    """DC terms of all blocks: an array (parts, blocks of the longest part).

    ``units``: in how many units each part ends. All parts advance by one block a step: a Huffman
    symbol and its difference, then AC symbols until the last part has ended its block.
    """
    per, want = len(blocks), units * len(blocks)
    buf = np.frombuffer(b"".join(p + b"\xff" * 8 for p in parts) + b"\xff" * 8, np.uint8)
    words = np.zeros(len(buf) - 7, np.uint64)  # the 64 bits from each byte on
    for k in range(8):
        words |= buf[k : k + len(words)].astype(np.uint64) << np.uint64(56 - 8 * k)
    sizes = np.array([len(p) + 8 for p in parts], np.int64)
    limit = np.cumsum(sizes) * 8
    place = limit - sizes * 8
    out = np.zeros((len(parts), int(want.max())), np.int32)
    before = np.zeros((len(tables), len(parts)), np.int64)
    u64 = np.uint64
    live = np.arange(len(parts))
    for block in range(int(want.max())):
        if (ended := want[live] <= block).any():
            live = live[~ended]
        comp = blocks[block % per]
        dc, ac = tables[comp]
        p = place[live]
        if (p > limit[live] - 64).any():
            raise ValueError("the scan is cut short")
        bits = words[p >> 3] << (p & 7).astype(u64)
        hit = dc[(bits >> u64(48)).astype(np.int64)]
        length, size = hit >> 8, hit & 15
        missing = (hit == 0).any()
        bits <<= length.astype(u64)
        raw = (bits >> u64(1) >> (63 - size).astype(u64)).astype(np.int64)
        low = (1 << size) - 1  # a first bit of 0 means a negative difference
        before[comp, live] += np.where(bits >> u64(63) == 1, raw, raw - low) * (size > 0)
        out[live, block] = before[comp, live]
        bits <<= size.astype(u64)
        hit = ac[(bits >> u64(48)).astype(np.int64)]
        missing |= (hit == 0).any()
        p = p + length + size + (hit >> 8) + (hit & 15)
        if (more := (hit & 0xFF) != 0).any():
            k = np.where(more, 1 + (hit >> 4 & 15) + 1, 64)
            while (on := np.flatnonzero(k < 64)).size:
                hit = ac[(words[p[on] >> 3] << (p[on] & 7).astype(u64) >> u64(48)).astype(np.int64)]
                missing |= (hit == 0).any()
                p[on] += (hit >> 8) + (hit & 15)
                k[on] += np.where((hit & 0xFF) == 0, 64, (hit >> 4 & 15) + 1)
                p = np.minimum(p, limit[live] - 8)
        if missing:
            raise ValueError("a code isn't in its table")
        place[live] = p
    return out


def images_of(data: bytes) -> list[Image]:
    out, at = [], 0
    while at < len(data):
        out.append(Image(data, at))
        at = out[-1].end
    return out


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail of each image, a sample a block.

    Restart intervals of images with the same tables and layout are decoded side by side.
    """
    alike: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        alike.setdefault((tuple(image.scan), tuple(image.layout()[0]), image.marks), []).append(i)
    out: list[np.ndarray] = [None] * len(images)  # type: ignore[list-item]
    for own in alike.values():
        first = images[own[0]]
        blocks = first.layout()[0]
        tables = [(first.tables[d], first.tables[0x10 | a]) for _, d, a in first.scan]
        parts, units, owners = [], [], []
        for i in own:
            image = images[i]
            total = image.layout()[3]
            per_part = image.restart or total
            parts += image.parts
            units += [min(per_part, total - per_part * j) for j in range(len(image.parts))]
            owners += [i] * len(image.parts)
        order = np.argsort(-np.array(units), kind="stable") if len(set(units)) > 1 else np.arange(len(units))
        rows: list[np.ndarray] = [None] * len(parts)  # type: ignore[list-item]
        for at in range(0, len(order), CHUNK):
            some = order[at : at + CHUNK]
            n = np.array([units[j] for j in some], np.int64)
            for j, u, row in zip(some.tolist(), n.tolist(), decode_dc([parts[j] for j in some], blocks, tables, n), strict=True):
                rows[j] = row[: u * len(blocks)]
        at = 0
        for i in own:
            n = len(images[i].parts)
            out[i] = images[i].luminance(np.concatenate(rows[at : at + n]))
            at += n
    return out


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: which cells of an 8x8 grid over the thumbnail are above the mean of all cells."""
    rows, cols = (np.arange(8) * n // 8 for n in thumb.shape)
    sums = np.add.reduceat(np.add.reduceat(thumb, rows, 0, dtype=np.int64), cols, 1)
    high, wide = (np.maximum(np.diff(at, append=n), 1) for at, n in zip((rows, cols), thumb.shape, strict=True))
    means = sums / (high[:, None] * wide)
    return int.from_bytes(np.packbits(means > means.mean()).tobytes(), "big")


def read_back(media: list[bytes]) -> list[tuple[bytes, int, int, int, list[int]]]:
    """Of each: the samples of all its images, the first's width, the sum of heights, the number of
    images and their hashes."""
    images = [images_of(m) for m in media]
    thumbs = iter(thumbnails([x for own in images for x in own]))
    out = []
    for own in images:
        mine = [next(thumbs) for _ in own]
        out.append((b"".join(t.tobytes() for t in mine), own[0].width, sum(x.height for x in own), len(own), [average_hash(t) for t in mine]))
    return out


def padded(data: bytes) -> bytes:
    """``data`` and zeros up to a positive multiple of 64 bytes."""
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the JPEG) of every document.

    Null and empty texts are stored as 64 zeros; repeated ids give a row each; other columns are
    ignored. Equal texts give equal media. One pass, without a shuffle.
    """
    small_batches(docs.sparkSession, mb=4)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_py().encode() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(write([padded(r) for r in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Read ``media`` back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, width, height and feature (dimensions and thumbnail hashes as text).

    Null media give null in all columns but doc_id and n_bytes.
    """
    small_batches(media.sparkSession, mb=4)
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("feature", pa.string())]

    def row(data: bytes, back: tuple) -> tuple:
        samples, width, height, n, hashes = back
        what = f"{width}x{height}x{n}:" + ",".join(f"{h:016x}" for h in hashes)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), width, height, what

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column("media").to_pylist()
            stored = [m for m in media if m is not None]
            made = iter(row(m, back) for m, back in zip(stored, read_back(stored), strict=True))
            rows = list(zip(*((None,) * len(fields) if m is None else next(made) for m in media), strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, t) for v, (_, t) in zip(rows, fields, strict=True))], ["doc_id", "n_bytes", *(n for n, _ in fields)])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string")
