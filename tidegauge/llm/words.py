"""Hashes of the words of whole Arrow batches, by array operations."""

from __future__ import annotations

import numpy as np

from tidegauge.llm.tables import mixed

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time; a single longer word is a piece of its own.
PIECE = 1 << 19
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; tables up to a few pieces are kept."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, PIECE + 1)
        held = np.ones(size, np.uint64)
        k = 1
        while k < size:
            m = min(k, size - k)
            held[k : k + m] = held[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
        if size <= 8 * PIECE:
            _powers[base] = held
    return held[:n]


def runs(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each stretch ``values[first:last]``; it depends on the values and their order alone.

    Sums of value times power from the start, so that a stretch is a difference of two of them.
    """
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    return mixed((sums[last] - sums[first]) * powers(INVERSE, n + 1)[first])


def words(data: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of ``data`` (bytes) between bytes b with ``is_gap[b]``."""
    edges = np.flatnonzero(np.diff(is_gap[data].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    starts, ends = edges[0::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        at = starts[i]
        hashes[i:j] = runs(data[at : ends[j - 1]], starts[i:j] - at, ends[i:j] - at)
        i = j
    return starts, ends, hashes


def minima(hashes: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """MinHash: for each group of ``hashes`` that begins at one of ``firsts``, ``n`` minima of 32 bits."""
    narrow = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(firsts), n), np.uint32)
    bounds = [*range(0, len(firsts), 1024), len(firsts)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):  # so much at a time that it stays in the cache
        begin = int(firsts[lo])
        part, own = narrow[begin : int(firsts[hi]) if hi < len(firsts) else len(narrow)], firsts[lo:hi] - begin
        for k in range(n):
            v = (part ^ _SALTS[2 * k]) * (_SALTS[2 * k + 1] | np.uint32(1))
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            out[lo:hi, k] = np.minimum.reduceat(v, own)
    return out


#: Two numbers for each of at most 256 minima.
_SALTS = (mixed(np.arange(1, 513, dtype=np.uint64) * np.uint64(BASE)) >> np.uint64(32)).astype(np.uint32)
