"""Tokens and their hashes for whole Arrow batches, without a Python loop over bytes or words.

A token is a run of ASCII letters, digits and underscores and of characters beyond ASCII. Its
hash is a polynomial over its bytes modulo 2**64, taken from one running sum over the batch.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64


def trimmed(run: Callable) -> Callable:
    """run, which maps batches, and at its end the memory that it freed given back: workers go on
    for a whole session, and each would keep what its largest task took."""

    @functools.wraps(run)
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return mapped


BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
WORD = np.zeros(256, bool)
WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = True
WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def raw(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each value starts; null counts as ''."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if col.null_count and (np.diff(at)[np.asarray(col.is_null())] != 0).any():
        return raw(col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else ""))
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def pieces(col: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, starts of the rows in these bytes), each of about
    size bytes or of one row, so that memory follows the longest text and not the batch."""
    data, at = raw(col)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Powers:
    """Powers of the base and of its inverse, as many as the longest piece so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 19)
            self.up, self.down = np.full(n, BASE, U), np.full(n, BASE_INVERSE, U)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)


def typography(data: np.ndarray) -> np.ndarray:
    """Places of the bytes of signs beyond ASCII that are no parts of words: U+00A0 to U+00BF but
    for the letters among them, general punctuation (U+2000 to U+206F) and that of U+3000 to U+303F."""
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3))
    lead = lead[lead + 1 < len(data)]
    kind, after = data[lead], data[lead + 1]
    two = lead[(kind == 0xC2) & (after >= 0xA0) & ~np.isin(after, (0xAA, 0xB5, 0xBA))]
    three, kind, after = (x[(kind != 0xC2) & (lead + 2 < len(data))] for x in (lead, kind, after))
    third = data[three + 2]
    quotes = (kind == 0xE2) & ((after == 0x80) | (after == 0x81) & (third <= 0xAF))
    wide = (kind == 0xE3) & (after == 0x80) & ~np.isin(third, (0x85, 0x86, 0x87))
    three = three[quotes | wide]
    return np.concatenate([two, two + 1, three, three + 1, three + 2])


def spans(data: np.ndarray, at: np.ndarray, word: np.ndarray = WORD, signs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each token, and the number of tokens before each row (and after the last).
    signs: typography() isn't part of any."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    w = word[data]
    if signs:
        w[typography(data)] = False
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edge = at[(at > 0) & (at < n)]
    first[edge] |= w[edge]
    last[edge - 1] |= w[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at, side="left")


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    powers.grow(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers.up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * powers.down[starts])


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n tokens within each row, and the number of runs before each row. A
    row with fewer than n tokens, but with any, has one run: all its tokens."""
    counts = np.diff(first)
    size = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    before = np.concatenate([[0], np.cumsum(size)])
    padded = np.concatenate([h, np.zeros(n, U)])
    row = np.repeat(np.arange(len(counts)), size)
    pos = np.arange(before[-1]) - before[row] + first[row]
    end = first[row + 1]
    out = np.zeros(len(pos), U)
    for k in range(n):
        q = pos + k
        out = mix(out * U(3) + np.where(q < end, padded[q], U(0)) + U(k + 1))
    return out, before
