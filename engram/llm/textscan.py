"""Vectorised word scanning of UTF-8 columns.

Both word classes the operators use are unions of bytes once A-Z is lowered: every byte of a non-ASCII
character is 0x80 or more and counts as a word byte. So words are found on bytes, with numpy, and no
Python object is made per word. Texts are scanned in pieces, so memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 18
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: `[^\x20\x09-\x0D]`.
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, dtype=U64)
            out[0] = 1
            _powers[i] = np.cumprod(out, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    starts: np.ndarray  # byte positions in the chunk
    ends: np.ndarray
    docs: np.ndarray  # row of the chunk
    hashes: np.ndarray

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; len - k + 1 of them, windows over two rows included."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        out = np.zeros(n, U64)
        for i in range(k):
            out = mix(out * U64(0x100000001B3) + self.hashes[i : i + n])
        return out

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each word on belong to one row."""
        n = len(self.docs) - k + 1
        return self.docs[k - 1 :] == self.docs[:n] if n > 0 else np.zeros(0, bool)


def _piece(b: np.ndarray, at: int, end: int, word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = b[at:end]
    m = word[part]
    before = np.empty(len(m), bool)
    before[0] = False
    before[1:] = m[:-1]
    inner = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, end)] - at
    before[inner] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty(len(m), bool)
    after[-1] = False
    after[:-1] = m[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    power, inverse = _power_tables(len(m) + 1)
    total = np.zeros(len(m) + 1, U64)
    np.cumsum((part.astype(U64) + U64(1)) * power[: len(m)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))
    return starts + at, ends + at, hashes


def scan(b: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Words:
    """Words of the rows `b[offsets[i]:offsets[i + 1]]`; b is already lower-cased if that is wanted."""
    starts, ends, hashes = [], [], []
    bounds = np.unique(offsets)
    at, n = 0, len(b)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            gaps = np.flatnonzero(~word[b[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the piece: go on to its end
                while end < n and word[b[end]].all():
                    gap = np.flatnonzero(~word[b[end : end + PIECE]])
                    end = end + int(gap[0]) + 1 if len(gap) else min(n, end + PIECE)
                    if len(gap):
                        break
        s, e, h = _piece(b, at, end, word, bounds)
        starts.append(s)
        ends.append(e)
        hashes.append(h)
        at = end
    if not starts:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, U64))
    s = np.concatenate(starts)
    docs = np.searchsorted(offsets, s, side="right") - 1
    return Words(s, np.concatenate(ends), docs, np.concatenate(hashes))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, end row, bytes, offsets from 0. A longer row is a run of its own."""
    b, offsets = raw(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def per_row(values: np.ndarray, docs: np.ndarray, rows: int) -> np.ndarray:
    """Sum of values by row."""
    return np.bincount(docs, weights=values, minlength=rows).astype(np.int64)
