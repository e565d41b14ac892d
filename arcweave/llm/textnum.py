"""Words of whole texts as numpy arrays: no Python loop touches a word.

A word is a maximal run of ASCII letters, digits and non-ASCII characters; ASCII punctuation and white space,
Latin-1 punctuation (U+0080 to U+00BF), general punctuation (U+2000 to U+207F) and U+3000 to U+303F separate words.
ASCII and Latin-1 capitals are folded. Everything works on the UTF-8 bytes of a whole Arrow batch at once. A word's hash
sums its pieces of 8 bytes, each put through a 64-bit finaliser with its place and length, so that no pattern of bytes
(as Thue-Morse strings under a polynomial modulo 2**64) makes words collide. Memory is some 12 bytes a byte of text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_LUT = np.zeros(256, np.uint8)
for _c in range(48, 58):
    _LUT[_c] = _c
for _c in range(97, 123):
    _LUT[_c] = _LUT[_c - 32] = _c
_LUT[128:] = np.arange(128, 256)
try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library keeps what it keeps
    _trim = None


def give_back() -> None:
    """Return freed memory to the system: a worker lives on, and what it keeps counts for the next task too."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x and seed."""
    x = x + U((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (length + 1); null reads as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words(NamedTuple):
    """All words of a batch. rows[i]:rows[i + 1] are the words of text i; start and end are byte positions in the folded
    bytes, which 8 zeros follow."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray

    def _eight(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes at[i] : at[i] + size[i], 8 at most, as one number."""
        wide = np.ndarray((len(self.data) - 7,), "<u8", self.data, 0, (1,))
        return wide[at] & (U(0xFFFFFFFFFFFFFFFF) >> ((U(8) - size.astype(U)) << U(3)))

    def hash(self, seed: int = 0) -> np.ndarray:
        """A hash of each word; equal words have equal hashes wherever they stand."""
        size = self.end - self.start
        out = mix(self._eight(self.start, np.minimum(size, 8)) ^ (size.astype(U) << U(56)), 23)
        if len(long := np.flatnonzero(size > 8)):
            more = (size[long] - 1) // 8
            first = np.cumsum(more) - more
            k = np.arange(more.sum()) - np.repeat(first, more) + 1
            of = np.repeat(long, more)
            at = self.start[of] + 8 * k
            part = mix(self._eight(at, np.minimum(self.end[of] - at, 8)) ^ mix(k.astype(U), 29), 31)
            out[long] += np.add.reduceat(part, first) + mix(size[long].astype(U), 37)
        return mix(out, seed)

    def heads(self, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
        """Hashes of the first n bytes, 8 at most, of the words `at`."""
        return mix(mix(self._eight(self.start[at], np.full(len(at), n)), 41), seed)

    def of_row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def fold(data: np.ndarray) -> np.ndarray:
    """Folded bytes, 0 where a separator stands, and 8 zeros after them."""
    out = np.zeros(len(data) + 8, np.uint8)
    out[: len(data)] = _LUT[data]
    if len(data) and data.max() >= 0xC2:
        lead = np.flatnonzero(data[:-1] == 0xC3)
        tail = out[lead + 1]
        out[lead + 1] = np.where((tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97), tail + 32, tail)
        at = np.flatnonzero(data[:-1] == 0xC2)
        out[at] = out[at + 1] = 0
        at = np.flatnonzero(((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81))) | ((data[:-2] == 0xE3) & (data[1:-1] == 0x80)))
        for k in range(3):
            out[at + k] = 0
    return out


def words(texts: pa.Array) -> Words:
    data, offsets = buffers(texts)
    low = fold(data)
    inside = low[: len(data)] != 0
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        first[heads] = inside[heads]
        last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(low, start, end, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, rows: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of q words that stay within a row, and their row pointers."""
    n = np.diff(rows)
    count = np.maximum(n - q + 1, 0)
    out_rows = np.concatenate([[0], np.cumsum(count)])
    if not len(hashes) or not count.sum():
        return np.zeros(0, U), out_rows
    acc = mix(hashes, 1)
    width = len(hashes) - q + 1
    total = acc[:width].copy()
    for k in range(1, q):
        total *= U(_P)
        total += acc[k : k + width]
    at = np.arange(out_rows[-1]) + np.repeat(rows[:-1] - out_rows[:-1], count)
    return mix(total[at]), out_rows


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text, so that memory doesn't depend on the batch."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_string())
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()
