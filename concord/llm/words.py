"""Words of whole Arrow text columns, found and hashed with numpy on the UTF-8 bytes.

A column slice becomes one byte buffer; words are runs of bytes of a class, so
no Python object is made per word.  Both classes used by the operators split
on ASCII bytes only, so multi-byte characters never need decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20          # texts worked on at once; a longer text is a slice of its own
LONG_WORD = 256                # longer words are hashed one by one

SPACE = np.ones(256, bool)     # [^\x20\x09-\x0D]+
SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)    # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOW_BYTES = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Row slices of about ``SLICE_BYTES`` of text each, at least one row."""
    if not batch.num_rows:
        return
    _, off = text_buffer(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(off, off[first] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    data: np.ndarray           # bytes of all rows (lower-cased on request)
    off: np.ndarray            # rows' byte offsets, n + 1
    start: np.ndarray          # words' first bytes
    end: np.ndarray            # and the bytes after their last
    first: np.ndarray          # rows' first words, n + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end)


def find(column: pa.Array, kind: np.ndarray = SPACE, lower: bool = False) -> Words:
    data, off = text_buffer(column)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = off[:-1][off[:-1] < off[1:]]            # first bytes of rows with text
    before[edge] = False
    after[edge[1:] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, off, start, end, np.searchsorted(start, off))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    size = end - start
    h = mix(size.astype(np.uint64) + M1)
    if not len(start):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at = 0
    while len(left):
        got = eight[start[left] + at] & LOW_BYTES[np.minimum(size[left] - at, 8)]
        h[left] = mix((h[left] ^ got) * M1 + np.uint64(at + 1))
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(data[start[k]:end[k]].tobytes())
    return h


def windows(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay in a row, and their first words."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1:])
    w = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        w = w * M1 + h[k: len(h) - n + 1 + k]
    return mix(w[keep]), keep


def covered(n_words: int, first: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of the words lie in any of the windows that begin at ``first``."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + size, -1)
    return np.cumsum(step)[:-1] > 0


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of word values by row."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[first[1:]] - total[first[:-1]]
