"""Vectorised word handling over Arrow string columns.

A batch is cut into slices of a few MB (never inside a document), so that the
temporary arrays stay small whatever the size of the batch or of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that belong to words split at white space.
NON_SPACE = ~_SPACE
#: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Maps A-Z to a-z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    kind = np.int64 if large else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of documents with at most `most` bytes, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of some documents: `first[d]:first[d + 1]` are those of document d."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same on every machine."""
        n = self.end - self.start
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        at8 = np.ndarray((len(self.raw) + 1,), "<u8", padded.data, strides=(1,))
        h = mix(n.astype(np.uint64) + np.uint64(seed * 2 + 1))
        if not len(n):
            return h
        h = mix(h ^ (at8[self.start] & _LOW_BYTES[np.minimum(n, 8)]))
        rest, k = np.flatnonzero(n > 8), 8
        while len(rest):
            left = n[rest] - k
            h[rest] = mix(h[rest] ^ (at8[self.start[rest] + k] & _LOW_BYTES[np.minimum(left, 8)]))
            rest, k = rest[left > 8], k + 8
        return h


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NON_SPACE) -> Words:
    """Maximal runs of the bytes marked in `inside`; none crosses a document's end."""
    is_in = inside[raw]
    n = len(raw)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = is_in[:-1], is_in[1:]
    edge = offsets[offsets < n]
    before[edge] = False
    edge = offsets[offsets > 0] - 1
    after[edge] = False
    start = np.flatnonzero(is_in & ~before)
    end = np.flatnonzero(is_in & ~after) + 1
    return Words(raw, start, end, np.searchsorted(start, offsets))


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those of first[1], and so on."""
    total = int(count.sum())
    at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if total else np.zeros(0, np.int64)
    return at + np.arange(total)
