"""Words, word hashes and byte hashes of Arrow text columns, whole batches at a time with numpy.

A word is a run of code points outside ``[\\x20\\x09-\\x0D]``; as these are all ASCII, words can be cut in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000  # texts are hashed in pieces of about this size, at least one document each
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """Polynomial hashes of byte ranges. Powers are kept between chunks."""

    def __init__(self, seed: int = 7):
        self.codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 1))
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            size = 1 << int(n - 1).bit_length()
            back = np.uint64(pow(int(BASE), -1, 1 << 64))
            for name, base in (("power", BASE), ("inverse", back)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.power[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
        return mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TAB, A, LETTERS, CASE = np.uint8(9), np.uint8(65), np.uint8(26), np.uint8(32)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column of a record batch; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


class Words:
    """The words of documents first..last of a column: hashes, and the first word of each document."""

    def __init__(self, hasher: Hasher, data: np.ndarray, offsets: np.ndarray, first: int, last: int, lower: bool):
        at = offsets[first: last + 1] - offsets[first]
        data = data[offsets[first]: offsets[last]]
        self.bytes = data + (data - A < LETTERS) * CASE if lower else data
        inner = (data != 32) & (data - TAB > 4)  # uint8 wraps around
        begins, ends = inner.copy(), inner.copy()
        begins[1:] &= ~inner[:-1]
        ends[:-1] &= ~inner[1:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begins[edge] = inner[edge]       # a word never goes on into the next document
        ends[edge - 1] = inner[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.hash = hasher.ranges(hasher.sums(self.bytes), self.start, self.end)
        self.first = np.searchsorted(self.start, at)  # word range of document i: first[i], first[i + 1]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from i on, document of word i); a window is whole if both ends are of one document."""
        n = max(0, len(self.hash) - k + 1)
        total = np.zeros(n, np.uint64)
        factor = 1
        for j in range(k):
            factor = factor * 0xD1342543DE82EF95 % (1 << 64)
            total += self.hash[j: j + n] * np.uint64(factor)
        return mix(total + np.uint64(k)), self.document()

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def unpack(column, dtype) -> np.ndarray:
    """All values of a binary column, one after the other."""
    data, offsets = text_buffers(column)
    if not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype)
    return np.frombuffer(data[offsets[0]: offsets[-1]].tobytes(), dtype)
