"""Texts of an Arrow batch as flat numpy arrays: bytes, words, hashes.

All work is per byte or per word of a whole block of documents, never a Python
step per word.  A block holds :data:`BLOCK_BYTES` of text, or one document if
that is longer, so memory follows the block, not the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


#: A 64-bit value for each byte; the second table reads A-Z as a-z.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]

#: White space as the contracts write it: blank and \t to \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def give_back() -> None:
    """Return memory that is free but still held by this Python worker, which serves one stage after another."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library offers it
        ctypes.CDLL(None).malloc_trim(0)


def text_blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offset of each text, with a line feed after every text; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ended = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(ended, pa.ChunkedArray):
        ended = ended.combine_chunks()
    if len(ended) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ended.buffers()[1], np.int64, len(ended) + 1, ended.offset * 8)
    return np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class PrefixHash:
    """Hashes of any byte range of one buffer, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        size = len(data)
        steps = np.full(size + 1, BASE, np.uint64)
        steps[:1] = 1
        powers = np.cumprod(steps, dtype=np.uint64)
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data] * powers[:size], out=self.sums[1:])
        steps[:] = BASE_INVERSE
        steps[:1] = 1
        self.back = np.cumprod(steps, dtype=np.uint64)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, length: int) -> np.ndarray:
        """The hash of each window of ``length`` bytes, by its start."""
        size = len(self.sums) - length
        if size <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:-length]) * self.back[:size])


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each text's place in the list of words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    return start, end, np.searchsorted(start, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, A-Z lower-cased, and each text's place in the list."""
    data, offsets = flat_bytes(texts)
    start, end, places = word_ranges(data, offsets)
    return PrefixHash(data, LOWER_VALUES).ranges(start, end), places


def joined_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, by its first word."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    found = mix(words[:count] + U(size))
    for step in range(1, size):
        found = mix(found * U(3) + words[step : count + step])
    return found


def shingle_sets(words: np.ndarray, places: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's set of ``size``-word shingles as sorted hashes.

    A text of fewer words is one shingle by itself; without words the set is empty.
    """
    runs = joined_hashes(words, size)
    sets = []
    for first, last in zip(places[:-1], places[1:], strict=True):
        if last - first >= size:
            sets.append(np.unique(runs[first : last - size + 1]))
        elif last > first:
            sets.append(joined_hashes(words[first:last], int(last - first)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def as_long(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(values).view(np.int64)
