"""Arrow string columns as flat code-point arrays, the common ground of the numpy operators.

A chunk joins whole texts (never a prefix) until about ``limit`` code points are
gathered, so memory follows the limit or the longest single text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_CHARS = 1 << 18

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Unicode White_Space code points (fixed values).
WHITE_SPACE = (
    9, 10, 11, 12, 13, 32, 133, 160, 5760,
    8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202,
    8232, 8233, 8239, 8287, 12288,
)


@dataclass
class Chunk:
    """Rows start..stop of a batch: their joined text, its code points and row offsets."""

    start: int
    stop: int
    text: str
    cp: np.ndarray
    off: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.off)

    def owner(self) -> np.ndarray:
        """The row (from 0 within the chunk) of each code point."""
        return np.repeat(np.arange(self.stop - self.start), self.lengths)


def chunks(column: pa.Array, limit: int = CHUNK_CHARS, rows: int = 1 << 16) -> Iterator[Chunk]:
    """Whole texts of an Arrow string array in chunks of at most so many rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(column)
    while start < n:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, base + limit, "right"))))
        text = "".join(column.slice(start, stop - start).to_pylist())
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        off = np.concatenate(([0], ends[start:stop] - base))
        yield Chunk(start, stop, text, cp, off)
        start = stop


@functools.cache
def class_table() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000
    )
    table[list(WHITE_SPACE)] = SPACE
    return table


@functools.cache
def lower_table() -> np.ndarray:
    """One-to-one lower case of every code point (those that grow stay as they are)."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true in member; a run never spans two rows."""
    if not len(member):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.empty(len(member), bool)
    before[0] = False
    before[1:] = member[:-1]
    edges = off[:-1][np.diff(off) > 0]
    before[edges] = False
    after = np.zeros(len(member), bool)
    after[:-1] = member[1:]
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)


def span_hashes(cp: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span cp[start:stop], equal for equal spans.

    Each code point is mixed with its place in the span and the results are summed.
    """
    if not len(start):
        return np.empty(0, np.uint64)
    length = stop - start
    total = int(length.sum())
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(total, dtype=np.int64) - np.repeat(first, length)
    value = cp[place + np.repeat(start, length)].astype(np.uint64)
    value += (place.astype(np.uint64) + np.uint64(1)) * _STEP
    return mix64(np.add.reduceat(mix64(value), first) + length.astype(np.uint64))
