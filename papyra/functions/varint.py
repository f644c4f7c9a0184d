"""Whole numbers as variable-length bytes, for arrays at a time: seven bits a byte, the lowest first."""

from __future__ import annotations

import numpy as np


def pack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where the bytes of each number end) of numbers from 0, up to 64 bits."""
    v = v.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    ends = np.cumsum(size)
    start = ends - size
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        on = size > k
        more = np.where(size[on] > k + 1, 128, 0)
        out[start[on] + k] = ((v[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8)
    return out, ends


def unpack(raw: np.ndarray | bytes) -> np.ndarray:
    """The numbers of packed bytes, as signed 64 bits."""
    b = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    if not len(b):
        return np.zeros(0, np.int64)
    start = np.concatenate(([0], np.flatnonzero(b < 128)[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), start)


def zigzag(v: np.ndarray) -> np.ndarray:
    """Signed numbers as numbers from 0, small ones first."""
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzag(v: np.ndarray) -> np.ndarray:
    u = v.view(np.uint64)
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)
