"""Partitions of unit vectors around pivots, and the bounds that tell which partitions can hold a neighbour.

Every vector belongs to the cell of its nearest pivot. Angles obey the triangle
inequality, so a vector within an angle of some member of a cell is within that angle
plus the cell's radius of its pivot; and it is within that angle of the half-space of
points that are nearer to this pivot than to its own. A vector visits a cell only if
both bounds allow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pivots at most: with their vectors they go along with the tasks (2048 of 768 numbers are 12 MB).
MAX_PIVOTS = 2048
#: Vectors that pivots are picked from, and that a choice of their number is tried on.
SAMPLE_ROWS = 4096
#: Rounding that bounds allow for, as an angle.
SLACK = 1e-6


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """Rows in the order of a farthest-first walk: every prefix is spread as far as the walk can."""
    order, near = [0], x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        at = int(near.argmin())
        if near[at] > 1 - 1e-9:
            break
        order.append(at)
        near = np.maximum(near, x @ x[at])
    return x[order]


class Cells:
    """Pivots with the radius of each cell; ``reach`` tells the cells that a vector has to visit."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray | None = None):
        self.pivots, self.radius = pivots, radius
        product = pivots @ pivots.T
        # Twice the sine of half the angle between two pivots is their distance.
        self.apart = np.sqrt(np.maximum(2 - 2 * product, 0.0))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, angle to its pivot) of each vector; the first of equally near pivots."""
        cosine = x @ self.pivots.T
        own = cosine.argmax(axis=1)
        return own, angle(cosine[np.arange(len(x)), own])

    def reach(self, x: np.ndarray, within: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """(own cell, matrix of the cells with a member that may lie within the angle)."""
        cosine = x @ self.pivots.T
        own = cosine.argmax(axis=1)
        within = np.broadcast_to(np.asarray(within, float), (len(x),))[:, None] + SLACK
        near = angle(cosine) <= self.radius[None, :] + within
        gap = cosine[np.arange(len(x)), own][:, None] - cosine
        side = np.divide(gap, self.apart[own], out=np.zeros_like(gap), where=self.apart[own] > 1e-12)
        # The sine of the angle to the half-space, as long as that is a right angle at most.
        near &= side <= np.sin(np.minimum(within, np.pi / 2))
        near[np.arange(len(x)), own] = True
        return own, near


def choose(sample: np.ndarray, n: int, within: float, block_rows: int) -> np.ndarray:
    """Pivots for n vectors: of the numbers tried on the sample, the one that leaves the fewest pairs to compare.

    A number that would copy vectors more often than a plain grid of blocks does, or that
    leaves more than half of its comparisons, is left out: where angles tell nothing the
    grid remains (one pivot).
    """
    walk = spread_out(sample, min(MAX_PIVOTS, max(1, len(sample) // 2)))
    grid = max(1.0, n / block_rows)
    best, k = (0.25, walk[:1]), 4
    while k <= len(walk) and within < np.pi / 2:
        cells = Cells(walk[:k])
        own, far = cells.assign(sample)
        cells.radius = np.zeros(k)
        np.maximum.at(cells.radius, own, far)
        _, near = cells.reach(sample, within)
        lower = np.arange(k)[None, :] < own[:, None]
        visits = (near & lower).mean(axis=0)
        share = np.bincount(own, minlength=k) / len(sample)
        pairs = float((share * share / 2 + share * visits).sum())
        copies = float(visits.sum() + (share * np.ceil((share + visits) * n / block_rows)).sum())
        if copies <= max(4.0, grid) and pairs < best[0]:
            best = (pairs, walk[:k])
        k *= 2
    return best[1]


def sample_of(rows: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of about ``SAMPLE_ROWS`` rows, the same at every run; rows: id, v."""
    pool = 1 << 20
    cut = min(pool, 1 + pool * SAMPLE_ROWS // max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(pool)) < cut).select("v").limit(2 * SAMPLE_ROWS)
    x = np.array([r["v"] for r in picked.collect()], np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x.reshape(0, 0)


def assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, v, cell and far (the angle to the cell's pivot) of every row."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(pivots)
        for batch in batches:
            if batch.num_rows:
                own, far = cells.assign(unit(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"])

    return rows.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, v array<double>, cell int, far double")


def radii(held: DataFrame, k: int) -> tuple[np.ndarray, dict[int, int]]:
    """(radius, rows) of the cells of an assigned table: a row a pivot reaches the driver. An empty cell has none."""
    radius, rows = np.full(k, -np.inf), {}
    for r in held.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[r["cell"]], rows[r["cell"]] = r["far"], r["n"]
    return radius, rows


def visits(rows: DataFrame, pivots: np.ndarray, radius: np.ndarray, within: float | str, only_lower: bool, with_own: bool) -> DataFrame:
    """id, v and cell of every cell that a row has to visit: its own only if asked for, or only cells before its own.

    within: an angle, or the column that holds each row's own.
    """
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(pivots, radius)
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = batch.column("within").to_numpy() if isinstance(within, str) else within
            own, near = cells.reach(unit(batch.column("v")), angles)
            near &= np.isfinite(radius)[None, :]
            if only_lower:
                near &= np.arange(len(pivots))[None, :] < own[:, None]
            if not with_own:
                near[np.arange(len(own)), own] = False
            row, cell = np.nonzero(near)
            for a in range(0, len(row), 4096):
                part = pa.array(row[a : a + 4096])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(part), batch.column("v").take(part), pa.array(cell[a : a + 4096].astype(np.int32))], names=["id", "v", "cell"]
                )

    own = [F.col(within).alias("within")] if isinstance(within, str) else []
    return rows.select("id", F.col("v").cast("array<double>").alias("v"), *own).mapInArrow(run, f"id {kind}, v array<double>, cell int")
