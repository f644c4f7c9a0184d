"""Average linkage where very many pairs are near: clusters look for their nearest one, and pairs are never written.

The mean similarity of two clusters of unit vectors is the product of their mean
vectors, so a cluster is its size and its sum. In a round the clusters that do not know
their nearest one look for it among all that are left, in a grid of blocks of which a
task holds two, and every two that are each other's nearest merge. A merged cluster is
to no other nearer than the nearer of its parts was. So a cluster whose nearest one did
not merge keeps it, and one that has none above the cut is done. A round writes the
clusters and, for each that asked, a row a block. Where few ask, they go along with the
tasks that read the others, as what changes then does, and no cluster is moved. What is
left is linked by one task as soon as it is a matrix of bounded size with few that ask.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pivots
from .components import connected_components
from .scratch import Scratch

#: Near pairs a vector from which on pairs are not written.
CROWD = 32
#: Bytes of the vectors of a block.
BLOCK_BYTES = 1 << 25
#: Vectors on either side of the products that a task holds at a time, which the cache of a core can keep.
TILE_ROWS = 512
#: Products of a task at least, so that small rounds take few tasks.
CELL_PRODUCTS = 1 << 24
#: Bytes of the vectors of those that ask up to which they go along with tasks, and up to which changes are sent to all.
ASKED_BYTES, CHANGED_BYTES = 1 << 22, 1 << 24
#: What is left is linked by one task if its vectors take so many bytes and its next round so many products at most.
LINK_BYTES, LINK_PRODUCTS = 1 << 26, 1 << 27
#: Part of the rows of a linking task that may be left over from merges until it copies the others.
LEFT_OVER = 0.25


def crowded(sample: np.ndarray, n: int, similarity: float) -> bool:
    """Whether n vectors like the sample have more near pairs a vector than ``CROWD``."""
    k = len(sample)
    near = sum(int((sample[a : a + 512] @ sample.T > similarity).sum()) for a in range(0, k, 512)) - k
    return k > 1 and near / (k * (k - 1.0)) * (n - 1) > CROWD


def best(x: np.ndarray, y: np.ndarray, both: bool = False, own: np.ndarray | None = None) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(places, products) of the y with the largest product of each x and, if both, the same of each y; the first of equal ones.

    own: the row of y that is each x itself, which it does not meet. Where y is x, rows
    do not meet themselves, and both results are one.
    """
    same = y is x
    own = np.arange(len(x)) if same else own
    there = np.zeros(len(x), int), np.full(len(x), -np.inf)
    back = there if same else (np.zeros(len(y), int), np.full(len(y), -np.inf))
    for c in range(0, len(y), TILE_ROWS):
        for a in range(0, c + 1 if same else len(x), TILE_ROWS):
            s = x[a : a + TILE_ROWS] @ y[c : c + TILE_ROWS].T
            if own is not None:
                at = own[a : a + TILE_ROWS] - c
                row = np.flatnonzero((at >= 0) & (at < s.shape[1]))
                s[row, at[row]] = -np.inf
            if both and not (same and a == c):
                most = s.max(axis=0)
                more = np.flatnonzero(most > back[1][c : c + TILE_ROWS])
                back[0][c + more], back[1][c + more] = a + s[:, more].argmax(axis=0), most[more]
            place = s.argmax(axis=1)
            most = s[np.arange(len(s)), place]
            more = np.flatnonzero(most > there[1][a : a + TILE_ROWS])
            there[0][a + more], there[1][a + more] = c + place[more], most[more]
    return there, back


def _blocks(asking: int, known: int, dims: int, tasks: int) -> tuple[int, int]:
    """Numbers of blocks of the clusters that ask and of the others: few large ones, but enough pairs of blocks for the tasks."""
    rows = max(1, BLOCK_BYTES // (8 * dims))
    work = max(CELL_PRODUCTS, (asking * asking / 2 + asking * known) / tasks)
    na = ceil(asking / min(rows, sqrt(work)))
    return na, ceil(known / min(rows, max(1.0, work * na / asking)))


def _nearest(groups: DataFrame, asking: int, known: int, dims: int, similarity: float, units: bool) -> DataFrame:
    """id, near and s: of each cluster that asks, the nearest one of every block, if above the cut; groups: id, n, v, ask.

    v is the sum of n unit vectors or, with units, one vector of any length.
    """
    na, nb = _blocks(asking, known, dims, 4 * groups.sparkSession.sparkContext.defaultParallelism)
    hashed = F.xxhash64("id")
    block = F.when(F.col("ask"), F.pmod(hashed, F.lit(na))).otherwise(na + F.pmod(hashed, F.lit(max(nb, 1)))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("ask"), F.lit(na + nb - 1)).otherwise(F.lit(na - 1)))
    met = groups.withColumn("block", block).withColumn("other", F.explode(others))
    met = met.select("id", "n", "v", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    # Pairs of blocks are numbered row by row, and each is a partition of its own: a hash would send some together.
    cells = na * (2 * (na + nb) - na + 1) // 2
    number = F.expr(f"cast(lo * ({2 * (na + nb) + 1} - lo) div 2 + hi - lo as int)")

    def cell(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = pivots.unit(t.column("v")) if units else _means(t)
        ids, block, lo, hi = t.column("id").to_numpy(), t.column("block").to_numpy(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        left, right = ids[block == lo], ids[block == hi]
        y = x if lo == hi else x[block == hi]
        there, back = best(x if lo == hi else x[block == lo], y, both=hi < na)
        found = [(left, right, *there)] + ([(right, left, *back)] if lo < hi < na else [])
        return pa.concat_tables(pa.table({"id": a[s > similarity], "near": b[at[s > similarity]], "s": s[s > similarity]}) for a, b, at, s in found)

    return met.withColumn("cell", number).repartitionById(cells, F.col("cell")).groupBy("cell").applyInArrow(cell, "id long, near long, s double")


def _nearest_of_few(groups: DataFrame, similarity: float) -> DataFrame:
    """As ``_nearest``, a row a partition: those that ask, of bounded size, go along with the tasks."""
    rows = groups.where("ask").select("id", "n", "v").collect()
    asked = np.array([r["id"] for r in rows])
    q = np.array([r["v"] for r in rows]) / np.array([r["n"] for r in rows])[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, top = np.full(len(asked), np.iinfo(np.int64).max), np.full(len(asked), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.table(batch).sort_by("id")
            ids, own = t.column("id").to_numpy(), np.full(len(asked), -1)
            _, a, b = np.intersect1d(asked, ids, return_indices=True)
            own[a] = b
            at, s = best(q, _means(t), own=own)[0]
            more = (s > top) | ((s == top) & (ids[at] < near))
            near[more], top[more] = ids[at[more]], s[more]
        found = top > similarity
        yield pa.RecordBatch.from_arrays([pa.array(asked[found]), pa.array(near[found]), pa.array(top[found])], names=["id", "near", "s"])

    return groups.select("id", "n", "v").mapInArrow(run, "id long, near long, s double")


def _means(t: pa.Table) -> np.ndarray:
    lists = t.column("v").combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) / t.column("n").to_numpy()[:, None]


def link(x: np.ndarray, n: np.ndarray, near: np.ndarray, s: np.ndarray, similarity: float) -> np.ndarray:
    """The first row of each row's cluster; x: mean vectors of n each; near, s: the nearest row, -1 if not known, and its similarity."""
    label, at, alive = np.arange(len(x)), np.arange(len(x)), np.ones(len(x), bool)
    # A last number puts rows that are gone below all others: those who ask have a 1 there.
    x, n, near, s = np.concatenate([x, np.zeros((len(x), 1))], axis=1), n.astype(np.float64), near.copy(), s.copy()

    def leave(rows: np.ndarray) -> None:
        alive[rows] = False
        x[rows] = 0.0
        x[rows, -1] = -4.0

    while True:
        ask = np.flatnonzero(alive & (near < 0))
        q = x[ask]
        q[:, -1] = 1.0
        near[ask], s[ask] = best(q, x, own=ask)[0]
        leave(ask[s[ask] <= similarity])
        live = np.flatnonzero(alive)
        if not len(live):
            break
        # Only rounding at the cut itself parts two that were near.
        near[live[~alive[near[live]]]] = -1
        sure = live[near[live] >= 0]
        into = sure[(near[near[sure]] == sure) & (sure < near[sure])]
        if not len(into) and len(sure):
            # Nor are all in a ring but by rounding: the nearest two merge.
            k = sure[s[sure].argmax()]
            into, gone = np.array([min(k, near[k])]), np.array([max(k, near[k])])
        else:
            gone = near[into]
        size = n[into] + n[gone]
        x[into] = (n[into, None] * x[into] + n[gone, None] * x[gone]) / size[:, None]
        n[into] = size
        label[at[gone]] = at[into]
        leave(gone)
        merged = np.zeros(len(x), bool)
        merged[into] = merged[gone] = True
        near[sure[merged[near[sure]]]] = -1
        near[into] = -1
        if alive.sum() < (1 - LEFT_OVER) * len(x):
            keep = np.flatnonzero(alive)
            place = np.full(len(x), -1)
            place[keep] = np.arange(len(keep))
            near = np.where(near[keep] < 0, -1, place[near[keep]])
            x, n, s, at, alive = x[keep], n[keep], s[keep], at[keep], alive[keep]
    while (label != label[label]).any():
        label = label[label]
    return label


def _rest(groups: DataFrame, similarity: float) -> DataFrame:
    """(id, cluster) of what is left, in one task."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, ask = t.column("id").to_numpy(), t.column("ask").to_numpy()
        near, s = t.column("near").fill_null(0).to_numpy(), t.column("s").fill_null(0.0).to_numpy()
        place = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        known = ~ask & (ids[place] == near)
        x = _means(t)
        return pa.table({"id": ids, "cluster": ids[link(x, t.column("n").to_numpy(), np.where(known, place, -1), s, similarity)]})

    return groups.groupBy().applyInArrow(run, "id long, cluster long")


def _length() -> Column:
    return F.sqrt(F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x * x))


def clusters(base: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(id, cluster) by average linkage, named by their least id; base: id, n (rows that the vector stands for), v.

    The clusters are those of merging the nearest two of all each time, where no two
    pairs are equally near. Vectors without a length and those that hold no number are
    clusters of their own. The products of all pairs are computed about once or twice;
    rounds are few unless near vectors form long chains.
    """
    usable = base.withColumn("r", _length()).where(~F.isnan("r") & (F.col("r") < float("inf")))
    if similarity >= 0:
        usable = usable.where("r > 0")
    # The length is a variable of the outer function; inside the inner one it would be computed for every number.
    total = F.get(F.transform(F.array(F.greatest("r", F.lit(1e-12))), lambda r: F.transform("v", lambda x: x.cast("double") / r * F.col("n"))), 0)
    nothing = [F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("s"), F.lit(True).alias("ask")]
    some = usable.select(F.size("v").alias("d")).first()
    if some is None:
        return base.select("id", F.col("id").alias("cluster"))
    dims = max(1, some["d"])
    groups, raw = usable.select("id", "n", total.alias("v"), *nothing), usable.select("id", "n", "v", F.lit(True).alias("ask"))
    links, held = [], None
    while True:
        count = groups.agg(F.count_if("ask").alias("asking"), F.count("*").alias("all")).first()
        if count["all"] * dims * 8 <= LINK_BYTES and count["asking"] * count["all"] <= LINK_PRODUCTS:
            links.append(_rest(groups, similarity).where("id <> cluster").select(F.col("id").alias("a"), F.col("cluster").alias("b")))
            break
        width, asking = dims * 8, count["asking"]
        if held is not None and asking * width <= ASKED_BYTES:
            found = _nearest_of_few(groups, similarity)
        else:
            # Vectors of the first round go about as narrow as they came.
            shown = groups.select("id", "n", "v", "ask") if held is not None else raw
            found = _nearest(shown, asking, count["all"] - asking, dims, similarity, held is None)
        found = found.groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("d"), "near")).alias("p"))
        found = scratch.write(found.select("id", F.col("p.near").alias("near"), (-F.col("p.d")).alias("s")))
        known = found.union(groups.where("not ask").select("id", "near", "s"))
        pair = [F.least("id", "near").alias("into"), F.greatest("id", "near").alias("gone")]
        merges = scratch.write(known.groupBy(*pair).agg(F.count("*").alias("k")).where("k = 2").select("into", "gone"))
        if merges.isEmpty():
            # Rounding alone can leave a ring of clusters, or one whose nearest is done by now.
            whole = known.join(known.select(F.col("id").alias("near")), "near", "left_semi")
            merges = scratch.write(whole.orderBy(F.desc("s"), *pair).limit(1).select(*pair))
            if known.isEmpty():
                break
        links.append(merges.select(F.col("gone").alias("a"), F.col("into").alias("b")))
        # Merges, and those that are done, are at most as many as those that asked.
        sent = F.broadcast if asking * width <= CHANGED_BYTES else lambda x: x
        done = groups.where("ask").select("id").join(sent(found.select("id")), "id", "left_anti")
        gone = merges.select(F.col("gone").alias("id"))
        lost = gone.union(merges.select("into")).union(done).select(F.col("id").alias("near"), F.lit(True).alias("lost"))
        gained = groups.select("id", "n", "v").join(sent(merges.select(F.col("gone").alias("id"), "into")), "id")
        gained = gained.select(F.col("into").alias("id"), F.col("n").alias("m"), F.col("v").alias("w"))
        stay = groups.select("id", "n", "v", "near", "s").join(sent(gone.union(done)), "id", "left_anti").join(sent(found.select("id", F.col("near").alias("to"), F.col("s").alias("by"))), "id", "left")
        stay = stay.select("id", "n", "v", F.coalesce("to", "near").alias("near"), F.coalesce("by", "s").alias("s")).join(sent(gained), "id", "left")
        v = F.when(F.col("w").isNull(), F.col("v")).otherwise(F.zip_with("v", "w", lambda x, y: x + y))
        ask = F.col("m").isNotNull() | F.coalesce("lost", F.lit(False))
        grown = stay.select("id", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), v.alias("v"), "near", "s", "m").join(sent(lost), "near", "left")
        groups = scratch.write(grown.select("id", "n", "v", "near", "s", ask.alias("ask")))
        scratch.drop(found)
        if held is not None:
            scratch.drop(held)
        held = groups
    roots = connected_components(reduce(DataFrame.union, links), scratch) if links else None
    if roots is None:
        return base.select("id", F.col("id").alias("cluster"))
    return base.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
