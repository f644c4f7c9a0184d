"""Similarity joins of sparse vectors by the features that a near pair must share.

A feature is a place with its sign. Over unit vectors x and y the product is at most
the length of x over the features that both have, so a pair over the threshold shares
features that carry most of either vector. Features have one order, rare ones first. Of
the first ``width`` that a pair shares, each vector tells by itself which sets are
possible: those whose squares and all squares after them exceed the squared threshold.
Every such set is a key under which the vector meets others, and a pair counts only
under the key of the first features that it really shares, so it is found once. Pairs
that share fewer features meet under all that they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pivots
from .scratch import Scratch

#: Features of a key at most; a key holds their places in 15 bits each.
MAX_WIDTH = 4
#: Bytes that the vectors of a task's group may take when spread out.
GROUP_BYTES = 1 << 25
#: Seconds, about, that a row takes to be dealt and that a product takes to be compared; only their ratio matters.
ROW_S, PRODUCT_S = 3e-6, 3e-8
#: Part of a grid's cost that keys may have at most to be taken.
WORTH = 0.25
#: Values other than 0 that the vectors of a sample may have on average.
SPARSE = 32
#: Rounding that bounds allow for.
SLACK = 1e-9


class Signatures:
    """Keys of vectors over a threshold; order: features from rare to frequent."""

    def __init__(self, order: np.ndarray, width: int, threshold: float):
        self.order, self.width, self.least = order, width, threshold * threshold - SLACK

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(x, 0.0), np.maximum(-x, 0.0)], axis=1)[:, self.order]

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of all keys of unit vectors."""
        q = self.features(x) ** 2
        has = (q > 0).sum(axis=1)
        most = int(has.max(initial=0))
        at = np.argsort(q == 0, axis=1, kind="stable")[:, :most]
        q = np.take_along_axis(q, at, axis=1)
        tail = np.concatenate([q[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)
        # The last feature of a key lies before the place from which on too little is left, whichever came before.
        top, left = np.zeros((len(x), self.width - 1)), np.ones((len(x), most + 1), bool)
        for p in range(most):
            top = np.sort(np.concatenate([top, q[:, p : p + 1]], axis=1), axis=1)[:, 1:]
            left[:, p + 1] = top.sum(axis=1) + tail[:, p + 1] > self.least
        reach = np.where(left.all(axis=1), has, np.minimum(left.argmin(axis=1), has))
        rows, keys = [], []
        for p in np.unique(reach):
            if p < self.width:
                continue
            own = np.flatnonzero(reach == p)
            sets = np.array(list(combinations(range(p), self.width)))
            for a in range(0, len(own), max(1, (1 << 20) // len(sets))):
                part = own[a : a + max(1, (1 << 20) // len(sets))]
                held = q[part][:, sets].sum(axis=2) + tail[part][:, sets[:, -1] + 1]
                r, s = np.nonzero(held > self.least)
                rows.append(part[r])
                keys.append(self._packed(at[part[r][:, None], sets[s]]))
        # Pairs that share fewer features share so much in them.
        ranked = -np.sort(-q, axis=1)
        for m in range(1, min(self.width, most + 1)):
            for i in np.flatnonzero(ranked[:, :m].sum(axis=1) > self.least):
                strong = np.flatnonzero((q[i] > 0) & (q[i] > self.least - ranked[i, : m - 1].sum()))
                sets = np.array(list(combinations(strong, m)), int).reshape(-1, m)
                sets = sets[q[i][sets].sum(axis=1) > self.least]
                rows.append(np.full(len(sets), i))
                keys.append(self._packed(at[i][sets]))
        if not rows:
            return np.zeros(0, int), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(keys)

    @staticmethod
    def _packed(places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        for k in range(places.shape[1]):
            out = (out << 15) | (places[:, k] + 1)
        return out

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The key of the first features that each two rows share."""
        both = (self.features(x) > 0) & (self.features(y) > 0)
        nth = both.cumsum(axis=1)
        row, place = np.nonzero(both & (nth <= self.width))
        out = np.zeros(len(x), np.int64)
        for k in range(1, self.width + 1):
            own = nth[row, place] == k
            out[row[own]] = (out[row[own]] << 15) | (place[own] + 1)
        return out


def choose(sample: np.ndarray, n: int, threshold: float, block_rows: int) -> Signatures | None:
    """The width of keys that costs least for n vectors, or None where a grid of blocks or pivots may be as good (dense vectors)."""
    if threshold <= 0 or not len(sample) or 2 * sample.shape[1] >= 1 << 15:
        return None
    # Sets of features of vectors that are not sparse are too many to be tried.
    if (sample != 0).sum(axis=1).mean() > SPARSE:
        return None
    order = np.argsort(np.concatenate([sample > 0, sample < 0], axis=1).sum(axis=0), kind="stable")
    grid = n * n / 2 * PRODUCT_S + n * np.ceil(n / block_rows) * ROW_S
    best, found = WORTH * grid, None
    for width in range(1, MAX_WIDTH + 1):
        tried = Signatures(order, width, threshold)
        _, keys = tried.keys(sample)
        _, count = np.unique(keys, return_counts=True)
        scale = n / len(sample)
        cost = len(keys) * scale * ROW_S + float((count * (count - 1.0) / 2).sum()) * scale * scale * PRODUCT_S
        if cost < best:
            best, found = cost, tried
    return found


def _packed_vectors(x: np.ndarray) -> pa.Array:
    """Each row as bytes: the places of its values other than 0, then the values."""
    row, place = np.nonzero(x)
    ends = np.searchsorted(row, np.arange(1, len(x) + 1))
    out, a = [], 0
    for b in ends:
        out.append(place[a:b].astype("<u2").tobytes() + x[row[a:b], place[a:b]].tobytes())
        a = b
    return pa.array(out, pa.binary())


def _spread(packed: pa.ChunkedArray, dims: int) -> np.ndarray:
    x = np.zeros((len(packed), dims))
    for i, raw in enumerate(packed.to_pylist()):
        k = len(raw) // 10
        x[i, np.frombuffer(raw, "<u2", k)] = np.frombuffer(raw, np.float64, k, 2 * k)
    return x


def keyed(rows: DataFrame, signatures: Signatures) -> DataFrame:
    """key, id and x (the unit vector's values other than 0) of every key of every row; rows: id, v."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = pivots.unit(part.column("v"))
                row, key = signatures.keys(x)
                packed, ids = _packed_vectors(x), part.column("id")
                for b in range(0, len(row), 1 << 15):
                    at = pa.array(row[b : b + (1 << 15)])
                    yield pa.RecordBatch.from_arrays([pa.array(key[b : b + (1 << 15)]), ids.take(at), packed.take(at)], names=["key", "id", "x"])

    return rows.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"key long, id {kind}, x binary")


def _met(rows: DataFrame, scratch: Scratch, dims: int, block_rows: int, pick: Callable, shown: Callable, out: str) -> DataFrame:
    """What shown makes of the rows that pick takes from the products of the vectors that meet under a key.

    rows: key, id, x, guest and sided (all alike): if sided, guests meet those that are none,
    else all meet each other. Keys of up to ``block_rows`` vectors share groups; larger ones are grids of blocks.
    """
    rows = scratch.write(rows)
    count = rows.groupBy("key").agg(F.count_if(~F.col("guest")).alias("own"), F.count_if("guest").alias("guests"), F.max("sided").alias("sided"))
    count = count.where(F.when(F.col("sided"), (F.col("own") > 0) & (F.col("guests") > 0)).otherwise(F.col("own") > 1))
    width = [F.ceil(F.col(c) / float(block_rows)).cast("int").alias(w) for c, w in (("own", "nb"), ("guests", "gb"))]
    kept = scratch.write(rows.join(count.select("key", *width), "key"))
    large = (F.col("nb") > 1) | (F.col("gb") > 1)
    groups = max(1, -(-kept.count() * 8 * dims // GROUP_BYTES))
    fields = ["key", "id", "x", "guest", "sided"]
    few = kept.where(~large).select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("block"), *fields)
    block = F.pmod(F.xxhash64("id"), F.when(F.col("guest"), F.col("gb")).otherwise(F.col("nb"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("sided") & ~F.col("guest"), F.col("gb")).otherwise(F.col("nb")) - 1)
    many = kept.where(large).withColumn("block", block).withColumn("other", F.explode(others))
    lo = F.when(F.col("guest"), F.col("other")).when(F.col("sided"), F.col("block")).otherwise(F.least("block", "other"))
    hi = F.when(F.col("guest"), F.col("block")).when(F.col("sided"), F.col("other")).otherwise(F.greatest("block", "other"))
    many = many.select((-F.col("key")).alias("group"), lo.alias("lo"), hi.alias("hi"), "block", *fields)

    def run(t: pa.Table) -> pa.Table:
        key, ids = t.column("key").to_numpy(), t.column("id").to_numpy()
        by = np.lexsort((ids, key))
        key, ids, x = key[by], ids[by], _spread(t.column("x"), dims)[by]
        block, guest = t.column("block").to_numpy()[by], t.column("guest").to_numpy()[by]
        lo, hi, sided = t.column("lo")[0].as_py(), t.column("hi")[0].as_py(), t.column("sided")[0].as_py()
        first = ~guest if sided else block == lo
        second = guest if sided else block == hi
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        left, right, product = [], [], []
        for a, b in zip(start, np.append(start[1:], len(key)), strict=True):
            i, j = a + np.flatnonzero(first[a:b]), a + np.flatnonzero(second[a:b])
            if len(i) and len(j):
                s = x[i] @ x[j].T
                p, q = pick(s, ids[i], ids[j], lo == hi)
                left.append(i[p]), right.append(j[q]), product.append(s[p, q])
        if not left:
            left, right, product = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        return shown(key, ids, x, np.concatenate(left), np.concatenate(right), np.concatenate(product))

    return few.unionByName(many).groupBy("group", "lo", "hi").applyInArrow(run, out)


def pairs(rows: DataFrame, signatures: Signatures, scratch: Scratch, dims: int, threshold: float, block_rows: int) -> DataFrame:
    """(a, b, similarity) of all pairs a < b whose cosine is over the threshold; rows: id, v."""

    def pick(s: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero(s > threshold)
        keep = a[i] < b[j] if same else a[i] != b[j]
        return i[keep], j[keep]

    def shown(key: np.ndarray, ids: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.Table:
        own = np.zeros(len(i), bool)
        for a in range(0, len(i), 4096):
            p, q = i[a : a + 4096], j[a : a + 4096]
            own[a : a + 4096] = signatures.shared(x[p], x[q]) == key[p]
        p, q = ids[i[own]], ids[j[own]]
        return pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q), "similarity": s[own]})

    alone = keyed(rows, signatures).withColumns({"guest": F.lit(False), "sided": F.lit(False)})
    return _met(alone, scratch, dims, block_rows, pick, shown, "a long, b long, similarity double")


def nearest(asked: DataFrame, known: DataFrame, signatures: Signatures, scratch: Scratch, dims: int, floor: float, block_rows: int) -> DataFrame:
    """id, nearest and similarity: the best known vector of each key, if at least the floor; asked and known: id, v."""

    def pick(s: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        s = np.round(s, 12)
        best = s.argmax(axis=1)
        keep = np.flatnonzero(s[np.arange(len(s)), best] >= floor)
        return keep, best[keep]

    def shown(key: np.ndarray, ids: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.Table:
        return pa.table({"id": ids[i], "nearest": ids[j], "similarity": np.round(s, 12)})

    sides = [keyed(r, signatures).withColumns({"guest": F.lit(guest), "sided": F.lit(True)}) for r, guest in ((asked, False), (known, True))]
    return _met(sides[0].unionByName(sides[1]), scratch, dims, block_rows, pick, shown, "id long, nearest long, similarity double")
