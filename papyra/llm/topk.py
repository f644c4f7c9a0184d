"""Exact top-k search by inner product: a KD-tree per shard, searched best first.

Vectors are dealt evenly into shards. Each shard builds a KD-tree by median splits
on the widest side, with the tight bounding box of every node. A query walks a tree
from the box with the highest possible score down, and stops when no box can reach
its k-th score. A small pilot tree gives each query a k-th score to start from, which
travels with it to every shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship

LEAF_ROWS = 128
#: Rows that a shard holds at least (where there are as many), and bytes of its vectors about at most.
LEAST_ROWS, SHARD_BYTES = 256, 64 << 20
#: Rows of the pilot tree about, and at most twice as many.
PILOT_ROWS = 2048
QUERY_BLOCK = 256
NO_SCORE = -(1 << 62)


class KDTree:
    """Median splits over integer vectors; bounds and scores are exact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        most = int(np.abs(x).max()) if x.size else 0
        need = most * most * max(x.shape[1], 1)
        # The narrowest type in which sums of products stay exact.
        self.dtype = np.float32 if need < 1 << 24 else np.float64 if need < 1 << 53 else np.int64
        order = np.arange(len(ids))
        lo, hi, left, right, span = [], [], [], [], []
        stack = [(0, len(ids), -1, False)]
        while stack:
            a, b, parent, is_right = stack.pop()
            node = len(span)
            if parent >= 0:
                (right if is_right else left)[parent] = node
            part = x[order[a:b]]
            lo.append(part.min(axis=0)), hi.append(part.max(axis=0))
            left.append(-1), right.append(-1), span.append((a, b))
            wide = hi[-1] - lo[-1]
            axis = int(wide.argmax()) if len(wide) else 0
            if b - a > LEAF_ROWS and len(wide) and wide[axis] > 0:
                m = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], m)]
                stack += [(a, a + m, node, False), (a + m, b, node, True)]
        self.ids, self.x = ids[order], x[order].astype(self.dtype)
        self.lo, self.hi = np.array(lo).astype(self.dtype), np.array(hi).astype(self.dtype)
        self.left, self.right, self.span = left, right, span
        self.most = most

    def search(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query up to k pairs (score, id), best first, none below its ``least``; ids equal to own are left out."""
        most = max(int(np.abs(q).max()) if q.size else 0, self.most)
        need = most * most * max(q.shape[1], 1)
        kind = np.float32 if need < 1 << 24 else np.float64 if need < 1 << 53 else np.int64
        kind = np.result_type(kind, self.dtype) if self.dtype != np.int64 and kind != np.int64 else np.int64
        q, x = q.astype(kind), self.x.astype(kind, copy=False)
        reach = np.maximum(q, 0) @ self.hi.T.astype(kind) + np.minimum(q, 0) @ self.lo.T.astype(kind)
        out = []
        for i in range(len(q)):
            bound, kth, best = reach[i], int(least[i]), []
            heap = [(-int(bound[0]), 0)]
            while heap:
                far, node = heapq.heappop(heap)
                if -far < kth:
                    break
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        if bound[child] >= kth:
                            heapq.heappush(heap, (-int(bound[child]), child))
                    continue
                a, b = self.span[node]
                score = x[a:b] @ q[i]
                near = np.flatnonzero((score >= kth) & (self.ids[a:b] != own[i]))
                if len(near):
                    if len(near) > k:
                        near = near[np.lexsort((self.ids[a:b][near], -score[near]))[:k]]
                    best += [(int(score[j]), int(self.ids[a + j])) for j in near]
                    best.sort(key=lambda p: (-p[0], p[1]))
                    del best[k:]
                    if len(best) == k:
                        kth = max(kth, best[-1][0])
            out.append(best)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """id, vec (floor(scale * x) of each component) and dim of the rows that take part.

    Rows whose id or vector is null, or whose vector holds a null or non-finite
    component, take no part.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(x * scale)).alias("vec"),
        F.size(vector_col).alias("dim"),
    )


def top_k(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows.

    Scores are integer inner products of quantised vectors of equal length (sums of
    products must fit 64 bits); ties go to the smaller id. Rows with the query's id are
    its own and never its answers; other repeated rows are candidates each. Query rows
    of one id with different vectors are one query: its ranking has the best scores of
    any of them. Queries with no candidate have no rows. Exact: no candidate is skipped that could rank.
    Other columns are not read; empty vectors score 0. An empty table gives no rows. A
    task holds one shard, about ``SHARD_BYTES`` of vectors and as much for its tree.
    """
    spark = df.sparkSession
    ship(spark)
    vectors = quantised(df, id_col, vector_col)
    queries = quantised(df.where(is_query), id_col, vector_col).distinct()
    n, numbers = vectors.agg(F.count("*"), F.sum(F.col("dim").cast("long"))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-8 * (numbers or 0) // SHARD_BYTES), min(parts, -(-n // LEAST_ROWS)))
    pool = 1 << 20
    cut = min(pool, 1 + pool * PILOT_ROWS // max(n, 1))
    pilot = vectors.where(F.pmod(F.xxhash64("id", F.lit("pilot")), F.lit(pool)) < cut).limit(2 * PILOT_ROWS).collect()
    by_dim: dict[int, list] = {}
    for r in pilot:
        by_dim.setdefault(r["dim"], []).append((r["id"], r["vec"]))
    shared = spark.sparkContext.broadcast(
        {d: (np.array([i for i, _ in v], np.int64), np.array([x for _, x in v], np.int64).reshape(len(v), d)) for d, v in by_dim.items()}
    )

    def pilot_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {d: KDTree(*v) for d, v in shared.value.items()}
        for batch in batches:
            ids, dims = batch.column("id").to_numpy(), batch.column("dim").to_numpy()
            least = np.full(len(ids), NO_SCORE, np.int64)
            for d in set(dims.tolist()) & set(trees):
                at = np.flatnonzero(dims == d)
                q = _matrix(batch.column("vec").take(pa.array(at)))
                found = trees[d].search(q, ids[at], least[at], k)
                least[at] = [f[-1][0] if len(f) == k else NO_SCORE for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=["id", "vec", "dim", "least"])

    bounded = queries.mapInArrow(pilot_bound, "id long, vec array<long>, dim int, least long")
    dealt = vectors.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"),
        "dim", F.lit(0).alias("kind"), "id", "vec", F.lit(NO_SCORE).alias("least"),
    )
    asked = bounded.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(1).alias("kind"), "id", "vec", "least"
    )
    rows = dealt.union(asked).repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "dim", "kind", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: a shard's vectors, then its queries, one vector length after another."""
        key, held, tree = None, [], None
        for batch in batches:
            shard, dim, kind = (batch.column(c).to_numpy() for c in ("shard", "dim", "kind"))
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(shard)], strict=True):
                if a == b:
                    continue
                if (shard[a], dim[a]) != key:
                    key, held, tree = (shard[a], dim[a]), [], None
                part = batch.slice(a, b - a)
                ids, x = part.column("id").to_numpy(), _matrix(part.column("vec"))
                if kind[a] == 0:
                    held.append((ids, x))
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree = KDTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held = held[:1]
                least = part.column("least").to_numpy()
                for lo in range(0, len(ids), QUERY_BLOCK):
                    s = slice(lo, lo + QUERY_BLOCK)
                    found = tree.search(x[s], ids[s], least[s], k)
                    q = np.repeat(ids[s], [len(f) for f in found])
                    flat = [p for f in found for p in f]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q, pa.int64()), pa.array([p[1] for p in flat], pa.int64()), pa.array([p[0] for p in flat], pa.int64())],
                        names=["query_id", "vec_id", "score"],
                    )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        rows.mapInArrow(search, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
