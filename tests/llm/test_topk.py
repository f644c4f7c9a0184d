import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import queries, topk


def plain(rows, is_query, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in ok if is_query(i)}:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q and len(y) == len(x))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k).collect())


def test_random_vectors_and_ties(spark):
    random.seed(2)
    rows = [(i, [random.choice((-0.5, 0.0, 0.25, 0.5)) for _ in range(4)]) for i in range(900)]
    assert run(spark, rows) == plain(rows, lambda i: i % 50 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (1, [None, 1.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [1.0, 2.0]), (5, [1.0]), (100, [9.0, -9.0, 1.0]), (None, [1.0, 1.0]), (6, [1e6, 1e6]), (150, [])]
    assert run(spark, rows) == plain(rows, lambda i: i % 50 == 0)
    assert run(spark, rows[:1]) == [] and run(spark, rows[1:2]) == []
    df = spark.createDataFrame(rows + rows[5:6], "vec_id long, embedding array<double>")
    more = df.selectExpr("*", "'x' as shard", "1 as dim", "2 as kind", "3 as score", "4 as id")
    assert sorted(tuple(r) for r in topk.top_k(more, F.col("vec_id") % 50 == 0).collect()) == plain(rows + rows[5:6], lambda i: i % 50 == 0)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_shards_follow_the_bytes_of_wide_vectors(spark, monkeypatch):
    """At 768 numbers a row a shard still holds no more bytes, and many shards give the same rows."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=768).tolist()) for i in range(300)]
    monkeypatch.setattr(topk, "SHARD_BYTES", 768 * 8 * 20)
    assert run(spark, rows) == plain(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 20])
def test_tree_is_exact(scale):
    rng = np.random.default_rng(1)
    x = rng.integers(-256, 257, (1500, 8)) * scale
    ids = rng.permutation(1500)
    tree = topk.KDTree(ids, x)
    found = tree.search(x[:40], ids[:40], np.full(40, topk.NO_SCORE), 5)
    for q, own, f in zip(x[:40], ids[:40], found, strict=True):
        want = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, y, strict=True))), int(i)) for i, y in zip(ids, x, strict=True) if i != own)[:5]
        assert [(-s, i) for s, i in f] == want
    for node, (a, b) in enumerate(tree.span):
        assert (tree.lo[node] == tree.x[a:b].min(axis=0)).all() and (tree.hi[node] == tree.x[a:b].max(axis=0)).all()


def test_query_equals_plain(spark, sf_dir):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op8_topk(spark, sf_dir).collect()) == plain(rows, lambda i: i % 50 == 0)
