"""Similarity joins of sparse vectors by shared features: exact, and with few products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.operators import cluster as C
from papyra.operators import pivots as V
from papyra.operators import signatures as S
from papyra.operators.scratch import Scratch
from papyra.sources.embeddings import hashed

KIND = "id long, embedding array<double>"


def words(n, seed=1):
    rng = np.random.default_rng(seed)
    parts = ["the", "er", "sch", "ing", "que", "tion", "ou", "le", "an", "ed", "re", "is", "st", "en"]
    return sorted({"".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(n)})


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND)


def keys_of(x, threshold, width):
    order = np.argsort(np.concatenate([x > 0, x < 0], axis=1).sum(axis=0), kind="stable")
    return S.Signatures(order, width, threshold)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("threshold", [0.5, 0.85, 0.97])
def test_near_pairs_have_their_shared_key(threshold, width):
    rng = np.random.default_rng(3)
    few = np.zeros((120, 8))
    for i in range(len(few)):
        np.add.at(few[i], rng.integers(0, 8, 3), rng.choice([-2.0, -1.0, 1.0], 3))
    for x in (hashed(words(150)).astype(float), few[np.abs(few).sum(axis=1) > 0]):
        x = V.unit(V.pa.array(x.tolist()))
        keys = keys_of(x, threshold, width)
        row, key = keys.keys(x)
        own = set(zip(row.tolist(), key.tolist(), strict=True))
        i, j = np.nonzero(np.triu(x @ x.T > threshold, 1))
        assert len(own) == len(row) and (len(i) or threshold > 0.9)
        for a, b, k in zip(i.tolist(), j.tolist(), keys.shared(x[i], x[j]).tolist(), strict=True):
            assert (a, k) in own and (b, k) in own


@pytest.mark.parametrize("block_rows", [4, 2048])
def test_pairs_and_nearest_are_exact(spark, block_rows):
    x = hashed(words(700)).astype(float)
    x[5] = x[9]
    x[11] = 0.0
    unit = V.unit(V.pa.array(x.tolist()))
    s = unit @ unit.T
    i, j = np.nonzero(np.triu(s > 0.8, 1))
    rows, scratch = frame(spark, x).withColumnRenamed("embedding", "v"), Scratch(spark, "t")
    keys = keys_of(unit, 0.8, 2)
    got = [(r["a"], r["b"]) for r in S.pairs(rows, keys, scratch, 128, 0.8, block_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == set(zip(i.tolist(), j.tolist(), strict=True))
    even = np.arange(len(x)) % 2 == 0
    found = S.nearest(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), keys, scratch, 128, 0.8, block_rows)
    best = {r["id"]: r["x"]["nearest"] for r in found.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "nearest")).alias("x")).collect()}
    t = np.where(even[None, :], -1.0, np.round(s, 12))
    assert best == {int(a): int(t[a].argmax()) for a in np.flatnonzero(even) if t[a].max() >= 0.8}


def test_sparse_vectors_are_hardly_compared():
    """Of 200,000 words a grid would compare all pairs; keys leave far fewer, and dense vectors keep their grid."""
    x = hashed(words(4000)).astype(float)
    keys = S.choose(x, 200_000, 0.85, 2048)
    _, count = np.unique(keys.keys(x)[1], return_counts=True)
    assert (count * (count - 1) / 2).sum() < 0.05 * len(x) * (len(x) - 1) / 2
    dense = np.random.default_rng(2).normal(size=(500, 64))
    assert S.choose(dense / np.linalg.norm(dense, axis=1, keepdims=True), 200_000, 0.38, 2048) is None


def test_long_chains_are_linked_in_parts(spark, monkeypatch):
    """A component over the limit that merges along a chain: after a few rounds its parts are linked by tasks."""
    rng = np.random.default_rng(5)
    at = np.cumsum(rng.uniform(0.05, 0.3, 120)) * 0.05
    x = np.stack([np.cos(at), np.sin(at)], axis=1)
    want = C.average_linkage(x, 1 - 0.999)
    rounds = []
    split = C._split
    monkeypatch.setattr(C, "LINK_ROWS", 30)
    monkeypatch.setattr(C, "SPLIT_ROUNDS", 1)
    monkeypatch.setattr(C, "_split", lambda *a: rounds.append(1) or split(*a))
    got = {r["id"]: r["cluster"] for r in C.clusters(frame(spark, x), 0.999).collect()}
    assert rounds and got == {i: int(np.flatnonzero(want == want[i])[0]) for i in range(len(x))}
