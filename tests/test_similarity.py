"""Similarity joins around pivots: exact, and with far fewer comparisons than all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.operators import cluster as C
from papyra.operators import pivots as V
from papyra.operators.scratch import Scratch

KIND = "id long, embedding array<double>"


def clustered(groups, each, dim, noise, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = np.repeat(centre, each, axis=0) + noise * rng.normal(size=(groups * each, dim))
    return x[rng.permutation(len(x))]


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], KIND)


def units(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def all_pairs(x, threshold):
    s = units(x) @ units(x).T
    i, j = np.nonzero(np.triu(s > threshold, 1))
    return set(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("threshold", [-0.2, 0.0, 0.3, 0.8, 0.95])
@pytest.mark.parametrize("x", [clustered(30, 20, 8, 0.1), np.random.default_rng(2).normal(size=(400, 5)), clustered(5, 60, 3, 0.02)])
def test_pairs_are_exact(spark, x, threshold):
    got = [(r["a"], r["b"]) for r in C.similarity_pairs(frame(spark, x), threshold, block_rows=64).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, threshold)


def test_clustered_vectors_are_hardly_compared(spark):
    x = clustered(60, 25, 16, 0.05)
    cells = C.similarity_cells(frame(spark, x), 0.9, Scratch(spark, "t"), block_rows=128)
    by = cells.groupBy("cell").agg(F.count_if(~F.col("guest")).alias("n"), F.count_if("guest").alias("g")).collect()
    compared = sum(r["n"] * (r["n"] - 1) // 2 + r["n"] * r["g"] for r in by)
    assert compared < 0.1 * len(x) * (len(x) - 1) / 2
    copies = cells.groupBy("id").count().agg(F.max("count"), F.avg("count"), F.count("*")).first()
    # At most what a plain grid of blocks would copy a vector.
    assert copies[0] <= 20 and copies[1] <= len(x) / 128 and copies[2] == len(x)


def test_pivots_follow_what_angles_tell(spark):
    """Vectors that are all equally far from each other stay in one grid; clustered ones do not."""
    even = np.random.default_rng(3).normal(size=(600, 200))
    assert len(V.choose(units(even), 600, float(np.arccos(0.2)), 64)) == 1
    assert len(V.choose(units(clustered(60, 25, 16, 0.05)), 1500, float(np.arccos(0.9)), 64)) >= 16


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(5)
    for dim in (2, 3, 8):
        x = units(rng.normal(size=(300, dim)))
        cells = V.Cells(V.spread_out(x, 20))
        own, far = cells.assign(x)
        cells.radius = np.full(len(cells.pivots), -np.inf)
        np.maximum.at(cells.radius, own, far)
        for threshold in (0.99, 0.7, 0.1):
            _, near = cells.reach(x, float(np.arccos(threshold)))
            i, j = np.nonzero(x @ x.T > threshold)
            assert near[i, own[j]].all()


@pytest.mark.parametrize("threshold", [-0.5, 0.2, 0.9])
def test_nearest_is_exact(spark, threshold):
    x, q = clustered(25, 20, 6, 0.1), clustered(25, 4, 6, 0.3, seed=1)
    x[:3], q[:2] = 0.0, 0.0
    x[10] = x[4]
    got = {r["id"]: (r["nearest"], round(r["similarity"], 9)) for r in C.nearest(frame(spark, q), frame(spark, x), threshold, block_rows=64).collect()}
    s = np.round(units(q) @ units(x).T, 12)
    want = {}
    for i in range(len(q)):
        best = int(s[i].argmax())
        if s[i, best] >= threshold:
            want[i] = (best, round(float(s[i, best]), 9))
    assert got == want


def test_nearest_of_nothing(spark):
    x = frame(spark, np.eye(3))
    assert C.nearest(x, x.limit(0), 0.5).count() == 0 and C.nearest(x.limit(0), x, 0.5).count() == 0
    assert C.similarity_pairs(x.limit(0), 0.5).count() == 0 and C.similarity_pairs(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], KIND), 0.5).count() == 0


def test_copies_are_clustered_once(spark):
    """A third of all vectors are copies of one; zero and null vectors stay alone."""
    x = clustered(8, 10, 5, 0.05, seed=7)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[3].tolist()) for i in range(40)] + [(200, [0.0] * 5), (201, [0.0] * 5), (202, None)]
    got = {r["id"]: r["cluster"] for r in C.clusters(spark.createDataFrame(rows, KIND), 0.8).collect()}
    plain = np.array([v for _, v in rows[:-3]])
    label = C.average_linkage(units(plain), 0.2)
    ids = [i for i, _ in rows[:-3]]
    want = {}
    for i, c in zip(ids, label, strict=True):
        want.setdefault(c, []).append(i)
    assert got == {i: min(g) for g in want.values() for i in g} | {200: 200, 201: 201, 202: 202}


def test_pairs_of_one_cell_are_not_one_task(spark):
    """Where angles tell nothing all vectors are one cell, whose blocks still go to many tasks."""
    x = np.random.default_rng(4).normal(size=(400, 60))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        tasks = C.similarity_pairs(frame(spark, x), 0.3, block_rows=64).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks > 1


def test_copies_are_not_joined_by_their_numbers(spark):
    """Copies find their first by hashes: sorting by vectors compares them number by number. Equal numbers are equal, whatever their sign or kind."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [0.0, 1.0]), (4, [float("nan"), 1.0]), (5, [float("nan"), 1.0])]
    out = C.clusters(spark.createDataFrame(rows, KIND), 0.9)
    assert {r["id"]: r["cluster"] for r in out.where("id < 4").collect()} == {1: 1, 2: 1, 3: 3}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "normalizenanandzero" in x]
