"""Average linkage of vectors of which very many pairs are near: equal to plain linkage, without writing pairs."""

import numpy as np
import pytest

from papyra.operators import cluster as C
from papyra.operators import mutual as M
from papyra.operators.scratch import Scratch

KIND = "id long, embedding array<double>"


def crowd(n, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)) + 0.8 * rng.normal(size=(5, dim))[rng.integers(0, 5, n)]


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(y) for y in v]) for i, v in rows], KIND)


def units(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def plain(ids, x, similarity, n=None):
    label = C.average_linkage(units(x), 1 - similarity, n)
    return {int(i): int(min(ids[label == c])) for i, c in zip(ids, label, strict=True)}


def small(monkeypatch, **sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(M, k, v)


def test_pairs_of_a_crowd_are_not_written(spark, monkeypatch):
    """The tables between grow with the vectors, not with the pairs that are near."""
    x = crowd(500)
    near = int(np.triu(units(x) @ units(x).T > 0.3, 1).sum())
    assert near > 40 * len(x)
    written = []
    write = Scratch.write

    def counted(self, df):
        out = write(self, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    got = {r["id"]: r["cluster"] for r in C.clusters(frame(spark, enumerate(x)), 0.3).collect()}
    assert got == plain(np.arange(len(x)), x, 0.3)
    assert max(written) <= 2 * len(x)


@pytest.mark.parametrize("similarity", [-0.3, 0.0, 0.3, 0.9])
def test_rounds_give_plain_linkage(spark, monkeypatch, similarity):
    """Blocks of a few rows, and no task that links what is left before nothing asks any more."""
    x = crowd(230, seed=2)
    # Blocks of at most 40 vectors.
    small(monkeypatch, BLOCK_BYTES=40 * 6 * 8, CELL_PRODUCTS=400, TILE_ROWS=16, LINK_BYTES=0)
    if similarity <= 0:
        # All who ask meet in blocks, and all clusters are joined with what changes.
        small(monkeypatch, ASKED_BYTES=0, CHANGED_BYTES=0)
    base = frame(spark, zip(3 * np.arange(len(x)) + 1, x, strict=True)).selectExpr("id", "1L AS n", "embedding AS v")
    got = {r["id"]: r["cluster"] for r in M.clusters(base, similarity, Scratch(spark, "t")).collect()}
    assert got == plain(3 * np.arange(len(x)) + 1, x, similarity)


def test_rounds_go_over_to_one_task(spark, monkeypatch):
    """After some rounds the rest is linked by a task, which knows who is nearest to whom; sizes count."""
    x = crowd(200, seed=3)
    n = np.random.default_rng(4).integers(1, 50, len(x))
    small(monkeypatch, CELL_PRODUCTS=900, LINK_BYTES=120 * 6 * 8)
    rest = []
    monkeypatch.setattr(M, "_rest", lambda g, s, f=M._rest: rest.append((g.count(), g.where("not ask").count())) or f(g, s))
    base = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(n, x, strict=True))], "id long, n long, v array<double>")
    got = {r["id"]: r["cluster"] for r in M.clusters(base, 0.2, Scratch(spark, "t")).collect()}
    assert 0 < rest[0][1] < rest[0][0] <= 120 and got == plain(np.arange(len(x)), x, 0.2, n)


def test_vectors_that_are_like_nothing(spark, monkeypatch):
    """Vectors of length 0, null ones and those without a number stay alone; copies of one count as many."""
    x = crowd(150, seed=5)
    used = []
    monkeypatch.setattr(M, "clusters", lambda *a, f=M.clusters: used.append(1) or f(*a))
    odd = [(900, np.zeros(6)), (901, np.zeros(6)), (902, None), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5)]
    rows = [*enumerate(x), *((300 + i, x[7]) for i in range(60)), *odd]
    for sizes in ({"CROWD": 1}, {"LINK_BYTES": 0, "CELL_PRODUCTS": 900}):
        small(monkeypatch, **sizes)
        got = {r["id"]: r["cluster"] for r in C.clusters(frame(spark, rows), 0.3).collect()}
        ids = np.array([i for i, _ in rows[: -len(odd)]])
        want = plain(np.arange(len(x)), x, 0.3, np.where(np.arange(len(x)) == 7, 61, 1))
        assert got == {int(i): want[int(i) if i < 300 else 7] for i in ids} | {i: i for i, _ in odd}
    assert len(used) == 2


def test_best_of_tiles():
    rng = np.random.default_rng(6)
    x, y = rng.integers(-2, 3, (37, 3)).astype(float), rng.integers(-2, 3, (53, 3)).astype(float)
    tile, M.TILE_ROWS = M.TILE_ROWS, 8
    try:
        (at, top), (back, high) = M.best(x, y, both=True)
        (same, most), _ = M.best(x, x, both=True)
        (other, s), _ = M.best(x[20:30], x, own=np.arange(20, 30))
    finally:
        M.TILE_ROWS = tile
    p, q = x @ y.T, x @ x.T
    np.fill_diagonal(q, -np.inf)
    # Of equal products the first.
    assert (at == p.argmax(1)).all() and (top == p.max(1)).all() and (back == p.argmax(0)).all() and (high == p.max(0)).all()
    assert (same == q.argmax(1)).all() and (most == q.max(1)).all() and (other == same[20:30]).all() and (s == most[20:30]).all()


def test_a_ring_of_equal_similarities_ends(spark, monkeypatch):
    """Where all are equally near there is no nearest pair, but the rounds end."""
    small(monkeypatch, LINK_BYTES=0, CELL_PRODUCTS=4)
    at = 2 * np.pi * np.arange(24) / 24
    x = np.stack([np.cos(at), np.sin(at)], axis=1)
    base = frame(spark, enumerate(x)).selectExpr("id", "1L AS n", "embedding AS v")
    out = {r["id"]: r["cluster"] for r in M.clusters(base, 0.5, Scratch(spark, "t")).collect()}
    assert len(out) == 24 and all(out[c] == c and c <= i for i, c in out.items()) and 1 < len(set(out.values())) < 24
