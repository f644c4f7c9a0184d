"""Postings beside edges: the same ids as arrays would hold, and nothing that grows with a frequent edge."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.functions import varint
from papyra.operators import evidence as E
from papyra.operators import graph as G

KIND = "triple_id long, block_id long, ingestion_source_id long, subject string, predicate string, object string"


def random_triples(n, seed, names=12):
    rng = random.Random(seed)
    big = [0, 5, -3, 1 << 40, -(1 << 62), (1 << 63) - 1, None]
    return [
        (rng.choice((i, i, i, rng.choice(big))), rng.choice((i // 4, rng.choice(big))), rng.choice((rng.randrange(9), rng.choice(big))), f"n{rng.randrange(names)}", rng.choice("pqr"), f"n{rng.randrange(names)}")
        for i in range(n)
    ]


def plain(rows):
    out = {}
    for t, b, s, *key in rows:
        ids = out.setdefault(tuple(key), (set(), set(), set()))
        for found, x in zip(ids, (t, b, s), strict=True):
            if x is not None:
                found.add(x)
    return {k: tuple(sorted(x) for x in v) for k, v in out.items()}


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_postings_hold_every_id(spark, block):
    rows = random_triples(700, block) + [(i, i, i, "hot", "p", "hot") for i in range(400)]
    t = spark.createDataFrame(rows, KIND).repartition(5)
    edges, blocks = G.structural_edges(t), E.postings(t, block)
    got = {(r["subject"], r["predicate"], r["object"]): (r["triple_ids"], r["block_ids"], r["source_ids"]) for r in E.with_ids(edges, blocks).collect()}
    assert got == plain(rows)
    assert {(r["subject"], r["predicate"], r["object"]): r["support"] for r in edges.collect()} == {k: len(v[2]) for k, v in plain(rows).items()}
    assert E.decoded(blocks).count() == len(rows)
    assert blocks.agg(F.max("n")).first()[0] <= block


def test_a_frequent_edge_is_spread_and_its_row_stays_small(spark):
    """Half of all triples say the same: many small blocks in many partitions, an edge row without arrays."""
    rows = spark.range(60_000).selectExpr("id as triple_id", "id div 3 as block_id", "id % 7000 as ingestion_source_id", "if(id % 2 = 0, 'hot', 'n' || id % 100) as subject", "'p' as predicate", "'o' as object")
    edges, blocks = G.structural_edges(rows), E.postings(rows)
    hot = edges.where("subject = 'hot'").first()
    assert hot["support"] == 3500 and all(not isinstance(v, list) for v in hot)
    own = blocks.where(F.col("edge_id") == F.lit(bytes(hot["edge_id"]))).select("n", F.octet_length("data").alias("bytes")).collect()
    assert sum(r["n"] for r in own) == 30_000 and max(r["n"] for r in own) <= E.BLOCK and len(own) >= 30
    # Neighbouring ids differ by little, so a posting of three ids takes a few bytes.
    assert sum(r["bytes"] for r in own) < 8 * 30_000


def test_edges_of_alike_texts_are_apart(spark):
    rows = [("a:", "b", "c"), ("a", ":b", "c"), ("a", "b", "c"), ("ab", "", "c"), ("a", "b", None), (None, "b", "c"), ("-", "b", "c")]
    t = spark.createDataFrame([(i, i, i, *r) for i, r in enumerate(rows)], KIND)
    assert t.select(E.edge_id()).distinct().count() == len(rows)


def test_merges_move_blocks(spark):
    """Renamed edges unite, loops go, support counts distinct sources; against sets."""
    rows = [r for r in random_triples(500, 9, names=8) if r[2] is None or r[2] < 10]
    t = spark.createDataFrame(rows, KIND)
    names = {f"n{i}": f"n{i % 3}" for i in range(8)}
    canon = spark.createDataFrame(list(names.items()), "node string, canonical string")
    edges, blocks = G.rewrite_edges(G.structural_edges(t), E.postings(t, 4), canon)
    want = plain([(*r[:3], names[r[3]], r[4], names[r[5]]) for r in rows if names[r[3]] != names[r[5]]])
    got = {(r["subject"], r["predicate"], r["object"]): r for r in E.with_ids(edges, blocks).collect()}
    assert {k: (r["triple_ids"], r["block_ids"], r["source_ids"]) for k, r in got.items()} == want
    assert {k: r["support"] for k, r in got.items()} == {k: len(v[2]) for k, v in want.items()}


def test_increment_keeps_support_of_untouched_edges(spark):
    old = spark.createDataFrame([(0, 0, 1, "a", "p", "b"), (1, 0, 2, "a", "p", "c")], KIND)
    new = spark.createDataFrame([(2, 1, 3, "a", "p", "b"), (3, 1, 4, "z", "p", "b"), (4, 1, 5, "a", "p", "a")], KIND)
    kept = G.structural_edges(old).withColumn("support", F.lit(9))
    canon = spark.createDataFrame([("a", "a"), ("z", "a"), ("b", "b")], "node string, canonical string")
    edges, blocks = G.merge_increment(kept, E.postings(old), G.structural_edges(new), E.postings(new), canon)
    got = {(r["subject"], r["object"]): (r["support"], r["source_ids"]) for r in E.with_ids(edges, blocks).collect()}
    assert got == {("a", "b"): (3, [1, 3, 4]), ("a", "c"): (9, [2])}


def test_empty(spark):
    t = spark.createDataFrame([], KIND)
    assert E.with_ids(G.structural_edges(t), E.postings(t)).count() == 0


def test_numbers():
    rng = np.random.default_rng(1)
    v = (rng.integers(-(1 << 62), 1 << 62, 5000) >> rng.integers(0, 62, 5000)).astype(np.int64)
    v[:4] = [0, -1, np.iinfo(np.int64).min, np.iinfo(np.int64).max]
    raw, ends = varint.pack(varint.zigzag(v))
    assert (varint.unzigzag(varint.unpack(raw)) == v).all() and ends[-1] == len(raw)
    assert len(varint.unpack(varint.pack(v[:0])[0])) == 0
