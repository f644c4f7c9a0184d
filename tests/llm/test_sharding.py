import zlib

import numpy as np

from papyra.llm import queries, sharding


def check(got, rows):
    assert len(got) == len(rows)
    assert (got.law == "bytes").all() and got.shard.between(0, 23).all() and got.grown_shard.isna().all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_query_is_balanced(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op6_sharding(spark, sf_dir).toPandas()
    check(got, docs)
    for r in got.itertuples():
        raw = docs[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    # No shard can be smaller than the mean less the largest row, nor the largest row be cut.
    size = got.groupby("shard")["size"].sum()
    assert size.max() <= max(1.05 * size.mean(), got["size"].max() + 0.05 * size.mean())
    shards = got.assign(text=got.doc_id.map(docs)).groupby("text").agg(n=("shard", "nunique"), size=("size", "sum"))
    assert (shards[shards["size"] <= size.mean()].n == 1).all()


def test_repeated_rows_and_null_ids_are_dealt_evenly(spark):
    rows = [(None, "same text of many rows")] * 30_000 + [(i, f"other {i} " * (1 + i % 30)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).toPandas()
    check(got, rows)
    size = got.groupby("shard")["size"].sum()
    assert size.max() < 1.03 * size.min()


def test_groups_are_split_only_where_balance_needs_it():
    rng = np.random.default_rng(1)
    small = rng.dirichlet(np.ones(500)) * 0.7
    large = np.full(10, 0.03)
    units = np.repeat(np.concatenate((small, large))[:, None], 3, axis=1)
    rows = np.concatenate((np.ones(500, np.int64), np.full(10, 1000)))
    pieces, where = sharding.split_and_pack(units, rows, 24)
    assert (pieces == 1).all() and len(where) == 510
    hot = np.concatenate((small, [0.3]))
    pieces, where = sharding.split_and_pack(np.repeat(hot[:, None], 3, axis=1), np.append(np.ones(500, np.int64), 1000), 24)
    load = np.bincount(where, np.repeat(hot / pieces, pieces), 24) * 24
    assert pieces[-1] > 7 and load.max() - load.min() < 0.02


def test_evening_out_never_widens():
    rng = np.random.default_rng(2)
    for _ in range(50):
        size, where = rng.dirichlet(np.ones(30)), rng.integers(0, 5, 30)
        load = [np.bincount(w, size, 5) for w in (where, sharding.even_out(size, where, 5, 0.0))]
        assert np.ptp(load[1]) <= np.ptp(load[0]) + 1e-12


def test_hot_group_is_split_and_others_stay_together(spark):
    rows = [(i, "copy " * 40) for i in range(3000)] + [(i, f"text {i // 2} " * (1 + i % 40)) for i in range(3000, 9000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    check(got, rows)
    size = got.groupby("shard")["size"].sum()
    assert size.max() < 1.03 * size.min()
    text = dict(rows)
    pairs = got[got.doc_id >= 3000].assign(text=lambda d: d.doc_id.map(text))
    assert (pairs.groupby("text").shard.nunique() == 1).all()


def test_pack_prefers_room():
    where = sharding.pack(np.array([[0.5, 0.5, 0.5], [0.3, 0.3, 0.3], [0.2, 0.2, 0.2]]), 2)
    assert where[0] != where[1] and where[1] == where[2]


def test_edges(edge_docs, empty_docs):
    got = sharding.shard(edge_docs).toPandas()
    check(got, edge_docs.collect())
    assert (got[got.doc_id.isin([3, 4])]["size"] == 8).all() and (got[got.doc_id.isin([3, 4])].text_crc32 == 0).all()
    assert sharding.shard(empty_docs).count() == 0
