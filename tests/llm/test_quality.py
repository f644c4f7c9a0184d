import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from papyra.llm import quality as Q
from papyra.llm import queries
from papyra.llm.codepoints import chunks


def test_query_tells_good_from_bad(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    got = queries.op10_quality(spark, sf_dir).toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    j = got.merge(labels, on="doc_id")
    assert j[j.quality == 1].keep.mean() >= 0.98
    assert j[j.quality == 0].keep.mean() <= 0.2


def test_query_equals_plain(spark, sf_dir):
    """The model from plain features, then sums by host and path in dictionaries."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()

    def features(text):
        c = next(chunks(pa.array([text])))
        return Q.text_features(c)[0]

    x = dict(zip(docs.doc_id, map(features, docs.text), strict=True))
    y = labels[labels.doc_id.isin(x)]
    m = Q.fit_logistic(np.stack([x[k] for k in y.doc_id]), y.quality.to_numpy(float))
    p = {k: 1 / (1 + np.exp(-np.clip(((v - m["mean"]) / m["std"]) @ m["w"][:-1] + m["w"][-1], -12, 12))) if v[0] > 0 else 0.5 for k, v in x.items()}
    site = {r.doc_id: (r.source or "", r.lang or "") for r in docs.itertuples()}
    paths, hosts = {}, {}
    for k, s in site.items():
        paths.setdefault(s, []).append(p[k])
        hosts.setdefault(s[0], []).append(p[k])
    rate = min(max(sum(p.values()) / len(p), 0.01), 0.99)

    def strength(groups):
        n, s = np.array([len(g) for g in groups]), np.array([sum(g) for g in groups])
        noise = max(rate * (1 - rate), 1e-6)
        spread = ((n * (s / n - rate) ** 2).sum() - (len(n) - 1) * noise) / max(n.sum() - (n**2).sum() / n.sum(), 1e-9)
        return min(max(noise / max(spread, noise / 1000) - 1, 1.0), 1000.0)

    a, b = strength(list(hosts.values())), strength(list(paths.values()))
    for r in queries.op10_quality(spark, sf_dir).collect():
        k = r["doc_id"]
        h, q = hosts[site[k][0]], paths[site[k]]
        host = (sum(h) - p[k] + a * rate) / (len(h) - 1 + a)
        path = (sum(q) - p[k] + b * host) / (len(q) - 1 + b)
        odds = [v / (1 - v) for v in np.clip([p[k], path, rate], 1e-6, 1 - 1e-6)]
        score = 1 / (1 + odds[2] / (odds[0] * odds[1]))
        assert np.allclose([r["p_doc"], r["host_rate"], r["path_rate"], r["score"]], [p[k], host, path, score], atol=1e-5)
        assert r["keep"] == (r["score"] >= Q.THRESHOLD)


def test_texts_are_looked_at_once(spark, sf_dir):
    plan = queries.op10_quality(spark, sf_dir)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan


def test_shrinking_by_hand(spark):
    rows = [("h", "h/a", 0.9), ("h", "h/a", 0.8), ("h", "h/b", 0.1), ("g", "g/a", 0.5)]
    ev = spark.createDataFrame(rows, "host string, path string, p_doc double")
    prior = {"rate": 0.6, "host": 4.0, "path": 2.0}
    stats = ev.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s"))
    hosts = stats.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    out = ev.join(stats.join(hosts, "host"), ["host", "path"]).withColumns(Q.posterior(prior)).orderBy("p_doc").collect()
    low = out[0]
    host = (1.8 - 0.1 + 4 * 0.6) / (3 - 1 + 4)
    path = (0.1 - 0.1 + 2 * host) / (1 - 1 + 2)
    odds = (0.1 / 0.9) * (path / (1 - path)) / (0.6 / 0.4)
    assert abs(low["host_rate"] - host) < 1e-9 and abs(low["path_rate"] - path) < 1e-9 and abs(low["score"] - odds / (1 + odds)) < 1e-9


def test_strength_grows_when_groups_agree(spark):
    alike = spark.createDataFrame([(100, 50.0)] * 20, "n long, s double")
    apart = spark.createDataFrame([(100, 5.0), (100, 95.0)] * 10, "n long, s double")
    assert Q.strength(alike, "n", "s", 0.5) > 100 > 10 > Q.strength(apart, "n", "s", 0.5)


def test_logistic_fits():
    x = np.random.default_rng(0).normal(size=(500, 3))
    y = (x[:, 0] > 0).astype(float)
    m = Q.fit_logistic(x, y)
    z = ((x - m["mean"]) / m["std"]) @ m["w"][:-1] + m["w"][-1]
    assert ((z > 0) == (y > 0)).mean() > 0.97


def test_edges(edge_docs, empty_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (2, None, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for lab in (labels, none):
        got = Q.score_documents(edge_docs, lab, F.col("source"), F.col("lang"))
        rows = got.collect()
        assert len(rows) == edge_docs.count()
        assert all(0 <= r["score"] <= 1 and r["keep"] is not None for r in rows)
        assert {"n", "s", "host", "path", "key"} <= set(got.columns) and rows[0]["host"] == "h"
    assert Q.score_documents(empty_docs, labels, F.col("source"), F.col("lang")).count() == 0
