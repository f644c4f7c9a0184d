"""The registered queries without SQL against plain versions over the whole tables at sf0.001."""

import heapq
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.functions import policy as P
from papyra.operators import graph as G
from papyra.plans import catalog
from papyra.plans import views as V
from papyra.sources import embeddings as E

SMALL = "/root/testdata/sf0.001"


def linkage(x, cut):
    """Clusters (lists of rows) by average linkage: the nearest two of all clusters merge while their mean similarity is over the cut."""
    s = x @ x.T
    held = {i: [i] for i in range(len(x))}
    near = defaultdict(set)
    heap = []
    for i, j in zip(*np.nonzero(np.triu(s > cut, 1)), strict=True):
        near[i].add(j), near[j].add(i)
        heapq.heappush(heap, (-s[i, j], int(i), int(j)))
    new = len(x)
    while heap:
        _, a, b = heapq.heappop(heap)
        if a not in held or b not in held:
            continue
        held[new] = held.pop(a) + held.pop(b)
        for o in (near.pop(a) | near.pop(b)) - {a, b}:
            if o in held:
                mean = s[np.ix_(held[new], held[o])].mean()
                near[new].add(o), near[o].add(new)
                if mean > cut:
                    heapq.heappush(heap, (-mean, o, new))
        new += 1
    return list(held.values())


def units(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def test_clusters_of_all_vectors(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r["vec_id"] for r in rows]
    want = {ids[i]: min(ids[k] for k in g) for g in linkage(units(np.array([r["embedding"] for r in rows], float)), 0.3) for i in g}
    got = {r["id"]: r["cluster"] for r in catalog.queries()["semantic_clusters"](spark, SMALL).collect()}
    assert got == want and len(set(want.values())) < len(want)


def grouped(triples):
    """Edges of triples: ids by (subject, predicate, object)."""
    out = {}
    for r in triples:
        ids = out.setdefault((r["subject"], r["predicate"], r["object"]), (set(), set(), set()))
        for found, c in zip(ids, ("triple_id", "block_id", "ingestion_source_id"), strict=True):
            found.add(r[c])
    return out


def vectors(texts):
    return E.hashed(texts).astype(np.float32).astype(float)


def consolidated(edges, good):
    """(nodes: aliases and score by canonical text, canonical text of each node)."""
    degree = defaultdict(int)
    for s, _, o in edges:
        for n in {s, o}:
            degree[n] += 1
    texts = sorted(n for n in degree if n in good)
    x = units(vectors(texts))
    nodes, names = {}, {}
    for g in linkage(x, P.MERGE_SIMILARITY):
        members = sorted((texts[i] for i in g), key=lambda t: (-degree[t], -len(t), t))
        raw = vectors([texts[i] for i in g])
        nodes[members[0]] = (members, float(np.linalg.norm(raw.mean(axis=0))))
        names |= dict.fromkeys(members, members[0])
    return nodes, names


def united(edges, names):
    out = {}
    for (s, p, o), ids in edges.items():
        s, o = names.get(s, s), names.get(o, o)
        if s != o:
            for have, more in zip(out.setdefault((s, p, o), (set(), set(), set())), ids, strict=True):
                have |= more
    return out


@pytest.fixture(scope="module")
def world(spark):
    triples = G.without_noise(V.triples(spark, SMALL)).collect()
    nodes = spark.createDataFrame([(n,) for n in {x for r in triples for x in (r["subject"], r["object"])}], "node string")
    good = {r["node"] for r in nodes.where(G.mergeable(F.col("node"))).collect()}
    return triples, good


def shown(df):
    return {r["text"]: (r["aliases"], r["cluster_score"]) for r in df.collect()}


def alike(got, want):
    assert {k: v[0] for k, v in got.items()} == {k: ",".join(v[0]) for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_semantic_merge_of_the_whole_graph(spark, world):
    triples, good = world
    nodes, names = consolidated(grouped(triples), good)
    alike(shown(catalog.queries()["semantic_merge"](spark, SMALL)), nodes)
    assert sum(len(a) > 1 for a, _ in nodes.values()) > 20
    want = {(*k, len(v[2]), *(",".join(map(str, sorted(x))) for x in v)) for k, v in united(grouped(triples), names).items()}
    got = catalog.queries()["semantic_edges"](spark, SMALL).select("subject", "predicate", "object", "support", *G.IDS).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_incremental_merge_of_the_whole_graph(spark, world):
    triples, good = world
    old = grouped(r for r in triples if r["ingestion_source_id"] % 2 == 0)
    new = grouped(r for r in triples if r["ingestion_source_id"] % 2 == 1)
    nodes, _ = consolidated(old, good)
    known = sorted(nodes)
    fresh = sorted({x for s, _, o in new for x in (s, o)} - set(known))
    s = np.round(units(vectors(fresh)) @ units(vectors(known)).T, 12)
    want = {k: (list(a), score) for k, (a, score) in nodes.items()}
    for i, text in enumerate(fresh):
        best = int(s[i].argmax())
        if s[i, best] >= P.MERGE_SIMILARITY:
            have = want[known[best]][0]
            if text not in have:
                have.append(text)
        else:
            want[text] = ([], 1.0)
    alike(shown(catalog.queries()["incremental_merge"](spark, SMALL)), want)
