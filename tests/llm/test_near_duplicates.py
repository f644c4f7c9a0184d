import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from papyra.llm import near_duplicates as N


def plain(rows, words=5, similarity=0.8):
    """(class of each row number, links of each row number) by all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else {("raw", t or "")}))
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    common = Counter((a, b) for m in at.values() for k, b in enumerate(m) for a in m[:k])
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if c >= similarity * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    return [find(i) for i in range(len(rows))], links


def same(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in N.near_duplicates(df).collect())
    cls, links = plain(rows)
    least = {}
    for (k, _), c in zip(rows, cls, strict=True):
        least[c] = min(least.get(c, k), k)
    assert got == sorted((k, least[c], links[i]) for i, ((k, _), c) in enumerate(zip(rows, cls, strict=True)))


def test_query_table_equals_plain(spark, sf_dir):
    same(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


@pytest.mark.parametrize("side", [3, 128])
def test_chain_of_edits_over_many_cells(spark, monkeypatch, side):
    monkeypatch.setattr(N, "SIDE", side)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words[(i * 3) % 120] = f"edit{i}"
        rows.append((i, " ".join(words)))
    same(spark, rows + [(100, rows[0][1]), (101, rows[0][1]), (102, "quite another text with no words in common at all")])


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.999):
        b, r = N.choose_bands(0.8, recall, 160)
        assert b * r <= 160 and 1 - (1 - 0.8**r) ** b >= recall


def test_edges(edge_docs, empty_docs):
    got = N.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[1]["n_links"] == 2
    assert by[3]["class_id"] == by[4]["class_id"] == 3
    assert by[7]["class_id"] == 7
    assert N.near_duplicates(empty_docs).count() == 0
    kept = N.keep_one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(set(texts)) == sorted(texts) and len(texts) == len({r["text"] or "" for r in edge_docs.collect()})


def cell(sides, own=(b"a", b"b", b"c")):
    grams = [list(range(100)), list(range(1, 101)), list(range(500, 600))]
    return pa.table({
        "digest": pa.array([b"a", b"b", b"c"], pa.binary()),
        "copies": [1, 2, 1],
        "side": sides,
        "own": pa.array(own, pa.binary()),
        "grams": pa.array(grams, pa.list_(pa.int64())),
    })


def test_a_side_links_every_near_pair():
    got = {r["digest"]: (r["links"], r["own"]) for r in N.verify_side(cell([0] * 3), 0.8).to_pylist()}
    assert got == {b"a": (2, b"a"), b"b": (1, b"a"), b"c": (0, b"c")}


def test_a_cell_links_across_and_gives_a_forest_of_roots():
    got = sorted(N.verify_across(cell([0, 1, 1]), 0.8).to_pylist(), key=str)
    assert got == [
        {"digest": b"a", "links": 0, "other": b"b"},
        {"digest": b"a", "links": 2, "other": None},
        {"digest": b"b", "links": 1, "other": None},
    ]
    same_root = N.verify_across(cell([0, 1, 1], (b"a", b"a", b"c")), 0.8)
    assert [r["other"] for r in same_root.to_pylist()] == [None, None]


def near_copies(m):
    words = [f"w{i}" for i in range(300)]
    return [(i, " ".join([*words[: i % 280 + 5], f"edit{i}", *words[i % 280 + 6 :]])) for i in range(m)]


def test_edges_follow_the_nodes_of_a_large_group(spark, monkeypatch):
    """Twice the near copies give about twice the edges, though four times the links."""
    monkeypatch.setattr(N, "SIDE", 32)
    sizes, found = [], N.connected_components
    monkeypatch.setattr(N, "connected_components", lambda e, *a: sizes.append(e.count()) or found(e, *a))
    most = []
    for m in (200, 400):
        sizes.clear()
        df = spark.createDataFrame(near_copies(m), "doc_id long, text string")
        got = N.near_duplicates(df).collect()
        assert {(r["class_id"], r["n_links"]) for r in got} == {(0, m - 1)}
        most.append(max(sizes))
    assert most[1] <= 2.5 * most[0]


def test_sides_are_bounded_in_shingles(spark, monkeypatch):
    monkeypatch.setattr(N, "SIDE_GRAMS", 2000)
    rows = near_copies(40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["class_id"], r["n_links"]) for r in N.near_duplicates(df).collect()} == {(0, 39)}
