import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from papyra.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(top, proof of every leaf) by plain recursion over whole levels."""
    levels, proofs = [leaves], [[] for _ in leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        for k in range(len(leaves)):
            i = k >> (len(levels) - 1)
            s = i ^ 1
            proofs[k].append((s < i, low[s]) if s < len(low) else (None, None))
        levels.append([h(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return levels[-1][0], proofs


def plain(rows, grp, order, leaf):
    groups = {}
    for r in rows:
        groups.setdefault(grp(r), []).append((order(r), leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in names:
        made[g] = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tops = {g: tree([d for _, d in made[g]]) for g in names}
    root, above = tree([tops[g][0] for g in names])
    return sorted(
        ((str(o), d, tops[g][0], root, tuple(p) + tuple(above[i])) for i, g in enumerate(names) for (o, d), p in zip(made[g], tops[g][1], strict=True)), key=str
    )


def got(df, order="doc_id"):
    return sorted(((str(r[order]), r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["digest"]) for s in r["proof"])) for r in df.collect()), key=str)


def leaf(r):
    return h(*("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def test_edges(spark, edge_docs, empty_docs):
    rows = edge_docs.collect()
    odd = edge_docs.withColumns({c: F.lit("x") for c in ("leaf", "grp", "proof", "root", "o1", "top", "_at")})
    assert got(merkle.manifest(odd, merkle.leaf_of(*FIELDS))) == plain(rows, lambda r: r["lang"], lambda r: r["doc_id"], leaf)
    assert merkle.manifest(empty_docs, merkle.leaf_of(*FIELDS)).count() == 0
    assert merkle.tamper_check(empty_docs).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    one = edge_docs.where("doc_id = 7")
    r = merkle.tamper_check(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h()


@pytest.mark.parametrize("part, step", [(7, 1), (16, 2), (50, 3)])
def test_many_partitions_and_a_hot_group(spark, monkeypatch, part, step):
    """A third and more of the rows in one group, many small groups, repeated rows: partitions cut trees at any place."""
    monkeypatch.setattr(merkle, "PART_ROWS", part)
    monkeypatch.setattr(merkle, "STEP", step)
    rng = random.Random(part)
    rows = [(rng.choice(("hot", "hot", "hot", "b", None, f"g{rng.randrange(60)}")), rng.randrange(600), i % 50) for i in range(700)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, n long").repartition(9)
    want = plain(rows, lambda r: r[0], lambda r: r[1], lambda r: h(f"{len(str(r[2]))}:{r[2]}"))
    assert got(merkle.manifest(df, merkle.leaf_of("n"))) == want


def test_proofs_find_every_change(spark, edge_docs):
    out = merkle.tamper_check(edge_docs).collect()
    for r in out:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        null = r["doc_id"] == 3
        assert r["verified"] == (not hit or null)


@pytest.mark.parametrize("total", [1, 2, 3, 5, 8, 13, 64, 77])
def test_subtrees_and_edges_cover_a_run_once(total):
    leaves = [h(str(i)) for i in range(total)]
    top, _ = tree(leaves)
    assert merkle.subtrees(leaves, 0, total)[-1] == (0, [top])
    for cut in range(1, total):
        nodes = {}
        for a, b in ((0, cut), (cut, total)):
            levels = merkle.subtrees(leaves[a:b], a, total)
            found = merkle.edges(levels, total)
            assert sorted(x for k, i in found for x in range(i << k, min((i + 1) << k, total))) == list(range(a, b))
            assert len(found) <= 2 * len(levels)
            nodes |= {(k, i): levels[k][1][i - levels[k][0]] for k, i in found}
        (_, _), paths = merkle.finish(nodes, total, 20)
        for (k, i), path in paths.items():
            acc = nodes[k, i]
            for s in path:
                acc = h(acc) if s is None else h(s[1], acc) if s[0] else h(acc, s[1])
            assert acc == top
