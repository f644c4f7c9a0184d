"""Paths over versions of a graph, and verification around hubs."""

import random

import pytest
from pyspark.sql import functions as F

from papyra.operators import graph as G
from papyra.operators import incremental as I
from papyra.operators import reason as R

PAIR = "subject string, object string, predicates array<string>, support int"
SHOWN = ["source", "mid", "target", "predicates_1", "predicates_2", "support_1", "support_2"]


def frame(spark, pairs):
    return spark.createDataFrame([(u, v, list(p), n) for (u, v), (p, n) in pairs.items()], PAIR)


def rows(paths):
    return sorted(map(str, (tuple(r) for r in paths.select(*SHOWN).collect())))


def plain(pairs):
    out = []
    for (a, b), (p, n) in pairs.items():
        for (c, d), (q, k) in pairs.items():
            if b == c and len({a, b, d}) == 3 and not {(a, d), (d, a), (b, a), (d, b)} & set(pairs):
                out.append(str((a, b, d, list(p), list(q), n, k)))
    return sorted(out)


def test_ten_versions_equal_full_recomputation(spark):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(22)]

    def some():
        return (rng.choice(names), rng.choice(names)), ((rng.choice("pqr"),), rng.randrange(1, 4))

    pairs = dict(some() for _ in range(60))
    paths = R.discovery_paths(frame(spark, pairs))
    assert rows(paths) == plain(pairs)
    for version in range(10):
        after = {k: v for k, v in pairs.items() if rng.random() > 0.1}
        after.update(some() for _ in range(version))
        found = I.updated_paths(paths, frame(spark, pairs), frame(spark, after))
        assert rows(found) == plain(after)
        pairs = after
        paths = spark.createDataFrame(found.collect(), found.schema)


def test_small_changes_cost_little(spark):
    rng = random.Random(2)
    pairs = {(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}"): (("p",), 1) for _ in range(3000)}
    after = dict(pairs)
    for k in list(pairs)[:5]:
        del after[k]
    after.update({("new", f"n{i}"): (("p",), 1) for i in range(5)})
    changed = I.changes(frame(spark, pairs), frame(spark, after))
    assert changed.count() == 10
    fresh = I.fresh_candidates(frame(spark, after), changed, I.touched_hops(changed)).count()
    assert fresh < 0.02 * R.discovery_paths(frame(spark, after)).count()


def test_nothing_changed(spark):
    pairs = frame(spark, {("a", "b"): (("p",), 1), ("b", "c"): (("q",), 2)})
    paths = R.discovery_paths(pairs)
    assert rows(I.updated_paths(paths, pairs, pairs)) == rows(paths) != []
    none = pairs.limit(0)
    assert I.updated_paths(paths, pairs, none).count() == 0 and rows(I.updated_paths(paths.limit(0), none, pairs)) == rows(paths)


def test_seeds_of_any_kind(spark):
    pairs = frame(spark, {("a", "b"): (("p",), 1), ("b", "c"): (("p",), 1), ("x", "y"): (("p",), 1), ("y", "z"): (("p",), 1)})
    table = spark.createDataFrame([("z",), ("z",)], "node string")
    assert {r["source"] for r in R.discovery_paths(pairs, seeds=["a"]).collect()} == {"a"}
    assert {r["source"] for r in R.discovery_paths(pairs, seeds=table).collect()} == {"x"}
    both = R.effective_seeds(["a", "a"], table)
    assert sorted(r["node"] for r in both.collect()) == ["a", "z"]
    assert R.discovery_paths(pairs, seeds=both).count() == 2
    assert [r["node"] for r in R.effective_seeds(None, table).collect()] == ["z"]


def ladder(pairs, source, target):
    nodes = {x for p in pairs for x in p}
    if (source, target) in pairs:
        return "direct_forward", [source, target]
    if (target, source) in pairs:
        return "direct_reverse", [target, source]
    tests = (
        ("2hop_forward", lambda m: (source, m) in pairs and (m, target) in pairs, lambda m: [source, m, target]),
        ("2hop_reverse", lambda m: (target, m) in pairs and (m, source) in pairs, lambda m: [target, m, source]),
        ("common_cause", lambda m: (m, source) in pairs and (m, target) in pairs, lambda m: [source, m, target]),
        ("collider", lambda m: (source, m) in pairs and (target, m) in pairs, lambda m: [source, m, target]),
    )
    for name, holds, path in tests:
        for m in sorted(nodes - {source, target}):
            if holds(m):
                return name, path(m)
    return "none", None


@pytest.mark.parametrize("bucket", [2, 1024])
def test_ladder_equals_plain(spark, bucket):
    rng = random.Random(bucket)
    pairs = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)} | {("hub", f"n{i}") for i in range(0, 30, 2)} | {(f"n{i}", "hub") for i in range(1, 30, 4)}
    asked = [(f"n{i}", f"n{j}") for i in range(0, 30, 3) for j in range(30)] + [("hub", f"n{i}") for i in range(30)] + [("gone", "n1"), ("n1", "gone"), ("hub", "hub"), ("n1", "n1")]
    edges = spark.createDataFrame([(u, "p", v) for u, v in pairs], "subject string, predicate string, object string")
    got = {(r["source"], r["target"]): (r["connection_type"], r["path"]) for r in R.verify_pairs(spark.createDataFrame(asked + asked[:9], "source string, target string"), edges, bucket).collect()}
    assert got == {q: ladder(pairs, *q) for q in set(asked)}
    assert {kind for kind, _ in got.values()} == {*R.PATTERNS, "none"}


def test_a_hub_costs_what_its_partner_has(spark):
    """A hub of 20,000 links asked about leaves of few: rows follow the leaves, and no join key holds more than a bucket."""
    links = spark.range(20_000).selectExpr("'hub' as u", "'x' || id as v").union(spark.createDataFrame([(f"leaf{i}", f"x{i * 7}") for i in range(300)], "u string, v string"))
    asked = spark.createDataFrame([("hub", f"leaf{i}") for i in range(300)], "source string, target string")
    assert R.expansions(asked, links, ("out", "out")).count() == 300
    assert R.wedges(asked, links, ("out", "out")).count() == 300
    _, near = R._neighbours(links, "u", "v", 1024)
    assert near.where("node = 'hub'").groupBy("bucket").count().agg(F.max("count")).first()[0] < 1400


def test_affected_nodes_reach_explore(spark):
    versions = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (2, "b", "c")], "version int, subject string, object string")
    assert [(r["version"], r["node"]) for r in G.affected_nodes(versions).collect()] == [(2, "c")]


def moved_rows(spark, run):
    """Rows that the stages of a run write for shuffles."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def total():
        stages = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_verification_moves_links_few_times(spark):
    """One question a link: all kinds of middles come from one expansion, so rows moved stay a small multiple of links."""
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(3000)}", f"n{rng.randrange(3000)}") for _ in range(12_000)}
    edges = spark.createDataFrame(sorted(pairs), "subject string, object string").cache()
    asked = edges.selectExpr("inline(array(struct(subject as source, object as target), struct(object as source, subject as target)))").cache()
    assert edges.count() == len(pairs) and asked.count() == 2 * len(pairs)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = moved_rows(spark, lambda: R.verify_pairs(asked, edges).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert moved < 12 * len(pairs)


def test_open_questions_are_expanded_once(spark, monkeypatch):
    seen, known = [], R.expansions
    monkeypatch.setattr(R, "expansions", lambda asked, *a: seen.append(sorted(map(tuple, asked.select("source", "target").collect()))) or known(asked, *a))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a"), ("d", "c")], "subject string, object string")
    asked = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "b"), ("b", "a"), ("b", "d")], "source string, target string")
    kinds = {(r["source"], r["target"]): r["connection_type"] for r in R.verify_pairs(asked, edges).collect()}
    assert kinds == {("a", "c"): "2hop_forward", ("c", "a"): "2hop_reverse", ("a", "b"): "direct_forward", ("b", "a"): "direct_reverse", ("b", "d"): "2hop_reverse"}
    assert seen == [[("a", "c"), ("b", "d")]]


@pytest.mark.parametrize("bucket", [1, 1024])
def test_ladder_with_nulls_loops_and_repeats(spark, bucket):
    """Null ends are tied to nothing and stay in their places; loops and repeated links count once."""
    links = [("a", "a"), ("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("d", "c"), ("e", "c"), ("c", "f"), (None, "a"), ("a", None), (None, None), ("", "a")]
    edges = spark.createDataFrame(links, "subject string, object string")
    ends = ["a", "b", "c", "d", "e", "f", "", "gone", None]
    asked = [(s, t) for s in ends for t in ends]
    got = {(r["source"], r["target"]): (r["connection_type"], r["path"]) for r in R.verify_pairs(spark.createDataFrame(asked + asked, "source string, target string"), edges, bucket).collect()}
    pairs = {p for p in links if None not in p}
    assert got == {q: ("none", None) if None in q else ladder(pairs, *q) for q in asked}
