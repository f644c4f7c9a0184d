"""Literal cases of the operators, worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.functions import policy as P
from papyra.functions import text as T
from papyra.operators import cluster as C
from papyra.operators import decide as D
from papyra.operators import graph as G
from papyra.operators import ingest as I
from papyra.operators import ledger as L
from papyra.operators import reason as R
from papyra.operators.components import connected_components
from papyra.operators.scratch import Scratch
from papyra.plans import catalog
from papyra.plans import views as V


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_slicer(spark):
    text = F.col("t")
    assert one(spark, T.blocks(text), t="A. B! C? D. E.") == ["A. B! C? D.", "E."]
    assert one(spark, T.blocks(text), t="  ") == []
    assert one(spark, T.blocks(text), t="x" * 2000) == ["x" * 2000]


def test_triple_parsing(spark):
    said = 'Here are triples:\n"a" | causes | b\nnote\nc | inhibits |\nd | treats | e | x\nf | treats | g\nDone.'
    assert one(spark, T.parse_triples(F.col("t")), t=said) == [["a", "causes", "b"], ["f", "treats", "g"]]
    assert one(spark, T.parse_triples(F.col("t")), t="NONE") == []


@pytest.mark.parametrize(
    ("node", "noise"),
    [(x, True) for x in ["2020", "42", "45%", "doi:10.1/x", "10.123/abc", "https://a.b", "!", "...", "the", " "]]
    + [(x, False) for x in ["gene editing", "p53", "DNA"]],
)
def test_noise(spark, node, noise):
    assert one(spark, T.is_noise(F.col("n")), n=node) is noise


def test_impactful(spark):
    got = {n: one(spark, T.is_impactful(F.col("n")), n=n) for n in ["DNA", "gene editing", "Aspirin", "p53", "cell", "x"]}
    assert got == {"DNA": True, "gene editing": True, "Aspirin": True, "p53": True, "cell": False, "x": False}


PATH_EDGES = [("a", "b"), ("b", "c"), ("d", "a"), ("d", "e"), ("f", "g"), ("h", "g")]


def graph(spark, pairs):
    return spark.createDataFrame([(s, "causes", o, 1) for s, o in pairs], "subject string, predicate string, object string, support int")


def test_discovery(spark):
    h = R.hypotheses_of(R.discovery_paths(G.pair_edges(graph(spark, PATH_EDGES)))).collect()
    assert sorted(r["path"] for r in h) == [["a", "b", "c"], ["d", "a", "b"]]
    assert h[0]["explanation"].count("-[causes]->") == 2


def test_discovery_edge_shapes(spark):
    assert R.discovery_paths(G.pair_edges(graph(spark, [("a", "a"), ("a", "b"), ("b", "a"), ("b", "c")]))).count() == 0
    assert R.discovery_paths(G.pair_edges(graph(spark, []))).count() == 0
    assert R.discovery_paths(G.pair_edges(graph(spark, PATH_EDGES)), seeds=[]).count() == 0


def test_verification(spark):
    want = {
        ("a", "b"): ("direct_forward", ["a", "b"]), ("b", "a"): ("direct_reverse", ["a", "b"]), ("a", "c"): ("2hop_forward", ["a", "b", "c"]),
        ("c", "a"): ("2hop_reverse", ["a", "b", "c"]), ("a", "e"): ("common_cause", ["a", "d", "e"]), ("f", "h"): ("collider", ["f", "g", "h"]),
        ("a", "g"): ("none", None), ("a", "zz"): ("none", None),
    }
    q = spark.createDataFrame(list(want), "source string, target string")
    got = {(r["source"], r["target"]): (r["connection_type"], r["path"]) for r in R.verify_pairs(q, graph(spark, PATH_EDGES)).collect()}
    assert got == want


def hyp(spark, rows):
    return spark.createDataFrame(
        rows, "job_id int, source string, target string, path array<string>, confidence int, passed_filter boolean, filter_reason map<string,string>, predicates array<string>"
    )


WORKED = [
    (1, "A", "B", ["A", "X", "B"], 5, True, None, ["p"]),
    (1, "A", "B", ["A", "Y", "B"], 4, True, None, ["p"]),
    (1, "A", "C", ["A", "Z", "C"], 3, False, {"low_confidence": "x"}, ["p"]),
]


def test_worked_measurements(spark):
    h = hyp(spark, WORKED)
    m = D.core_measurements(h).first()
    assert (m["total_hypothesis_count"], m["passed_hypothesis_count"], m["rejected_hypothesis_count"], m["promising_hypothesis_count"]) == (3, 2, 1, 0)
    assert m["max_normalized_confidence"] == 0.5 and abs(m["mean_normalized_confidence"] - 0.45) < 1e-9
    assert (m["unique_source_target_pairs"], m["unique_nodes_in_paths"], m["is_dominant_clear"]) == (1, 4, False)
    assert abs(m["diversity_score"] - 4 / 6) < 1e-9 and abs(m["filtered_to_total_ratio"] - 2 / 3) < 1e-9
    i = D.indirect_measurements(h).first()
    assert (i["max_paths_per_pair"], i["mean_paths_per_pair"], i["dominant_pair"], i["dominant_pair_path_ratio"]) == (2, 1.5, "A,B", 1.0)
    assert (i["unique_intermediate_nodes_dominant"], i["redundancy_score"], i["confidence_variance"]) == (2, 0.0, 0.25)
    assert abs(i["dominant_confidence_gap"] - 0.4) < 1e-9 and abs(i["pair_distribution_entropy"] - 0.918296) < 1e-6
    assert (i["mean_path_length"], i["path_length_variance"]) == (3.0, 0.0)
    row = D.core_measurements(h).join(D.indirect_measurements(h), "job_id").withColumns(
        {"growth_score": F.lit(0.0), "evidence_growth_rate": F.lit(0.0), "saturated": F.lit(False), "graph_density": F.lit(0.5)}
    )
    assert row.select(D.decide_discovery().alias("d")).first()["d"] == "fetch_more_literature"
    assert D.rejection_reasons(h).first()["reason"] == "low_confidence"


def test_stability(spark):
    def pairs(rows):
        return spark.createDataFrame(rows, "job_id int, source string, target string")

    jobs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "job_id int")
    before, now = pairs([(1, "a", "b"), (1, "a", "c"), (1, "a", "c"), (2, "x", "y")]), pairs([(1, "a", "b"), (1, "q", "r"), (3, "a", "b")])
    got = {r["job_id"]: r["hypothesis_stability"] for r in D.stability(jobs, now, before).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 1.0, 4: 0.0}


def test_as_of_over_slices_equals_one_sort(spark):
    rng = np.random.default_rng(6)
    runs = [(int(j), i, int(t)) for i, (j, t) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 90, 300), strict=True))]
    decisions = [(int(j), float(i), int(t)) for i, (j, t) in enumerate(zip(rng.integers(0, 2, 40), rng.permutation(90)[:40], strict=True))]
    seconds = F.timestamp_seconds("t").alias("created_at")
    r = spark.createDataFrame(runs, "job_id int, run_id long, t long").select("job_id", "run_id", seconds)
    d = spark.createDataFrame(decisions, "job_id int, value double, t long").select("job_id", "value", seconds)
    want = {}
    for j, i, t in runs:
        own = sorted((x, v) for k, v, x in decisions if k == j)
        want[i] = (next((v for x, v in reversed(own) if x < t), None), next((v for x, v in own if x > t), None))
    for rows in (10, 1000):
        got = D.around(r, d, slice_rows=rows).collect()
        assert {x["run_id"]: (x["before_value"], x["after_value"]) for x in got} == want


def test_filters(spark):
    rows = [(1, "a", "c", ["a", "b", "c"], 1, None, None, ["causes"]), (1, "a", "d", ["a", "b", "d"], 2, None, None, ["causes"]), (1, "a", "e", ["a", "b", "e"], 9, None, None, ["Mentions", "about"])]
    got = {r["target"]: r for r in R.filter_hypotheses(hyp(spark, rows)).collect()}
    assert set(got) == {"c", "d"}
    assert not got["c"]["passed_filter"] and got["c"]["filter_reason"] == {"evidence_threshold": "Confidence 1 < 2"}
    assert got["d"]["passed_filter"] and got["d"]["filter_reason"] is None


def test_boost_floors(spark):
    assert one(spark, R.boosted(F.col("c"), 1.2), c=4) == 4
    assert one(spark, R.boosted(F.col("c"), 1.2), c=5) == 6
    assert one(spark, R.boosted(F.col("c"), 9.0), c=80) == 100


def test_spans():
    assert I._spans("a\n\nb c", 4) == ["a", "b c"]
    assert I._spans("x" * 10, 4) == ["xxxx", "xxxx", "xx"]
    assert I._spans(" " + "x" * 10, 4)[-1].strip("x") == ""


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert connected_components(edges.limit(0), Scratch(spark, "t")).count() == 0


def plain_linkage(x, cut):
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        d, a, b = min((np.mean([1 - x[i] @ x[j] for i in groups[a] for j in groups[b]]), a, b) for b in range(len(groups)) for a in range(b))
        if not d < cut:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_average_linkage_over_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = C.clusters(df, 0.8).toPandas()
    assert {frozenset(g.id) for _, g in got.groupby("cluster")} == plain_linkage(x, 0.2)


def test_linkage_rounds_equal_the_matrix(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(C, "LINK_ROWS", 1)
    got = C.clusters(df, 0.8).toPandas()
    assert {frozenset(g.id) for _, g in got.groupby("cluster")} == plain_linkage(x, 0.2)
    assert all(g.id.min() == c for c, g in got.groupby("cluster"))


def test_similarity_over_blocks(spark):
    x = np.random.default_rng(4).normal(size=(50, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if u[i] @ u[j] > 0.7}
    assert {(r["a"], r["b"]) for r in C.similarity_pairs(df, 0.7, block_rows=16).collect()} == want


def test_hex_distance(spark):
    assert one(spark, T.hex_distance(F.col("a"), F.col("b")), a="abcd", b="abce") == 1
    assert one(spark, T.hex_distance(F.col("a"), F.col("b")), a="abc", b="abcde") == 5
    assert one(spark, T.fingerprint_similarity(F.col("a"), F.col("b")), a="", b="ab") == 0.0


def test_paper_record(spark):
    r = one(spark, L.paper_record(F.col("j")), j='{"abstract": "x", "openAccessPdf": {"url": " "}, "authors": [{}]}')
    assert (r["title"], r["authors"], r["pdf_url"], r["doi"]) == ("Untitled", ["Unknown"], None, None)


def test_versions(spark):
    old = spark.createDataFrame([(1, 3), (1, 2)], "job_id int, version int")
    new = spark.createDataFrame([(1, "a"), (2, "b")], "job_id int, x string")
    assert {r["job_id"]: r["version"] for r in G.version_rows(new, old).collect()} == {1: 4, 2: 1}


def test_policy_tables():
    assert len(P.PREDICATE_MAP) == 27 and len(P.NOISE_WORDS) == 28 and len(P.NOISE_PATTERNS) == 14


def test_spans_leave_in_small_batches(spark, monkeypatch):
    """A worker lets spans go after a bounded number of characters; null texts have none, empty ones an empty span."""
    monkeypatch.setattr(I, "SPAN_BATCH", 40)
    texts = ["word " * 30, None, "", "x" * 25, "a\n\nb c", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "source_id long, text string").coalesce(1)
    got = sorted((r["source_id"], r["pos"], r["span"]) for r in I.split_spans(rows, limit=10).collect())
    assert got == [(i, p, s) for i, t in enumerate(texts) if t is not None for p, s in enumerate(I._spans(t, 10))]


def test_components_need_few_rounds(spark):
    """A chain of 300 nodes in random order: trees hang under trees, so 8 rounds suffice where labels alone took 149."""
    order = np.random.default_rng(8).permutation(300).tolist()
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    scratch = Scratch(spark, "t")
    assert {r["root"] for r in connected_components(edges, scratch).collect()} == {0}
    assert scratch.n <= 2 + 2 * 8


def test_lines_are_cut_once(spark):
    """Texts are split into lines and a line into parts once each; quotes need no pattern."""
    plan = spark.createDataFrame([("a | 'b' | c",)], "r string").select(T.parse_triples(F.col("r")).alias("t"))
    assert plan.first()["t"] == [["a", "b", "c"]]
    said = plan._jdf.queryExecution().analyzed().toString()
    assert said.count("split(") == 2 and "regexp_replace" not in said


@pytest.mark.parametrize("name", ["policy_overrides", "partial_deactivate"])
def test_results_do_not_read_texts_again(spark, sf_dir, name):
    """Pairs and triples are written, so what paths read many times is small."""
    assert not [f for f in catalog.queries()[name](spark, sf_dir).inputFiles() if "documents" in f]


def test_increments_parse_texts_once(spark, sf_dir, monkeypatch):
    names, write = [], V.written
    monkeypatch.setattr(V, "written", lambda df, name: names.append(name) or write(df, name))
    catalog.queries()["incremental_edges"](spark, sf_dir)
    assert names.count("triples") == 1
