"""Sources, providers and whole-graph consolidation."""

import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.functions.settings import Policy, PolicyError, job_settings, load_policy, policy_of
from papyra.operators import decide as D
from papyra.operators import evidence as I
from papyra.operators import graph as G
from papyra.operators import intake as N
from papyra.operators import ledger as L
from papyra.operators import records as K
from papyra.operators import semantic as S
from papyra.sources import embeddings as E
from papyra.sources import files
from papyra.sources import search as X


def test_stored_search(spark, tmp_path):
    for q, titles in {"a b": ["One", "Two"], "c": []}.items():
        (tmp_path / X.query_file(q)).write_text(json.dumps({"data": [{"title": t} for t in titles]}))
    queries = spark.createDataFrame([("a b",), ("c",), ("missing",), ("a b",)], "query string")
    raw = X.stored(spark, queries, str(tmp_path))
    assert raw.count() == 2
    got = X.batch_of(raw, 1).select("query", L.paper_record(F.col("record")).alias("p")).collect()
    assert [(r["query"], r["p"]["title"]) for r in got] == [("a b", "One")]


class Service(http.server.BaseHTTPRequestHandler):
    """Fails on paths of /bad, answers 429 once on /busy, wants no key on /open."""

    seen = []

    def do_GET(self):
        path, query = self.path.split("?")
        busy = path == "/busy" and path not in self.seen
        self.seen.append(path)
        code = 500 if path == "/bad" else 429 if busy else 403 if path == "/open" and self.headers.get("x-api-key") else 200
        self.send_response(code)
        self.end_headers()
        if code == 200:
            self.wfile.write(json.dumps({"data": [{"title": f"{path} {query}"}]}).encode())

    def log_message(self, *a):
        pass


def test_the_next_service_answers_where_one_fails(spark, monkeypatch):
    monkeypatch.setattr(X.time, "sleep", lambda s: None)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    services = {"a": {"endpoint": f"{at}/bad", "retries": 0}, "b": {"endpoint": f"{at}/good"}, "o": {"endpoint": f"{at}/open", "key": "k"}, "dead": {"endpoint": "http://127.0.0.1:1/x", "timeout": 1}}
    order = {"default": ["dead", "a", "b"], "bio": ["o", "unknown"], "worst": ["a", "dead"]}
    got = X.search(spark, ["x", "y z"], X.services_of("other", order, services)).collect()
    assert sorted((r["query"], r["service"]) for r in got) == [("x", "b"), ("y z", "b")] and "/good query=" in got[0]["record"]
    assert X.search(spark, ["x"], X.services_of("bio", order, services)).first()["service"] == "o"
    assert X.search(spark, ["x"], X.services_of(None, {}, services)).count() == 0
    with pytest.raises(Exception, match="refused|500"):
        X.search(spark, ["x"], X.services_of("worst", order, services)).collect()
    assert X.fetch(f"{at}/busy?q", None, 5, 1, wait=0.0)["data"]
    server.shutdown()


def test_pages_fall_back_without_regions(spark):
    rows = [
        (1, 1, 0, 1, "Abstract"), (1, 1, 250, 0, "right column"), (1, 1, 3, 5, "left column"), (1, 2, 0, 0, "References"), (1, 2, 0, 1, "cut off"),
        (2, 1, 0, 0, "plain page"), (2, 2, 0, 0, "second page"),
    ]
    b = spark.createDataFrame(rows, "source_id int, page int, x0 int, y0 int, text string")
    got = {r["source_id"]: r["text"] for r in files.extract_pages(b, 15).collect()}
    assert got == {1: "left column right column", 2: "plain page\n\nsecon"}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("  \n")
    assert [r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()] == ["one\ntwo"]


def triples(spark, pairs):
    rows = [(i, i, i, s, "p", o) for i, (s, o) in enumerate(pairs)]
    return spark.createDataFrame(rows, "triple_id long, block_id long, ingestion_source_id long, subject string, predicate string, object string")


def evidence(spark, pairs):
    t = triples(spark, pairs)
    return G.structural_edges(t), I.postings(t)


def test_semantic_merge_and_increment(spark):
    edges, blocks = evidence(spark, [("gene editing", "cell wall"), ("gene editings", "cell wall"), ("gene editing", "virus"), ("cell wall", "cell walls")])
    vec = E.embed(G.nodes_of(edges), "node")
    nodes, merged, moved = S.merge(edges, blocks, vec, 0.8)
    got = {r["text"]: r["aliases"] for r in nodes.collect()}
    assert got == {"gene editing": ["gene editing", "gene editings"], "cell wall": ["cell wall", "cell walls"], "virus": ["virus"]}
    assert {(r["subject"], r["object"], r["support"]) for r in merged.collect()} == {("gene editing", "cell wall", 2), ("gene editing", "virus", 1)}
    ids = {(r["subject"], r["object"]): r["triple_ids"] for r in I.with_ids(merged, moved).collect()}
    assert ids == {("gene editing", "cell wall"): [0, 1], ("gene editing", "virus"): [2]}
    new, new_blocks = evidence(spark, [("viruss", "cell wall"), ("membrane", "virus")])
    more = E.embed(G.nodes_of(edges.union(new)), "node")
    after, joined, _ = S.merge_incrementally(nodes, merged, moved, new, new_blocks, more, 0.7)
    names = {r["text"]: r["aliases"] for r in after.collect()}
    assert names["virus"] == ["virus", "viruss"] and names["membrane"] == []
    assert ("virus", "cell wall") in {(r["subject"], r["object"]) for r in joined.collect()}
    same, _, _ = S.merge_incrementally(nodes, merged, moved, edges.limit(0), blocks, vec, 0.7)
    assert same is nodes


def test_semantic_nodes_keep_what_they_are(spark):
    """Attributes and centroids come along, other types stay, concepts that may not merge go."""
    edges, blocks = evidence(spark, [("gene editing", "cell wall"), ("gene editings", "2020-01-01"), ("x", "cell wall")])
    vec = E.embed(G.nodes_of(edges), "node")
    kinds = [("gene editing", "concept", {"doi": "1"}), ("gene editings", "concept", {"doi": "2"}), ("cell wall", "concept", None), ("2020-01-01", "metadata", {"k": "v"}), ("x", "concept", {})]
    table = spark.createDataFrame(kinds, "text string, type string, attributes map<string, string>")
    nodes, _, _ = S.merge(edges, blocks, vec, 0.8, table)
    got = {r["text"]: r for r in nodes.collect()}
    assert set(got) == {"gene editings", "cell wall", "2020-01-01"}
    assert got["gene editings"]["attributes"] == {"doi": "2"} and got["cell wall"]["attributes"] == {}
    assert (got["2020-01-01"]["type"], got["2020-01-01"]["attributes"], got["2020-01-01"]["embedding"]) == ("metadata", {"k": "v"}, None)
    x = np.array([r["embedding"] for r in vec.where("text like 'gene%'").collect()], float)
    mean = x.mean(axis=0)
    assert np.allclose(got["gene editings"]["embedding"], mean / np.linalg.norm(mean))
    assert abs(got["gene editings"]["cluster_score"] - float((x @ (mean / np.linalg.norm(mean))).mean())) < 1e-6


def test_semantic_merge_without_concepts_returns_the_graph(spark):
    edges, blocks = evidence(spark, [("7", "7"), ("7", "9")])
    nodes, same, kept = S.merge(edges, blocks, E.embed(G.nodes_of(edges), "node"), 0.8)
    assert nodes.count() == 0 and same is edges and kept is blocks
    assert {(r["subject"], r["object"]) for r in same.collect()} == {("7", "7"), ("7", "9")}


def test_embeddings_are_unit_and_blank_is_zero():
    x = E.hashed(["Gene editing", "gene editing ", "", "x"])
    assert np.allclose(x[0], x[1]) and np.linalg.norm(x[2]) == 0 and abs(np.linalg.norm(x[3]) - 1) < 1e-6


def test_decide_step(spark):
    fields = "job_id int, created_at int, passed_hypothesis_count int, promising_hypothesis_count int, unique_nodes_in_paths int, diversity_score double, mean_path_length double, max_paths_per_pair int, is_dominant_clear boolean, max_normalized_confidence double, graph_density double, unique_source_target_pairs int"
    history = spark.createDataFrame([(1, t, 5, 0, 9, 0.5, 3.0, 1, False, 0.2, 0.1, 4) for t in (1, 2, 3)], fields)
    now = spark.createDataFrame([(1, 4, 5, 0, 9, 0.5, 3.0, 1, False, 0.2, 0.1, 4), (2, 4, 0, 0, 0, 0.0, 0.0, 0, False, 0.0, 0.0, 0)], fields)
    got = {r["job_id"]: r["decision"] for r in N.decide_step(history, now).collect()}
    assert got == {1: "halt_no_hypothesis", 2: "insufficient_signal"}
    assert D.stage_after(F.lit("INGESTED")) is not None


def test_policies_are_checked(spark, tmp_path):
    assert policy_of({}) == Policy()
    nested = {"algorithm": {"slicing": {"sentences_per_block": 2}, "domain_resolution": {"allowed_domains": ["law"]}}, "llm": {}}
    p = policy_of(nested)
    assert (p.sentences_per_block, p.allowed_domains, p.hub_degree) == (2, ("law",), 25)
    (tmp_path / "p.json").write_text(json.dumps(nested))
    assert load_policy(spark, str(tmp_path / "p.json")) == p
    bad = [{"allowed_domains": []}, {"hub_degree": "many"}, {"min_confidence": 1.5}, {"merge_similarity": 2}, {"sentences_per_block": 0}, {"allowed_domains": [1]}, [], {"hub_degree": True}]
    for values in bad:
        with pytest.raises(PolicyError):
            policy_of(values)
    (tmp_path / "broken.json").write_text("{")
    for name in ("broken.json", "none.json"):
        with pytest.raises(PolicyError):
            load_policy(spark, str(tmp_path / name))
    job = job_settings({"graph_config": {"excluded_entities": ["x"]}, "legacy": 1})
    assert job.excluded_entities == ("x",) and job.domain == "biomedical" and job_settings(None).seeds == ()
    with pytest.raises(PolicyError):
        job_settings({"domain": 3})


def test_jobs_explore_under_their_settings(spark):
    t = triples(spark, [("gene", "cell"), ("cell", "organ"), ("cell", "tissue"), ("organ", "body")])
    ends = {(r["source"], r["target"]) for r in K.explore(t).collect()}
    assert ends == {("gene", "organ"), ("gene", "tissue"), ("cell", "body")}
    seeded = K.explore(t, job=job_settings({"seeds": ["body"]}))
    assert [(r["source"], r["target"], r["mode"]) for r in seeded.collect()] == [("cell", "body", "query")]
    assert K.explore(t, policy_of({"hub_degree": 2})).count() == 0
    assert K.explore(t, job=job_settings({"excluded_entities": ["Cell"], "stoplist": ["organ"]})).count() == 0
    assert {r["passed_filter"] for r in K.explore(t, policy_of({"min_confidence": 1})).collect()} == {True}


def test_appended_rows(spark, tmp_path):
    c = spark.createDataFrame([(1, None, "abc", None)], "job_id int, title string, abstract string, source string")
    rows = K.paper_rows(c, 41).collect()
    assert [(r["title"], r["source"], r["paper_id"] > 41) for r in rows] == [("", "unknown", True)]
    for _ in range(2):
        K.append(K.paper_rows(c), str(tmp_path / "papers"))
    assert K.of_job(spark.read.parquet(str(tmp_path / "papers")), 1).count() == 2
    assert K.job_status(spark.createDataFrame([(1, "NEW")], "job_id int, status string"), 2).count() == 0
