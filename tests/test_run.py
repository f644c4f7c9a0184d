"""Each field of a policy and of a job's settings changes what a run does."""

import random

import pytest
from pyspark.sql import functions as F

from papyra.functions.settings import JobSettings, Policy, PolicyError, job_settings
from papyra.operators import ledger as L
from papyra.operators.run import JobRun

TRIPLE = "triple_id long, block_id long, ingestion_source_id long, subject string, predicate string, object string"


def triples(spark, pairs):
    return spark.createDataFrame([(i, i, i, s, "p", o) for i, (s, o) in enumerate(pairs)], TRIPLE)


def test_blocks_follow_the_policy(spark):
    text = spark.createDataFrame([(1, "One two. Three four. Five six. Seven.")], "source_id long, text string")
    assert [r["block_text"] for r in JobRun(Policy(sentences_per_block=2)).slices(text).collect()] == ["One two. Three four.", "Five six. Seven."]
    assert JobRun(Policy(sentences_per_block=9, tokens_per_block=3)).slices(text).count() == 4 and JobRun().slices(text).count() < 4


def test_domains_follow_policy_and_job(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "source string, target string")
    none = pairs.limit(0).withColumn("domain", F.lit("x"))
    answers = pairs.withColumn("answer", F.when(F.col("source") == "a", " LAW ").otherwise("art"))

    def got(run):
        return {r["source"]: r["domain"] for r in run.domains(pairs, none, answers).collect()}

    law = Policy(allowed_domains=("law", "tax"))
    assert got(JobRun(law, JobSettings(domain=""))) == {"a": "law", "c": None}
    assert got(JobRun(law, JobSettings(domain="Tax"))) == {"a": "Tax", "c": "Tax"}
    with pytest.raises(PolicyError):
        JobRun(law, job_settings(None))


HYP = "job_id int, source string, target string, path array<string>, confidence int, passed_filter boolean, filter_reason map<string, string>"


def test_numbers_of_leads_and_pairs(spark):
    h = spark.createDataFrame([(1, f"s{i}", "t", [f"s{i}", "m", "t"], i, True, None) for i in range(9)], HYP)
    run = JobRun(Policy(leads=3, top_hypotheses=2), job_settings({"query_config": {"focus_areas": ["x", "y"]}}))
    leads = run.leads(h)
    assert [r["source"] for r in leads.collect()] == ["s8", "s7", "s6"] and [r["source"] for r in run.top_pairs(h).collect()] == ["s8", "s7"]
    assert {r["query_text"] for r in run.searches(leads).collect()} == {f"(relationship between s{i} and t) AND (x OR y)" for i in (6, 7, 8)}
    assert JobRun().searches(leads.limit(1)).first()["query_text"] == "relationship between s8 and t"


def test_affected_nodes_join_the_seeds(spark):
    t = triples(spark, [("gene", "cell"), ("cell", "organ"), ("virus", "host"), ("host", "death"), ("ion", "salt"), ("salt", "sea")])
    run = JobRun(job=JobSettings(seeds=("gene",)))
    affected = spark.createDataFrame([("death",)], "node string")
    assert {r["source"] for r in run.explore(t).collect()} == {"gene"} and {r["source"] for r in run.explore(t, affected).collect()} == {"gene", "virus"}
    assert {r["source"] for r in JobRun().explore(t, affected).collect()} == {"gene", "virus", "ion"}


@pytest.mark.parametrize("similarity", [0.99, 0.95, 0.9, 0.8, 0.7])
def test_fingerprints_of_any_likeness(spark, similarity):
    """Exact for any threshold: compared with the distance of all pairs."""
    rng = random.Random(1)
    known = ["".join(rng.choice("0123456789abcdef") for _ in range(64)) for _ in range(12)]
    asked = []
    for i in range(60):
        f = list(known[i % 12])
        for k in rng.sample(range(64), rng.randrange(64)):
            f[k] = rng.choice("0123456789abcdef")
        asked.append("".join(f))
    schema = "paper_id long, fingerprint string"
    c = spark.createDataFrame([(100 + i, f) for i, f in enumerate(asked)] + [(1, None), (2, "")], schema)
    k = spark.createDataFrame([(i, f) for i, f in enumerate(known)] + [(50, known[3]), (51, None)], schema)
    got = {r["paper_id"]: r["match"] for r in L.by_fingerprint(c, k, similarity).collect()}
    want = {}
    for i, f in enumerate(asked):
        near = [j for j, g in enumerate(known) if 1 - sum(a != b for a, b in zip(f, g, strict=True)) / 256 >= similarity]
        if near:
            want[100 + i] = min(near)
    assert got == want


def test_merging_follows_the_policy(spark):
    from papyra.operators import evidence as E
    from papyra.operators import graph as G
    from papyra.sources import embeddings as M

    t = triples(spark, [("gene editing", "cell wall"), ("gene editings", "cell wall")])
    edges, blocks = G.structural_edges(t), E.postings(t)
    v = M.embed(G.nodes_of(edges), "node")
    assert JobRun(Policy(merge_similarity=0.8)).consolidate(edges, blocks, v)[0].count() == 2
    assert JobRun(Policy(merge_similarity=0.999)).consolidate(edges, blocks, v)[0].count() == 3
