"""Every registered query returns rows, and every branch of a ladder occurs."""

import pytest
from pyspark.sql import functions as F

from papyra.functions import policy as P
from papyra.operators import ledger as L
from papyra.operators import reason as R
from papyra.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_has_rows(spark, name):
    assert not catalog.queries()[name](spark, SMALL).isEmpty()


BRANCHES = {
    "verification_ladder": ("connection_type", {*R.PATTERNS, "none"}),
    "dedup_ladder": ("match_type", {"doi", "external_id", "fingerprint", None}),
    "decision_text": ("decision", set(P.DECISIONS)),
    "metadata_extract": ("attribute", {*P.METADATA_PATTERNS, None}),
    "decision_discovery": ("decision", {"halt_no_hypothesis", "strategic_download_targeted", "halt_confident", "fetch_more_literature", "insufficient_signal"}),
    "decision_verification": ("decision", {"verification_found", "verification_not_found", "fetch_more_literature"}),
}


@pytest.mark.parametrize("name", sorted(BRANCHES))
def test_every_branch_occurs(spark, name):
    column, want = BRANCHES[name]
    got = {r[0] for r in catalog.queries()[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}
    assert got == want


PAPER = "paper_id long, doi string, external_ids map<string, string>, fingerprint string"


def test_duplicates_by_every_test(spark):
    known = spark.createDataFrame(
        [(1, "10.1/A", {"arXiv": "x1"}, "f1"), (2, "10.1/a ", {"PubMed": "77", "arXiv": " "}, "f2"), (3, None, None, "f3"), (4, " ", {"pubmed": "77"}, "f3"), (9, "10.1/Z", {"MAG": "5"}, "f9")], PAPER
    )
    asked = spark.createDataFrame(
        [
            (10, " 10.1/a", {"MAG": "5"}, "f9"),
            (11, None, {"ARXIV": " X1 ", "PubMed": "77"}, "f3"),
            (12, "", {"arXiv": "", "PubMed": " "}, "f3"),
            (13, "10.1/none", {"arXiv": "77"}, "f0"),
            (14, None, None, "f0"),
            (15, "  ", {"pubmed": "77"}, "f9"),
        ],
        PAPER,
    )
    assert {r["paper_id"]: r["match"] for r in L.by_doi(asked, known).collect()} == {10: 1}
    assert {r["paper_id"]: r["match"] for r in L.by_external_id(asked, known).collect()} == {10: 9, 11: 1, 15: 2}
    assert {r["paper_id"]: r["match"] for r in L.by_fingerprint(asked, known).collect()} == {10: 9, 11: 3, 12: 3, 15: 9}
    got = {r["paper_id"]: (r["match"], r["match_type"], r["match_confidence"]) for r in L.find_duplicates(asked, known).collect()}
    assert got == {
        10: (1, "doi", 1.0), 11: (1, "external_id", 0.95), 12: (3, "fingerprint", 0.9), 13: (None, None, None), 14: (None, None, None), 15: (2, "external_id", 0.95),
    }


def test_reports_of_rejections(spark):
    """Each reason of the filters, and none."""
    rows = [("a", "c", ["mentions"], 5), ("a", "d", ["causes"], 5), ("a", "e", ["causes"], 1), ("a", "f", ["causes", "mentions"], 9)]
    h = spark.createDataFrame(rows, "source string, target string, predicates array<string>, confidence int").withColumn("path", F.array("source", F.lit("m"), "target"))
    direct = spark.createDataFrame([("a", "d")], "subject string, object string")
    got = {r["target"]: (r["passed_filter"], list(r["filter_reason"] or {}), r["rejection_type"]) for r in R.with_rejection(h, direct).collect()}
    assert got == {"c": (False, ["predicate_semantics"], "permanent"), "d": (False, ["novelty"], "permanent"), "e": (False, ["evidence_threshold"], "extractable"), "f": (True, [], None)}
