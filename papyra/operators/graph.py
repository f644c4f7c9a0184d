"""Evidence graphs from triples: grouping, sanitising, degrees, consolidation, snapshots.

Edges have edge_id, subject, predicate, object and support; the ids behind them are in
postings (``evidence``). Every function takes and returns DataFrames and keeps the job
column out: filter a job before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions import text as T
from . import evidence as E
from .scratch import Scratch

IDS = E.IDS


def without_entities(triples: DataFrame, excluded: list[str] | None) -> DataFrame:
    """Triples with no excluded entity at either end (any case)."""
    if not excluded:
        return triples
    names = [e.lower() for e in excluded]
    return triples.where(~F.lower("subject").isin(names) & ~F.lower("object").isin(names))


def structural_edges(triples: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Triples grouped by (subject, predicate, object); support counts distinct sources."""
    return E.edges(without_entities(triples, excluded))


def nodes_of(edges: DataFrame) -> DataFrame:
    """Distinct ends of edges."""
    return edges.select(F.explode(F.array("subject", "object")).alias("node")).distinct()


def evidence_groups(triples: DataFrame, threshold: int = 2) -> DataFrame:
    """Groups of equal triples seen at least ``threshold`` times, with distinct blocks and sources."""
    return (
        triples.groupBy("subject", "predicate", "object")
        .agg(
            F.count("*").alias("evidence"),
            F.countDistinct("block_id").alias("blocks"),
            F.countDistinct("ingestion_source_id").alias("sources"),
        )
        .where(F.col("evidence") >= threshold)
    )


def without_noise(edges: DataFrame) -> DataFrame:
    """Edges whose ends are both concepts. A node's class depends on its text alone, so no join is needed."""
    return edges.where(~T.is_noise(F.col("subject")) & ~T.is_noise(F.col("object")))


def sanitise_summary(edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges before and after noise removal, in one row."""
    kinds = nodes_of(edges).select(T.is_noise(F.col("node")).alias("noise"))
    n = kinds.agg(F.count("*").alias("nodes_before"), F.count_if(~F.col("noise")).alias("nodes_after"))
    noisy = T.is_noise(F.col("subject")) | T.is_noise(F.col("object"))
    e = edges.agg(F.count("*").alias("edges_before"), F.count_if(~noisy).alias("edges_after"))
    return n.crossJoin(e).withColumn("nodes_removed", F.col("nodes_before") - F.col("nodes_after"))


def mergeable(node: Column) -> Column:
    """Concepts that clustering may merge: long enough, not all digits, no link."""
    n = F.trim(node)
    return ~T.is_noise(node) & (F.length(n) >= P.NODE_MIN_LENGTH) & ~n.rlike(r"^\d+$") & ~n.contains("://")


def row_degree(edges: DataFrame) -> DataFrame:
    """Edge rows that touch each node; a loop counts once."""
    return (
        edges.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("node"))
        .groupBy("node")
        .agg(F.count("*").alias("degree"))
    )


def pair_degree(pairs: DataFrame) -> DataFrame:
    """In plus out degree over distinct pairs; a loop counts twice."""
    return (
        pairs.select("subject", "object")
        .distinct()
        .select(F.explode(F.array("subject", "object")).alias("node"))
        .groupBy("node")
        .agg(F.count("*").alias("degree"))
    )


def pair_edges(edges: DataFrame) -> DataFrame:
    """One row a (subject, object): its predicates in order and greatest support."""
    return edges.groupBy("subject", "object").agg(F.sort_array(F.collect_set("predicate")).alias("predicates"), F.max("support").alias("support"))


def suppress_hubs(pairs: DataFrame, threshold: int = P.HUB_DEGREE) -> DataFrame:
    """Drop every pair with an end whose degree is over the threshold (0 or less keeps all), in one pass.

    Hubs are written, so that the planner knows their size and pairs need not move to meet few of them.
    """
    if threshold <= 0:
        return pairs
    hubs = Scratch(pairs.sparkSession, "hubs").write(pair_degree(pairs).where(F.col("degree") > threshold).select("node"))
    return pairs.join(hubs, pairs["subject"] == hubs["node"], "left_anti").join(
        hubs.withColumnRenamed("node", "hub"), F.col("object") == F.col("hub"), "left_anti"
    )


def canonical_labels(members: DataFrame, degrees: DataFrame) -> DataFrame:
    """(cluster, canonical, aliases): the member of highest degree, then longest, then first by text.

    members has cluster and node; aliases keep that order.
    """
    order = F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), (-F.length("node")).alias("l"), "node")
    ranked = members.join(degrees, "node", "left").groupBy("cluster").agg(F.sort_array(F.collect_list(order)).alias("m"))
    names = F.transform("m", lambda x: x["node"])
    return ranked.select("cluster", F.get(names, 0).alias("canonical"), names.alias("aliases"))


def rewritten(edges: DataFrame, canon: DataFrame) -> DataFrame:
    """Both ends replaced by their canonical node (node, canonical); others stay."""
    s, o = canon.toDF("subject", "_s"), canon.toDF("object", "_o")
    return (
        edges.join(s, "subject", "left")
        .join(o, "object", "left")
        .withColumns({"subject": F.coalesce("_s", "subject"), "object": F.coalesce("_o", "object")})
        .drop("_s", "_o")
    )


def rewrite_edges(edges: DataFrame, blocks: DataFrame, canon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, postings) with canonical ends; loops go; support is the number of distinct sources united."""
    fresh, moved = E.renamed(rewritten(edges, canon).where("subject <> object"), blocks)
    return E.merged(fresh.withColumn("fresh", F.lit(True)), moved), moved


def merge_increment(old: DataFrame, old_blocks: DataFrame, new: DataFrame, new_blocks: DataFrame, canon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, postings) of old edges united with new ones; an old edge that no new one touches keeps its support."""
    fresh, moved = E.renamed(rewritten(new, canon).where("subject <> object"), new_blocks)
    both = old.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
    blocks = old_blocks.unionByName(moved)
    return E.merged(both, blocks), blocks


def active_snapshot(versions: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows of the highest version of each key."""
    top = versions.groupBy(key).agg(F.max("version").alias("version"))
    return versions.join(top, [key, "version"], "left_semi")


def affected_nodes(versions: DataFrame) -> DataFrame:
    """Nodes of the current version that the one before lacks: version, node."""
    n = versions.select("version", F.explode(F.array("subject", "object")).alias("node")).distinct()
    n = Scratch(versions.sparkSession, "affected").write(n)
    before = n.select((F.col("version") + 1).alias("version"), "node")
    first = n.agg(F.min("version")).first()[0]
    return n.where(F.col("version") > F.lit(first)).join(before, ["version", "node"], "left_anti")


def deactivate(hypotheses: DataFrame, affected: DataFrame) -> DataFrame:
    """is_active false for hypotheses whose path holds an affected node."""
    touched = (
        hypotheses.select("source", "target", "path", F.explode("path").alias("node"))
        .join(affected.select("node").distinct(), "node", "left_semi")
        .select("source", "target", "path")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    return hypotheses.join(touched, ["source", "target", "path"], "left").withColumn("is_active", F.col("_hit").isNull()).drop("_hit")


def version_rows(df: DataFrame, existing: DataFrame, key: str = "job_id") -> DataFrame:
    """df with the next version of its key (1 where there is none); no rows leave the old snapshot active."""
    last = existing.groupBy(key).agg(F.max("version").alias("_last"))
    return df.join(last, key, "left").withColumn("version", F.coalesce(F.col("_last"), F.lit(0)) + 1).drop("_last")


def latest_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
