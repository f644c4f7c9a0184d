"""Consolidation of a sanitised graph by embedding similarity, whole or step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster as C
from . import graph as G
from .scratch import Scratch


def _numbered(vectors: DataFrame) -> DataFrame:
    """Vectors with ids that follow the order of the texts, so ties go to the lesser text; to be written before use."""
    return vectors.select("text", "embedding").orderBy("text").select(F.monotonically_increasing_id().alias("id"), "text", "embedding")


#: Columns of a node of a consolidated graph.
NODE = "text string, type string, aliases array<string>, attributes map<string, string>, cluster_score double, embedding array<double>"
_NO_NAMES, _NO_ATTRIBUTES, _NO_VECTOR = "array<string>", "map<string, string>", "array<double>"


def _nodes(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """text, type and attributes of a graph's nodes: those of its edges, as concepts, where no table is given."""
    if nodes is None:
        return G.nodes_of(edges).select(F.col("node").alias("text"), F.lit("concept").alias("type"), F.create_map().cast(_NO_ATTRIBUTES).alias("attributes"))
    known = F.col("attributes") if "attributes" in nodes.columns else F.lit(None)
    return nodes.select("text", "type", F.coalesce(known.cast(_NO_ATTRIBUTES), F.create_map().cast(_NO_ATTRIBUTES)).alias("attributes"))


def merge(
    edges: DataFrame, blocks: DataFrame, vectors: DataFrame, similarity: float, nodes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, postings) of the consolidated graph.

    vectors: text, embedding of the graph's nodes; nodes: text, type and attributes (those of
    the edges, as concepts, if none are given). Mergeable concepts are clustered by
    average linkage; each cluster becomes its canonical member with its attributes, all
    aliases, the centroid and the mean similarity of the members to it. Nodes of other
    types are united with them as they are; concepts that may not merge are left out.
    Edges are rewritten and merged. Without mergeable concepts there are no nodes, and
    edges and postings stay as they are, loops too.
    """
    scratch = Scratch(edges.sparkSession, "semantic")
    known = scratch.write(_nodes(nodes, edges))
    concepts = known.where((F.col("type") == "concept") & G.mergeable(F.col("text")))
    vec = scratch.write(_numbered(vectors.join(concepts, "text", "left_semi")))
    if vec.isEmpty():
        return edges.sparkSession.createDataFrame([], NODE), edges, blocks
    labels = C.clusters(vec, similarity)
    members = scratch.write(vec.join(labels, "id").select(F.col("text").alias("node"), "cluster", "embedding"))
    canon = scratch.write(G.canonical_labels(members.select("cluster", "node"), G.row_degree(edges)))
    scores = C.cluster_scores(members, "cluster").drop("members")
    named = canon.join(scores, "cluster").withColumnRenamed("canonical", "text").join(known.select("text", "attributes"), "text")
    merged = named.select("text", F.lit("concept").alias("type"), "aliases", "attributes", "cluster_score", "embedding")
    others = known.where(F.col("type") != "concept").select(
        "text", "type", F.array().cast(_NO_NAMES).alias("aliases"), "attributes", F.lit(None).cast("double").alias("cluster_score"), F.lit(None).cast(_NO_VECTOR).alias("embedding")
    )
    mapping = canon.select(F.explode("aliases").alias("node"), "canonical")
    return (merged.unionByName(others), *G.rewrite_edges(edges, blocks, mapping))


def merge_incrementally(
    nodes: DataFrame, edges: DataFrame, blocks: DataFrame, new_edges: DataFrame, new_blocks: DataFrame, vectors: DataFrame, similarity: float,
    new_nodes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, postings) after new edges join a consolidated graph.

    A new concept becomes an alias of its nearest canonical concept if that is at least
    ``similarity`` near, else a canonical node of its own with its attributes; new nodes
    are not compared with each other. Nodes of other types stay what they are. Without
    new concepts the graph stays as it is.
    """
    scratch = Scratch(edges.sparkSession, "increment")
    fresh = _nodes(new_nodes, new_edges).where("type = 'concept'").join(nodes.select("text"), "text", "left_anti")
    fresh = scratch.write(fresh)
    if fresh.isEmpty():
        return nodes, edges, blocks
    vec = scratch.write(_numbered(vectors))
    q = vec.join(fresh, "text", "left_semi")
    c = vec.join(nodes.where("type = 'concept'").select("text"), "text", "left_semi")
    near = C.nearest(q, c, similarity).join(vec.select("id", "text"), "id")
    near = near.join(vec.select(F.col("id").alias("nearest"), F.col("text").alias("canonical")), "nearest").select("text", "canonical")
    mapping = scratch.write(fresh.join(near, "text", "left").select("text", "attributes", F.coalesce("canonical", "text").alias("canonical")))
    gained = mapping.where("text <> canonical").groupBy(F.col("canonical").alias("text")).agg(F.sort_array(F.collect_set("text")).alias("more"))
    old = nodes.join(gained, "text", "left").withColumn("aliases", F.array_union("aliases", F.coalesce("more", F.array().cast(_NO_NAMES)))).drop("more")
    added = mapping.where("text = canonical").join(vectors.select("text", F.col("embedding").cast(_NO_VECTOR).alias("embedding")), "text", "left").select(
        "text", F.lit("concept").alias("type"), F.array().cast(_NO_NAMES).alias("aliases"), "attributes", F.lit(1.0).alias("cluster_score"), "embedding"
    )
    renames = mapping.select(F.col("text").alias("node"), "canonical")
    return (old.unionByName(added), *G.merge_increment(edges, blocks, new_edges, new_blocks, renames))
