"""Registered queries over sources, providers and whole-graph consolidation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as P
from ..operators import evidence as I
from ..operators import graph as G
from ..operators import intake as N
from ..operators import semantic as S
from ..sources import embeddings as E
from ..sources import files
from . import views as V
from .registry import Registry

REG = Registry()


@REG.query(
    """WITH b AS (SELECT l_orderkey AS source_id, l_linenumber % 2 AS page, l_partkey % 600 AS x0, l_suppkey AS y0, l_shipmode AS text FROM (SELECT *, l_returnflag || l_linenumber AS l_shipmode FROM lineitem))
SELECT source_id, text, (row_number() OVER (PARTITION BY source_id ORDER BY page, x0 // 200, y0, x0, text) - 1)::INTEGER AS seq FROM b"""
)
def layout_order(spark, sf):
    b = V.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("source_id"), (F.col("l_linenumber") % 2).alias("page"), (F.col("l_partkey") % 600).alias("x0"), F.col("l_suppkey").alias("y0"),
        F.concat("l_returnflag", "l_linenumber").alias("text"),
    )
    return files.reading_order(b).select("source_id", "text", "seq")


@REG.query("SELECT user_id AS job_id, 'uploads/' || user_id || '/original/' || md5(event_type || event_id || '.PDF') || '.PDF' AS path FROM events")
def upload_paths(spark, sf):
    name = F.concat("event_type", "event_id", F.lit(".PDF"))
    return V.read(spark, sf, "events").select(F.col("user_id").alias("job_id"), files.upload_path(F.col("user_id"), name).alias("path"))


_KIND = "(['user_text', 'file', 'paper_abstract', 'pdf_text'])[turn % 4 + 1]"


def _inputs(spark, sf):
    kinds = F.array(*map(F.lit, ("user_text", "file", "paper_abstract", "pdf_text")))
    return V.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("job_id"), F.get(kinds, (F.col("turn") % 4).cast("int")).alias("kind"), F.col("turn").cast("string").alias("ref"), F.when(F.col("conv_id") % 3 != 0, F.col("text")).otherwise(" ").alias("text")
    )


@REG.query(
    f"""SELECT conv_id AS job_id, {_KIND} AS source_type, CASE turn % 4 WHEN 0 THEN 'user_text_' || turn WHEN 1 THEN 'file:' || turn ELSE 'paper:' || turn END AS source_ref, false AS processed
FROM conversations WHERE turn % 4 = 1 OR (conv_id % 3 <> 0 AND trim(text) <> '')"""
)
def input_registration(spark, sf):
    return N.register_inputs(_inputs(spark, sf))[0].drop("raw_text")


@REG.query("SELECT DISTINCT conv_id AS job_id, 'READY_TO_INGEST' AS status FROM conversations WHERE turn % 4 = 1 OR (conv_id % 3 <> 0 AND trim(text) <> '')")
def input_states(spark, sf):
    return N.register_inputs(_inputs(spark, sf))[1]


@REG.query(
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'create_query' WHEN 'click' THEN 'append_source' ELSE 'append_message' END AS action,
CASE event_type WHEN 'view' THEN 'FETCH_QUEUED' WHEN 'click' THEN 'READY_TO_INGEST' END AS status FROM events"""
)
def intent_effects(spark, sf):
    label = F.when(F.col("event_type") == "view", "RESEARCH_SEED").when(F.col("event_type") == "click", "EVIDENCE_INPUT").otherwise("WHATEVER")
    return V.read(spark, sf, "events").select("event_id", N.intent_effect(label).alias("e")).select("event_id", "e.*")


@REG.query(
    """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'presentation_decision_found.txt' ELSE 'presentation_fetch.txt' END AS prompt,
CASE WHEN user_id % 2 = 0 THEN 'DECISION/found' ELSE 'FETCH/done' END || ': type=' || event_type || ', user=' || user_id AS message FROM events"""
)
def progress_events(spark, sf):
    even = F.col("user_id") % 2 == 0
    e = V.read(spark, sf, "events").select(
        "event_id", F.when(even, "DECISION").otherwise("FETCH").alias("phase"), F.when(even, "found").otherwise("done").alias("status"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type")).alias("result"),
    )
    return N.progress_event(e).select("event_id", "prompt", "message")


@REG.query(
    """WITH e AS (SELECT event_id AS job_id, event_type AS a, 'u' || user_id % 7 AS b FROM events)
SELECT job_id, substr(sha256(a || '→' || b), 1, 64) AS signature, '(relationship between ' || a || ' and ' || b || ') AND (x OR y)' AS query_text FROM e"""
)
def research_queries(spark, sf):
    e = V.read(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), F.lit("t").alias("topic"), F.array(F.col("event_type"), F.lit("x"), F.lit("y"), F.concat(F.lit("u"), F.col("user_id") % 7)).alias("entities")
    )
    return N.research_query(e)


def _concepts(spark, sf):
    """The sanitised graph's edges and postings and the vectors of its nodes."""
    edges, blocks = V.evidence_of(G.without_noise(V.triples(spark, sf)))
    return edges, blocks, V.written(E.embed(G.nodes_of(edges), "node"), "vectors")


# The provider's hash of three characters, modulo 2^64: its upper 7 bits are the place, bit 20 the sign.
@REG.query(
    f"""WITH {V.SQL_TRIPLES}, {V.sql_edges('v_triples', 'e')}, n AS (SELECT DISTINCT unnest([subject, object]) AS node FROM e),
p AS (SELECT node, '  ' || lower(trim(node)) || ' ' AS p FROM n), i AS (SELECT node, p, unnest(range(1, length(p) - 1)) AS i FROM p),
h AS (SELECT node, ((unicode(substr(p, i, 1))::HUGEINT * 1000003 + unicode(substr(p, i + 1, 1))) * 1000003 + unicode(substr(p, i + 2, 1))) * 11400714819323198485::HUGEINT % 18446744073709551616::HUGEINT AS h FROM i),
s AS (SELECT node, (h // 144115188075855872)::INTEGER AS place, sum(CASE WHEN (h // 1048576) % 2 = 1 THEN 1 ELSE -1 END) AS s FROM h GROUP BY ALL HAVING s <> 0)
SELECT node AS text, place, round(s / sqrt(sum(s * s) OVER (PARTITION BY node)), 5)::DOUBLE AS value FROM s"""
)
def hashed_embeddings(spark, sf):
    v = _concepts(spark, sf)[2]
    places = v.select("text", F.posexplode("embedding").alias("place", "value")).where("value <> 0")
    return places.withColumn("value", F.round(F.col("value").cast("double"), 5))


def _shown(nodes):
    return V.flat(nodes.drop("attributes", "embedding"), "aliases").withColumn("cluster_score", F.round("cluster_score", 6))


@REG.query()
def semantic_merge(spark, sf):
    edges, blocks, v = _concepts(spark, sf)
    return _shown(S.merge(edges, blocks, v, P.MERGE_SIMILARITY)[0])


@REG.query()
def semantic_edges(spark, sf):
    edges, blocks, v = _concepts(spark, sf)
    _, merged, moved = S.merge(edges, blocks, v, P.MERGE_SIMILARITY)
    return V.flat(I.with_ids(V.written(merged, "merged"), V.written(moved, "moved")), *G.IDS).drop("edge_id")


@REG.query()
def incremental_merge(spark, sf):
    """The graph of even sources, then the odd ones joined to it."""
    t = V.written(G.without_noise(V.triples(spark, sf)), "triples")
    old = V.graph_of(t.where("ingestion_source_id % 2 = 0"))
    new = V.graph_of(t.where("ingestion_source_id % 2 = 1"))
    v = V.written(E.embed(G.nodes_of(old[0].union(new[0])), "node"), "vectors")
    nodes, edges, blocks = S.merge(*old, v, P.MERGE_SIMILARITY)
    merged, _, _ = S.merge_incrementally(V.written(nodes, "nodes"), V.written(edges, "edges"), blocks, *new, v, P.MERGE_SIMILARITY)
    return _shown(merged)


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}, {V.sql_edges('v_triples', 'ev', noise=False)}, n AS (SELECT DISTINCT unnest([subject, object]) AS node FROM ev)
SELECT node, NOT {V.sql_noise('node')} AND length(trim(node)) >= 2 AND NOT regexp_matches(trim(node), '^\\d+$') AND NOT contains(node, '://') AS mergeable FROM n"""
)
def mergeable_concepts(spark, sf):
    return G.nodes_of(V.edges(spark, sf)).withColumn("mergeable", G.mergeable(F.col("node")))
