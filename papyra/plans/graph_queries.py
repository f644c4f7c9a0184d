"""Registered queries over graphs and hypotheses, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions import text as T
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import reason as R
from ..operators import versions as W
from ..operators.scratch import Scratch
from . import views as V
from .registry import Registry

REG = Registry()
IDS_SQL = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in G.IDS)


def _hyp_flat(df: DataFrame) -> DataFrame:
    reason = F.array_join(F.map_values("filter_reason"), "|")
    return (
        V.flat(V.flat(df, *G.IDS), "path", "predicates", sep=" > ")
        .withColumn("weak", reason)
        .select("source", "target", "path", "predicates", "explanation", "confidence", "passed_filter", "weak", *G.IDS)
    )


def _edges_flat(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    return V.flat(E.with_ids(edges, blocks), *G.IDS).drop("edge_id")


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}
SELECT source, target, path, array_to_string(predicates, ' > ') AS predicates,
  source || ' -[' || array_to_string(p1, ', ') || ']-> ' || mid || ' then ' || mid || ' -[' || array_to_string(p2, ', ') || ']-> ' || target AS explanation,
  confidence, passed_filter, weak, {IDS_SQL} FROM v_hyp"""
)
def hypotheses(spark, sf):
    edges, blocks = V.evidence_of(V.projected_triples(spark, sf))
    found = V.written(V.hypotheses(spark, sf, V.written(G.pair_edges(edges), "pairs")), "hyp")
    return _hyp_flat(E.hypotheses_with_ids(found, edges, blocks)).orderBy(F.desc("confidence"), "source", "target", "path")


@REG.query(f"WITH {V.SQL_TRIPLES}, {V.sql_edges('v_triples', 'e', noise=False)} SELECT subject, predicate, object, support, {IDS_SQL} FROM e")
def structural_graph(spark, sf):
    return _edges_flat(*V.evidence_of(V.triples(spark, sf)))


@REG.query(f"WITH {V.SQL_TRIPLES} SELECT DISTINCT unnest([subject, object]) AS node FROM v_triples")
def structural_nodes(spark, sf):
    return G.nodes_of(V.edges(spark, sf))


@REG.query(
    f"""WITH {V.SQL_TRIPLES}, x AS (SELECT * FROM v_triples WHERE lower(subject) NOT IN ('the', 'and', 'in') AND lower(object) NOT IN ('the', 'and', 'in')),
{V.sql_edges('x', 'e', noise=False)} SELECT subject, predicate, object, support FROM e"""
)
def excluded_entities(spark, sf):
    return G.structural_edges(V.triples(spark, sf), ["The", "and", "IN"]).drop("edge_id")


@REG.query(
    f"""WITH {V.SQL_TRIPLES} SELECT subject, predicate, object, count(*) AS evidence, count(DISTINCT block_id) AS blocks,
count(DISTINCT ingestion_source_id) AS sources FROM v_triples GROUP BY ALL HAVING count(*) >= 2"""
)
def evidence_threshold_graph(spark, sf):
    return G.evidence_groups(V.triples(spark, sf))


@REG.query(
    f"WITH {V.SQL_TRIPLES}, n AS (SELECT DISTINCT unnest([subject, object]) AS node FROM v_triples) "
    f"SELECT node, CASE WHEN {V.sql_noise('node')} THEN 'noise' ELSE 'concept' END AS kind FROM n"
)
def sanitize_nodes(spark, sf):
    return G.nodes_of(V.edges(spark, sf)).withColumn("kind", T.classify_node(F.col("node")))


@REG.query(f"WITH {V.SQL_TRIPLES}, {V.sql_edges('v_triples', 'e')} SELECT subject, predicate, object, support, {IDS_SQL} FROM e")
def sanitize_edges(spark, sf):
    edges, blocks = V.evidence_of(V.triples(spark, sf))
    return _edges_flat(G.without_noise(edges), blocks)


@REG.query(
    f"""WITH {V.SQL_TRIPLES}, n AS (SELECT DISTINCT unnest([subject, object]) AS node FROM v_triples),
e AS (SELECT DISTINCT subject, predicate, object FROM v_triples)
SELECT (SELECT count(*) FROM n) AS nodes_before, (SELECT count(*) FROM n WHERE NOT {V.sql_noise('node')}) AS nodes_after,
(SELECT count(*) FROM n WHERE {V.sql_noise('node')}) AS nodes_removed, (SELECT count(*) FROM e) AS edges_before,
(SELECT count(*) FROM e WHERE NOT {V.sql_noise('subject')} AND NOT {V.sql_noise('object')}) AS edges_after"""
)
def sanitize_summary(spark, sf):
    return G.sanitise_summary(V.edges(spark, sf))


@REG.query(
    f"""WITH {V.SQL_TRIPLES}, e AS (SELECT DISTINCT subject, predicate, object FROM v_triples)
SELECT node, count(*) AS degree FROM (SELECT subject AS node FROM e UNION ALL SELECT object FROM e WHERE object <> subject) GROUP BY node"""
)
def node_degree(spark, sf):
    return G.row_degree(V.edges(spark, sf))


@REG.query(
    f"""WITH {V.SQL_TRIPLES}, e AS (SELECT DISTINCT subject, object FROM v_triples)
SELECT node, count(*) AS degree FROM (SELECT subject AS node FROM e UNION ALL SELECT object FROM e) GROUP BY node"""
)
def graph_degree(spark, sf):
    return G.pair_degree(V.edges(spark, sf))


@REG.query(f"WITH {V.SQL_TRIPLES}, {V.sql_edges('v_triples', 'e')}, {V.sql_paths('e')} SELECT subject, object, support FROM v_live")
def hub_suppression(spark, sf):
    pairs = V.written(G.pair_edges(G.without_noise(V.edges(spark, sf))), "pairs")
    return G.suppress_hubs(pairs).select("subject", "object", "support")


@REG.query(
    f"""WITH {V.SQL_TRIPLES_PRED}, {V.sql_edges('v_triples_pred', 'e')}, {V.sql_paths('e')}
SELECT subject, object, array_to_string(predicates, ',') AS predicates, support, {IDS_SQL} FROM v_pairs"""
)
def pair_edges(spark, sf):
    edges, blocks = V.evidence_of(V.triples_with_predicates(spark, sf))
    pairs = G.pair_edges(G.without_noise(edges))
    return V.flat(E.pairs_with_ids(pairs, edges, blocks), "predicates", *G.IDS)


_PATHS = f"WITH {V.SQL_TRIPLES}, {V.sql_edges('v_triples', 'v_edges_p', V.sql_predicate('predicate'))}, {V.sql_paths('v_edges_p')}"


@REG.query(f"{_PATHS} SELECT source, mid, target, confidence FROM v_paths")
def discovery_paths(spark, sf):
    pairs = V.live_pairs(V.projected_pairs(spark, sf))
    return R.discovery_paths(pairs).select("source", "mid", "target", F.least("support_1", "support_2").alias("confidence"))


SEEDS = ["thre", "onan", "erin", "anth", "reon", "this", "that", "leaux", "heed", "andti", "eron", "enre"]


@REG.query(f"{_PATHS} SELECT source, mid, target FROM v_paths WHERE source IN ({', '.join(map(V.sql_quote, SEEDS))}) OR target IN ({', '.join(map(V.sql_quote, SEEDS))})")
def query_mode_paths(spark, sf):
    pairs = V.live_pairs(V.projected_pairs(spark, sf))
    return R.discovery_paths(pairs, seeds=SEEDS).select("source", "mid", "target")


STOPS = ["Anth", "reon", "ERIN", "heed", "thre", "onan"]


@REG.query(f"{_PATHS} SELECT source, mid, target FROM v_paths WHERE mid NOT IN ({', '.join(V.sql_quote(w.lower()) for w in STOPS)})")
def stoplist_paths(spark, sf):
    pairs = V.live_pairs(V.projected_pairs(spark, sf))
    return R.discovery_paths(pairs, stop_words=STOPS).select("source", "mid", "target")


_PRED = f"WITH {V.SQL_TRIPLES_PRED}, {V.sql_edges('v_triples_pred', 'e')}, {V.sql_paths('e')}"
_GENERIC = ", ".join(map(V.sql_quote, P.GENERIC_PREDICATES))


@REG.query(
    f"""{_PRED} SELECT source, mid, target, CASE WHEN list_has_any(predicates, ['causes', 'inhibits'])
THEN least(floor(confidence * 3 * 1.2), 100)::INTEGER ELSE confidence * 3 END AS confidence FROM v_paths"""
)
def predicate_boost(spark, sf):
    h = V.predicate_hypotheses(spark, sf).withColumn("confidence", F.col("confidence") * 3)
    return R.boost(h, ["Causes", "inhibits"]).select("source", F.get("path", 1).alias("mid"), "target", "confidence")


@REG.query(
    f"""{_PRED} SELECT source, mid, target, confidence, confidence >= 2 AS passed_filter,
CASE WHEN confidence < 2 THEN 'evidence_threshold: Confidence ' || confidence || ' < 2' ELSE '' END AS reason,
CASE WHEN confidence < 2 THEN 'extractable' END AS rejection_type
FROM v_paths WHERE len(list_filter(predicates, lambda p: p NOT IN ({_GENERIC}))) > 0"""
)
def hypothesis_filter(spark, sf):
    h = R.filter_hypotheses(V.predicate_hypotheses(spark, sf))
    reason = F.array_join(F.transform(F.map_entries("filter_reason"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "|")
    return h.select("source", F.get("path", 1).alias("mid"), "target", "confidence", "passed_filter", F.coalesce(reason, F.lit("")).alias("reason"), "rejection_type")


@REG.query(
    f"""{_PRED} SELECT coalesce(CASE WHEN len(list_filter(predicates, lambda p: p NOT IN ({_GENERIC}))) = 0 THEN 'predicate_semantics'
WHEN confidence < 2 THEN 'evidence_threshold' END, 'none') AS reason, count(*) AS n FROM v_paths GROUP BY 1"""
)
def rejection_report(spark, sf):
    h = R.with_rejection(V.predicate_hypotheses(spark, sf))
    return h.groupBy(F.coalesce(F.get(F.map_keys("filter_reason"), 0), F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@REG.query(f"WITH {V.SQL_HYPOTHESES} SELECT source, target, path FROM v_hyp WHERE NOT passed_filter")
def promising(spark, sf):
    h = V.hypotheses(spark, sf)
    return V.flat(h.where(R.is_promising(F.col("passed_filter"), F.col("filter_reason"))), "path", sep=" > ").select("source", "target", "path")


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}, p AS (SELECT subject u, object v FROM v_pairs),
q AS (SELECT source, target FROM v_hyp UNION SELECT target, source FROM v_hyp UNION SELECT u, v FROM p UNION SELECT v, u FROM p
  UNION SELECT min(v), max(v) FROM p GROUP BY u UNION SELECT min(u), max(u) FROM p GROUP BY v UNION SELECT u, 'no ' || u FROM p),
c AS (
  SELECT source, target, 0 AS r, [source, target] AS path FROM q JOIN p ON u = source AND v = target
  UNION ALL SELECT source, target, 1, [target, source] FROM q JOIN p ON u = target AND v = source
  UNION ALL SELECT source, target, 2, [source, a.v, target] FROM q JOIN p a ON a.u = source JOIN p b ON b.u = a.v AND b.v = target WHERE a.v NOT IN (source, target)
  UNION ALL SELECT source, target, 3, [target, a.v, source] FROM q JOIN p a ON a.u = target JOIN p b ON b.u = a.v AND b.v = source WHERE a.v NOT IN (source, target)
  UNION ALL SELECT source, target, 4, [source, a.u, target] FROM q JOIN p a ON a.v = source JOIN p b ON b.u = a.u AND b.v = target WHERE a.u NOT IN (source, target)
  UNION ALL SELECT source, target, 5, [source, a.v, target] FROM q JOIN p a ON a.u = source JOIN p b ON b.v = a.v AND b.u = target WHERE a.v NOT IN (source, target)),
m AS (SELECT source, target, min(struct_pack(r := r, path := path)) AS b FROM c GROUP BY source, target)
SELECT source, target, coalesce((['direct_forward', 'direct_reverse', '2hop_forward', '2hop_reverse', 'common_cause', 'collider'])[b.r + 1], 'none') AS connection_type,
array_to_string(b.path, ' > ') AS path FROM q LEFT JOIN m USING (source, target)"""
)
def verification_ladder(spark, sf):
    """Verified are the ends of every hypothesis and of every edge, both ways round, two effects of each node, two causes of each, and a node that is not there."""
    # Ends are asked about, whatever the support: projected predicates are never generic, and what a direct edge makes old is asked as an edge.
    pairs = V.written(V.projected_triples(spark, sf).select("subject", "object").distinct(), "pairs")
    ends = R.discovery_paths(V.live_pairs(pairs)).select("source", "target")
    s, t = F.col("source"), F.col("target")
    back = F.struct(t.alias("source"), s.alias("target"))
    ends = ends.select(F.inline(F.array(F.struct("source", "target"), back)))
    edges = pairs.select(F.col("subject").alias("source"), F.col("object").alias("target"))
    edges = edges.select(F.inline(F.array(F.struct("source", "target"), back, F.struct("source", F.concat(F.lit("no "), s).alias("target")))))
    effects = pairs.groupBy("subject").agg(F.min("object").alias("source"), F.max("object").alias("target")).select("source", "target")
    causes = pairs.groupBy("object").agg(F.min("subject").alias("source"), F.max("subject").alias("target")).select("source", "target")
    questions = ends.union(edges).union(effects).union(causes)
    return V.flat(R.verify_pairs(questions, pairs), "path", sep=" > ")


@REG.query(f"{_PATHS} SELECT source, mid, target, array_to_string(p1, ',') AS predicates_1, array_to_string(p2, ',') AS predicates_2, confidence FROM v_paths")
def incremental_paths(spark, sf):
    """Paths of the graph of even sources, brought up to date with all sources."""
    t = V.written(V.projected_triples(spark, sf), "triples")
    before = V.live_pairs(V.written(G.pair_edges(G.structural_edges(t.where("ingestion_source_id % 2 = 0"))), "before"))
    after = V.live_pairs(V.written(G.pair_edges(G.structural_edges(t)), "after"))
    known = V.written(R.discovery_paths(before), "paths")
    found = I.updated_paths(known, before, after)
    found = V.flat(found, "predicates_1", "predicates_2")
    return found.select("source", "mid", "target", "predicates_1", "predicates_2", F.least("support_1", "support_2").alias("confidence"))


@REG.query(
    f"""{_PATHS}, n AS (SELECT node, min(ingestion_source_id % 2) AS odd FROM (SELECT subject AS node, ingestion_source_id FROM v_triples UNION ALL SELECT object, ingestion_source_id FROM v_triples) GROUP BY node),
e AS (SELECT node FROM n WHERE odd = 1 UNION SELECT unnest([{", ".join(map(V.sql_quote, SEEDS))}]))
SELECT source, mid, target FROM v_paths WHERE source IN (SELECT node FROM e) OR target IN (SELECT node FROM e)"""
)
def effective_seed_paths(spark, sf):
    """Paths that start or end in a seed or in a node that the last version lacked."""
    t = V.written(V.triples(spark, sf), "triples")
    seeds = R.effective_seeds(SEEDS, G.affected_nodes(_version_rows(t)))
    pairs = V.live_pairs(V.written(G.pair_edges(G.structural_edges(V.projected(t))), "pairs"))
    return R.discovery_paths(pairs, seeds=V.written(seeds, "seeds")).select("source", "mid", "target")


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}, hop AS (
  SELECT source, target, path, 1 AS hop, source AS subject, mid AS object FROM v_hyp
  UNION ALL SELECT source, target, path, 2, mid, target FROM v_hyp),
s AS (SELECT source, target, path, hop, predicates, unnest(source_ids) AS paper_id FROM (
  SELECT h.source, h.target, h.path, h.hop, p.predicates, p.source_ids FROM hop h JOIN v_pairs p USING (subject, object)))
SELECT source, target, path, paper_id, array_to_string(flatten(list(predicates ORDER BY hop)), ',') AS predicates FROM s GROUP BY source, target, path, paper_id"""
)
def supporting_papers(spark, sf):
    edges, blocks = V.evidence_of(V.projected_triples(spark, sf))
    pairs = V.written(G.pair_edges(edges), "pairs")
    out = R.supporting_papers(V.written(V.hypotheses(spark, sf, pairs), "hyp"), pairs, edges, blocks)
    return V.flat(out.withColumn("path", F.array_join("path", " > ")), "predicates")


def _plotted(spark, sf) -> tuple[DataFrame, DataFrame]:
    edges = V.written(V.projected_edges(spark, sf), "edges")
    pairs = V.written(G.pair_edges(edges), "pairs")
    return R.project_graph(V.written(V.hypotheses(spark, sf, pairs), "hyp"), edges)


_HOPS = """hop AS (SELECT source AS u, mid AS v, path FROM v_hyp UNION ALL SELECT mid, target, path FROM v_hyp),
used AS (SELECT u, v, count(DISTINCT path) AS used_in_hypotheses FROM hop GROUP BY u, v)"""


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}, {_HOPS}
SELECT u, v, coalesce(predicate, 'related_to') AS predicate, coalesce(sum(support), 0)::BIGINT AS support, used_in_hypotheses
FROM used LEFT JOIN v_edges_p ON lower(trim(subject)) = lower(trim(u)) AND lower(trim(object)) = lower(trim(v))
GROUP BY u, v, predicate, used_in_hypotheses"""
)
def projected_graph(spark, sf):
    return _plotted(spark, sf)[1]


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}, n AS (SELECT unnest([source, mid, target]) AS node, path FROM v_hyp)
SELECT node, count(DISTINCT path) AS used_in_hypotheses FROM n GROUP BY node"""
)
def projected_nodes(spark, sf):
    return _plotted(spark, sf)[0]


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}, g AS (SELECT source, target, sum(CASE WHEN passed_filter THEN 1.0 ELSE 0.5 END) AS pair_score,
max(confidence) AS max_confidence, count(*) AS n, array_to_string(list_sort(list_distinct(list(mid))), ',') AS intermediates FROM v_hyp GROUP BY source, target)
SELECT source, target, pair_score::DOUBLE AS pair_score, max_confidence, n, intermediates FROM g ORDER BY pair_score DESC, max_confidence DESC, source, target LIMIT 5"""
)
def top_pairs(spark, sf):
    return V.flat(R.top_pairs(V.hypotheses(spark, sf)).drop("any_passed"), "intermediates")


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}, l AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY passed_filter DESC, confidence DESC, path) AS r FROM v_hyp)
SELECT source, target, path, confidence FROM l WHERE r = 1 ORDER BY passed_filter DESC, confidence DESC, source, target LIMIT 2"""
)
def diverse_leads(spark, sf):
    return V.flat(R.diverse_leads(V.hypotheses(spark, sf)), "path", sep=" > ").select("source", "target", "path", "confidence")


@REG.query(f"WITH {V.SQL_HYPOTHESES} SELECT source, target, path, confidence FROM v_hyp ORDER BY confidence DESC, source, target, path LIMIT 20 OFFSET 5")
def hypothesis_page(spark, sf):
    return V.flat(R.page(V.hypotheses(spark, sf), 20, 5), "path", sep=" > ").select("source", "target", "path", "confidence")


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES} SELECT source, target, path, substr(sha256(lower(source) || '→' || lower(target)), 1, 64) AS signature,
substr(sha256(lower(source) || '|' || lower(target)), 1, 16) AS entities, 'relationship between ' || source || ' and ' || target AS query,
'(relationship between ' || source || ' and ' || target || ') AND (' || mid || ')' AS focused FROM v_hyp"""
)
def hypothesis_signature(spark, sf):
    h = V.hypotheses(spark, sf)
    s, t = F.col("source"), F.col("target")
    return h.select(
        "source", "target", F.array_join("path", " > ").alias("path"),
        T.hypothesis_signature(s, t).alias("signature"),
        T.entities_hash(F.array(s, t)).alias("entities"),
        T.query_text(s, t).alias("query"),
        T.query_text(s, t, F.slice("path", 2, 1)).alias("focused"),
    )


_CANON = f"""WITH {V.SQL_TRIPLES}, {V.sql_edges('v_triples', 'e')},
d AS (SELECT node, count(*) AS degree FROM (SELECT subject AS node FROM e UNION ALL SELECT object FROM e WHERE object <> subject) GROUP BY node),
n AS (SELECT DISTINCT unnest([subject, object]) AS node FROM e),
r AS (SELECT substr(node, 1, 4) AS cluster, node, row_number() OVER (PARTITION BY substr(node, 1, 4) ORDER BY degree DESC, length(node) DESC, node) AS k FROM n JOIN d USING (node)),
c AS (SELECT cluster, max(node) FILTER (k = 1) AS canonical, list(node ORDER BY k) AS aliases FROM r GROUP BY cluster)"""


def _canon(e: DataFrame) -> DataFrame:
    """Clusters of nodes by their first four letters stand in for similarity clusters."""
    members = G.nodes_of(e).withColumn("cluster", F.substring("node", 1, 4))
    return G.canonical_labels(members, G.row_degree(e))


@REG.query(f"{_CANON} SELECT cluster, canonical, array_to_string(aliases, ',') AS aliases FROM c")
def canonical_labels(spark, sf):
    return V.flat(_canon(G.without_noise(V.edges(spark, sf))), "aliases")


_MAP = "m AS (SELECT canonical, unnest(aliases) AS node FROM c)"
_MERGED = ", ".join(f"list_sort(list_distinct(flatten(list({c})))) AS {c}" for c in G.IDS)


@REG.query(
    f"""{_CANON}, {_MAP}, w AS (SELECT coalesce(a.canonical, subject) AS s, predicate, coalesce(b.canonical, object) AS o, triple_ids, block_ids, source_ids
FROM e LEFT JOIN m a ON a.node = subject LEFT JOIN m b ON b.node = object),
g AS (SELECT s AS subject, predicate, o AS object, {_MERGED} FROM w WHERE s <> o GROUP BY s, predicate, o)
SELECT subject, predicate, object, len(source_ids)::INTEGER AS support, {IDS_SQL} FROM g"""
)
def edge_rewrite(spark, sf):
    edges, blocks = V.evidence_of(G.without_noise(V.triples(spark, sf)))
    canon = V.written(_canon(edges).select(F.explode("aliases").alias("node"), "canonical"), "canon")
    merged, moved = G.rewrite_edges(edges, blocks, canon)
    return _edges_flat(V.written(merged, "merged"), V.written(moved, "moved"))


@REG.query(
    f"""WITH {V.SQL_TRIPLES}, t0 AS (SELECT * FROM v_triples WHERE ingestion_source_id % 2 = 0), t1 AS (SELECT * FROM v_triples WHERE ingestion_source_id % 2 = 1),
{V.sql_edges('t0', 'a')}, {V.sql_edges('t1', 'b')},
u AS (SELECT *, 0 AS fresh FROM a UNION ALL SELECT *, 1 FROM b WHERE subject <> object),
g AS (SELECT subject, predicate, object, max(fresh) AS fresh, max(support) FILTER (fresh = 0) AS old, {_MERGED} FROM u GROUP BY subject, predicate, object)
SELECT subject, predicate, object, CASE WHEN fresh = 1 THEN len(source_ids)::INTEGER ELSE old END AS support FROM g"""
)
def incremental_edges(spark, sf):
    t = V.written(G.without_noise(V.triples(spark, sf)), "triples")
    old = V.graph_of(t.where("ingestion_source_id % 2 = 0"))
    new = V.graph_of(t.where("ingestion_source_id % 2 = 1"))
    same = G.nodes_of(new[0]).select("node", F.col("node").alias("canonical"))
    return G.merge_increment(*old, *new, same)[0].drop("edge_id")


def _version_rows(triples: DataFrame) -> DataFrame:
    """Version 1 of the graph holds the triples of even sources, version 2 all."""
    return triples.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).where("version = 2 or ingestion_source_id % 2 = 0")


def _versions(spark, sf) -> DataFrame:
    t = _version_rows(V.written(V.triples(spark, sf), "triples"))
    return t.groupBy("job_id", "version", "subject", "predicate", "object").agg(F.count("*").alias("n"))


_VERSIONS = f"""WITH {V.SQL_TRIPLES}, v AS (SELECT job_id, version, subject, predicate, object, count(*) AS n FROM v_triples, (SELECT unnest([1, 2]) AS version)
WHERE version = 2 OR ingestion_source_id % 2 = 0 GROUP BY ALL)"""


@REG.query(f"{_VERSIONS} SELECT * FROM v WHERE version = (SELECT max(w.version) FROM v w WHERE w.job_id = v.job_id)")
def snapshot_active(spark, sf):
    return G.active_snapshot(_versions(spark, sf))


@REG.query(
    f"""{_VERSIONS}, n AS (SELECT DISTINCT version, unnest([subject, object]) AS node FROM v)
SELECT version, node FROM n WHERE version > 1 AND NOT EXISTS (SELECT 1 FROM n b WHERE b.version = n.version - 1 AND b.node = n.node)"""
)
def affected_nodes(spark, sf):
    return G.affected_nodes(_version_rows(V.triples(spark, sf)))


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}, n AS (SELECT node, min(ingestion_source_id % 2) AS odd FROM (
  SELECT subject AS node, ingestion_source_id FROM v_triples UNION ALL SELECT object, ingestion_source_id FROM v_triples) GROUP BY node)
SELECT source, target, path, NOT ((source IN (SELECT node FROM n WHERE odd = 1)) OR (mid IN (SELECT node FROM n WHERE odd = 1))
  OR (target IN (SELECT node FROM n WHERE odd = 1))) AS is_active FROM v_hyp"""
)
def partial_deactivate(spark, sf):
    t = V.written(V.triples(spark, sf), "triples")
    affected = G.affected_nodes(_version_rows(t))
    pairs = V.written(G.pair_edges(G.structural_edges(V.projected(t))), "pairs")
    found = V.written(V.hypotheses(spark, sf, pairs).select("source", "target", "path"), "hyp")
    return V.flat(G.deactivate(found, affected), "path", sep=" > ").select("source", "target", "path", "is_active")


_OF_JOBS = f"""WITH {V.SQL_TRIPLES}, t AS (SELECT job_id, version, subject, predicate, object, ingestion_source_id FROM v_triples, (SELECT unnest([1, 2]) AS version) WHERE version = 2 OR ingestion_source_id % 8 < 4),
e AS (SELECT job_id, version, subject, predicate, object, count(DISTINCT ingestion_source_id) AS support FROM t GROUP BY ALL)"""


def _published(spark, sf) -> W.VersionedTable:
    """Graphs of four jobs, published twice: half of the sources, then all; job 3 is withdrawn, and job 2 once more published."""
    table = W.VersionedTable(spark, Scratch(spark, "versions").folder())
    t = V.written(V.triples(spark, sf), "triples")

    def edges(rows: DataFrame) -> DataFrame:
        seen = rows.select("job_id", *E.KEY, "ingestion_source_id").distinct()
        return seen.groupBy("job_id", *E.KEY).agg(F.count("*").alias("support"))

    first = table.publish({"edges": edges(t.where("ingestion_source_id % 8 < 4"))}, now=1000.0)
    table.publish({"edges": edges(t)}, expect=first, now=2000.0)
    table.deactivate(3, now=3000.0)
    table.publish({"edges": edges(t.where("job_id = 2"))}, now=4000.0)
    return table


@REG.query(f"{_OF_JOBS} SELECT job_id, CASE WHEN job_id = 2 THEN 3 ELSE 2 END::BIGINT AS version, subject, predicate, object, support FROM e WHERE version = 2 AND job_id <> 3")
def published_edges(spark, sf):
    """What is active of all jobs after publications and a withdrawal."""
    return _published(spark, sf).active("edges").select("job_id", "version", *E.KEY, "support")


@REG.query(
    f"""{_OF_JOBS}, n AS (SELECT job_id, version, count(*) AS n FROM e GROUP BY ALL)
SELECT job_id, version AS entry, version, 'publish' AS action, n AS rows, version * 1000000 AS created_at FROM n
UNION ALL SELECT 3, 3, 2, 'withdraw', 0, 3000000 UNION ALL SELECT 2, 3, 3, 'publish', n, 4000000 FROM n WHERE job_id = 2 AND version = 2"""
)
def version_log(spark, sf):
    """The log of the same publications as a table."""
    return _published(spark, sf).manifest().select("job_id", "entry", "version", "action", "rows", "created_at")


@REG.query(f"{_OF_JOBS} SELECT subject, predicate, object, support FROM e WHERE job_id = 3 AND version = 1")
def published_version(spark, sf):
    """A version that is no longer active, read by its number."""
    return _published(spark, sf).read("edges", 3, 1).select(*E.KEY, "support")
