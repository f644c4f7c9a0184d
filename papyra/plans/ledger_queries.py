"""Registered queries over papers, searches, vectors and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cluster as C
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import ledger as L
from ..operators.components import connected_components as components
from ..operators.scratch import Scratch
from ..streaming import ingest as S
from ..streaming import jobs as J
from . import views as V
from .registry import Registry
from .text_queries import SQL_BLOCKS, SQL_FINGERPRINT, SQL_SOURCES, sources

REG = Registry()


#: Two kinds of ids, in two spellings; some blank, some papers without any.
_EXTERNAL = """CASE WHEN doc_id % 5 <> 2 THEN map('arXiv', CAST(doc_id % 89 AS STRING), 'PubMed',
CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 2 = 0 THEN concat('P', doc_id % 71) ELSE concat('p', doc_id % 71) END) END"""


def papers(spark, sf) -> DataFrame:
    """Documents as papers; every third is a candidate, the others are known."""
    i = F.col("doc_id")
    return V.read(spark, sf, "documents").select(
        i.alias("paper_id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract"), F.when(i % 4 != 1, F.concat(F.lit("10.1/X"), i % 151)).alias("doi"),
        F.expr(_EXTERNAL).alias("external_ids"), T.fingerprint(F.substring("text", 1, 80), F.col("text")).alias("fingerprint"),
    )


SQL_PAPERS = f"""p AS (SELECT doc_id AS paper_id, text AS abstract, CASE WHEN doc_id % 4 <> 1 THEN '10.1/X' || doc_id % 151 END AS doi, CASE WHEN doc_id % 5 <> 2 THEN doc_id % 89 END AS arxiv,
CASE WHEN doc_id % 5 <> 2 AND doc_id % 7 <> 0 THEN doc_id % 71 END AS pubmed, {SQL_FINGERPRINT} AS fp FROM documents),
c AS (SELECT * FROM p WHERE paper_id % 3 = 0), k AS (SELECT * FROM p WHERE paper_id % 3 <> 0)"""


def _split(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = papers(spark, sf)
    return p.where("paper_id % 3 = 0"), p.where("paper_id % 3 <> 0")


@REG.query(f"WITH {SQL_PAPERS} SELECT c.paper_id, min(k.paper_id) AS match FROM c JOIN k ON lower(c.doi) = lower(k.doi) GROUP BY c.paper_id")
def doi_dedup(spark, sf):
    return L.by_doi(*_split(spark, sf))


@REG.query(f"WITH {SQL_PAPERS} SELECT c.paper_id, min(k.paper_id) AS match FROM c JOIN k ON c.arxiv = k.arxiv OR c.pubmed = k.pubmed GROUP BY c.paper_id")
def external_id_dedup(spark, sf):
    return L.by_external_id(*_split(spark, sf))


@REG.query(f"WITH {SQL_PAPERS} SELECT c.paper_id, min(k.paper_id) AS match FROM c JOIN k ON c.fp = k.fp GROUP BY c.paper_id")
def fingerprint_dedup(spark, sf):
    return L.by_fingerprint(*_split(spark, sf))


@REG.query(
    f"""WITH {SQL_PAPERS}, m AS (SELECT c.paper_id, (SELECT min(paper_id) FROM k WHERE lower(k.doi) = lower(c.doi) AND c.paper_id % 9 = 0) AS d, (SELECT min(paper_id) FROM k WHERE (k.arxiv = c.arxiv OR k.pubmed = c.pubmed) AND c.paper_id % 2 = 0) AS e,
(SELECT min(paper_id) FROM k WHERE k.fp = c.fp) AS f FROM c)
SELECT paper_id, coalesce(d, e, f) AS match, CASE WHEN d IS NOT NULL THEN 'doi' WHEN e IS NOT NULL THEN 'external_id' WHEN f IS NOT NULL THEN 'fingerprint' END AS match_type,
CASE WHEN d IS NOT NULL THEN 1.0 WHEN e IS NOT NULL THEN 0.95 WHEN f IS NOT NULL THEN 0.9 END::DOUBLE AS match_confidence FROM m"""
)
def dedup_ladder(spark, sf):
    c, k = _split(spark, sf)
    i = F.col("paper_id")
    c = c.withColumns({"external_ids": F.when(i % 2 == 0, F.col("external_ids")), "doi": F.when(i % 9 == 0, F.col("doi"))})
    return L.find_duplicates(c, k).select("paper_id", "match", "match_type", "match_confidence")


@REG.query("SELECT doc_id % 3 AS job_id, doc_id AS paper_id FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 5 = 0)")
def job_new_papers(spark, sf):
    p = V.read(spark, sf, "documents").select((F.col("doc_id") % 3).alias("job_id"), F.col("doc_id").alias("paper_id"))
    return L.not_in_ledger(p, p.where("paper_id % 2 = 0 and paper_id % 5 = 0"))


@REG.query(f"WITH {SQL_SOURCES} SELECT doc_id % 3 AS job_id, 'paper:' || doc_id AS source_ref FROM documents d WHERE doc_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM v_sources s WHERE s.source_ref = 'paper:' || d.doc_id AND s.job_id = d.doc_id % 3)")
def source_guard(spark, sf):
    p = papers(spark, sf).select("paper_id", (F.col("paper_id") % 3).alias("job_id"), F.when(F.col("paper_id") % 4 != 0, F.col("abstract")).alias("abstract"))
    return L.new_sources(p, sources(spark, sf)).select("job_id", "source_ref")


_WANTED = """w AS (SELECT DISTINCT user_id % 5 AS job_id, substr(sha256(event_type || '→' || 'u' || user_id % 50), 1, 64) AS signature, event_id % 50 = 0 AS used FROM events)"""


@REG.query(f"WITH {_WANTED} SELECT DISTINCT job_id, signature, 'new' AS status FROM w WHERE signature NOT IN (SELECT v.signature FROM w v WHERE v.used AND v.job_id = w.job_id)")
def get_or_create_query(spark, sf):
    w = V.read(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("job_id"), T.hypothesis_signature(F.col("event_type"), F.concat(F.lit("U"), F.col("user_id") % 50)).alias("signature"), (F.col("event_id") % 50 == 0).alias("used")
    )
    return L.missing_queries(w.drop("used"), w.where("used")).select("job_id", "signature", "status")


_LEVELS = """o AS (SELECT user_id AS job_id, level, CASE level WHEN 0 THEN 'a' || user_id || '|c' || user_id WHEN 1 THEN 'a' || user_id ELSE 'c' || user_id END AS e
FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0, 1, 2]) AS level)), h AS (SELECT *, substr(sha256(e), 1, 16) AS entities_hash FROM o)"""


@REG.query(f"WITH {_LEVELS} SELECT job_id, min(level)::INTEGER AS level, arg_min(entities_hash, level) AS entities_hash FROM h WHERE NOT (job_id % 4 > level AND job_id % 5 <> 0) GROUP BY job_id")
def verification_next_query(spark, sf):
    q = V.read(spark, sf, "events").select(F.col("user_id").alias("job_id")).distinct().select("job_id", F.concat(F.lit("A"), "job_id").alias("source"), F.concat(F.lit("C"), "job_id").alias("target"))
    levels = q.select("job_id", F.posexplode(F.array(F.array("source", "target"), F.array("source"), F.array("target"))).alias("level", "e"))
    used = levels.where("job_id % 4 > level").select("job_id", T.entities_hash(F.col("e")).alias("entities_hash"), F.when(F.col("job_id") % 5 == 0, "new").otherwise("done").alias("status"))
    return L.next_verification(q, used).select("job_id", "level", "entities_hash")


def _ledger(spark, sf) -> DataFrame:
    labels = V.read(spark, sf, "labels")
    return labels.select((F.col("doc_id") % 3).alias("job_id"), F.col("doc_id").alias("paper_id"), (F.col("quality") == 1).alias("evaluated"))


def _found(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hypotheses and the edges and postings that they were found in."""
    edges, blocks = V.evidence_of(V.projected_triples(spark, sf))
    return V.written(V.hypotheses(spark, sf, V.written(G.pair_edges(edges), "pairs")), "hyp"), edges, blocks


def _impact(spark, sf) -> DataFrame:
    h, edges, blocks = _found(spark, sf)
    return L.impact_scores(_ledger(spark, sf), h, edges, blocks, V.triples(spark, sf), sources(spark, sf))


_IMPACT = f"""WITH {V.SQL_HYPOTHESES}, {SQL_SOURCES}, tp AS (SELECT triple_id, substr(source_ref, 7)::BIGINT AS paper_id, subject, object FROM v_triples JOIN v_sources ON source_id = ingestion_source_id WHERE source_ref LIKE 'paper:%'),
ht AS (SELECT path, confidence, unnest(triple_ids) AS triple_id FROM v_hyp), cr AS (SELECT DISTINCT path, confidence, paper_id FROM ht JOIN tp USING (triple_id)),
cs AS (SELECT paper_id, count(*) AS refs, sum(confidence)::DOUBLE AS conf FROM cr GROUP BY paper_id),
nd AS (SELECT DISTINCT paper_id, unnest([subject, object]) AS node FROM tp), ed AS (SELECT paper_id, count(*) AS dens FROM nd WHERE length(node) >= 2 AND NOT {V.sql_noise('node')}
 AND (contains(node, ' ') OR contains(node, '-') OR regexp_matches(node, '\\d') OR regexp_matches(node, '^\\p{{Lu}}')) GROUP BY paper_id),
imp AS (SELECT doc_id % 3 AS job_id, doc_id AS paper_id, quality = 1 AS evaluated, coalesce(refs, 0) AS hypo_ref_count, coalesce(conf, 0)::DOUBLE AS cumulative_conf, coalesce(dens, 0) AS entity_density,
(coalesce(refs, 0) + coalesce(conf, 0) + coalesce(dens, 0))::DOUBLE AS impact_score FROM labels LEFT JOIN cs ON cs.paper_id = doc_id LEFT JOIN ed ON ed.paper_id = doc_id)"""


@REG.query(f"{_IMPACT} SELECT * FROM imp")
def impact_score(spark, sf):
    return _impact(spark, sf)


@REG.query(f"{_IMPACT} SELECT paper_id, impact_score FROM imp WHERE NOT evaluated ORDER BY impact_score DESC, paper_id LIMIT 3")
def next_downloads(spark, sf):
    return L.next_downloads(_impact(spark, sf), 3).select("paper_id", "impact_score")


@REG.query(
    f"""{_IMPACT} SELECT job_id, count(*) AS papers, count(*) FILTER (evaluated) AS contributing, count(*) FILTER (NOT evaluated) AS undownloaded,
printf('%.2f-%.2f', min(impact_score) FILTER (evaluated), max(impact_score) FILTER (evaluated)) AS impact_range FROM imp GROUP BY job_id"""
)
def paper_metrics(spark, sf):
    return L.paper_metrics(_impact(spark, sf))


@REG.query(
    f"""WITH RECURSIVE {V.SQL_HYPOTHESES}, {SQL_BLOCKS}, t AS (SELECT DISTINCT unnest(triple_ids) AS triple_id FROM v_hyp WHERE passed_filter),
b AS (SELECT DISTINCT block_id FROM v_triples JOIN t USING (triple_id)) SELECT DISTINCT block_text FROM v_blocks JOIN b ON source_id * 10000 + block_order + 1 = block_id"""
)
def evidence_text(spark, sf):
    h, edges, postings = _found(spark, sf)
    blocks = I.slice_sources(V.read(spark, sf, "documents"), "doc_id").select((F.col("source_id") * 10000 + F.col("block_order") + 1).alias("block_id"), "block_text")
    return L.evidence_text(h.where("passed_filter"), edges, postings, blocks)


@REG.query(
    r"""SELECT doc_id AS paper_id, CASE WHEN doc_id % 5 = 0 THEN 'Untitled' ELSE regexp_replace(text, '["\\\x00-\x1f]', '', 'g') END AS title, CASE WHEN doc_id % 4 = 0 THEN 'Unknown,B' ELSE '' END AS authors,
CASE WHEN doc_id % 3 = 0 THEN '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 2 = 0 THEN 'http://x/' || doc_id END AS pdf_url FROM documents"""
)
def record_normalise(spark, sf):
    i = F.col("doc_id")
    title = F.when(i % 5 == 0, "").otherwise(F.concat(F.lit('"title": "'), F.regexp_replace("text", r'["\\\x00-\x1f]', ""), F.lit('", ')))
    raw = F.concat(
        F.lit("{"), title, F.lit('"authors": '), F.when(i % 4 == 0, '[{"id": 1}, {"name": "B"}]').otherwise("null"),
        F.lit(', "externalIds": '), F.when(i % 3 == 0, F.concat(F.lit('{"DOI": "10.1/'), i, F.lit('"}'))).otherwise("{}"),
        F.lit(', "openAccessPdf": {"url": "'), F.when(i % 2 == 0, F.concat(F.lit("http://x/"), i)).otherwise(" "), F.lit('"}}'),
    )
    r = V.read(spark, sf, "documents").select(i.alias("paper_id"), L.paper_record(raw).alias("r"))
    return V.flat(r.select("paper_id", "r.title", "r.authors", "r.doi", "r.pdf_url"), "authors")


@REG.query(r"SELECT doc_id AS paper_id, doc_id % 7 || '_' || doc_id || '_' || regexp_replace(substr(text, 1, 30), '[^\p{L}\p{N}]', '_', 'g') || '.pdf' AS name FROM documents")
def download_names(spark, sf):
    i = F.col("doc_id")
    return V.read(spark, sf, "documents").select(i.alias("paper_id"), L.download_name(i % 7 + F.lit(0.9), i, F.col("text")).alias("name"))


@REG.query("SELECT doc_id AS paper_id, substr(text, 1, 300) AS snippet FROM documents")
def abstract_snippet(spark, sf):
    return V.read(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.substring("text", 1, 300).alias("snippet"))


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}, q AS (SELECT DISTINCT source, target FROM v_hyp)
SELECT source, target, CASE WHEN length(source) % 4 = 0 THEN 'biomedical' WHEN length(target) % 3 = 0 THEN 'computer science' WHEN length(target) % 3 = 1 THEN 'None' END AS domain FROM q"""
)
def domain_resolution(spark, sf):
    q = V.written(V.hypotheses(spark, sf).select("source", "target").distinct(), "pairs")
    known = q.where(F.length("source") % 4 == 0).withColumn("domain", F.lit("biomedical"))
    answer = F.when(F.length("target") % 3 == 0, " Computer Science ").when(F.length("target") % 3 == 1, "none").otherwise("cooking")
    return L.resolve_domains(q, None, known, q.withColumn("answer", answer))


_VEC = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"


@REG.query(f"WITH {_VEC} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 5) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) > 0.38")
def similarity_pairs(spark, sf):
    return C.similarity_pairs(V.read(spark, sf, "embeddings"), 0.38, "vec_id").withColumn("similarity", F.round("similarity", 5))


@REG.query(
    f"""WITH {_VEC}, s AS (SELECT q.vec_id AS id, c.vec_id AS nearest, list_cosine_similarity(q.e, c.e) AS s FROM v q, v c WHERE q.vec_id % 10 = 0 AND c.vec_id % 10 <> 0)
SELECT id, nearest, round(s, 5) AS similarity FROM s WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, nearest) = 1"""
)
def nearest_canonical(spark, sf):
    e = V.read(spark, sf, "embeddings")
    return C.nearest(e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0"), 0.3, "vec_id").withColumn("similarity", F.round("similarity", 5))


@REG.query(
    f"""WITH {_VEC}, q AS (SELECT vec_id, e, CASE WHEN vec_id % 20 = 0 THEN 'label' || label ELSE 'entity' || vec_id END AS entity FROM v WHERE vec_id % 10 = 0),
s AS (SELECT q.vec_id, c.vec_id AS n, list_cosine_similarity(q.e, c.e) AS s FROM q, v c WHERE c.vec_id % 10 <> 0),
t AS (SELECT * FROM s WHERE s >= 0.32 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, n) = 1)
SELECT entity, CASE WHEN vec_id % 20 = 0 THEN 'node' || right(entity, 1) WHEN n IS NOT NULL THEN 'node' || n ELSE entity END AS node FROM q LEFT JOIN t USING (vec_id)"""
)
def closest_node(spark, sf):
    """Aliases first, then the nearest concept over the threshold, else the entity itself."""
    e = V.read(spark, sf, "embeddings")
    q = e.where("vec_id % 10 = 0").withColumn("entity", F.when(F.col("vec_id") % 20 == 0, F.concat(F.lit("label"), "label")).otherwise(F.concat(F.lit("entity"), "vec_id")))
    alias = e.select(F.concat(F.lit("label"), "label").alias("entity"), F.concat(F.lit("node"), "label").alias("by_alias")).distinct()
    near = C.nearest(q, e.where("vec_id % 10 <> 0"), 0.32, "vec_id").select(F.col("id").alias("vec_id"), F.concat(F.lit("node"), "nearest").alias("by_vector"))
    return q.join(alias, "entity", "left").join(near, "vec_id", "left").select("entity", F.coalesce("by_alias", "by_vector", "entity").alias("node"))


@REG.query()
def semantic_clusters(spark, sf):
    return C.clusters(V.read(spark, sf, "embeddings"), 0.3, "vec_id")


@REG.query(
    f"""WITH RECURSIVE {_VEC}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) > 0.38),
r(node, x) AS (SELECT a, a FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.x) SELECT node, min(x) AS root FROM r GROUP BY node"""
)
def connected_components(spark, sf):
    pairs = C.similarity_pairs(V.read(spark, sf, "embeddings"), 0.38, "vec_id")
    return components(pairs, Scratch(spark, "components"))


@REG.query(
    f"""WITH {_VEC}, d AS (SELECT label, vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM v), c AS (SELECT label, k, avg(x) AS c FROM d GROUP BY label, k),
n AS (SELECT label, sqrt(sum(c * c)) AS n FROM c GROUP BY label), s AS (SELECT d.label, vec_id, sum(x * c / n) AS s FROM d JOIN c USING (label, k) JOIN n USING (label) GROUP BY d.label, vec_id)
SELECT label AS cluster, count(*) AS members, round(avg(s), 6) AS cluster_score FROM s GROUP BY label"""
)
def cluster_score(spark, sf):
    return C.cluster_scores(V.read(spark, sf, "embeddings"), "label").drop("embedding").withColumn("cluster_score", F.round("cluster_score", 6))


@REG.query(f"WITH RECURSIVE {SQL_BLOCKS} SELECT source_id, block_order::INTEGER AS block_order, block_text FROM v_blocks")
def stream_ingest(spark, sf):
    """The slicer run as a stream over the documents' files; equals the batch result."""
    V.ship(spark)
    base = Scratch(spark, "stream").folder()
    return S.stream_blocks(S.source(spark, f"{sf}/documents.parquet"), f"{base}/blocks", f"{base}/state")


@REG.query(f"SELECT {SQL_FINGERPRINT} AS fingerprint, min(doc_id) AS first_seen FROM documents GROUP BY 1")
def stream_new_papers(spark, sf):
    """The first document of each fingerprint over all micro-batches."""
    V.ship(spark)
    key = T.fingerprint(F.substring("text", 1, 80), F.col("text"))
    base = Scratch(spark, "stream").folder()
    return S.stream_first_seen(S.source(spark, f"{sf}/documents.parquet"), key, f"{base}/seen", f"{base}/state").withColumnRenamed("key", "fingerprint")


@REG.query(f"SELECT DISTINCT {SQL_FINGERPRINT} AS fingerprint FROM documents")
def stream_unique_papers(spark, sf):
    """Fetched papers, each fingerprint once, remembered for a bounded time."""
    V.ship(spark)
    key = T.fingerprint(F.substring("text", 1, 80), F.col("text"))
    base = Scratch(spark, "stream").folder()
    rows = S.source(spark, f"{sf}/documents.parquet").withColumn("at", F.timestamp_seconds(F.col("doc_id") + 1_600_000_000))
    return S.stream_new(rows, key, "at", f"{base}/new", f"{base}/state").select(F.col("key").alias("fingerprint"))


@REG.query()
def stream_status_log(spark, sf):
    """Users as jobs, their events as what happens to them: the stream's log of statuses, retries and barriers."""
    V.ship(spark)
    base = Scratch(spark, "stream").folder()
    e = S.source(spark, f"{sf}/events.parquet")
    stages = F.array(*map(F.lit, ("EXTRACTING", "READY_TO_INGEST", "INGESTED", "TRIPLES_EXTRACTED")))
    kinds = F.array(*map(F.lit, ("expect", "extracted", "done", "failed", "set")))
    made = e.select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").alias("at"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"),
        F.get(stages, (F.crc32(F.col("event_type").cast("binary")) % 4).cast("int")).alias("stage"), F.concat(F.lit("f"), F.col("event_id") % 3).alias("file"), F.lit(1).alias("number"),
    )
    J.stream_status(made, f"{base}/log", f"{base}/state", "1 day").awaitTermination()
    return J.read_log(spark, f"{base}/log").withColumn("at", F.col("at").cast("string"))
