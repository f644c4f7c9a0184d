"""Registered queries over appended rows, listings, policies and jobs without hypotheses, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions import text as T
from ..functions.settings import job_settings, policy_of
from ..operators import decide as D
from ..operators import ingest as I
from ..operators import records as N
from ..operators.run import JobRun
from . import views as V
from .registry import Registry
from .text_queries import SQL_BLOCKS, SQL_FINGERPRINT

REG = Registry()

_BLOCKS = f"""{SQL_BLOCKS}, b AS (SELECT source_id % 3 AS job_id, source_id * 10000 + block_order + 1 AS block_id, source_id AS ingestion_source_id,
block_order::INTEGER AS block_order, block_text, (source_id + block_order) % 2 = 0 AS triples_extracted FROM v_blocks)"""


def _blocks(spark, sf):
    i, k = F.col("source_id"), F.col("block_order")
    return I.slice_sources(V.read(spark, sf, "documents"), "doc_id").select(
        (i % 3).alias("job_id"), (i * 10000 + k + 1).alias("block_id"), i.alias("ingestion_source_id"), "block_order", "block_text", ((i + k) % 2 == 0).alias("triples_extracted")
    )


@REG.query(f"WITH RECURSIVE {_BLOCKS} SELECT job_id, block_order, block_id FROM b WHERE NOT triples_extracted ORDER BY job_id, block_order, block_id")
def pending_blocks(spark, sf):
    return N.pending_blocks(_blocks(spark, sf)).select("job_id", "block_order", "block_id")


@REG.query(f"WITH RECURSIVE {_BLOCKS} SELECT block_id, block_text, block_order, ingestion_source_id FROM b WHERE job_id = 1 ORDER BY block_order, block_id")
def block_listing(spark, sf):
    return N.block_listing(_blocks(spark, sf), 1)


@REG.query(f"SELECT substr(text, 1, 80) AS title, text AS abstract, 'unknown' AS source, {SQL_FINGERPRINT} AS fingerprint FROM documents")
def paper_insert(spark, sf):
    rows = V.read(spark, sf, "documents").select(F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract"), F.lit(None).cast("string").alias("source"))
    return N.paper_rows(rows).select("title", "abstract", "source", "fingerprint")


@REG.query(
    """SELECT event_id AS query_id, user_id AS job_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider_used,
CASE event_type WHEN 'view' THEN 'initial_attempt' WHEN 'click' THEN 'reuse' ELSE 'expansion' END AS reason, NULL::INTEGER AS signal_delta FROM events"""
)
def run_log(spark, sf):
    e = V.read(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("job_id"), "event_type")
    why = F.when(F.col("event_type") == "view", "initial_attempt").when(F.col("event_type") == "click", "reuse").otherwise("expansion")
    return N.run_rows(e, F.when(F.col("job_id") % 2 == 0, "a").otherwise("b"), why)


@REG.query("SELECT text AS query_text, role AS status, role || '|' || turn AS entities FROM conversations WHERE conv_id % 5 = 1")
def job_queries(spark, sf):
    c = V.read(spark, sf, "conversations").select((F.col("conv_id") % 5).alias("job_id"), F.col("text").alias("query_text"), F.col("role").alias("status"), F.array("role", F.col("turn").cast("string")).alias("entities_used"))
    return V.flat(N.queries_of_job(c, 1), "entities", sep="|")


@REG.query("SELECT conv_id AS job_id, text AS query_text, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM conversations")
def reasoning_queries(spark, sf):
    c = V.read(spark, sf, "conversations").select(F.col("conv_id").alias("job_id"), F.col("text").alias("query_text"))
    return N.reasoning_rows(c, F.lit("2024-01-01 00:00:00").cast("timestamp"))


@REG.query("SELECT user_id AS job_id, event_type AS status FROM events WHERE user_id = 3 QUALIFY row_number() OVER (ORDER BY event_id DESC) = 1")
def job_status(spark, sf):
    last = V.read(spark, sf, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", "event_id").alias("status"))
    return N.job_status(last, 3)


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}, j AS (SELECT unnest([0, 1]) AS job_id), h AS (SELECT * FROM v_hyp WHERE confidence >= 1)
SELECT job_id, CASE job_id WHEN 0 THEN (SELECT count(*) FROM h) ELSE 0 END AS total_hypothesis_count, CASE job_id WHEN 0 THEN (SELECT count(*) FROM h WHERE passed_filter) ELSE 0 END AS passed_hypothesis_count,
CASE job_id WHEN 0 THEN 3.0 ELSE 0.0 END::DOUBLE AS mean_path_length, CASE job_id WHEN 0 THEN (SELECT max(n) FROM (SELECT count(DISTINCT path) AS n FROM h GROUP BY source, target)) ELSE 0 END AS max_paths_per_pair FROM j"""
)
def zero_measurements(spark, sf):
    """Job 1 has no hypotheses and still has a row of measurements."""
    h = V.written(V.hypotheses(spark, sf).withColumn("job_id", F.lit(0)), "hyp")
    jobs = spark.createDataFrame([(0,), (1,)], "job_id int")
    m = D.for_jobs(D.core_measurements(h).join(D.indirect_measurements(h), "job_id"), jobs)
    return m.select("job_id", "total_hypothesis_count", "passed_hypothesis_count", "mean_path_length", "max_paths_per_pair")


@REG.query(
    f"""WITH {V.SQL_TRIPLES}, p AS (SELECT DISTINCT job_id, subject AS s, object AS o FROM v_triples), c AS (SELECT * FROM p WHERE NOT {V.sql_noise('s')} AND NOT {V.sql_noise('o')}),
x AS (SELECT job_id, count(*) AS n FROM p GROUP BY job_id), b AS (SELECT job_id, count(*) AS n FROM c GROUP BY job_id), j AS (SELECT unnest([0, 1, 2, 3, 9]) AS job_id)
SELECT job_id, round(coalesce(b.n / x.n, 0.0), 6)::DOUBLE AS hypothesis_stability FROM j LEFT JOIN x USING (job_id) LEFT JOIN b USING (job_id)"""
)
def hypothesis_stability(spark, sf):
    """How much of each job's pairs is left when noise is gone; job 9 has none."""
    before = V.triples(spark, sf).select("job_id", F.col("subject").alias("source"), F.col("object").alias("target"))
    now = before.where(~T.is_noise(F.col("source")) & ~T.is_noise(F.col("target")))
    jobs = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,)], "job_id int")
    return D.stability(jobs, now, before).withColumn("hypothesis_stability", F.round("hypothesis_stability", 6))


TUNED = {"algorithm": {"path_reasoning_defaults": {"hub_degree_threshold": 12, "min_confidence": 3, "preferred_predicate_boost_factor": 1.5}}}
JOB = {"path_reasoning_config": {"stoplist": ["this", "le"]}, "hypothesis_config": {"preferred_predicates": ["causes"]}, "graph_config": {"excluded_entities": ["die", "El"]}, "old_key": 1}
_GENERIC = ", ".join(map(V.sql_quote, P.GENERIC_PREDICATES))


@REG.query(
    f"""WITH {V.SQL_TRIPLES_PRED}, x AS (SELECT * FROM v_triples_pred WHERE lower(subject) NOT IN ('die', 'el') AND lower(object) NOT IN ('die', 'el')), {V.sql_edges('x', 'e')}, {V.sql_paths('e', 12)},
b AS (SELECT *, CASE WHEN list_contains(predicates, 'causes') THEN least(floor(confidence * 1.5), 100)::INTEGER ELSE confidence END AS c FROM v_paths WHERE mid NOT IN ('this', 'le'))
SELECT source, mid, target, c AS confidence, c >= 3 AS passed_filter FROM b WHERE len(list_filter(predicates, lambda p: p NOT IN ({_GENERIC}))) > 0"""
)
def policy_overrides(spark, sf):
    h = N.explore(V.triples_with_predicates(spark, sf), policy_of(TUNED), job_settings(JOB))
    return h.select("source", F.get("path", 1).alias("mid"), "target", "confidence", "passed_filter")


_SMALL = {"algorithm": {"slicing": {"sentences_per_block": 2}, "deduplication_defaults": {"similarity_threshold": 0.8}}, "query_orchestrator": {"top_k_hypotheses": 4}}
_FOCUS = {"query_config": {"focus_areas": ["cell", "gene"]}}


@REG.query(
    f"""WITH {V.SQL_HYPOTHESES}, l AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY passed_filter DESC, confidence DESC, path) AS r FROM v_hyp),
d AS (SELECT source, target FROM l WHERE r = 1 ORDER BY passed_filter DESC, confidence DESC, source, target LIMIT 4)
SELECT 0 AS job_id, substr(sha256(lower(source) || '→' || lower(target)), 1, 64) AS signature,
'(relationship between ' || source || ' and ' || target || ') AND (cell OR gene)' AS query_text FROM d"""
)
def tuned_searches(spark, sf):
    """Searches for as many leads as the policy says, within the job's focus areas."""
    run = JobRun(policy_of(_SMALL), job_settings(_FOCUS))
    return run.searches(run.leads(V.hypotheses(spark, sf)).withColumn("job_id", F.lit(0)))


@REG.query(
    rf"""WITH s AS (SELECT doc_id, unnest(ss) AS st, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(
regexp_replace({V.sql_strip('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents))
SELECT doc_id AS source_id, ((i - 1) // 2)::INTEGER AS block_order, string_agg(st, ' ' ORDER BY i) AS block_text FROM s GROUP BY doc_id, (i - 1) // 2"""
)
def tuned_slices(spark, sf):
    """Blocks of two sentences each, whatever their length."""
    run = JobRun(policy_of(_SMALL | {"tokens_per_block": 1_000_000}))
    return run.slices(V.read(spark, sf, "documents"), "doc_id")
