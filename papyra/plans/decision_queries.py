"""Registered queries over measurements, decisions and history, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy as P
from ..operators import decide as D
from ..operators import graph as G
from . import views as V
from .registry import Registry

REG = Registry()
_H = f"WITH {V.SQL_HYPOTHESES}"


def _h(spark, sf) -> DataFrame:
    return V.written(V.hypotheses(spark, sf).withColumn("job_id", F.lit(0)), "hyp")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_N = "least(confidence / 10.0, 1.0)"


@REG.query(
    f"""{_H}, p AS (SELECT * FROM v_hyp WHERE passed_filter), s AS (SELECT unnest([source, mid, target]) AS node FROM p),
t AS (SELECT {_N} AS c, row_number() OVER (ORDER BY confidence DESC, source, target, path) AS r FROM p)
SELECT 0 AS job_id, count(*) AS total_hypothesis_count, count(*) FILTER (passed_filter) AS passed_hypothesis_count, count(*) FILTER (NOT passed_filter) AS rejected_hypothesis_count,
count(*) FILTER (NOT passed_filter) AS promising_hypothesis_count, round(max({_N}) FILTER (passed_filter), 6)::DOUBLE AS max_normalized_confidence,
round(avg({_N}) FILTER (passed_filter), 6)::DOUBLE AS mean_normalized_confidence, (SELECT count(DISTINCT source || '|' || target) FROM p) AS unique_source_target_pairs,
round(count(*) FILTER (passed_filter) / count(*), 6)::DOUBLE AS filtered_to_total_ratio, (SELECT count(DISTINCT node) FROM s) AS unique_nodes_in_paths,
round((SELECT count(DISTINCT node) / count(*) FROM s), 6)::DOUBLE AS diversity_score,
(SELECT max(c) FILTER (r = 1) - max(c) FILTER (r = 2) > 0.3 * max(c) FILTER (r = 1) FROM t) AS is_dominant_clear FROM v_hyp"""
)
def measurement_core(spark, sf):
    return _rounded(D.core_measurements(_h(spark, sf)))


_PAIRS = """g AS (SELECT source, target, count(*) AS n, count(DISTINCT path) AS paths, avg(confidence) AS mean_confidence, max(confidence) AS max_confidence, count(DISTINCT mid) AS intermediates FROM v_hyp GROUP BY source, target)"""


@REG.query(
    f"""{_H}, {_PAIRS}, d AS (SELECT * FROM g ORDER BY mean_confidence DESC, source, target LIMIT 1),
m AS (SELECT max_confidence AS c, row_number() OVER (ORDER BY max_confidence DESC) AS r FROM g), t AS (SELECT sum(paths) AS total FROM g)
SELECT 0 AS job_id, (SELECT max(paths) FROM g) AS max_paths_per_pair, round((SELECT avg(paths) FROM g), 6) AS mean_paths_per_pair, (SELECT source || ',' || target FROM d) AS dominant_pair,
(SELECT round(paths / n, 6)::DOUBLE FROM d) AS dominant_pair_path_ratio, (SELECT intermediates FROM d) AS unique_intermediate_nodes_dominant,
round((count(mid) - count(DISTINCT mid)) / count(mid), 6)::DOUBLE AS redundancy_score, round(coalesce(var_pop(confidence) FILTER (passed_filter), 0), 6) AS confidence_variance,
(SELECT round((max(c) FILTER (r = 1) - max(c) FILTER (r = 2)) / max(c) FILTER (r = 1), 6)::DOUBLE FROM m) AS dominant_confidence_gap,
round((SELECT -sum(paths / total * log2(paths / total)) FROM g, t), 6) AS pair_distribution_entropy, 3.0::DOUBLE AS mean_path_length, 0.0::DOUBLE AS path_length_variance FROM v_hyp"""
)
def indirect_metrics(spark, sf):
    return _rounded(D.indirect_measurements(_h(spark, sf)))


@REG.query(f"{_H}, {_PAIRS} SELECT source, target, n, paths, round(mean_confidence, 6) AS mean_confidence, max_confidence, intermediates FROM g ORDER BY mean_confidence DESC, source, target LIMIT 1")
def dominant_pair(spark, sf):
    return _rounded(D.dominant_pair(D.pair_statistics(_h(spark, sf))).drop("job_id"))


@REG.query(f"{_H} SELECT 0 AS job_id, 'evidence_threshold' AS reason, count(*) AS n FROM v_hyp WHERE NOT passed_filter")
def rejection_reasons(spark, sf):
    return D.rejection_reasons(_h(spark, sf))


@REG.query(
    f"""WITH {V.SQL_TRIPLES}, {V.sql_edges('v_triples', 'e')}, n AS (SELECT DISTINCT unnest([subject, object]) AS node FROM e)
SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)), 9)::DOUBLE AS graph_density"""
)
def graph_density(spark, sf):
    e = G.without_noise(V.edges(spark, sf))
    return D.graph_density(e, G.nodes_of(e)).withColumn("graph_density", F.round("graph_density", 9))


def snapshots(spark, sf) -> DataFrame:
    """Daily records of each user as the measurement history of a job."""
    e = V.read(spark, sf, "events")
    s = e.groupBy(F.col("user_id").alias("job_id"), F.to_date("ts").alias("day")).agg(
        F.count("*").alias("passed_hypothesis_count"), F.countDistinct("event_type").alias("unique_nodes_in_paths"), F.count_if(F.col("event_type") == "view").alias("promising_hypothesis_count")
    )
    return s.withColumns(
        {
            "diversity_score": F.col("unique_nodes_in_paths") / F.col("passed_hypothesis_count"),
            "passed_hypothesis_count": F.greatest(F.col("passed_hypothesis_count") - 2, F.lit(0)),
        }
    )


SQL_SNAPSHOTS = """v_s AS (SELECT user_id AS job_id, ts::DATE AS day, greatest(count(*) - 2, 0) AS passed_hypothesis_count, count(DISTINCT event_type) AS unique_nodes_in_paths,
count(*) FILTER (event_type = 'view') AS promising_hypothesis_count, count(DISTINCT event_type) / count(*) AS diversity_score FROM events GROUP BY 1, 2),
v_g AS (SELECT *, coalesce((unique_nodes_in_paths - lag(unique_nodes_in_paths) OVER w) + (diversity_score - lag(diversity_score) OVER w) + (passed_hypothesis_count - lag(passed_hypothesis_count) OVER w), 0) AS growth_score,
CASE WHEN lag(passed_hypothesis_count) OVER w IS NULL THEN 0 WHEN lag(passed_hypothesis_count) OVER w = 0 THEN passed_hypothesis_count
ELSE (passed_hypothesis_count - lag(passed_hypothesis_count) OVER w) / lag(passed_hypothesis_count) OVER w END AS evidence_growth_rate FROM v_s WINDOW w AS (PARTITION BY job_id ORDER BY day)),
v_t AS (SELECT *, max(abs(growth_score)) OVER x <= 0.5 AND count(*) OVER x = 4 AS saturated FROM v_g WINDOW x AS (PARTITION BY job_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


@REG.query(f"WITH {SQL_SNAPSHOTS} SELECT job_id, day::VARCHAR AS day, round(growth_score, 6)::DOUBLE AS growth_score, round(evidence_growth_rate, 6)::DOUBLE AS evidence_growth_rate FROM v_g")
def growth_score(spark, sf):
    g = D.growth(snapshots(spark, sf))
    return _rounded(g.select("job_id", F.col("day").cast("string").alias("day"), "growth_score", "evidence_growth_rate"))


@REG.query(f"WITH {SQL_SNAPSHOTS} SELECT job_id, day::VARCHAR AS day, saturated FROM v_t")
def stagnation_window(spark, sf):
    s = D.saturated(D.growth(snapshots(spark, sf)))
    return s.select("job_id", F.col("day").cast("string").alias("day"), "saturated")


_DECIDE = """CASE WHEN passed_hypothesis_count = 0 AND promising_hypothesis_count = 0 THEN 'insufficient_signal' WHEN saturated THEN 'halt_no_hypothesis' WHEN growth_score > 0.5 THEN 'strategic_download_targeted'
WHEN job_id % 4 > 1 AND max_paths_per_pair >= 2 AND is_dominant_clear AND max_normalized_confidence >= 0.7 THEN 'halt_confident'
WHEN job_id % 4 > 1 AND abs(evidence_growth_rate) <= 0.1 AND max_paths_per_pair < 2 AND graph_density > 0.05 AND diversity_score > 0.3 THEN 'halt_no_hypothesis'
WHEN pairs < 2 OR diversity_score < 0.3 OR graph_density < 0.05 THEN 'fetch_more_literature' ELSE 'insufficient_signal' END"""
_MEASURES = """m AS (SELECT *, job_id % 3 AS max_paths_per_pair, job_id % 5 = 0 AS is_dominant_clear, (job_id % 11) / 10.0 AS max_normalized_confidence, (job_id % 7) / 50.0 AS graph_density, job_id % 4 + 1 AS pairs FROM v_t)"""


def _decisions(spark, sf) -> DataFrame:
    """History with the measurements that events lack made from the job id."""
    j = F.col("job_id")
    m = {
        "mean_path_length": (j % 4).cast("double"), "max_paths_per_pair": j % 3, "is_dominant_clear": j % 5 == 0, "max_normalized_confidence": (j % 11) / 10.0,
        "graph_density": (j % 7) / 50.0, "unique_source_target_pairs": j % 4 + 1,
    }
    return D.saturated(D.growth(snapshots(spark, sf))).withColumn("decision", D.decide_discovery(m))


@REG.query(f"WITH {SQL_SNAPSHOTS}, {_MEASURES} SELECT job_id, day::VARCHAR AS day, {_DECIDE} AS decision FROM m")
def decision_discovery(spark, sf):
    return _decisions(spark, sf).select("job_id", F.col("day").cast("string").alias("day"), "decision")


@REG.query(
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'verification_found' WHEN user_id % 2 = 0 THEN 'verification_not_found' ELSE 'fetch_more_literature' END AS decision FROM events"""
)
def decision_verification(spark, sf):
    e = V.read(spark, sf, "events")
    return e.select("event_id", D.decide_verification(F.col("event_type") == "purchase", F.col("user_id") % 2 == 0).alias("decision"))


@REG.query(f"WITH {SQL_SNAPSHOTS}, {_MEASURES} SELECT job_id, day::VARCHAR AS day, {_DECIDE} AS decision FROM m QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY day DESC) = 1")
def latest_decision(spark, sf):
    last = G.latest_by(_decisions(spark, sf), "job_id", F.desc("day"))
    return last.select("job_id", F.col("day").cast("string").alias("day"), "decision")


@REG.query(
    f"""WITH {SQL_SNAPSHOTS}, {_MEASURES}, d AS (SELECT job_id, day, {_DECIDE} AS decision, promising_hypothesis_count AS u FROM m)
SELECT job_id, day::VARCHAR AS day, CASE WHEN decision LIKE 'halt%' THEN 'COMPLETED' WHEN decision = 'insufficient_signal' THEN 'NEED_MORE_INPUT'
WHEN decision = 'strategic_download_targeted' AND u > 0 THEN 'DOWNLOAD_QUEUED' WHEN job_id % 40 >= 30 THEN 'COMPLETED' ELSE 'FETCH_QUEUED' END AS status FROM d"""
)
def state_transitions(spark, sf):
    d = _decisions(spark, sf)
    status = D.next_status(F.col("decision"), F.col("promising_hypothesis_count"), F.col("job_id") % 40, 30)
    return d.select("job_id", F.col("day").cast("string").alias("day"), status.alias("status"))


_STATUSES = [*P.STAGE_AFTER, "COMPLETED"]


@REG.query(
    f"""SELECT event_id, CASE ([{', '.join(map(V.sql_quote, _STATUSES))}])[event_id % {len(_STATUSES)} + 1] {' '.join(f'WHEN {V.sql_quote(a)} THEN {V.sql_quote(b)}' for a, b in P.STAGE_AFTER.items())} END AS after,
CASE ([{', '.join(map(V.sql_quote, _STATUSES))}])[event_id % {len(_STATUSES)} + 1] {' '.join(f'WHEN {V.sql_quote(a)} THEN {V.sql_quote(b)}' for a, b in P.MANUAL_TRIGGERS.items())} END AS trigger FROM events"""
)
def stage_transitions(spark, sf):
    status = F.get(F.array(*map(F.lit, _STATUSES)), (F.col("event_id") % len(_STATUSES)).cast("int"))
    return V.read(spark, sf, "events").select("event_id", D.stage_after(status).alias("after"), D.stage_after(status, P.MANUAL_TRIGGERS).alias("trigger"))


_PHASE = "CASE event_type WHEN 'view' THEN 'DECISION' WHEN 'click' THEN 'GRAPH' WHEN 'error' THEN 'UNKNOWN' ELSE 'FETCH' END"
_STATUS = "CASE user_id % 4 WHEN 0 THEN 'found' WHEN 1 THEN 'nohypo' WHEN 2 THEN 'odd' END"


@REG.query(
    f"""WITH e AS (SELECT event_id, {_PHASE} AS phase, {_STATUS} AS status FROM events)
SELECT event_id, phase, status, CASE WHEN phase = 'DECISION' AND status = 'found' THEN 'presentation_decision_found.txt' WHEN phase = 'DECISION' AND status = 'nohypo' THEN 'presentation_decision_nohypo.txt'
WHEN phase = 'DECISION' THEN 'presentation_decision.txt' WHEN phase = 'GRAPH' THEN 'presentation_graph.txt' WHEN phase = 'FETCH' THEN 'presentation_fetch.txt' END AS prompt FROM e"""
)
def prompt_route(spark, sf):
    e = V.read(spark, sf, "events").select("event_id", F.expr(_PHASE).alias("phase"), F.expr(_STATUS).alias("status"))
    return D.prompt_route(e).select("event_id", "phase", "status", "prompt")


SQL_RUNS = """d AS (SELECT user_id AS job_id, ts AS created_at, value FROM events WHERE event_type IN ('purchase', 'signup')),
r AS (SELECT event_id AS run_id, user_id AS job_id, ts AS created_at, CASE WHEN event_id % 7 = 0 THEN 1 END AS signal_delta FROM events WHERE event_type IN ('view', 'click'))"""


def _runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = V.read(spark, sf, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("ts").alias("created_at"), "value", "event_type")
    runs = e.where("event_type in ('view', 'click')").select(F.col("event_id").alias("run_id"), "job_id", "created_at", F.when(F.col("event_id") % 7 == 0, 1).alias("signal_delta"))
    return runs, e.where("event_type in ('purchase', 'signup')").select("job_id", "created_at", "value")


@REG.query(f"WITH {SQL_RUNS} SELECT run_id, r.job_id, d.created_at AS before_at, round(d.value, 6) AS before_value FROM r ASOF LEFT JOIN d ON r.job_id = d.job_id AND r.created_at > d.created_at")
def asof_before(spark, sf):
    return _rounded(D.around(*_runs(spark, sf)).select("run_id", "job_id", "before_at", "before_value"))


@REG.query(f"WITH {SQL_RUNS} SELECT run_id, r.job_id, d.created_at AS after_at, round(d.value, 6) AS after_value FROM r ASOF LEFT JOIN d ON r.job_id = d.job_id AND r.created_at < d.created_at")
def asof_after(spark, sf):
    return _rounded(D.around(*_runs(spark, sf)).select("run_id", "job_id", "after_at", "after_value"))


@REG.query(
    f"""WITH {SQL_RUNS}, l AS (SELECT job_id, created_at AS cur, lag(created_at) OVER (PARTITION BY job_id ORDER BY created_at) AS prev, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC) AS k FROM d)
SELECT r.job_id, run_id FROM r JOIN l ON l.job_id = r.job_id AND k = 1 WHERE signal_delta IS NULL AND (prev IS NULL OR created_at > prev) AND created_at < cur"""
)
def pending_runs(spark, sf):
    return D.pending_runs(*_runs(spark, sf))


_DELTA = "(coalesce(a.value, 0) - coalesce(b.value, 0)) / 100.0 + (coalesce(a.value, 0) - coalesce(b.value, 0)) / 1000.0 / 0.2 * 0.5"


@REG.query(
    f"""WITH {SQL_RUNS}, x AS (SELECT run_id, b.value AS bv, r.created_at, r.job_id FROM r ASOF LEFT JOIN d b ON r.job_id = b.job_id AND r.created_at > b.created_at),
y AS (SELECT run_id, bv, d.value AS av FROM x ASOF LEFT JOIN d ON x.job_id = d.job_id AND x.created_at < d.created_at),
z AS (SELECT run_id, (coalesce(av, 0) - coalesce(bv, 0)) / 100.0 * 1.0 + (coalesce(av / 1000.0, 0) - coalesce(bv / 1000.0, 0)) / 0.2 * 0.5 AS delta FROM y)
SELECT run_id, round(delta, 6) AS delta, CASE WHEN delta >= 1 THEN 1 WHEN delta <= -1 THEN -1 ELSE 0 END AS signal, CASE WHEN delta >= 1 THEN 'reusable' WHEN delta <= -1 THEN 'blocked' ELSE 'exhausted' END AS status,
CASE WHEN delta >= 1 THEN 10 WHEN delta <= -1 THEN -20 ELSE 0 END AS reputation_change FROM z"""
)
def signal_delta(spark, sf):
    a = D.around(*_runs(spark, sf))

    def m(c: str) -> dict:
        return {"passed_hypothesis_count": F.col(c), "graph_density": F.col(c) / F.lit(1000.0)}

    delta = D.measurement_delta(m("before_value"), m("after_value"))
    return a.withColumn("delta", delta).select("run_id", F.round("delta", 6).alias("delta"), D.signal_class(F.col("delta")).alias("s")).select("run_id", "delta", "s.*")


_SAID = "(conv_id + turn) % 9"


@REG.query(
    f"""WITH a AS (SELECT conv_id, turn, lower(CASE {_SAID} {' '.join(f"WHEN {k} THEN 'So: {d.upper()}, ' || text" for k, d in enumerate(P.DECISIONS))}
WHEN 7 THEN text || ' verification_not_found or Halt_Confident.' ELSE text END) AS a FROM conversations)
SELECT conv_id, turn, CASE {' '.join(f"WHEN contains(a, '{d}') THEN '{d}'" for d in P.DECISIONS)} ELSE 'insufficient_signal' END AS decision FROM a"""
)
def decision_text(spark, sf):
    """Answers that name each label, answers that name two, and answers that name none."""
    c = V.read(spark, sf, "conversations")
    answer = F.when(F.expr(f"{_SAID} = 7"), F.concat("text", F.lit(" verification_not_found or Halt_Confident."))).otherwise(F.col("text"))
    for k, label in enumerate(P.DECISIONS):
        answer = F.when(F.expr(f"{_SAID} = {k}"), F.concat(F.lit(f"So: {label.upper()}, "), "text")).otherwise(answer)
    return c.select("conv_id", "turn", D.decision_in(answer).alias("decision"))
