"""Measurements of hypotheses and graphs, decision rules, history windows, signals, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy as P
from .reason import is_promising


#: Rows of a job that one task sorts, and slices that a larger job is cut into at most.
SLICE_ROWS, MOST_SLICES = 1_000_000, 512


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def normalised(confidence: Column) -> Column:
    return F.least(confidence / F.lit(P.CONFIDENCE_NORM), F.lit(1.0))


def core_measurements(h: DataFrame) -> DataFrame:
    """One row a job: counts over all hypotheses, confidence and diversity over passed ones.

    h: job_id, source, target, path, confidence, passed_filter, filter_reason. The
    dominant hypothesis is clear when the first (by confidence) leads the second by
    more than its share, or is alone.
    """
    ok = F.col("passed_filter")
    c = F.when(ok, normalised(F.col("confidence")))
    slots = h.where(ok).select("job_id", F.explode("path").alias("node")).groupBy("job_id").agg(
        F.countDistinct("node").alias("unique_nodes_in_paths"), F.count("*").alias("slots")
    )
    order = Window.partitionBy("job_id").orderBy(F.desc("confidence"), "source", "target", F.array_join("path", " > "))
    top = (
        h.where(ok).withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("job_id").agg(
            F.max(F.when(F.col("r") == 1, normalised(F.col("confidence")))).alias("first"),
            F.max(F.when(F.col("r") == 2, normalised(F.col("confidence")))).alias("second"),
        )
    )
    counts = h.groupBy("job_id").agg(
        F.count("*").alias("total_hypothesis_count"),
        F.count_if(ok).alias("passed_hypothesis_count"),
        F.count_if(~ok).alias("rejected_hypothesis_count"),
        F.count_if(is_promising(ok, F.col("filter_reason"))).alias("promising_hypothesis_count"),
        F.coalesce(F.max(c), F.lit(0.0)).alias("max_normalized_confidence"),
        F.coalesce(F.avg(c), F.lit(0.0)).alias("mean_normalized_confidence"),
        F.countDistinct(F.when(ok, F.struct("source", "target"))).alias("unique_source_target_pairs"),
    )
    out = counts.join(slots, "job_id", "left").join(top, "job_id", "left")
    clear = F.when(F.col("second").isNull(), F.col("first").isNotNull()).otherwise(
        (F.col("first") > 0) & (F.col("first") - F.col("second") > P.DOMINANT_GAP * F.col("first"))
    )
    return out.select(
        *counts.columns,
        _share(F.col("passed_hypothesis_count"), F.col("total_hypothesis_count")).alias("filtered_to_total_ratio"),
        F.coalesce("unique_nodes_in_paths", F.lit(0)).alias("unique_nodes_in_paths"),
        _share(F.coalesce("unique_nodes_in_paths", F.lit(0)), F.coalesce("slots", F.lit(0))).alias("diversity_score"),
        F.coalesce(clear, F.lit(False)).alias("is_dominant_clear"),
    )


def _variance(x: Column) -> Column:
    return F.when(F.count(x) < 2, 0.0).otherwise(F.var_pop(x))


def pair_statistics(h: DataFrame) -> DataFrame:
    """One row a (job, source, target): hypotheses, distinct paths, mean and greatest confidence, intermediates."""
    p = F.array_join("path", " > ")
    return h.where("source <> '' and target <> ''").groupBy("job_id", "source", "target").agg(
        F.count("*").alias("n"),
        F.countDistinct(p).alias("paths"),
        F.avg("confidence").alias("mean_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.countDistinct(F.when(F.size("path") > 2, F.get("path", 1))).alias("intermediates"),
    )


def dominant_pair(stats: DataFrame) -> DataFrame:
    """The pair of highest mean confidence of each job (ties: least source, target)."""
    order = Window.partitionBy("job_id").orderBy(F.desc("mean_confidence"), "source", "target")
    return stats.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def indirect_measurements(h: DataFrame) -> DataFrame:
    """One row a job over all its hypotheses (confidence variance: passed ones only).

    All by sums and maxima, which combine before the shuffle, so a large job needs no
    sort in one task.
    """
    stats = pair_statistics(h)
    # Of n equal pairs the second is as high as the first, else it is the next lower value.
    levels = stats.groupBy("job_id", "max_confidence").agg(F.count("*").alias("n"))
    first = levels.groupBy("job_id").agg(F.max("max_confidence").alias("c1"))
    lower = F.when((F.col("max_confidence") < F.col("c1")) | (F.col("n") > 1), F.col("max_confidence"))
    two = levels.join(first, "job_id").groupBy("job_id", "c1").agg(F.max(lower).alias("c2"))
    # -sum p log p over shares p = paths / all is log all - sum paths log paths / all.
    every, weighted = F.sum("paths"), F.sum(F.col("paths") * F.log2("paths"))
    by_pair = stats.groupBy("job_id").agg(
        F.max("paths").alias("max_paths_per_pair"),
        F.avg("paths").alias("mean_paths_per_pair"),
        (F.log2(every) - weighted / every).alias("pair_distribution_entropy"),
    ).join(two, "job_id")
    top = dominant_pair(stats).select(
        "job_id",
        F.concat_ws(",", "source", "target").alias("dominant_pair"),
        (F.col("paths") / F.col("n")).alias("dominant_pair_path_ratio"),
        F.col("intermediates").alias("unique_intermediate_nodes_dominant"),
    )
    mids = F.when(F.size("path") > 2, F.get("path", 1))
    base = h.groupBy("job_id").agg(
        F.count(mids).alias("mids"),
        F.countDistinct(mids).alias("unique_mids"),
        _variance(F.when(F.col("passed_filter"), F.col("confidence"))).alias("confidence_variance"),
        F.avg(F.size("path")).alias("mean_path_length"),
        _variance(F.size("path")).alias("path_length_variance"),
    )
    gap = F.when(F.col("c2").isNull() | (F.col("c1") <= 0), 0.0).otherwise((F.col("c1") - F.col("c2")) / F.col("c1"))
    return base.join(by_pair, "job_id", "left").join(top, "job_id", "left").select(
        "job_id", "max_paths_per_pair", "mean_paths_per_pair", "dominant_pair", "dominant_pair_path_ratio", "unique_intermediate_nodes_dominant",
        _share(F.col("mids") - F.col("unique_mids"), F.col("mids")).alias("redundancy_score"),
        "confidence_variance", gap.alias("dominant_confidence_gap"), "pair_distribution_entropy", "mean_path_length", "path_length_variance",
    )


def for_jobs(measurements: DataFrame, jobs: DataFrame) -> DataFrame:
    """Measurements of every job: one without hypotheses has zeros (no dominant pair), mean path length too."""
    filled = jobs.select("job_id").join(measurements, "job_id", "left").fillna(0)
    flags = [c for c, kind in measurements.dtypes if kind == "boolean"]
    return filled.fillna(False, flags) if flags else filled


def stability(jobs: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """(job_id, hypothesis_stability): the share of a job's earlier (source, target) pairs that are still there.

    Without earlier pairs it is 1 if there are any now, else 0.
    """
    key = ["job_id", "source", "target"]
    was, are = before.select(*key).distinct(), now.select(*key).distinct().withColumn("_now", F.lit(True))
    kept = was.join(are, key, "left").groupBy("job_id").agg((F.count("_now") / F.count("*")).alias("_kept"))
    some = are.select("job_id").distinct().withColumn("_some", F.lit(1.0))
    out = jobs.select("job_id").join(kept, "job_id", "left").join(some, "job_id", "left")
    return out.select("job_id", F.coalesce("_kept", "_some", F.lit(0.0)).alias("hypothesis_stability"))


def graph_density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges and edges over the n(n - 1) possible ones (0 for fewer than two nodes)."""
    n = nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))
    return n.withColumn("graph_density", _share(F.col("edge_count"), F.col("node_count") * (F.col("node_count") - 1)))


def rejection_reasons(h: DataFrame) -> DataFrame:
    """Rejected hypotheses by their reasons, sorted and joined; ``unknown`` without one."""
    reason = F.array_join(F.array_sort(F.map_keys("filter_reason")), "|")
    return h.where(~F.col("passed_filter")).groupBy("job_id", F.coalesce(reason, F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def growth(history: DataFrame, order: str = "day") -> DataFrame:
    """Add growth_score and evidence_growth_rate against the record before (0 for the first of a job)."""
    along = Window.partitionBy("job_id").orderBy(order)

    def step(c: str) -> Column:
        return F.col(c) - F.lag(c).over(along)

    score = F.coalesce(step("unique_nodes_in_paths") + step("diversity_score") + step("passed_hypothesis_count"), F.lit(0.0))
    before = F.lag("passed_hypothesis_count").over(along)
    rate = F.when(before.isNull(), 0.0).when(before == 0, F.col("passed_hypothesis_count").cast("double")).otherwise(step("passed_hypothesis_count") / before)
    return history.withColumns({"growth_score": score, "evidence_growth_rate": rate})


def saturated(history: DataFrame, order: str = "day", cycles: int = P.STABILITY_CYCLES) -> DataFrame:
    """Add saturated: this record and the cycles - 1 before it exist and none grew by more than the threshold."""
    last = Window.partitionBy("job_id").orderBy(order).rowsBetween(-(cycles - 1), 0)
    still = F.max(F.abs("growth_score")).over(last) <= P.ABSOLUTE_GROWTH
    return history.withColumn("saturated", still & (F.count("*").over(last) == cycles))


def decide_discovery(m: dict[str, Column] | None = None) -> Column:
    """The decision of a measurement row: the first rule that holds."""
    c = lambda k: (m or {}).get(k, F.col(k))
    deep = c("mean_path_length") > 1
    return (
        F.when((c("passed_hypothesis_count") == 0) & (c("promising_hypothesis_count") == 0), "insufficient_signal")
        .when(c("saturated"), "halt_no_hypothesis")
        .when(c("growth_score") > P.ABSOLUTE_GROWTH, "strategic_download_targeted")
        .when(
            deep & (c("max_paths_per_pair") >= P.PATH_SUPPORT) & c("is_dominant_clear") & (c("max_normalized_confidence") >= P.HIGH_CONFIDENCE),
            "halt_confident",
        )
        .when(
            deep
            & (F.abs(c("evidence_growth_rate")) <= P.RELATIVE_GROWTH)
            & (c("max_paths_per_pair") < P.PATH_SUPPORT)
            & (c("graph_density") > P.SPARSE_DENSITY)
            & (c("diversity_score") > P.DIVERSITY_RATIO),
            "halt_no_hypothesis",
        )
        .when(
            (c("unique_source_target_pairs") < P.LOW_DIVERSITY_PAIRS) | (c("diversity_score") < P.DIVERSITY_RATIO) | (c("graph_density") < P.SPARSE_DENSITY),
            "fetch_more_literature",
        )
        .otherwise("insufficient_signal")
    )


def decide_verification(found: Column, complete: Column) -> Column:
    return F.when(found, "verification_found").when(complete, "verification_not_found").otherwise("fetch_more_literature")


def decision_in(response: Column) -> Column:
    """The first label, in order of the policy, that a model's answer holds."""
    out = F.lit("insufficient_signal")
    for label in reversed(P.DECISIONS):
        out = F.when(F.lower(response).contains(label), label).otherwise(out)
    return out


def next_status(decision: Column, undownloaded: Column, papers: Column, cap: int) -> Column:
    """The job status that a decision leads to; fetching stops at the paper cap."""
    fetch = F.when(papers >= cap, "COMPLETED").otherwise("FETCH_QUEUED")
    return (
        F.when(decision.isin("halt_confident", "halt_no_hypothesis", "verification_found", "verification_not_found"), "COMPLETED")
        .when(decision == "insufficient_signal", "NEED_MORE_INPUT")
        .when(decision == "fetch_more_literature", fetch)
        .when(decision == "strategic_download_targeted", F.when(undownloaded > 0, "DOWNLOAD_QUEUED").otherwise(fetch))
    )


def stage_after(status: Column, table: dict[str, str] = P.STAGE_AFTER) -> Column:
    """The status after the stage that a status starts; null if it starts none (the job stays)."""
    out = F.lit(None).cast("string")
    for a, b in table.items():
        out = F.when(status == a, b).otherwise(out)
    return out


def prompt_route(events: DataFrame) -> DataFrame:
    """Add prompt: that of (phase, status), else of the phase alone, else null."""
    rows = [(a, b, p) for (a, b), p in P.PROMPTS.items()]
    table = F.broadcast(events.sparkSession.createDataFrame(rows, "phase string, status string, prompt string"))
    exact = table.where("status is not null").withColumnRenamed("prompt", "_exact")
    loose = table.where("status is null").select("phase", F.col("prompt").alias("_loose"))
    return events.join(exact, ["phase", "status"], "left").join(loose, "phase", "left").withColumn("prompt", F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def around(runs: DataFrame, decisions: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each run with the last decision strictly before and the first strictly after it.

    runs: job_id, run_id, created_at; decisions: job_id, value, created_at. One sort of
    the union; ties in time lie outside both. Where a job has more than ``slice_rows``
    rows, jobs are cut into slices of time, so that no task sorts a large job whole: a
    slice brings its last and first decision, and a run that finds none in its own slice
    takes that of the nearest slice that has one.
    """
    d = decisions.select("job_id", "created_at", F.struct("created_at", "value").alias("d"), F.lit(None).cast("long").alias("run_id"))
    r = runs.select("job_id", "created_at", F.lit(None).cast(d.schema["d"].dataType).alias("d"), "run_id")
    both = d.union(r).withColumn("t", F.unix_micros(F.col("created_at").cast("timestamp")))
    most = both.groupBy("job_id").count().agg(F.max("count")).first()[0] or 0
    n = min(MOST_SLICES, -(-most // slice_rows))
    bounds = []
    if n > 1:
        bounds = sorted(set(both.agg(F.percentile_approx("t", F.array(*(F.lit(i / n) for i in range(1, n))), 20 * n)).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("t"))) if bounds else F.lit(0)
    both = both.withColumn("slice", part)
    # Range frames end before the current time, so rows of equal time stay out.
    along = Window.partitionBy("job_id", "slice").orderBy("t")
    before = F.last("d", ignorenulls=True).over(along.rangeBetween(Window.unboundedPreceding, -1))
    after = F.first("d", ignorenulls=True).over(along.rangeBetween(1, Window.unboundedFollowing))
    out = both.withColumns({"before": before, "after": after}).where("run_id is not null")
    if bounds:
        ends = both.groupBy("job_id", "slice").agg(F.max_by("d", F.when(F.col("d").isNotNull(), F.col("t"))).alias("last"), F.min_by("d", F.when(F.col("d").isNotNull(), F.col("t"))).alias("first"))
        order = Window.partitionBy("job_id").orderBy("slice")
        carried = {
            "earlier": F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "later": F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
        out = out.join(ends.withColumns(carried).drop("last", "first"), ["job_id", "slice"])
        out = out.withColumns({"before": F.coalesce("before", "earlier"), "after": F.coalesce("after", "later")})
    return out.select(
        "job_id", "run_id", "created_at",
        F.col("before.created_at").alias("before_at"), F.col("before.value").alias("before_value"),
        F.col("after.created_at").alias("after_at"), F.col("after.value").alias("after_value"),
    )


def pending_runs(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Runs without a signal, strictly between a job's last decision and the one before it."""
    order = Window.partitionBy("job_id").orderBy("created_at")
    last = decisions.withColumns({"prev": F.lag("created_at").over(order), "r": F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("created_at")))})
    span = last.where("r = 1").select("job_id", "prev", F.col("created_at").alias("cur"))
    return runs.where("signal_delta is null").join(span, "job_id").where("(prev is null or created_at > prev) and created_at < cur").select("job_id", "run_id")


def measurement_delta(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Weighted change over the largest expected change; measurements that nobody emits count as unchanged."""
    out = F.lit(0.0)
    for name, (weight, largest) in P.SIGNAL_WEIGHTS.items():
        if name in before:
            out = out + (F.coalesce(after[name], F.lit(0)) - F.coalesce(before[name], F.lit(0))) / F.lit(largest) * F.lit(weight)
    return out


def signal_class(delta: Column) -> Column:
    """signal, status and change of reputation of a delta."""
    signal = F.when(delta >= P.SIGNAL_POSITIVE, 1).when(delta <= P.SIGNAL_NEGATIVE, -1).otherwise(0)
    status = F.when(signal == 1, "reusable").when(signal == -1, "blocked").otherwise("exhausted")
    change = F.when(signal == 1, P.REPUTATION[1]).when(signal == -1, P.REPUTATION[-1]).otherwise(P.REPUTATION[0])
    return F.struct(signal.alias("signal"), status.alias("status"), change.alias("reputation_change"))
