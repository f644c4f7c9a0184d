"""Inputs of a job and what they set off: registration, intents, progress events, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import decide as D


def register_inputs(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, job states) of new inputs (job_id, kind, ref, text).

    kind: user_text, file, paper_abstract or pdf_text. Blank texts register nothing,
    except files, whose text comes later. A job with a source is ready to ingest.
    """
    ref = (
        F.when(F.col("kind") == "file", F.concat(F.lit("file:"), "ref"))
        .when(F.col("kind").isin("paper_abstract", "pdf_text"), F.concat(F.lit("paper:"), "ref"))
        .otherwise(F.concat(F.lit("user_text_"), "ref"))
    )
    good = inputs.where((F.col("kind") == "file") | (T.strip(F.coalesce("text", F.lit(""))) != ""))
    sources = good.select("job_id", F.col("kind").alias("source_type"), ref.alias("source_ref"), F.col("text").alias("raw_text"), F.lit(False).alias("processed"))
    return sources, sources.select("job_id", F.lit("READY_TO_INGEST").alias("status")).distinct()


def intent_effect(label: Column) -> Column:
    """What an intent sets off: action and the job's next status; unknown labels count as talk."""
    action = F.when(label == "RESEARCH_SEED", "create_query").when(label == "EVIDENCE_INPUT", "append_source").otherwise("append_message")
    status = F.when(label == "RESEARCH_SEED", "FETCH_QUEUED").when(label == "EVIDENCE_INPUT", "READY_TO_INGEST")
    return F.struct(action.alias("action"), status.alias("status"))


def progress_event(events: DataFrame) -> DataFrame:
    """Add prompt and message of progress events (job_id, phase, status, result map)."""
    said = F.concat_ws(", ", F.transform(F.array_sort(F.map_entries("result")), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return D.prompt_route(events).withColumn("message", F.concat_ws(": ", F.concat_ws("/", "phase", "status"), said))


def decide_step(history: DataFrame, current: DataFrame, order: str = "created_at") -> DataFrame:
    """The decision rows of a cycle: current measurements against each job's history, ready to append.

    Both hold job_id, the order column and the measurements; growth and saturation are
    taken over the union, the decision once.
    """
    both = D.saturated(D.growth(history.select(*current.columns).unionByName(current), order), order)
    return both.join(current.select("job_id", order), ["job_id", order], "left_semi").withColumn("decision", D.decide_discovery())


def research_query(intents: DataFrame) -> DataFrame:
    """Search queries (job_id, signature, query_text) of research seeds (job_id, topic, entities)."""
    s = intents.select("job_id", T.seed_endpoints(F.col("entities"), F.col("topic")).alias("s")).select("job_id", "s.*")
    pair = F.when(F.col("source") == F.col("target"), F.lit(None)).otherwise(F.col("target"))
    return s.select("job_id", T.hypothesis_signature(F.col("source"), F.col("target")).alias("signature"), T.query_text(F.col("source"), pair, F.col("focus")).alias("query_text"))
