"""Rows that stages append and lists that they read: blocks, papers, search runs, questions, jobs.

Every function is a narrow projection or filter; on tables partitioned by job_id the
filters prune partitions. ``append`` writes the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.settings import JobSettings, Policy
from .run import JobRun


def of_job(table: DataFrame, job_id: int) -> DataFrame:
    return table.where(F.col("job_id") == job_id)


def pending_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks whose triples are not extracted yet, by job and block order (then block id); null counts as not yet."""
    return blocks.where(~F.coalesce("triples_extracted", F.lit(False))).orderBy("job_id", "block_order", "block_id")


def block_listing(blocks: DataFrame, job_id: int) -> DataFrame:
    """(block_id, block_text, block_order, ingestion_source_id) of a job's blocks in order."""
    return of_job(blocks, job_id).orderBy("block_order", "block_id").select("block_id", "block_text", "block_order", "ingestion_source_id")


def job_status(jobs: DataFrame, job_id: int) -> DataFrame:
    """The status of a job: no row for an unknown job."""
    return of_job(jobs, job_id).select("job_id", "status")


def paper_rows(candidates: DataFrame, after: int = 0) -> DataFrame:
    """Rows to insert for papers that passed the duplicate tests, with fingerprint and paper_id above ``after``.

    Missing titles become empty and missing sources ``unknown``. Ids are unique, not dense.
    """
    return candidates.withColumns(
        {
            "title": F.coalesce("title", F.lit("")),
            "source": F.coalesce("source", F.lit("unknown")),
            "fingerprint": T.fingerprint(F.col("title"), F.col("abstract")),
            "paper_id": F.monotonically_increasing_id() + F.lit(after + 1),
        }
    )


def run_rows(queries: DataFrame, provider: Column, reason: Column) -> DataFrame:
    """A log row a search that ran: its provider, why it ran, and no signal yet."""
    return queries.select("query_id", "job_id", provider.alias("provider_used"), reason.alias("reason"), F.lit(None).cast("int").alias("signal_delta"))


def queries_of_job(queries: DataFrame, job_id: int) -> DataFrame:
    """(query_text, status, entities) of the searches of a job."""
    return of_job(queries, job_id).select("query_text", "status", F.col("entities_used").alias("entities"))


def reasoning_rows(questions: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows to insert for questions (job_id, query_text)."""
    return questions.select("job_id", "query_text", (F.current_timestamp() if now is None else now).alias("created_at"))


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a table of Parquet files partitioned by job."""
    rows.write.mode("append").partitionBy("job_id").parquet(path)


def explore(triples: DataFrame, policy: Policy | None = None, job: JobSettings | None = None) -> DataFrame:
    """Hypotheses of a job's triples under a policy and the job's own settings (``JobRun.explore``)."""
    return JobRun(policy or Policy(), job or JobSettings()).explore(triples)
