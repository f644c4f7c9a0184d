"""The ingest stage as Structured Streaming jobs that resume: folders of results and progress are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I

#: How long a fetched paper is remembered, in the time of the papers.
REMEMBER = "7 days"


def source(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files under path, those to come included; a single file serves as well."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    # As a pattern, so that a single file serves as well as a folder.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def _by_batch(rows: DataFrame, make, out: str, checkpoint: str, mode: str = "append") -> None:
    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    job = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def stream_blocks(rows: DataFrame, out: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Slice every source that has arrived; returns the block table after all that is there now.

    Each micro-batch writes its own folder by number and overwrites it, so a batch that
    is run again after a failure leaves the same rows. A later call with the same
    folders takes only what has arrived since.
    """
    _by_batch(rows, lambda batch: I.slice_sources(batch, id_col, text_col), out, checkpoint)
    return rows.sparkSession.read.parquet(out).drop("batch")


def stream_first_seen(rows: DataFrame, key: Column, out: str, checkpoint: str, id_col: str = "doc_id") -> DataFrame:
    """(key, first_seen): the least id of each key over all that has arrived, without any state.

    Each micro-batch writes the least id of its own keys to its own folder by number, and
    a key's least row over the folders is its present one: nothing is kept between
    batches, and a batch that is run again leaves the same rows. A later call with the
    same folders takes only what has arrived since.
    """
    _by_batch(rows, lambda batch: batch.groupBy(key.alias("key")).agg(F.min(id_col).alias("first_seen")), out, checkpoint)
    return rows.sparkSession.read.parquet(out).groupBy("key").agg(F.min("first_seen").alias("first_seen"))


def stream_new(rows: DataFrame, key: Column, at: str, out: str, checkpoint: str, remember: str = REMEMBER) -> DataFrame:
    """Rows of a stream whose key was not seen before, each key once, with the column ``key``.

    A key is remembered until the watermark, the greatest time less ``remember``, has passed
    it by that long, so state is bounded by the papers of that span. A row that comes
    later than the watermark is dropped; a key that comes again after it was forgotten is
    new. Rows go to files under out, each once; a later call with the same folders takes
    only what has arrived since and remembers the keys of before.
    """
    once = rows.withColumn("key", key).withWatermark(at, remember).dropDuplicatesWithinWatermark(["key"])
    job = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return rows.sparkSession.read.schema(once.schema).parquet(out)
