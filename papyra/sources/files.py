"""Texts and layouts as tables: whole text files, PDF bytes, page blocks in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions import text as T
from ..operators import ingest as I

#: Page blocks whose left edges fall into the same band of this width share a column.
COLUMN_WIDTH = 200
SUPPORTED = ("txt", "md", "text", "pdf")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files; blank files are left out."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(T.strip("text") != "")


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files, for a layout provider run with mapInPandas."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def supported(path: Column) -> Column:
    """Whether an adapter reads a file, by extension; rows that fail belong in quarantine."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*SUPPORTED)


def reading_order(blocks: DataFrame, width: int = COLUMN_WIDTH) -> DataFrame:
    """Blocks (source_id, page, x0, y0, text) numbered by page, column, then height: seq from 0."""
    order = Window.partitionBy("source_id").orderBy("page", F.floor(F.col("x0") / width), "y0", "x0", "text")
    return blocks.withColumn("seq", F.row_number().over(order) - 1)


def extract_pages(blocks: DataFrame, fallback_chars: int = P.FALLBACK_CHARS) -> DataFrame:
    """(source_id, text): whitelisted regions joined by blank lines; sources with none fall back to their pages."""
    regions = I.assign_regions(reading_order(blocks)).groupBy("source_id").agg(
        F.sort_array(F.collect_list(F.struct("run", "text"))).alias("r")
    )
    named = regions.select("source_id", F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"))
    rest = blocks.join(named, "source_id", "left_anti")
    pages = reading_order(rest).groupBy("source_id", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("b"))
    pages = pages.select("source_id", "page", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"))
    return named.unionByName(I.page_fallback(pages, fallback_chars))


def upload_path(job_id: Column, name: Column) -> Column:
    """uploads/<job>/original/<digest>.<extension>; the digest of the name stands for a random id, so it can be repeated."""
    ext = F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)
    return F.concat(F.lit("uploads/"), job_id.cast("string"), F.lit("/original/"), F.md5(name.cast("binary")), ext)
