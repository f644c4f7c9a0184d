"""From raw sources to blocks: routing, regions, page fallback, spans, refinement, bookkeeping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import policy as P
from ..functions import text as T

#: Characters of texts whose spans leave together.
SPAN_BATCH = 1 << 20


def region_of(block: Column) -> Column:
    """The region that a heading opens (short, any case, with or without full stops at the end); null for other text."""
    key = F.regexp_replace(T.strip(F.lower(block)), r"\.+$", "")
    out = F.lit(None).cast("string")
    for name, region in P.REGION_MARKERS.items():
        out = F.when(key == name, region).otherwise(out)
    return F.when(F.length(block) <= P.HEADING_CHARS, out)


def assign_regions(blocks: DataFrame) -> DataFrame:
    """(source_id, run, region, text) of the whitelisted regions of each source.

    blocks: source_id, seq, text in reading order. Text counts only inside a named
    region; a heading that names the current region again is text; everything from the
    first block that shows an excluded word in its beginning is cut off.
    """
    b = blocks.withColumn("text", T.strip("text")).where("text <> ''")
    start = F.lower(F.substring("text", 1, P.HEADING_CHARS))
    excluded = F.lit(False)
    for word in P.EXCLUDED_REGIONS:
        excluded = excluded | start.contains(word)
    along = Window.partitionBy("source_id").orderBy("seq")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    marked = b.withColumns({"mark": region_of(F.col("text")), "cut": F.max(excluded.cast("int")).over(upto)}).where("cut = 0")
    marked = marked.withColumn("current", F.last("mark", ignorenulls=True).over(before))
    heading = F.col("mark").isNotNull() & ~F.col("mark").eqNullSafe(F.col("current"))
    runs = marked.withColumns({"heading": heading, "run": F.sum(heading.cast("int")).over(upto), "region": F.last("mark", ignorenulls=True).over(upto)})
    return (
        runs.where(~F.col("heading") & (F.col("run") > 0) & F.col("region").isin(P.WHITELISTED_REGIONS))
        .groupBy("source_id", "run", "region")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("t"))
        .select("source_id", "run", "region", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
    )


def page_fallback(pages: DataFrame, limit: int = P.FALLBACK_CHARS) -> DataFrame:
    """(source_id, text): pages in order until the limit, the last one cut; pages (source_id, page, text)."""
    p = pages.withColumn("text", T.strip("text")).where("text <> ''")
    before = Window.partitionBy("source_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(limit) - F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    return (
        p.withColumn("room", room)
        .where("room > 0")
        .withColumn("text", F.expr("substring(text, 1, cast(room as int))"))
        .groupBy("source_id")
        .agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("t"))
        .select("source_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))
    )


def _spans(text: str, limit: int) -> list[str]:
    """Cut at the last blank line, else line end, else blank within the limit, else at the limit."""
    if len(text) <= limit:
        return [text]
    out = []
    while len(text) > limit:
        cut = next((i for i in (text.rfind(sep, 0, limit) for sep in ("\n\n", "\n", " ")) if i > 0), limit)
        out.append(text[:cut].strip())
        text = text[cut:].strip()
    return [*out, text] if text else out


def split_spans(sources: DataFrame, id_col: str = "source_id", text_col: str = "text", limit: int = P.SPAN_CHARS) -> DataFrame:
    """(id, pos, span): spans of at most ``limit`` characters; a null text has none.

    A cut at place 0 would never end, so it is taken at the limit instead. Texts are taken
    one by one and spans leave in small batches, so a worker holds few of either as objects.
    """
    kind = dict(sources.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, places, spans, held = [], [], [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if text is not None:
                    cut = _spans(text, limit)
                    rows += [i] * len(cut)
                    places += range(len(cut))
                    spans += cut
                    held += len(text)
                if rows and (held >= SPAN_BATCH or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(places, pa.int32()), pa.array(spans, pa.string())], names=[id_col, "pos", "span"])
                    rows, places, spans, held = [], [], [], 0

    ship(sources.sparkSession)
    return sources.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, pos int, span string")


def clean_refinement(response: Column) -> Column:
    """A model's refined text: non-blank trimmed lines, without leading lines that talk about the text."""
    out = F.array_join(F.filter(F.transform(F.split(response, "\n"), lambda s: T.strip(s)), lambda s: s != ""), "\n")
    for marker in P.META_LINES:
        rest = F.when(out.contains("\n"), T.strip(F.regexp_replace(out, r"^[^\n]*\n", ""))).otherwise("")
        out = F.when(F.startswith(F.lower(out), F.lit(marker)), rest).otherwise(out)
    return out


def looks_truncated(span: Column, response: Column) -> Column:
    """A long span whose answer does not end a sentence should be asked again."""
    lines = F.filter(F.transform(F.split(response, "\n"), lambda s: T.strip(s)), lambda s: s != "")
    last = F.get(lines, F.size(lines) - 1)
    return (F.length(span) > 200) & F.coalesce(~last.rlike(r"[.?!\"]$"), F.lit(False))


def needs_refinement(source_type: Column) -> Column:
    return source_type.isin(P.REFINED_TYPES)


def adapter_of(source_type: Column, ref: Column) -> Column:
    """pdf or text by source type, then by extension; null for a file that neither reads (quarantine it)."""
    ext = F.lower(F.regexp_extract(ref, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when((source_type == "pdf_text") | (ext == "pdf"), "pdf")
        .when(source_type.isin("user_text", "paper_abstract", "api_text") | ext.isin("txt", "md", "text"), "text")
    )


def slice_sources(
    sources: DataFrame, id_col: str = "source_id", text_col: str = "text", per_block: int = P.SENTENCES_PER_BLOCK, tokens: int = P.TOKENS_PER_BLOCK
) -> DataFrame:
    """(source_id, block_order, block_text) of every source; blank sources have none."""
    return sources.select(F.col(id_col).alias("source_id"), F.posexplode(T.blocks(F.col(text_col), per_block, tokens)).alias("block_order", "block_text"))


def pending_sources(sources: DataFrame) -> DataFrame:
    """Unprocessed sources of each job in order of arrival, numbered from 1."""
    order = Window.partitionBy("job_id").orderBy("source_id")
    return sources.where(~F.col("processed")).withColumn("turn", F.row_number().over(order))


def input_status(sources: DataFrame) -> DataFrame:
    """Sources of each job: total, processed, pending."""
    return sources.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("processed")).alias("processed"), F.count_if(~F.col("processed")).alias("pending")
    )


def extraction_summary(blocks: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: blocks processed, triples made, blocks that gave none."""
    per = triples.groupBy("block_id").agg(F.count("*").alias("n"))
    return blocks.join(per, "block_id", "left").agg(
        F.count("*").alias("blocks_processed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("triples_created"),
        F.count_if(F.col("n").isNull()).alias("failures"),
    )


def pipeline_metrics(sources: DataFrame, blocks: DataFrame, triples: DataFrame) -> DataFrame:
    """Per job: sources, abstracts, pdfs, blocks, triples and triples a block."""
    s = sources.groupBy("job_id").agg(
        F.count("*").alias("sources"),
        F.count_if(F.col("source_type") == "paper_abstract").alias("abstracts"),
        F.count_if(F.col("source_type") == "pdf_text").alias("pdfs"),
    )
    owner = sources.select("source_id", "job_id")
    b = blocks.join(owner, "source_id").groupBy("job_id").agg(F.count("*").alias("blocks"))
    t = triples.select(F.col("ingestion_source_id").alias("source_id")).join(owner, "source_id").groupBy("job_id").agg(F.count("*").alias("triples"))
    out = s.join(b, "job_id", "left").join(t, "job_id", "left").fillna(0, ["blocks", "triples"])
    # Rounded as binary numbers are: 2.385, which lies just below, gives 2.38.
    ratio = F.when(F.col("blocks") > 0, F.round(F.col("triples") / F.col("blocks") * 100) / 100).otherwise(0.0)
    return out.withColumn("triples_per_block", ratio)
