"""Evidence of edges, kept apart from them.

An edge row has its key and counts and stays as wide as it is, however often it was
seen. The triples, blocks and sources behind it lie in a table of postings: blocks of at
most ``BLOCK`` of them, coded as differences. A frequent edge has many blocks, which
range over many partitions, so no task and no row grows with it. Merges and rewrites of
edges move blocks as they are, and ids are looked up only for rows that are shown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import varint
from .scratch import Scratch

#: Postings of a block at most.
BLOCK = 1024
KEY = ("subject", "predicate", "object")
IDS = ("triple_ids", "block_ids", "source_ids")
_NULL = np.iinfo(np.int64).min


def edge_id(subject: str | Column = "subject", predicate: str | Column = "predicate", object: str | Column = "object") -> Column:
    """Sixteen bytes that name an edge: a digest of its three texts with their lengths (null: its own)."""
    parts = []
    for c in (subject, predicate, object):
        c = F.col(c) if isinstance(c, str) else c
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.unhex(F.md5(F.concat(*parts)))


def edges(triples: DataFrame) -> DataFrame:
    """edge_id, subject, predicate, object, support (distinct sources): one row an edge.

    Sources are made distinct before they are counted, so a frequent edge combines in all
    tasks first. A posting without a source counts for none.
    """
    seen = triples.groupBy(*KEY, F.col("ingestion_source_id").alias("s")).agg(F.lit(1).alias("one"))
    counted = seen.groupBy(*KEY).agg(F.count("s").cast("int").alias("support"))
    return counted.select(edge_id().alias("edge_id"), *KEY, "support")


def postings(triples: DataFrame, block: int = BLOCK) -> DataFrame:
    """edge_id, first (the least triple id), n and data: blocks of the triples of every edge, in order of triple ids.

    triples: triple_id, block_id, ingestion_source_id and the edge's texts. Repeated
    triples stay; null ids stay null. One range shuffle; a task holds one batch.
    """
    ship(triples.sparkSession)
    key = ["edge_id", "t", "b", "s"]
    rows = triples.select(
        edge_id().alias("edge_id"), F.col("triple_id").cast("long").alias("t"), F.col("block_id").cast("long").alias("b"), F.col("ingestion_source_id").cast("long").alias("s")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).fill_null(_NULL).to_numpy(zero_copy_only=False) for c in ("t", "b", "s")], axis=1)
            edge = batch.column("edge_id").cast(pa.binary(16))
            names = np.frombuffer(edge.buffers()[1], "V16", len(edge), edge.offset * 16)
            new = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            at = np.arange(len(edge)) - np.repeat(new, np.diff(np.append(new, len(edge))))
            start = np.flatnonzero(at % block == 0)
            step = np.diff(ids, axis=0, prepend=np.zeros((1, 3), np.int64))
            step[start] = ids[start]
            raw, ends = varint.pack(varint.zigzag(step.reshape(-1)))
            stop = np.append(start[1:], len(edge))
            offsets = np.append(0, ends[3 * stop - 1]).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
            first = batch.column("t").take(pa.array(start))
            yield pa.RecordBatch.from_arrays([batch.column("edge_id").take(pa.array(start)), first, pa.array((stop - start).astype(np.int32)), data], names=["edge_id", "first", "n", "data"])

    return rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(run, "edge_id binary, first long, n int, data binary")


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(postings of each block, their triple, block and source ids in three columns)."""
    count = batch.column("n").to_numpy().astype(np.int64)
    raw = b"".join(batch.column("data").to_pylist())
    step = varint.unzigzag(varint.unpack(raw)).reshape(-1, 3)
    start = np.cumsum(count) - count
    total = np.cumsum(step, axis=0)
    # Sums run on over all blocks, so what was summed before a block is taken off.
    return count, total - np.repeat(total[start] - step[start], count, axis=0)


def _kept(blocks: DataFrame) -> list[str]:
    return [c for c in blocks.columns if c not in ("first", "n", "data")]


def _fields(blocks: DataFrame) -> str:
    kinds = dict(blocks.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in _kept(blocks))


def decoded(blocks: DataFrame) -> DataFrame:
    """edge_id, triple_id, block_id, source_id and the other columns: a row a posting."""
    ship(blocks.sparkSession)
    kept = _kept(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            count, ids = _ids_of(batch)
            row = pa.array(np.repeat(np.arange(len(count)), count))
            for a in range(0, len(ids), 1 << 16):
                part = ids[a : a + (1 << 16)]
                columns = [pa.array(part[:, k].copy(), mask=part[:, k] == _NULL) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(row.slice(a, len(part))) for c in kept), *columns], names=[*kept, "triple_id", "block_id", "source_id"]
                )

    return blocks.select(*kept, "n", "data").mapInArrow(run, f"{_fields(blocks)}, triple_id long, block_id long, source_id long")


def listed(blocks: DataFrame) -> DataFrame:
    """A row a block: its other columns and its triple_ids, block_ids and source_ids as they stand, null ids left out."""
    ship(blocks.sparkSession)
    kept = _kept(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            count, ids = _ids_of(batch)
            ends = np.append(0, np.cumsum(count))
            lists = []
            for k in range(3):
                there = ids[:, k] != _NULL
                lists.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(there))[ends].astype(np.int32), pa.array(ids[there, k])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *lists], names=[*kept, *IDS])

    return blocks.select(*kept, "n", "data").mapInArrow(run, f"{_fields(blocks)}, " + ", ".join(f"{c} array<long>" for c in IDS))


def _arrays(blocks: DataFrame, *key: str) -> DataFrame:
    """Sorted distinct ids of each key's blocks; rows that meet are blocks, not postings."""
    return listed(blocks).groupBy(*key).agg(*(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in IDS))


def with_ids(shown: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges (with edge_id) and the sorted ids of their triples, blocks and sources; for rows that are shown."""
    own = blocks.join(shown.select("edge_id").distinct(), "edge_id", "left_semi").select("edge_id", "n", "data")
    return shown.join(_arrays(own, "edge_id"), "edge_id")


def _blocks_of_pairs(pairs: DataFrame, all_edges: DataFrame, blocks: DataFrame) -> DataFrame:
    wanted = all_edges.join(pairs.select("subject", "object").distinct(), ["subject", "object"]).select("subject", "object", "edge_id")
    return blocks.join(wanted, "edge_id").select("subject", "object", "n", "data")


def of_pairs(pairs: DataFrame, all_edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """subject, object, triple_id, block_id, source_id: a row a posting of any edge between the given pairs' ends."""
    return decoded(_blocks_of_pairs(pairs, all_edges, blocks))


def pairs_with_ids(shown: DataFrame, all_edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs and the sorted ids of the evidence of all edges between their ends."""
    return shown.join(_arrays(_blocks_of_pairs(shown, all_edges, blocks), "subject", "object"), ["subject", "object"])


def hops_of(hypotheses: DataFrame, *more: str) -> DataFrame:
    """subject, object and hop (from 1) of every step of every path, with the given columns."""
    steps = hypotheses.select(*more, "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("hop"))
    return steps.select(*more, "hop", F.get("path", F.col("hop") - 1).alias("subject"), F.get("path", F.col("hop")).alias("object"))


def hypotheses_with_ids(shown: DataFrame, all_edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hypotheses of two hops and the sorted ids of the evidence along their paths; for rows that are shown."""
    ids = pairs_with_ids(hops_of(shown).select("subject", "object").distinct(), all_edges, blocks)
    out = shown.withColumns({"_s": F.get("path", 0), "_m": F.get("path", 1), "_t": F.get("path", 2)})
    for k, (a, b) in enumerate((("_s", "_m"), ("_m", "_t"))):
        out = out.join(ids.select(F.col("subject").alias(a), F.col("object").alias(b), *(F.col(c).alias(f"{c}{k}") for c in IDS)), [a, b])
    united = {c: F.sort_array(F.array_union(f"{c}0", f"{c}1")) for c in IDS}
    return out.select(*shown.columns, *(x.alias(c) for c, x in united.items()))


def sources_of_pairs(pairs: DataFrame, all_edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """subject, object, source_id: the distinct sources of the given pairs."""
    return of_pairs(pairs, all_edges, blocks).where("source_id is not null").select("subject", "object", "source_id").distinct()


def renamed(changed: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, postings) under their new keys: changed has edge_id as before and the new texts.

    Blocks go over as they are; those of edges that ``changed`` lacks are left out.
    """
    # Edges and blocks both read it, and what reads edges may do so more than once.
    named = Scratch(changed.sparkSession, "renamed").write(changed.withColumn("_new", edge_id()))
    moved = blocks.join(named.select("edge_id", "_new"), "edge_id").select(F.col("_new").alias("edge_id"), "first", "n", "data")
    return named.drop("edge_id").withColumnRenamed("_new", "edge_id"), moved


def merged(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row an edge of rows that may name it more than once.

    rows: an edge and fresh (whether the row brings news of it). Where several rows meet
    and one is fresh, support is the number of distinct sources, looked up for these
    edges alone; others keep theirs.
    """
    groups = rows.groupBy("edge_id", *KEY).agg(F.count("*").alias("rows"), F.max("support").alias("support"), F.max("fresh").alias("fresh"))
    groups = Scratch(rows.sparkSession, "merged").write(groups)
    meet = groups.where((F.col("rows") > 1) & F.col("fresh")).select("edge_id")
    sources = decoded(blocks.join(meet, "edge_id", "left_semi")).where("source_id is not null").groupBy("edge_id", "source_id").agg(F.lit(1).alias("one"))
    counted = sources.groupBy("edge_id").agg(F.count("*").cast("int").alias("many"))
    out = groups.join(counted, "edge_id", "left")
    return out.select("edge_id", *KEY, F.coalesce("many", "support").alias("support"))
