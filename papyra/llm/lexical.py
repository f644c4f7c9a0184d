"""Ranked lexical search: document-at-a-time over compressed postings, shard by shard.

A shard is a bounded run of documents, numbered in the order of their ids. Its postings
are, a term, the gaps between document numbers and the term frequencies as
variable-length bytes. A query keeps a cursor on each of its terms in a heap keyed by
the cursor's next document; the cursors that stand lowest are merged a short window of
documents at a time, so every document's score is whole before a later one is looked at.
A bounded heap keyed by score, then document, keeps the best of a shard, and the shards'
best are merged by a ranking over all.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..cluster import ship
from ..functions import varint
from ..operators.scratch import Scratch

#: Documents of a shard and their terms (with repeats) at most, but for a single long document.
SHARD_DOCS, SHARD_TERMS = 16384, 1 << 24
#: Documents of a merge step; terms of the queries that go along with the tasks at a time.
WINDOW, BLOCK_TERMS = 4096, 200_000
#: Constants of the weight and the length norm (fixed by the contract).
BASE, SLOPE = 100, 50

_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)
_UPPER, _BREAK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """Terms of a text: only A-Z lower-cased; runs of digits, letters a-z and code points above 127."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _BREAK), lambda w: w != "")


def pack_postings(docs: np.ndarray, tf: np.ndarray) -> bytes:
    """Ascending document numbers as gaps, each followed by its term frequency."""
    pairs = np.empty(2 * len(docs), np.int64)
    pairs[0::2] = np.diff(docs, prepend=0)
    pairs[1::2] = tf
    return varint.pack(pairs)[0].tobytes()


def unpack_postings(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = varint.unpack(raw)
    return np.cumsum(pairs[0::2]), pairs[1::2]


INDEX = "shard long, term string, df long, terms long, postings binary, ids array<long>, lengths array<int>"
_ARROW = pa.schema(
    [("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("terms", pa.int64()), ("postings", pa.binary()),
     ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]
)


class _Shard:
    def __init__(self):
        self.ids, self.lengths, self.terms = [], [], 0
        self.found = defaultdict(lambda: ([], []))

    def add(self, doc_id: int | None, words: list[bytes], counts: dict[bytes, int]) -> None:
        row = len(self.ids)
        self.ids.append(doc_id), self.lengths.append(len(words))
        self.terms += len(words)
        for w, n in counts.items():
            rows, tf = self.found[w]
            rows.append(row), tf.append(n)

    def table(self, shard: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0, i))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        head = {"shard": shard, "term": None, "df": len(order), "terms": self.terms, "postings": None}
        yield pa.RecordBatch.from_pylist([head | {"ids": [self.ids[i] for i in order], "lengths": [self.lengths[i] for i in order]}], _ARROW)
        out = []
        for w, (rows, tf) in self.found.items():
            docs = number[rows]
            by = np.argsort(docs)
            out.append({"shard": shard, "term": w.decode(), "df": len(rows), "postings": pack_postings(docs[by], np.array(tf)[by])})
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
                out = []
        yield pa.RecordBatch.from_pylist(out, _ARROW)


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: set[str] | None = None) -> DataFrame:
    """The postings of all rows, of all terms or of the given ones: a row a shard and term, and a row a shard.

    Whole texts. A shard's own row (term null) has the ids of its documents in order and
    their numbers of terms; texts without a term (null ones too) have no entry. Repeated
    rows and null ids are documents of their own. A narrow map without a shuffle; write
    the result to keep it. Shards are numbered by task, so they are the same if a task is
    run again.
    """
    ship(df.sparkSession)
    wanted = None if terms is None else {t.encode() for t in terms}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_binary())
            for doc_id, text in zip(ids, texts, strict=True):
                words = text.as_py().translate(_LOWER).split() if text.is_valid else []
                if not words:
                    continue
                counts = Counter(words)
                if wanted is not None:
                    counts = {w: counts[w] for w in counts.keys() & wanted}
                if shard.ids and (len(shard.ids) >= SHARD_DOCS or shard.terms + len(words) > SHARD_TERMS):
                    yield from shard.table(number)
                    number, shard = number + 1, _Shard()
                shard.add(doc_id, words, counts)
        if shard.ids:
            yield from shard.table(number)

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, INDEX)


def best_documents(cursors: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int) -> list[tuple[int, int]]:
    """Up to k pairs (score, document number) above 0, best first, equal scores by the lower number.

    cursors: ascending document numbers and what each adds, a term.
    """
    at = [0] * len(cursors)
    heap = [(int(c[0][0]), i) for i, c in enumerate(cursors) if len(c[0])]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []
    score = np.zeros(min(WINDOW, docs), np.int64)
    while heap:
        begin = heap[0][0]
        end = begin + len(score)
        score[:] = 0
        while heap and heap[0][0] < end:
            i = heapq.heappop(heap)[1]
            numbers, gains = cursors[i]
            stop = int(np.searchsorted(numbers, end))
            score[numbers[at[i] : stop] - begin] += gains[at[i] : stop]
            at[i] = stop
            if stop < len(numbers):
                heapq.heappush(heap, (int(numbers[stop]), i))
        # A later document of an equal score is behind those kept.
        least = best[0][0] if len(best) == k else 0
        ahead = np.flatnonzero(score > least)
        if len(ahead) > k:
            ahead = ahead[np.lexsort((ahead, -score[ahead]))[:k]]
        for d in ahead.tolist():
            entry = (int(score[d]), -(begin + d))
            if len(best) < k:
                heapq.heappush(best, entry)
            else:
                heapq.heappushpop(best, entry)
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _blocks(asked: DataFrame) -> Iterator[list]:
    """Items and their terms, about ``BLOCK_TERMS`` of them at a time."""
    block, held = [], 0
    for r in asked.toLocalIterator():
        if block and held + len(r["terms"]) > BLOCK_TERMS:
            yield block
            block, held = [], 0
        block.append((r["item"], r["terms"]))
        held += len(r["terms"])
    if block:
        yield block


def search(df: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_col, rank (from 1), id_col and score of each item's k best documents of score above 0.

    Terms of an item count once each; rows of one item id are one item (null too). Equal
    scores rank by id, null ids first, so ranks are unique. Repeated rows of the documents
    rank each. Empty tables, and items without a term that any document holds, give no
    rows; other columns are not read. The postings of the items' terms are written first;
    items go along with the tasks in blocks of bounded size, every block against all shards.
    """
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession, "lexical")
    asked = queries.select(F.col(item_col).alias("item"), F.explode(terms_of(F.col(query_col))).alias("t")).groupBy("item").agg(F.array_sort(F.collect_set("t")).alias("terms"))
    kind = queries.schema[item_col].dataType
    found = [_search_block(df, block, kind, k, id_col, text_col, scratch) for block in _blocks(asked)]
    if not found:
        found = [df.sparkSession.createDataFrame([], f"item {kind.simpleString()}, doc_id long, score long")]
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "_row")
    ranked = reduce(DataFrame.union, found).withColumn("_row", F.monotonically_increasing_id()).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")


def _search_block(df: DataFrame, block: list, kind, k: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    wanted = {t for _, terms in block for t in terms}
    stored = scratch.write(index(df, id_col, text_col, wanted))
    held = stored.where("term is null").agg(F.count("*").alias("shards"), F.sum("df").alias("n"), F.sum("terms").alias("l")).first()
    # At most a row a term of the block.
    weights = {r["term"]: weight(held["n"], r["df"]) for r in stored.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    return search_index(stored, block, weights, held["n"] or 0, held["l"] or 1, kind, k, max(1, held["shards"]))


def search_index(stored: DataFrame, items: list, weights: dict[str, int], n: int, total: int, kind, k: int, shards: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each shard for each item.

    items: (item, terms) pairs; weights: of the terms; n and total: documents with a term and all their terms.
    """
    spark = stored.sparkSession
    item_type = to_arrow_type(kind)
    # The best of a term that all shards lack is nothing, so it needs no cursor.
    plans = [(i, [t for t in terms if weights.get(t, 0) > 0]) for i, (_, terms) in enumerate(items)]
    names = [i for i, _ in items]
    sent = spark.sparkContext.broadcast((plans, names, weights))

    def run(t: pa.Table) -> pa.Table:
        plans, names, weights = sent.value
        own = t.filter(pc.is_null(t.column("term")))
        ids = own.column("ids")[0].values
        length = own.column("lengths")[0].values.to_numpy().astype(np.int64)
        m = 20 * (BASE - SLOPE + (SLOPE * length * n) // total)
        cursors = {}
        for term, raw in zip(t.column("term").to_pylist(), t.column("postings").to_pylist(), strict=True):
            if term is not None and weights.get(term, 0) > 0:
                docs, tf = unpack_postings(raw)
                cursors[term] = (docs, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + m[docs])))
        item, doc, score = [], [], []
        for i, terms in plans:
            for s, d in best_documents([cursors[x] for x in terms if x in cursors], len(ids), k):
                item.append(i), doc.append(d), score.append(s)
        return pa.table(
            {"item": pa.array(names, item_type).take(pa.array(item, pa.int64())), "doc_id": ids.take(pa.array(doc, pa.int64())), "score": pa.array(score, pa.int64())}
        )

    rows = stored.repartition(shards, "shard").groupBy("shard")
    return rows.applyInArrow(run, f"item {kind.simpleString()}, doc_id long, score long")
