"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line ends, and a paragraph further before about every
``PIECE_WORDS``-th word, picked by its own content, so an edit changes only pieces near
it: what is digested are paragraphs or runs of a few words of one. Each piece's digest
is added to three cells of a small table (count, sum of digests, sum of check hashes,
all 64 bits); the table is the fingerprint. Two tables subtract, stored ones too
(``parse``, ``subtract``, ``peel``); peeling the difference recovers the digests that
differ. Where peeling stalls, both texts are sketched again in a table four times as
large, until it succeeds. Many pairs are peeled at once, with arrays over all their cells.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from .codepoints import LETTER, NUMBER, chunks, class_table, mix64, runs, span_hashes

#: Cells of each of the three subtables of a fingerprint, and the factor of each retry.
BASE, GROW = 4, 4
#: A piece ends before one word in about so many.
PIECE_WORDS = 4


def pieces(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the pieces of each row, and where each row's begin.

    A repeated piece counts its repetitions into the digest, so rows are sets.
    """
    n = len(off) - 1
    if not len(cp):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    kind = class_table()[cp]
    start, stop = runs((kind == LETTER) | (kind == NUMBER), off)
    mark = np.zeros(len(cp) + 1, bool)
    if len(start):
        sign = mix64(cp[start].astype(np.uint64) * np.uint64(65599) + cp[stop - 1] * np.uint64(257) + (stop - start).astype(np.uint64))
        mark[start] = sign % np.uint64(PIECE_WORDS) == 0
    mark[1:] |= cp == 10
    mark[off] = True
    cut = np.flatnonzero(mark)
    begin, end = cut[:-1], cut[1:]
    at = np.searchsorted(begin, off)
    digest = span_hashes(cp, begin, end)
    row = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((digest, row))
    sorted_digest, sorted_row = digest[order], row[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (sorted_digest[1:] != sorted_digest[:-1]) | (sorted_row[1:] != sorted_row[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    nth = (np.arange(len(order)) - first).astype(np.uint64)
    return mix64(sorted_digest + nth * np.uint64(0xA24BAED4963EE407)), at


def _check(key: np.ndarray) -> np.ndarray:
    return mix64(key ^ np.uint64(0x5851F42D4C957F2D))


def _cells(key: np.ndarray, base: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The three cells of each key: one in each subtable of ``side`` cells from ``base``."""
    h = [mix64(key + np.uint64(j * 0x632BE59BD9B4E019 % (1 << 64))) for j in (1, 2, 3)]
    s = side.astype(np.uint64)
    return np.concatenate([base + j * side + (h[j] % s).astype(np.int64) for j in range(3)])


def sketch(key: np.ndarray, sign: np.ndarray, base: np.ndarray, side: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
    """Signed counts, digest sums and check sums (modulo 2^64) of a run of tables."""
    cell = _cells(key, base, side)
    w = sign.astype(np.uint64)  # -1 wraps, as the sums do
    count = np.bincount(cell, weights=np.tile(sign, 3), minlength=total).astype(np.int64)
    keys, checks = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    np.add.at(keys, cell, np.tile(key * w, 3))
    np.add.at(checks, cell, np.tile(_check(key) * w, 3))
    return count, keys, checks


def peel(count: np.ndarray, keys: np.ndarray, checks: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peel tables laid one after another, table i of 3 * side[i] cells.

    Returns (table, digest, sign) of what was recovered and whether each table emptied.
    """
    start = np.concatenate(([0], np.cumsum(3 * side)))
    table_of = np.repeat(np.arange(len(side)), 3 * side)
    found_t, found_k, found_s = [], [], []
    look = np.arange(len(count))
    left = int(np.abs(count).sum()) + len(count)
    while len(look) and left > 0:
        one = look[np.abs(count[look]) == 1]
        w = count[one].astype(np.uint64)
        key = keys[one] * w
        pure = _check(key) == checks[one] * w
        one, key, sign = one[pure], key[pure], count[one[pure]]
        if not len(one):
            break
        table = table_of[one]
        _, pick = np.unique(key ^ (table.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
        key, sign, table = key[pick], sign[pick], table[pick]
        found_t.append(table), found_k.append(key), found_s.append(sign)
        cell = _cells(key, start[table], side[table])
        w = np.tile(sign.astype(np.uint64), 3)
        np.subtract.at(count, cell, np.tile(sign, 3))
        np.subtract.at(keys, cell, np.tile(key, 3) * w)
        np.subtract.at(checks, cell, np.tile(_check(key), 3) * w)
        look = np.unique(cell)
        left -= len(key)
    bad = (count != 0) | (keys != 0) | (checks != 0)
    empty = np.bincount(table_of[bad], minlength=len(side)) == 0

    def joined(parts: list, kind) -> np.ndarray:
        return np.concatenate(parts) if parts else np.empty(0, kind)

    return joined(found_t, np.int64), joined(found_k, np.uint64), joined(found_s, np.int64), empty


class Sketches:
    """The pieces of many rows, and differences between pairs of rows."""

    def __init__(self, cp: np.ndarray, off: np.ndarray):
        self.key, self.at = pieces(cp, off)
        self.size = np.diff(self.at)
        n = len(self.size)
        row = np.repeat(np.arange(n), self.size)
        side = np.full(len(row), BASE)
        self.base = sketch(self.key, np.ones(len(row), np.int64), row * 3 * BASE, side, n * 3 * BASE)

    def text(self, row: int) -> str:
        """The fingerprint of a row: number of pieces and the base table, base64."""
        a, b = row * 3 * BASE, (row + 1) * 3 * BASE
        parts = (self.base[0][a:b].astype("<i8"), self.base[1][a:b].astype("<u8"), self.base[2][a:b].astype("<u8"))
        return base64.b64encode(np.int64(self.size[row]).astype("<i8").tobytes() + b"".join(p.tobytes() for p in parts)).decode()

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of the given rows one after another, and the place in rows of each."""
        size = self.size[rows]
        pair = np.repeat(np.arange(len(rows)), size)
        first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(rows) else np.empty(0, np.int64)
        return self.key[np.arange(size.sum()) - first[pair] + self.at[rows][pair]], pair


def parse(fingerprint: str) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of pieces, table) of a stored fingerprint: counts, digest sums and check sums of its cells."""
    raw = base64.b64decode(fingerprint)
    cells = 3 * BASE
    if len(raw) != 8 * (1 + 3 * cells):
        raise ValueError(f"a fingerprint has {8 * (1 + 3 * cells)} bytes, not {len(raw)}")
    words = np.frombuffer(raw, "<u8")
    counts = words[1 : 1 + cells].astype(np.int64)
    return int(words[0]), (counts, words[1 + cells : 1 + 2 * cells].astype(np.uint64), words[1 + 2 * cells :].astype(np.uint64))


def subtract(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The table of what a holds and b lacks (counts above 0), and the other way round (below 0)."""
    return tuple(x - y for x, y in zip(a, b, strict=True))


def stored_difference(a: str, b: str) -> tuple[set[int], set[int]] | None:
    """(removed, added) digests between the texts of two stored fingerprints; None if they differ too much to peel."""
    _, keys, signs, empty = peel(*subtract(parse(a)[1], parse(b)[1]), np.array([BASE]))
    if not empty[0]:
        return None
    return set(keys[signs > 0].tolist()), set(keys[signs < 0].tolist())


def difference(a: Sketches, rows_a: np.ndarray, b: Sketches, rows_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of all pieces in which the pairs of rows differ."""
    out = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))]
    todo = np.arange(len(rows_a))
    side = BASE
    while len(todo):
        sides = np.full(len(todo), side)
        if side == BASE:
            cells_a = (rows_a[todo][:, None] * 3 * BASE + np.arange(3 * BASE)).ravel()
            cells_b = (rows_b[todo][:, None] * 3 * BASE + np.arange(3 * BASE)).ravel()
            tables = [x[cells_a] - y[cells_b] for x, y in zip(a.base, b.base, strict=True)]
        else:
            key_a, pair_a = a.gather(rows_a[todo])
            key_b, pair_b = b.gather(rows_b[todo])
            key, pair = np.concatenate((key_a, key_b)), np.concatenate((pair_a, pair_b))
            sign = np.concatenate((np.ones(len(key_a), np.int64), -np.ones(len(key_b), np.int64)))
            tables = list(sketch(key, sign, pair * 3 * side, np.full(len(key), side), len(todo) * 3 * side))
        table, key, sign, done = peel(*tables, sides)
        ok = done[table]
        out.append((todo[table[ok]], key[ok], sign[ok]))
        todo = todo[~done]
        side *= GROW
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def likeness(a: Sketches, rows_a: np.ndarray, b: Sketches, rows_b: np.ndarray) -> np.ndarray:
    """Shared over all distinct pieces of each pair, from what peeling recovered (1 for two empty texts)."""
    pair, _, _ = difference(a, rows_a, b, rows_b)
    apart = np.bincount(pair, minlength=len(rows_a)).astype(float)
    total = (a.size[rows_a] + b.size[rows_b]).astype(float)
    return np.where(total > 0, (total - apart) / np.maximum(total + apart, 1), 1.0)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return cp, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Append the fingerprint of each whole text (null: empty). Narrow; equal texts have equal fingerprints."""
    ship(df.sparkSession)
    df = df.drop(out_col)
    names = df.columns
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(names.index(text_col))):
                s = Sketches(c.cp, c.off)
                part = batch.slice(c.start, c.stop - c.start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([s.text(i) for i in range(c.stop - c.start)], pa.string())], names=[*names, out_col]
                )

    return df.mapInArrow(run, f"{fields}, `{out_col}` string")


def _bucket(bounds: list[int], key):
    """How many of the sorted bounds are at most key, in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*map(F.lit, bounds[step - 1 :: step]))
    fine = F.array(*map(F.lit, bounds))
    block = F.size(F.filter(coarse, lambda x: x <= key)) * step
    return block + F.size(F.filter(F.slice(fine, block + 1, step), lambda x: x <= key))


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and both likenesses.

    The edited text replaces a document's last quarter (rounded down) by as many first
    code points of the next document by id; after the last comes the first. Null text
    is empty. Rows that share an id follow each other by a hash of their text; null ids
    come first. A lone document follows itself. An empty table gives no rows. Other
    columns are not read.

    Documents are dealt into id ranges, each closed by a copy of the next range's first
    row, so the one shuffle of the texts is enough and tasks stream their sorted rows.
    An id (or null) that fills several ranges is dealt over them by the hash of the
    text; rows that repeat an id and a text whole stream through one task.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*(F.lit(i / n) for i in range(1, n)))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    bounds = sorted(docs.agg(F.percentile_approx("key", shares, 20 * n)).first()[0] or []) if n > 1 else []
    bucket = _bucket(bounds, F.col("key"))
    # A key that is the bound of c ranges has these c for its own rows, in order of the hash.
    heavy = {k: c for k, c in Counter(bounds).items() if c > 1}
    if heavy:
        times = F.element_at(F.create_map(*(F.lit(x) for pair in heavy.items() for x in pair)), F.col("key"))
        part = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * times)
        bucket = bucket - F.coalesce(times - 1 - F.least(part, times - 1), F.lit(0)).cast("int")
    placed = docs.withColumn("bucket", bucket)
    first = placed.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("head"))
    heads = sorted((r["bucket"], r["head"]["key"], r["head"]["tie"]) for r in first.collect())
    before = {h[0]: heads[i - 1][0] for i, h in enumerate(heads)}
    moved = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("bucket")) if heads else F.lit(0)
    is_head = F.col("key").isin([k for _, k, _ in heads]) & F.col("tie").isin([t for _, _, t in heads]) if heads else F.lit(False)
    ends = (
        placed.where(is_head)
        .groupBy("bucket")
        .agg(F.min(F.struct("key", "tie", "text")).alias("head"))
        .select(moved.alias("bucket"), F.lit(1).alias("end"), F.lit(None).cast("long").alias("doc_id"), "head.key", "head.tie", "head.text")
    )
    rows = placed.select("bucket", F.lit(0).alias("end"), F.col("doc_id").cast("long"), "key", "tie", "text").union(ends)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "end", "key", "tie")
    out = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_pieces long"
    )
    return dealt.select("end", "doc_id", "text").mapInArrow(_compare_stream, out).withColumnRenamed("doc_id", id_col)


def _compare_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each followed by its next one; rows marked end only serve as next ones."""
    held: list[tuple[int, int | None, str]] = []

    def flush() -> pa.RecordBatch:
        texts = [x[2] for x in held]
        own = Sketches(*_flat(texts))
        at = np.array([i for i in range(len(held) - 1) if not held[i][0]], np.int64)
        edited = []
        for i in at.tolist():
            cut = len(texts[i]) // 4
            edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
        other = Sketches(*_flat(edited))
        every = np.arange(len(at))
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([held[i][1] for i in at.tolist()], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in at.tolist()], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array([own.text(i) for i in at.tolist()], pa.string()),
                "edited_fingerprint": pa.array([other.text(i) for i in every.tolist()], pa.string()),
                "near_edited": likeness(own, at, other, every),
                "near_next": likeness(own, at, own, at + 1),
                "n_pieces": pa.array(own.size[at], pa.int64()),
            }
        )

    size = 0
    for batch in batches:
        for row in itertools.zip_longest(*(batch.column(k).to_pylist() for k in range(3))):
            held.append(row)
            size += len(row[2])
            if size > 1 << 18 and len(held) > 1:
                yield flush()
                held, size = held[-1:], len(held[-1][2])
    if len(held) > 1:
        yield flush()


def version_difference(df: DataFrame, old_col: str, new_col: str) -> DataFrame:
    """Append removed and added: digests of the pieces in which two versions of a text differ.

    Recovered by peeling the subtracted sketches, larger ones where that stalls. Null
    versions are empty; equal versions differ in nothing. Columns named removed or
    added are replaced. Narrow: no shuffle.
    """
    ship(df.sparkSession)
    df = df.drop("removed", "added")
    names = df.columns
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)

    def lists(pair: np.ndarray, key: np.ndarray, n: int) -> pa.Array:
        order = np.lexsort((key, pair))
        ends = np.concatenate(([0], np.cumsum(np.bincount(pair, minlength=n)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order].view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(names.index(old_col))):
                n = c.stop - c.start
                newer = [t or "" for t in batch.column(names.index(new_col)).slice(c.start, n).to_pylist()]
                every = np.arange(n)
                pair, key, sign = difference(Sketches(c.cp, c.off), every, Sketches(*_flat(newer)), every)
                part = batch.slice(c.start, n)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(lists(pair[sign == s], key[sign == s], n) for s in (1, -1))], names=[*names, "removed", "added"]
                )

    return df.mapInArrow(run, f"{fields}, removed array<long>, added array<long>")
