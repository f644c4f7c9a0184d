"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. One pass over the texts gives each row the digest of its shingle set and its
   band keys. Rows of equal digest become one node that carries its copies' count.
2. Nodes meet on band keys. A bucket links its members to its least member (a star,
   never all pairs); connected components of the stars are the candidate groups.
3. Only nodes of candidate groups get their full shingle sets. A group is dealt into
   sides bounded in nodes and in shingles; inside a side every pair is verified on the
   sets, and each node gets its links and the least node it is linked with, its root.
4. Groups of several sides meet side by side in cells. Each node brings its root, and
   a cell returns links a node and, of the pairs of different roots that it links, only
   a spanning forest, so that edges follow the number of roots, not nodes times sides.
5. Linked roots join up to classes; every row gets its class and number of links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.scratch import Scratch
from .codepoints import LETTER, NUMBER, Chunk, chunks, class_table, lower_table, mix64, runs, span_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.999
MAX_HASHES = 160
#: Nodes of one side of a cell, and the most sides before sides grow.
SIDE, MAX_SIDES, LARGEST_SIDE = 128, 64, 2048
#: Shingles of one side about (8 bytes each); one text of more is a side's share alone.
SIDE_GRAMS = 1 << 20


def choose_bands(similarity: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding that still finds a pair of the given
    similarity with the given probability using at most max_hashes hashes."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        p = similarity**rows
        bands = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def shingle_hashes(c: Chunk, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word n-gram of a chunk, and where each row's begin.

    Words are runs of letters and digits, lower-cased. A text of fewer words than n
    has one shingle of all its words; a text of none has none.
    """
    kind = class_table()[c.cp]
    start, stop = runs((kind == LETTER) | (kind == NUMBER), c.off)
    word = span_hashes(lower_table()[c.cp], start, stop)
    first = np.searchsorted(start, c.off)
    count = np.diff(first)
    grams = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(grams)))
    row = np.repeat(np.arange(len(grams)), grams)
    begin = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    size = np.minimum(words, count[row])
    out = size.astype(np.uint64)
    padded = np.concatenate((word, np.zeros(words, np.uint64)))
    for k in range(words):
        part = padded[begin + k] * np.uint64(2 * k + 3) + np.uint64(k + 1)
        out = np.where(k < size, mix64(out + part), out)
    return out, at


def band_keys(h: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash band keys (rows that have shingles x bands) as int64."""
    full = np.flatnonzero(np.diff(at) > 0)
    rng = np.random.default_rng(20240601)
    mult = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    keys = np.empty((len(full), bands), np.uint64)
    if len(full):
        for j in range(bands):
            key = np.full(len(full), j + 1, np.uint64)
            for k in range(j * rows, (j + 1) * rows):
                key = mix64(key * np.uint64(31) + np.minimum.reduceat(h * mult[k] + add[k], at[full]))
            keys[:, j] = key
    return keys.view(np.int64)


def set_digest(grams: np.ndarray, c: Chunk, row: int) -> bytes:
    """16 bytes that stand for a set of shingles, or for the raw text if it has none."""
    if len(grams):
        return mix64(np.array([grams.sum(dtype=np.uint64), mix64(grams).sum(dtype=np.uint64)])).tobytes()
    raw = c.text[c.off[row] : c.off[row + 1]]
    return hashlib.blake2b(raw.encode(), digest_size=16).digest()


def signatures(df: DataFrame, text_col: str, bands: int, rows: int, words: int = SHINGLE_WORDS) -> DataFrame:
    """Append digest (16 bytes: equal for equal shingle sets), n_grams and band keys.

    Null text counts as empty. Rows without words have null keys and the digest of
    their raw text, so that only equal texts meet.
    """
    names = df.columns
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema if x.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = names.index(text_col)
            others = [k for k in range(len(names)) if k != i]
            for c in chunks(batch.column(i)):
                h, at = shingle_hashes(c, words)
                keys = band_keys(h, at, bands, rows)
                digest, sizes = [], []
                for r in range(len(at) - 1):
                    s = np.unique(h[at[r] : at[r + 1]])
                    digest.append(set_digest(s, c, r))
                    sizes.append(len(s))
                have = np.diff(at) > 0
                ends = np.concatenate(([0], np.cumsum(np.where(have, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()), mask=pa.array(~have))
                part = batch.slice(c.start, c.stop - c.start)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in others), pa.array(digest, pa.binary()), pa.array(sizes, pa.int64()), lists],
                    names=[*(names[k] for k in others), "digest", "n_grams", "keys"],
                )

    return df.mapInArrow(run, f"{fields}, digest binary, n_grams long, keys array<long>")


def gram_sets(df: DataFrame, text_col: str, words: int) -> DataFrame:
    """Replace the text by its sorted distinct shingle hashes (column grams)."""
    names = df.columns
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema if x.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = names.index(text_col)
            others = [k for k in range(len(names)) if k != i]
            for c in chunks(batch.column(i)):
                h, at = shingle_hashes(c, words)
                sets = [np.unique(h[at[r] : at[r + 1]]) for r in range(len(at) - 1)]
                digest = [set_digest(s, c, r) for r, s in enumerate(sets)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
                part = batch.slice(c.start, c.stop - c.start)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in others), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=[*(names[k] for k in others), "own_digest", "grams"],
                )

    return df.mapInArrow(run, f"{fields}, own_digest binary, grams array<long>")


def overlaps(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections of the sets flat[at[i]:at[i+1]], in column blocks."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, col = owner[keep], place[column[keep]]
    out = np.zeros((n, n), np.float32)
    columns = int(shared.sum())
    width = min(max(256, (1 << 22) // max(n, 1)), max(columns, 1))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, columns, width):
        a, b = np.searchsorted(col, (lo, lo + width))
        block = np.zeros((n, width), np.float32)
        block[row[a:b], col[a:b] - lo] = 1
        out += block @ block.T
    return out


def _distinct_nodes(table: pa.Table) -> pa.Table:
    """The first row of each digest: repeated rows bring a node twice."""
    first = {}
    for i, d in enumerate(table.column("digest").to_pylist()):
        first.setdefault(d, i)
    return table.take(list(first.values()))


def _linked(table: pa.Table, similarity: float) -> np.ndarray:
    """Which pairs of a cell's nodes have shingle sets of at least the given Jaccard similarity."""
    lists = table.column("grams").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    common = overlaps(lists.flatten().to_numpy(), at).astype(np.int64)
    # Integers throughout: common / union >= similarity, without a rounded quotient.
    scale = 1_000_000
    link = common * scale >= round(similarity * scale) * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(link, False)
    return link


def verify_side(table: pa.Table, similarity: float) -> pa.Table:
    """One row a node of a side: how many documents it links to there, and the least node it is linked with."""
    table = _distinct_nodes(table)
    node = table.column("digest").to_pylist()
    link = _linked(table, similarity)
    links = link @ table.column("copies").to_numpy().astype(np.int64)
    root = np.full(len(node), -1)
    for seed in sorted(range(len(node)), key=node.__getitem__):
        if root[seed] < 0:
            root[seed] = seed
            front = np.array([seed])
            while len(front):
                front = np.flatnonzero(link[front].any(axis=0) & (root < 0))
                root[front] = seed
    return pa.table({"digest": pa.array(node, pa.binary()), "links": links.astype(np.int64), "own": pa.array([node[r] for r in root], pa.binary())})


def verify_across(table: pa.Table, similarity: float) -> pa.Table:
    """Links between the two sides of a cell: (digest, links) of nodes that have any, and (digest, other) edges.

    Edges are a spanning forest of the roots that the links join, so a cell returns
    fewer edges than it has roots, however many pairs it links.
    """
    table = _distinct_nodes(table)
    node, own = table.column("digest").to_pylist(), table.column("own").to_pylist()
    side = table.column("side").to_numpy()
    link = _linked(table, similarity) & (side[:, None] != side[None, :])
    links = link @ table.column("copies").to_numpy().astype(np.int64)
    top = {r: r for r in own}

    def find(r: bytes) -> bytes:
        while top[r] != r:
            top[r] = top[top[r]]
            r = top[r]
        return r

    digest, count, other = [], [], []
    for i in np.flatnonzero(links):
        digest.append(node[i]), count.append(int(links[i])), other.append(None)
        met = {own[j] for j in np.flatnonzero(link[i])} if side[i] == side.min() else ()
        for r in sorted(met):
            a, b = find(own[i]), find(r)
            if a != b:
                top[max(a, b)] = min(a, b)
                digest.append(a), count.append(0), other.append(b)
    return pa.table({"digest": pa.array(digest, pa.binary()), "links": pa.array(count, pa.int64()), "other": pa.array(other, pa.binary())})


def _with_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """nodes with their shingle sets, made anew from the texts of their keys."""
    sets = gram_sets(docs.select("key", "text").join(nodes, "key").drop("key"), "text", words)
    return sets.where("own_digest = digest").drop("own_digest")


def _classes(
    df: DataFrame, id_col: str, text_col: str, similarity: float, words: int, recall: float, max_hashes: int
) -> tuple[DataFrame, DataFrame, Scratch]:
    """(id, key, digest of every row; digest, class_id, kept_key, n_links of every node).

    key stands for a row's id and text; kept_key is that of the row of least id in the class.
    """
    scratch = Scratch(df.sparkSession, "near")
    bands, rows = choose_bands(similarity, recall, max_hashes)
    docs = df.select(
        F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text")
    )
    seen = scratch.write(signatures(docs, "text", bands, rows, words))

    holder = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    nodes = scratch.write(
        seen.groupBy("digest").agg(
            F.min(holder).alias("holder"), F.count("*").alias("copies"), F.max("n_grams").alias("n_grams"), F.first("keys").alias("keys")
        )
    )
    banded = nodes.where("keys is not null").select("digest", F.explode("keys").alias("band"))
    buckets = scratch.write(
        banded.groupBy("band")
        .agg(F.min("digest").alias("least"), F.count("*").alias("n"))
        .where("n > 1")
        .select("band", "least")
    )
    stars = banded.join(buckets, "band").where("digest <> least").select("digest", "least").distinct()
    groups = connected_components(stars, scratch, "digest", "least")
    dealt = groups.withColumnRenamed("node", "digest").join(nodes.drop("keys"), "digest")
    grouped = scratch.write(dealt.select("digest", "root", "copies", "n_grams", F.col("holder.key").alias("key")))
    members, grams = F.count("*"), F.sum("n_grams")
    sides = F.greatest(F.least(F.ceil(members / SIDE), F.lit(MAX_SIDES)), F.ceil(members / LARGEST_SIDE), F.ceil(grams / SIDE_GRAMS))
    sized = scratch.write(grouped.groupBy("root").agg(sides.cast("int").alias("sides")))
    side = F.pmod(F.xxhash64("digest"), F.col("sides")).cast("int").alias("side")
    picked = scratch.write(grouped.join(sized, "root").select("digest", "copies", "root", "key", "sides", side))
    # Texts and nodes both grow with the input, so both are shuffled at every size; the
    # texts stream past a hash table of the nodes and are not sorted.
    within = scratch.write(
        _with_sets(docs, picked.hint("shuffle_hash"), words)
        .groupBy("root", "side")
        .applyInArrow(lambda t: verify_side(t, similarity), "digest binary, links long, own binary")
    )
    links = within.select("digest", "links")
    top = within.select("digest", "own")
    if picked.agg(F.max("sides")).first()[0] not in (None, 1):
        many = scratch.write(picked.where("sides > 1").join(top, "digest"))
        cells = (
            _with_sets(docs, many, words)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
            .where("side <> other")
            .withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")})
            .drop("sides", "other")
        )
        across = scratch.write(
            cells.groupBy("root", "lo", "hi").applyInArrow(
                lambda t: verify_across(t, similarity), "digest binary, links long, other binary"
            )
        )
        links = links.unionByName(across.where("other is null").select("digest", "links"))
        joined = connected_components(across.where("other is not null").select("digest", "other").distinct(), scratch, "digest", "other")
        joined = joined.select(F.col("node").alias("own"), F.col("root").alias("top"))
        top = top.join(joined, "own", "left").select("digest", F.coalesce("top", "own").alias("own"))
    links = links.groupBy("digest").agg(F.sum("links").alias("links"))
    known = scratch.write(
        nodes.select("digest", "holder", "copies")
        .join(links, "digest", "left")
        .join(top, "digest", "left")
        .select(
            "digest",
            "holder",
            F.coalesce("own", "digest").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    named = scratch.write(known.groupBy("root").agg(F.min("holder").alias("best")))
    labels = scratch.write(
        known.join(named, "root").select(
            "digest", F.col("best.id").alias("class_id"), F.col("best.key").alias("kept_key"), "n_links"
        )
    )
    return seen.select("id", "key", "digest"), labels, scratch


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    words: int = SHINGLE_WORDS,
    recall: float = TARGET_RECALL,
    max_hashes: int = MAX_HASHES,
) -> DataFrame:
    """One row a document: id, class_id (least id of its class) and n_links.

    A link is a pair of rows whose shingle sets have a Jaccard similarity of at least
    ``similarity``; classes are connected components of links; n_links counts the
    other rows linked to a row, copies included. Null text is empty. Texts without
    words link only to equal texts. Repeated rows stay rows and link to each other. A
    null id stays null and names a class only if all ids of the class are null.
    Other columns are not read. An empty table gives no rows. Found links are exact; a
    pair of exactly ``similarity`` becomes a candidate by its own band keys with
    probability ``recall``, a closer one with more; a pair whose rows other rows bring
    into one candidate group is always found.
    """
    seen, labels, _ = _classes(df, id_col, text_col, similarity, words, recall, max_hashes)
    return seen.join(labels, "digest").select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one_of_each(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    words: int = SHINGLE_WORDS,
    recall: float = TARGET_RECALL,
    max_hashes: int = MAX_HASHES,
) -> DataFrame:
    """One document of each class, that of least id, with all its columns.

    Classes are those of near_duplicates. Of rows with that id and the same text, the
    one of least hash over all columns (maps aside) is kept.
    """
    _, labels, scratch = _classes(df, id_col, text_col, similarity, words, recall, max_hashes)
    kept = scratch.write(labels.select(F.col("kept_key").alias("_papyra_key")).distinct())
    hashed = [f"`{c}`" for c, kind in df.dtypes if "map<" not in kind]
    keyed = df.select(F.xxhash64(id_col, text_col).alias("_papyra_key"), F.struct("*").alias("_papyra_row"), F.xxhash64(*hashed).alias("_papyra_order"))
    one = keyed.join(kept, "_papyra_key", "left_semi").groupBy("_papyra_key").agg(F.min_by("_papyra_row", "_papyra_order").alias("r"))
    return one.select("r.*")
