"""Similarity of vectors: pairs over a threshold, nearest neighbours, average linkage, scores.

Vectors are partitioned around pivots and visit only the cells that the triangle
inequality allows a neighbour in (``pivots``). A cell is a grid of blocks and a task one
matrix product of bounded size, so no task and no group grows with the input. Average
linkage works on the pairs that are near enough only; large components are linked by
DataFrame rounds. Where those pairs are very many, clusters look for their nearest one
instead (``mutual``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from . import mutual, pivots, signatures
from .components import connected_components
from .scratch import Scratch

BLOCK_ROWS = 2048
#: Vectors of a block of the grid that finds all pairs, of whose products a task holds strips.
PAIR_ROWS, STRIP_ROWS = 8192, 512
#: Components of at most so many vectors are linked in one task (a matrix of 32 MB), larger ones by rounds.
LINK_ROWS = 2048
#: Rounds of merges after which what is left of a large component is looked at for parts that a task can link.
SPLIT_ROUNDS = 4


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")


def similarity_cells(df: DataFrame, threshold: float, scratch: Scratch, id_col: str = "id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, v, cell and guest of every visit: each vector in its own cell, and as a guest in those before it that may hold a pair.

    Two vectors whose cosine is over the threshold meet in exactly one cell, that of the
    lesser pivot of theirs. Vectors of length 0 are similar to nothing; over a threshold
    of 0 or less, where angles bound nothing, all vectors stay in one cell.
    """
    rows = _vectors(df, id_col, vector_col)
    if threshold > 0:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    within = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
    n = rows.count()
    sample = pivots.sample_of(rows, n)
    picked = pivots.choose(sample, n, within, block_rows) if len(sample) else np.zeros((1, 1))
    if len(picked) == 1:
        # As narrow as they came: a grid copies them once a block.
        return rows.select("id", "v", F.lit(0).alias("cell"), F.lit(False).alias("guest"))
    held = scratch.write(pivots.assigned(rows, picked))
    radius, _ = pivots.radii(held, len(picked))
    guests = pivots.visits(held, picked, radius, within, only_lower=True, with_own=False)
    return held.select("id", "v", "cell", F.lit(False).alias("guest")).union(guests.select("id", "v", "cell", F.lit(True).alias("guest")))


def similarity_pairs(df: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "embedding", block_rows: int = PAIR_ROWS) -> DataFrame:
    """(a, b, similarity) of all pairs a < b whose cosine is over the threshold.

    A cell's vectors meet its guests and each other in a grid of blocks, so a task is one
    matrix product of bounded size, however many vectors are alike. Sizes of cells, a row
    a pivot, go along with the tasks: a join dealt by cell would send all to one task
    where the vectors are one cell.
    """
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession, "similar")
    rows = _vectors(df, id_col, vector_col)
    n = rows.count()
    sample = pivots.sample_of(rows, n)
    keys = signatures.choose(sample, n, threshold, block_rows)
    if keys is not None:
        return signatures.pairs(rows, keys, scratch, sample.shape[1], threshold, block_rows)
    visits = scratch.write(similarity_cells(df, threshold, scratch, id_col, vector_col, block_rows))
    count = visits.groupBy("cell").agg(F.count_if(~F.col("guest")).alias("natives"), F.count_if("guest").alias("guests"))
    width = [F.ceil(F.col(c) / F.lit(float(block_rows))).cast("int").alias(w) for c, w in (("natives", "nb"), ("guests", "gb"))]
    sized = visits.join(F.broadcast(count.where("natives > 0").select("cell", *width)), "cell")
    at = F.when(F.col("guest"), F.col("nb") + F.pmod(F.xxhash64("id"), F.greatest("gb", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.col("nb"))).cast("int")
    # Natives meet every block, guests the natives' blocks only.
    others = F.sequence(F.lit(0), F.when(F.col("guest"), F.col("nb")).otherwise(F.col("nb") + F.col("gb")) - 1)
    met = sized.withColumn("block", at).withColumn("other", F.explode(others))
    met = met.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "v")

    def cell(t: pa.Table) -> pa.Table:
        ids, x, block = t.column("id").to_numpy(), pivots.unit(t.column("v")), t.column("block").to_numpy()
        left = block == t.column("lo")[0].as_py()
        right = block == t.column("hi")[0].as_py()
        same = (left == right).all()
        a, b, x, y = ids[left], ids[right], x[left], x[right]
        strips = []
        for at in range(0, max(len(a), 1), STRIP_ROWS):
            s = x[at : at + STRIP_ROWS] @ y.T
            i, j = np.nonzero(s > threshold)
            p, q = a[at + i], b[j]
            keep = p < q if same else p != q
            strips.append(pa.table({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "similarity": s[i, j][keep]}))
        return pa.concat_tables(strips)

    return met.groupBy("cell", "lo", "hi").applyInArrow(cell, "a long, b long, similarity double")


def _best_in_cells(asked: DataFrame, held: DataFrame, sizes: dict[int, int], floor: float, block_rows: int) -> DataFrame:
    """id, nearest and similarity: the best of the vectors of each visited cell, in blocks.

    asked and held: id, v, cell; sizes: rows of each cell of ``held`` (a row a pivot).
    """
    spark = asked.sparkSession
    visits = asked.groupBy("cell").agg(F.count("*").alias("asked"))
    rows = [(c, n) for c, n in sizes.items()]
    count = spark.createDataFrame(rows, "cell int, n long").join(visits, "cell")
    width = count.select("cell", F.ceil(F.col("n") / float(block_rows)).cast("int").alias("cb"), F.ceil(F.col("asked") / float(block_rows)).cast("int").alias("qb"))
    q = asked.join(width, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("qb")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("y"), F.lit(0).alias("kind"), "id", "v")
    c = held.join(width, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("x"), F.pmod(F.xxhash64("id"), F.col("cb")).cast("int").alias("y"), F.lit(1).alias("kind"), "id", "v")

    def cell(t: pa.Table) -> pa.Table:
        kind, ids, x = t.column("kind").to_numpy(), t.column("id").to_numpy(), pivots.unit(t.column("v"))
        order = np.argsort(ids[kind == 1])
        canon_ids = ids[kind == 1][order]
        if not len(canon_ids) or not (kind == 0).any():
            return pa.table({"id": pa.array([], pa.int64()), "nearest": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        s = np.round(x[kind == 0] @ x[kind == 1][order].T, 12)
        best = s.argmax(axis=1)
        top = s[np.arange(len(s)), best]
        keep = top >= floor
        return pa.table({"id": ids[kind == 0][keep], "nearest": canon_ids[best][keep], "similarity": top[keep]})

    return q.unionByName(c).groupBy("cell", "x", "y").applyInArrow(cell, "id long, nearest long, similarity double")


def nearest(queries: DataFrame, canon: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, nearest, similarity): each query's most similar canonical vector, if at least the threshold; ties go to the least id.

    A query first looks into the cell of its nearest pivot. The best found there, or the
    threshold, is the radius of a second ring: the other cells that may hold as near a
    vector.
    """
    spark = queries.sparkSession
    ship(spark)
    scratch = Scratch(spark, "nearest")
    asked, known = _vectors(queries, id_col, vector_col), _vectors(canon, id_col, vector_col)
    if threshold > 0:
        # A vector of length 0 is similar to nothing, and no angle bounds it.
        known = known.where(F.exists("v", lambda x: x != 0))
    n = known.count()
    within = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
    sample = pivots.sample_of(known, n)
    if not len(sample):
        return spark.createDataFrame([], "id long, nearest long, similarity double")
    keys = signatures.choose(sample, n, threshold, block_rows)
    if keys is not None:
        found = signatures.nearest(asked, known, keys, scratch, sample.shape[1], threshold, block_rows)
        best = F.min(F.struct((-F.col("similarity")).alias("d"), "nearest")).alias("x")
        return found.groupBy("id").agg(best).select("id", F.col("x.nearest").alias("nearest"), (-F.col("x.d")).alias("similarity"))
    picked = pivots.choose(sample, n, within, block_rows)
    held = scratch.write(pivots.assigned(known, picked))
    radius, sizes = pivots.radii(held, len(picked))
    first = scratch.write(pivots.assigned(asked, picked).drop("far"))
    found = scratch.write(_best_in_cells(first, held.drop("far"), sizes, threshold, block_rows))
    best = F.min(F.struct((-F.col("similarity")).alias("d"), "nearest")).alias("x")
    if len(picked) > 1:
        ring = found.groupBy("id").agg(F.acos(F.least(F.max("similarity"), F.lit(1.0))).alias("ring"))
        wider = first.join(ring, "id", "left").select("id", "v", F.coalesce("ring", F.lit(within)).alias("within"))
        rest = scratch.write(pivots.visits(wider, picked, radius, "within", only_lower=False, with_own=False))
        found = found.union(_best_in_cells(rest, held.drop("far"), sizes, threshold, block_rows))
    return found.groupBy("id").agg(best).select("id", F.col("x.nearest").alias("nearest"), (-F.col("x.d")).alias("similarity"))


def average_linkage(x: np.ndarray, distance: float, size: np.ndarray | None = None) -> np.ndarray:
    """Labels of average linkage over cosine distance, cut strictly below ``distance``; least pair first on ties.

    size: how many equal vectors each row stands for.
    """
    n = len(x)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if size is None else size.astype(np.float64)
    label, alive = np.arange(n), np.ones(n, bool)
    while n > 1:
        flat = int(d.argmin())
        i, j = divmod(flat, len(x))
        if not d[i, j] < distance:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, :], d[:, i] = merged, merged
        d[j, :], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        d[i, ~alive] = d[~alive, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == label[j]] = label[i]
        n -= 1
    return label


def _linked(rows: DataFrame, similarity: float, means: bool = False) -> DataFrame:
    """(id, cluster) of components of at most ``LINK_ROWS`` rows; rows: root, id, n, v, where v is a vector or, with means, the mean of n unit vectors.

    Most components are a few rows, so a group of rows holds many of them.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, -(-rows.count() // (4 * LINK_ROWS)))

    def link(t: pa.Table) -> pa.Table:
        root, ids = t.column("root").to_numpy(), t.column("id").to_numpy()
        by = np.lexsort((ids, root))
        lists = t.column("v").combine_chunks()
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if means else pivots.unit(lists)
        root, ids, x, n = root[by], ids[by], x[by], t.column("n").to_numpy()[by]
        start = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
        named = ids.copy()
        for a, b in zip(start, np.append(start[1:], len(root)), strict=True):
            named[a:b] = ids[a:b][average_linkage(x[a:b], 1 - similarity, n[a:b])]
        return pa.table({"id": ids, "cluster": named})

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("root"), F.lit(groups)))
    # A given number of partitions stays: what is linked is small, the work on it is not.
    return dealt.repartition(min(groups, 16 * parts), "group").groupBy("group").applyInArrow(link, "id long, cluster long")


def _linked_pairs(base: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(id, cluster) by the pairs above the cut; base: id, n (rows that the vector stands for), v."""
    pairs = scratch.write(similarity_pairs(base, similarity, "id", "v"))
    roots = connected_components(pairs, scratch)

    sizes = scratch.write(roots.groupBy("root").agg(F.count("*").alias("size")))
    found = base.join(roots.withColumnRenamed("node", "id"), "id").join(sizes, "root")
    linked = _linked(found.where(F.col("size") <= LINK_ROWS).select("root", "id", "n", "v"), similarity)
    alone = base.join(roots, base["id"] == roots["node"], "left_anti").select("id", F.col("id").alias("cluster"))
    out = linked.union(alone)
    large = sizes.where(F.col("size") > LINK_ROWS)
    if not large.isEmpty():
        nodes = scratch.write(roots.join(large, "root").select(F.col("node").alias("id")))
        inside = pairs.join(nodes.withColumnRenamed("id", "a"), "a", "left_semi")
        out = out.union(linkage_rounds(base.join(nodes, "id"), inside, similarity, scratch))
    return out


def clusters(df: DataFrame, similarity: float, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster): average-linkage clusters cut at 1 - similarity, named by their least id.

    Equal vectors merge before all others, so each is looked at once, with its number, and
    a group of copies costs one row. Clusters never cross components of the graph of
    pairs nearer than the cut (a merge below it needs one such pair), so components are
    found first and linked apart: small ones whole in a task, large ones by
    ``linkage_rounds``, with equal results where no two pairs are equally near. Pairs of
    dense vectors that are near by the dozen grow with the square of the input, so they are
    not written, and ``mutual`` links those vectors. Vectors of length 0 are clusters of their own.
    """
    scratch = Scratch(df.sparkSession, "cluster")
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    if 1 - similarity > 0:
        same = F.exists("v", lambda x: x != 0)
        rows = rows.withColumn("same", F.when(same, F.lit(None).cast("long")).otherwise(F.col("id")))
    else:
        rows = rows.withColumn("same", F.col("id"))
    # Two hashes of a vector are its key in joins: sorting by vectors would compare them number by number.
    rows = rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit("copy"), "v")})
    copies = scratch.write(rows.groupBy("h", "g", "v", "same").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    base = copies.select("id", "n", "v")
    seen = _vectors(base, "id", "v")
    n = seen.count()
    sample = pivots.sample_of(seen, n)
    if mutual.crowded(sample, n, similarity) and signatures.choose(sample, n, similarity, PAIR_ROWS) is None:
        out = mutual.clusters(base, similarity, scratch)
    else:
        out = _linked_pairs(base, similarity, scratch)
    first = copies.select(F.col("id").alias("first"), "h", "g", F.col("v").alias("w"), F.col("same").alias("of"))
    equal = F.forall(F.zip_with("v", "w", lambda x, y: x.eqNullSafe(y)), lambda e: e)
    equal = F.coalesce(equal, F.col("v").isNull() & F.col("w").isNull()) & F.col("same").eqNullSafe(F.col("of"))
    of = rows.join(first, ["h", "g"]).where(equal).select("id", "first")
    return of.join(out.select(F.col("id").alias("first"), "cluster"), "first").select("id", "cluster")


def linkage_rounds(base: DataFrame, pairs: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(id, cluster) by average linkage in rounds: every pair of clusters that are each other's nearest merges.

    base: id, n (rows that the vector stands for), v; pairs: a < b and similarity of all pairs above the cut. The mean
    similarity of two clusters of unit vectors is the product of their mean vectors, so
    a cluster is its size and its sum. It exceeds the cut only if it did for a pair that
    the two were merged from, so pairs at or below it are dropped. Pairs are in a total
    order (similarity, then ids), so the nearest pair of all merges in every round. Merges
    and dropped pairs take a component apart: every ``SPLIT_ROUNDS`` rounds the parts of at
    most ``LINK_ROWS`` clusters are linked by a task each, so long chains need no round a link.
    """
    square = F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x * x)
    # The length is bound to a variable of its own; inside the inner function it would be computed for every number.
    length = F.array(F.greatest(F.sqrt(square), F.lit(1e-12)))
    total = F.get(F.transform(length, lambda r: F.transform("v", lambda x: x.cast("double") / r * F.col("n"))), 0)
    groups = scratch.write(base.select("id", "n", total.alias("sum")))
    near = scratch.write(pairs.select("a", "b", "similarity"))
    member = scratch.write(base.select("id", F.col("id").alias("cluster")))
    done = 0
    while True:
        ends = near.select(F.explode(F.array("a", "b")).alias("c"), F.struct((-F.col("similarity")).alias("d"), "a", "b").alias("p"))
        best = ends.groupBy("c").agg(F.min("p").alias("p")).groupBy(F.col("p.a").alias("into"), F.col("p.b").alias("gone"))
        merges = scratch.write(best.agg(F.count("*").alias("k")).where("k = 2").select("into", "gone"))
        if merges.isEmpty():
            return member
        gone = merges.select(F.col("gone").alias("id"), "into")
        gained = groups.join(gone, "id").select(F.col("into").alias("id"), F.col("n").alias("m"), F.col("sum").alias("more"))
        total = F.when(F.col("more").isNull(), F.col("sum")).otherwise(F.zip_with("sum", "more", lambda x, y: x + y))
        grown = scratch.write(
            groups.join(gone, "id", "left_anti").join(gained, "id", "left")
            .select("id", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), total.alias("sum"))
        )
        moved = near
        for end in ("a", "b"):
            moved = moved.join(gone.select(F.col("id").alias(end), F.col("into").alias(f"_{end}")), end, "left")
        a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
        moved = moved.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "similarity").where("a <> b")
        moved = moved.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
        for end in ("a", "b"):
            moved = moved.join(merges.select(F.col("into").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
        moved = scratch.write(moved.select("a", "b", "similarity", (F.col("_a").isNotNull() | F.col("_b").isNotNull()).alias("fresh")))
        again = moved.where("fresh").select("a", "b")
        for end in ("a", "b"):
            again = again.join(grown.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sum").alias(f"s_{end}")), end)
        product = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        again = again.select("a", "b", (product / (F.col("n_a") * F.col("n_b"))).alias("similarity"))
        kept = scratch.write(moved.where("not fresh").select("a", "b", "similarity").union(again).where(F.col("similarity") > similarity))
        named = member.join(gone.select(F.col("id").alias("cluster"), "into"), "cluster", "left")
        renamed = scratch.write(named.select("id", F.coalesce("into", "cluster").alias("cluster")))
        for old in (groups, near, member, moved):
            scratch.drop(old)
        groups, near, member = grown, kept, renamed
        done += 1
        if done % SPLIT_ROUNDS == 0:
            groups, near, member = _split(groups, near, member, similarity, scratch)


def _split(groups: DataFrame, near: DataFrame, member: DataFrame, similarity: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, near, member) once the small components of near are linked whole: they have no pairs any more."""
    roots = connected_components(near, scratch)
    sizes = scratch.write(roots.groupBy("root").agg(F.count("*").alias("size")))
    part = scratch.write(roots.join(sizes, "root").select(F.col("node").alias("id"), "root", (F.col("size") <= LINK_ROWS).alias("small")))
    means = groups.join(part.where("small"), "id").select("root", "id", "n", F.transform("sum", lambda x: x / F.col("n")).alias("v"))
    linked = _linked(means, similarity, means=True).select(F.col("id").alias("cluster"), F.col("cluster").alias("into"))
    renamed = scratch.write(member.join(linked, "cluster", "left").select("id", F.coalesce("into", "cluster").alias("cluster")))
    large = part.where("not small").select("id")
    kept = scratch.write(near.join(large.withColumnRenamed("id", "a"), "a", "left_semi"))
    grown = scratch.write(groups.join(large, "id", "left_semi"))
    for old in (groups, near, member):
        scratch.drop(old)
    return grown, kept, renamed


def cluster_scores(df: DataFrame, cluster_col: str, vector_col: str = "embedding") -> DataFrame:
    """(cluster, members, cluster_score, embedding): mean dot of the members with their renormalised centroid, and that centroid."""
    rows = df.select(F.col(cluster_col).alias("cluster"), F.col(vector_col).alias("v")).where(F.size("v") > 0)
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("members"), F.first("v").alias("v"))
    # The centroid of one vector is that vector; only others are taken apart.
    square = F.aggregate("v", F.lit(0.0), lambda acc, y: acc + F.coalesce(y.cast("double") * y.cast("double"), F.lit(0.0)))
    single = sizes.where("members = 1").select("cluster", "members", F.sqrt(square).alias("cluster_score"), F.transform("v", lambda y: y.cast("double")).alias("p"))
    several = rows.join(sizes.where("members > 1").select("cluster"), "cluster", "left_semi")
    x = several.select("cluster", F.posexplode("v").alias("k", "x")).groupBy("cluster", "k").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    # The mean dot with c / |c| is |c|: sum(m . c/|c|) / n = n c . c/|c| / n.
    c = F.col("s") / F.col("n")
    parts = F.sort_array(F.collect_list(F.struct("k", c.alias("c"))))
    out = x.groupBy("cluster").agg(F.max("n").alias("members"), F.sqrt(F.sum(c * c)).alias("cluster_score"), parts.alias("p"))
    out = single.unionByName(out.withColumn("p", F.transform("p", lambda y: y["c"])))
    length = F.when(F.col("cluster_score") > 0, F.col("cluster_score")).otherwise(1.0)
    return out.select("cluster", "members", "cluster_score", F.transform("p", lambda y: y / length).alias("embedding"))
