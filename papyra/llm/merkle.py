"""Merkle manifest of a dataset: a tree a group over its sorted rows, a tree over the groups, proofs.

Leaves are range-partitioned by group and order and sorted, and the counts of each group
in each partition, summed up, give every leaf its place. A partition then builds all
aligned subtrees that lie whole within it. What is ragged at its edges, a few nodes a
level, is shuffled by the coordinate of the block it belongs to, and blocks of blocks
finish the upper levels. Proofs come down the same way: each partition looks up the
siblings of its own subtrees and appends the path above them.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..operators.scratch import Scratch

#: Leaves of a sorted partition about; levels that one round finishes above the first.
PART_ROWS, STEP = 32768, 10
_PLACE = (1 << 33) - 1
_PATH = "array<struct<left: boolean, digest: string>>"
_ARROW_PATH = pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: str | Column) -> Column:
    """A value as hashed: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(*columns: str | Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def widths(leaves: int) -> list[int]:
    """Nodes of each level of a tree of so many leaves, from the leaves to the one at the top."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out


def subtrees(leaves: list[str], first: int, total: int) -> list[tuple[int, list[str]]]:
    """(index of the first node, digests) of the nodes of each level that lie whole within a run of leaves.

    The run holds places ``first`` on of ``total``. Those of a level are neighbours: a
    run with fewer children ends a level, so the right end of the tree counts as whole.
    """
    out = [(first, leaves)]
    for width in widths(total)[:-1]:
        lo, nodes = out[-1]
        hi = lo + len(nodes)
        up = -(-lo // 2)
        stop = -(-hi // 2) if hi == width else hi // 2
        if stop <= up:
            break
        out.append((up, [digest("".join(nodes[2 * i - lo : 2 * i + 2 - lo])) for i in range(up, stop)]))
    return out


def edges(levels: list[tuple[int, list[str]]], total: int) -> list[tuple[int, int]]:
    """(level, index) of the subtrees that no larger one of the run holds."""
    out = []
    for level, (lo, nodes) in enumerate(levels):
        above, up = levels[level + 1] if level + 1 < len(levels) else (0, [])
        out += [(level, i) for i in {lo, lo + len(nodes) - 1} if not above <= i // 2 < above + len(up)]
    return out


def finish(nodes: dict[tuple[int, int], str], total: int, ceiling: int) -> tuple[tuple[int, int], dict[tuple[int, int], list]]:
    """((level, index) of the node that all given ones lie below, path to it of each given one).

    nodes: digests by coordinate that cover one block of 2 ** ceiling leaves; the digests of
    nodes between are added. A path's entry is None where a node has no sibling, else
    whether the sibling is to the left, and its digest.
    """
    width = widths(total)
    top = min(ceiling, len(width) - 1)
    given = list(nodes)
    for level in range(min(x for x, _ in given), top):
        for i in sorted({i // 2 for x, i in list(nodes) if x == level}):
            if (level + 1, i) not in nodes:
                nodes[level + 1, i] = digest("".join(nodes[level, k] for k in (2 * i, 2 * i + 1) if k < width[level]))
    paths = {}
    for level, i in given:
        path, at = [], i
        for up in range(level, top):
            sibling = at ^ 1
            path.append((sibling < at, nodes[up, sibling]) if sibling < width[up] else None)
            at //= 2
        paths[level, i] = path
    return (top, given[0][1] >> (top - given[0][0])), paths


def _struct(path: list) -> list[dict]:
    return [{"left": None, "digest": None} if p is None else {"left": p[0], "digest": p[1]} for p in path]


def _join_key(*pairs: tuple[Column, Column]) -> Column:
    return reduce(lambda a, b: a & b, (x == y for x, y in pairs))


def forest(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(leaves with their proofs within their group, groups with their top).

    leaves: grp (string, not null), the columns of ``order`` named o1, o2, ..., leaf, and
    any others, which pass through. The first result has them, ``top`` (the digest of the
    group's tree) and ``proof`` (an entry a level: whether the sibling is to the left, and
    its digest; null without a sibling). The second has grp and top. Leaves that are equal
    in grp and order stand next to each other in the order of their digests.
    """
    spark = leaves.sparkSession
    order = sorted(c for c in leaves.columns if c[0] == "o" and c[1:].isdigit())
    n = leaves.count()
    parts = max(1, -(-n // PART_ROWS))
    if parts > 1:
        parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = leaves.withColumn("_row", F.monotonically_increasing_id())
    key = ["grp", *order, "leaf", "_row"]
    dealt = numbered.repartitionByRange(parts, *key).sortWithinPartitions(*key).drop("_row")
    placed = scratch.write(dealt.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counted = placed.groupBy("grp", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("begin"))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("grp"))})
    runs = scratch.write(counted)
    names = [f.name for f in placed.schema]

    def locals_of(left: pa.Table, right: pa.Table) -> list:
        """(run, rows of it, its subtrees) of a partition, rows in order."""
        if not left.num_rows:
            return []
        rows = left.sort_by("_at")
        at = rows.column("_at").to_numpy()
        found = []
        for r in sorted(right.select(["grp", "n", "begin", "first", "total"]).to_pylist(), key=lambda r: r["begin"]):
            a = int(np.searchsorted(at, r["begin"]))
            part = rows.slice(a, r["n"])
            found.append((r, part, subtrees(part.column("leaf").to_pylist(), r["first"], r["total"])))
        return found

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [
            {"grp": r["grp"], "total": r["total"], "level": level, "idx": i, "digest": levels[level][1][i - levels[level][0]], "_part": left.column("_part")[0].as_py()}
            for r, _, levels in locals_of(left, right)
            for level, i in edges(levels, r["total"])
        ]
        return pa.Table.from_pylist(out, pa.schema([("grp", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("_part", pa.int64())]))

    ragged = scratch.write(
        placed.select("grp", "leaf", "_at", "_part").groupBy("_part").cogroup(runs.groupBy("_part"))
        .applyInArrow(build, "grp string, total long, level int, idx long, digest string, _part long")
    )

    def upper(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        nodes = {(r["level"], r["idx"]): r["digest"] for r in rows}
        (level, idx), paths = finish(nodes, rows[0]["total"], rows[0]["ceiling"])
        out = [
            {"grp": r["grp"], "total": r["total"], "level": r["level"], "idx": r["idx"], "path": _struct(paths[r["level"], r["idx"]]),
             "up_level": level, "up_idx": idx, "up_digest": nodes[level, idx]}
            for r in rows
        ]
        return pa.Table.from_pylist(out, pa.schema([("grp", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("path", _ARROW_PATH), ("up_level", pa.int32()), ("up_idx", pa.int64()), ("up_digest", pa.string())]))

    most = runs.agg(F.max("total")).first()[0] or 1
    height, rounds, ceiling = len(widths(most)) - 1, [], max(1, (2 * PART_ROWS - 1).bit_length())
    nodes = ragged.select("grp", "total", "level", "idx", "digest")
    while True:
        # Nodes above the ceiling wait for a later round, each in a block of its own.
        block = F.when(F.col("level") > ceiling, -1 - F.col("idx")).otherwise(F.expr(f"shiftright(idx, {ceiling} - level)"))
        ready = nodes.withColumns({"block": block, "ceiling": F.greatest("level", F.lit(ceiling))})
        step = scratch.write(
            ready.groupBy("grp", "block", "ceiling").applyInArrow(
                upper, f"grp string, total long, level int, idx long, path {_PATH}, up_level int, up_idx long, up_digest string"
            )
        )
        rounds.append(step)
        if ceiling >= height:
            break
        nodes = step.select("grp", "total", F.col("up_level").alias("level"), F.col("up_idx").alias("idx"), F.col("up_digest").alias("digest")).distinct()
        ceiling += STEP
    groups = scratch.write(rounds[-1].select("grp", F.col("up_digest").alias("top")).distinct())
    above = rounds[-1].select("grp", "level", "idx", "path", F.col("up_digest").alias("top"))
    for step in reversed(rounds[:-1]):
        below = step.select("grp", "level", "idx", "path", F.col("up_level").alias("u"), F.col("up_idx").alias("i"))
        over = above.select(F.col("grp").alias("g"), F.col("level").alias("l"), F.col("idx").alias("k"), F.col("path").alias("more"), "top")
        on = _join_key((F.col("grp"), F.col("g")), (F.col("u"), F.col("l")), (F.col("i"), F.col("k")))
        above = below.join(over, on).select("grp", "level", "idx", F.concat("path", "more").alias("path"), "top")
    tops = ragged.select("grp", "level", "idx", "_part").join(above, ["grp", "level", "idx"])
    told = runs.groupBy("_part").agg(F.collect_list(F.struct("grp", "n", "begin", "first", "total")).alias("runs"))
    right = tops.select("_part", F.struct("grp", "level", "idx", "path", "top").alias("t"), F.lit(None).cast(dict(told.dtypes)["runs"]).alias("runs"))
    right = right.unionByName(told.select("_part", F.lit(None).cast(dict(right.dtypes)["t"]).alias("t"), "runs"))

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        runs_of = pa.Table.from_pylist([x for r in rows if r["runs"] is not None for x in r["runs"]])
        upper_of = {(r["t"]["grp"], r["t"]["level"], r["t"]["idx"]): r["t"] for r in rows if r["t"] is not None}
        out = []
        for r, part, levels in locals_of(left, runs_of):
            proofs, tops_ = [None] * part.num_rows, None
            for level, i in edges(levels, r["total"]):
                t = upper_of[r["grp"], level, i]
                tops_ = t["top"]
                for at in range(max(i << level, r["first"]), min((i + 1) << level, r["first"] + part.num_rows)):
                    proofs[at - r["first"]] = _local(levels, at, level, r["total"]) + t["path"]
            part = part.append_column("top", pa.array([tops_] * part.num_rows, pa.string()))
            out.append(part.append_column("proof", pa.array(proofs, _ARROW_PATH)))
        wanted = [c for c in names if not c.startswith("_")] + ["top", "proof"]
        if not out:
            return pa.table({c: pa.array([], left.schema.field(c).type if c in left.schema.names else pa.string() if c == "top" else _ARROW_PATH) for c in wanted})
        return pa.concat_tables(out).select(wanted)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if not f.name.startswith("_"))
    proved = placed.groupBy("_part").cogroup(right.groupBy("_part")).applyInArrow(prove, f"{kept}, top string, proof {_PATH}")
    return proved, groups


def _local(levels: list[tuple[int, list[str]]], at: int, top: int, total: int) -> list[dict]:
    out, width = [], total
    for level in range(top):
        lo, nodes = levels[level]
        sibling = at ^ 1
        out.append({"left": sibling < at, "digest": nodes[sibling - lo]} if sibling < width else {"left": None, "digest": None})
        at, width = at // 2, -(-width // 2)
    return out


def manifest(df: DataFrame, leaf: Column, group_col: str = "lang", order_col: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """order_col, leaf, subroot, root, proof and the columns of ``keep``, one row an input row.

    Rows of a group stand by order_col (nulls first, equal ones by their digests), groups by
    their bytes (null first). Proofs run from the leaf to the root; ``folded`` follows one. A
    single leaf or group is its own top. Repeated rows are leaves each; columns that nothing
    names are not read. An empty table gives no rows. No task holds more than a partition of
    about ``PART_ROWS`` leaves and no group, however large, meets in one.
    """
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession, "merkle")
    keep = keep or {}
    name = {c: f"k_{c}" for c in keep}
    grp = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    leaves = scratch.write(df.select(grp.alias("grp"), F.col(order_col).alias("o1"), leaf.alias("leaf"), *(keep[c].alias(name[c]) for c in keep)))
    proved, groups = forest(leaves, scratch)
    # The tops of the groups are the leaves of one more tree.
    over, whole = forest(groups.select(F.lit("").alias("grp"), F.col("grp").alias("o1"), F.col("top").alias("leaf")), scratch)
    over = scratch.write(over.select(F.col("o1").alias("grp"), F.col("top").alias("root"), F.col("proof").alias("more")))
    return proved.join(over, "grp").select(
        F.col("o1").alias(order_col), "leaf", F.col("top").alias("subroot"), "root", F.concat("proof", "more").alias("proof"),
        *(F.col(name[c]).alias(c) for c in keep),
    )


def folded(leaf: str, proof: str) -> Column:
    """The root that a leaf and the siblings of its proof give."""

    def up(acc: Column, s: Column) -> Column:
        both = F.when(s["left"], F.concat(s["digest"], acc)).when(~s["left"], F.concat(acc, s["digest"])).otherwise(acc)
        return F.sha2(both, 256)

    return F.aggregate(proof, F.col(leaf), up)


def proof_digest(proof: str) -> Column:
    """H of a proof's siblings in order."""
    there = F.filter(proof, lambda s: s["digest"].isNotNull())
    return F.sha2(F.array_join(F.transform(there, lambda s: s["digest"]), ""), 256)


def tamper_check(docs: DataFrame) -> DataFrame:
    """The registered query: every row's proof, and what it gives where n_chars was raised by one."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    raised = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    tampered = leaf_of("doc_id", "source", "lang", raised, "text")
    out = manifest(docs, leaf_of(*fields), keep={"tampered": tampered})
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof_digest("proof").alias("proof_sha256"), folded("tampered", "proof").alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
