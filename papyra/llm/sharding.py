"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows of equal text form a group with a vector of bytes, tokens and rows. Small groups
are gathered by hash into bundles, larger ones stand alone. That leaves a number of
units that depends on the number of shards only, so the greedy step (largest unit
first, each to the shard whose residual capacity has the highest dot product with it)
sees a bounded table, whatever the input. A group stays whole unless the shards cannot
be balanced with it: then the packing is tried again with the largest groups dealt, row
by row, into ever smaller pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import Scratch

#: Bundles a shard: a unit holds about this fraction of a shard's capacity.
UNITS_PER_SHARD = 64
#: Shares of a shard above which a group is split, tried in this order; the spread of sizes
#: (over their mean) with which a try is good enough, and the one aimed at.
LIMITS, SPREAD, AIM = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125, 0.015625), 0.05, 0.005
#: Plans of more units and places are joined by shuffle instead of a broadcast.
BROADCAST_UNITS = 200_000
#: Rows of one ordering group of a shard, and such groups of a shard at most.
SLOT_ROWS, SLOT_GROUPS = 2000, 4096
EXTRA_BYTES = 8


def pack(units: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit (rows x dimensions, each dimension scaled to a sum of 1).

    Largest unit first, to the shard with the highest dot product of unit and residual
    capacity; ties go to the lower shard.
    """
    residual = np.full((shards, units.shape[1]), 1.0 / shards)
    out = np.zeros(len(units), np.int64)
    for i in np.lexsort((np.arange(len(units)), -units.max(axis=1))):
        out[i] = np.argmax(residual @ units[i])
        residual[out[i]] -= units[i]
    return out


def even_out(size: np.ndarray, where: np.ndarray, shards: int, spread: float) -> np.ndarray:
    """where with single units moved from the largest shard to the smallest while that narrows the sizes.

    The greedy step balances all dimensions; this last one sees to the law, nearly equal
    sizes, and stops as soon as they are within ``spread`` of the mean (1 / shards).
    """
    where = where.copy()
    load = np.bincount(where, weights=size, minlength=shards)
    for _ in range(4 * shards + len(size)):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        if gap * shards <= spread:
            break
        own = np.flatnonzero((where == high) & (size < gap) & (size > 0))
        if not len(own):
            break
        unit = own[np.abs(size[own] - gap / 2).argmin()]
        where[unit] = low
        load[high] -= size[unit]
        load[low] += size[unit]
    return where


def split_and_pack(units: np.ndarray, rows: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of each unit, shard of each piece, unit after unit).

    units: scaled as for ``pack``; rows: rows of a unit that may be dealt apart (1: stays
    whole). The first limit whose spread of sizes (the first dimension) is within
    ``SPREAD`` wins, else the one of least spread.
    """
    best = None
    for limit in LIMITS:
        pieces = np.clip(np.ceil(units.max(axis=1) * shards / limit).astype(np.int64), 1, rows)
        # A group over the limit is dealt as finely as bundles are, so that pieces fill gaps.
        fine = np.clip(np.ceil(units.max(axis=1) * shards * UNITS_PER_SHARD).astype(np.int64), 1, rows)
        pieces = np.where(pieces > 1, fine, 1)
        owner = np.repeat(np.arange(len(units)), pieces)
        where = pack(units[owner] / pieces[owner][:, None], shards)
        where = even_out(units[owner, 0] / pieces[owner], where, shards, AIM)
        load = np.bincount(where, weights=units[owner, 0] / pieces[owner], minlength=shards) * shards
        spread = load.max() - load.min()
        if best is None or spread < best[0] - 1e-12:
            best = (spread, pieces, where)
        if spread <= SPREAD:
            break
    return best[1], best[2]


def shard(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Law ``bytes``: shards hold nearly equal sizes. Size is UTF-8 bytes plus 8; null
    text has none and counts as empty. Equal texts share a shard unless the shards could
    not be balanced so; then the rows of the largest groups are dealt evenly. Slots run
    from 0 without gaps. Repeated rows are rows of their own, whatever their id (null
    too). Other columns are not read. An empty table gives no rows. What reaches the
    driver and the broadcasts are at most some hundred units a shard.
    """
    scratch = Scratch(df.sparkSession, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    blanks = F.length(text) - F.length(F.translate(text, " \n\t\r", ""))
    rows = scratch.write(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + EXTRA_BYTES).cast("long").alias("size"),
            (blanks + 1).cast("long").alias("tokens"),
            F.crc32(text).alias("crc"),
            F.xxhash64(text).alias("group"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    vector = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    total = rows.agg(*vector).first()
    units = shards * UNITS_PER_SHARD
    share = F.greatest(*(F.col(c) / F.lit(float(total[c] or 1)) for c in ("size", "tokens", "n"))) * units
    # Groups of more than a bundle's share, at most three times ``units`` of them, and the bundles of the others.
    groups = scratch.write(rows.groupBy("group").agg(*vector).withColumn("heavy", share > 1))
    light = F.pmod(F.xxhash64("group", F.lit(1)), F.lit(units)).cast("long")
    unit = F.when(F.col("heavy"), F.col("group")).otherwise(light)
    summed = groups.groupBy("heavy", unit.alias("unit")).agg(*(F.sum(c).alias(c) for c in ("size", "tokens", "n"))).collect()
    summed.sort(key=lambda r: (r["heavy"], r["unit"]))
    scale = np.array([total["size"] or 1, total["tokens"] or 1, total["n"] or 1], float)
    each = np.array([[r["size"], r["tokens"], r["n"]] for r in summed], float).reshape(-1, 3) / scale
    pieces, where = split_and_pack(each, np.array([r["n"] if r["heavy"] else 1 for r in summed], np.int64), shards)
    ends = np.cumsum(pieces)
    plan = df.sparkSession.createDataFrame(
        [(r["heavy"], r["unit"], where[e - p : e].tolist()) for r, p, e in zip(summed, pieces, ends, strict=True)],
        "heavy boolean, unit long, places array<int>",
    )
    if len(summed) + int(pieces.sum()) <= BROADCAST_UNITS:
        plan = F.broadcast(plan)
    alone = plan.where("heavy").select(F.col("unit").alias("group"), F.col("places").alias("own"))
    bundled = plan.where("not heavy").select(F.col("unit").alias("bundle"), F.col("places").alias("shared"))
    placed = (
        rows.withColumn("bundle", light)
        .join(alone, "group", "left")
        .join(bundled, "bundle", "left")
        .withColumn("places", F.coalesce("own", "shared"))
    )
    # Rows of a split group are dealt in turn within each part of the input that they came from.
    split = F.size("places") > 1
    origin = F.shiftright("row", 33)
    turn = F.row_number().over(Window.partitionBy("group", "origin").orderBy("row")) + F.pmod(F.xxhash64("group", "origin"), F.size("places"))
    whole = placed.where(~split).withColumn("shard", F.get("places", F.lit(0)))
    dealt = placed.where(split).withColumn("origin", origin)
    dealt = dealt.withColumn("shard", F.get("places", F.pmod(turn, F.size("places")).cast("int")))
    parts = max(1, min(SLOT_GROUPS, -(-total["n"] // (shards * SLOT_ROWS))))
    columns = ["id", "size", "crc", "shard", "row", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part")]
    assigned = scratch.write(whole.select(*columns).union(dealt.select(*columns)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.write(
        assigned.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "part").orderBy("id", "crc", "row")
    return (
        assigned.withColumn("nth", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets) if shards * parts <= BROADCAST_UNITS else offsets, ["shard", "part"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
