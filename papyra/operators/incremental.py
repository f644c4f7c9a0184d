"""Paths of a new graph version from those of the last: only what changes touch is joined again.

Paths depend on their two hops, on the hops' reverses and on edges between their ends.
A hop is touched if its pair came, went or changed, or if its reverse came or went. A
path stays if neither hop is touched and no new edge joins its ends. New paths have a
touched hop (touched x all, untouched x touched), or their ends lost the edge that
closed them. So the self-join of the whole graph is left to the first version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reason as R
from .scratch import Scratch

KEY = ["subject", "object"]


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """subject, object and change (added, removed, altered) of every pair that differs between two versions of pair edges."""
    old = before.select(*KEY, F.struct("predicates", "support").alias("was"))
    new = after.select(*KEY, F.struct("predicates", "support").alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "altered")
    return old.join(new, KEY, "full").withColumn("change", kind).where("change is not null").select(*KEY, "change")


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("object").alias("subject"), F.col("subject").alias("object"))


def touched_hops(changed: DataFrame) -> DataFrame:
    """subject, object: pairs that changed, and reverses of pairs that came or went."""
    moved = changed.where("change <> 'altered'")
    return changed.select(*KEY).union(_turned(moved)).distinct()


def kept_paths(paths: DataFrame, changed: DataFrame, touched: DataFrame) -> DataFrame:
    """Paths that hold as they are: no hop is touched and no added pair joins their ends."""
    first = touched.select(F.col("subject").alias("source"), F.col("object").alias("mid"))
    second = touched.select(F.col("subject").alias("mid"), F.col("object").alias("target"))
    out = paths.join(first, ["source", "mid"], "left_anti").join(second, ["mid", "target"], "left_anti")
    added = changed.where("change = 'added'").select(*KEY)
    closed = added.union(_turned(added)).select(F.col("subject").alias("source"), F.col("object").alias("target"))
    return out.join(closed, ["source", "target"], "left_anti")


def fresh_candidates(after: DataFrame, changed: DataFrame, touched: DataFrame) -> DataFrame:
    """Paths over one-way pairs with a touched hop or with ends that a removed pair joined; edges between ends are not yet tested."""
    one_way = R.one_way_pairs(after)
    news, rest = one_way.join(touched, KEY, "left_semi"), one_way.join(touched, KEY, "left_anti")
    grown = R.first_hops(news).join(R.second_hops(one_way), "mid")
    grown = grown.unionByName(R.first_hops(rest).join(R.second_hops(news), "mid"))
    gone = changed.where("change = 'removed'").select(*KEY)
    opened = gone.union(_turned(gone)).distinct().select(F.col("subject").alias("source"), F.col("object").alias("target"))
    again = opened.join(R.first_hops(rest), "source").join(R.second_hops(rest), ["mid", "target"])
    return grown.unionByName(again)


def updated_paths(paths: DataFrame, before: DataFrame, after: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """``discovery_paths(after)`` from ``discovery_paths(before)``, both without seeds and with the same stop words.

    before and after: pair edges of the two versions, hubs suppressed in each. One full
    join compares them; everything else is joins of what differs.
    """
    scratch = Scratch(after.sparkSession, "update")
    changed = scratch.write(changes(before, after))
    touched = scratch.write(touched_hops(changed))
    fresh = R.still_open(fresh_candidates(after, changed, touched), after)
    if stop_words:
        fresh = fresh.where(~F.lower("mid").isin([w.lower() for w in stop_words]))
    return kept_paths(paths, changed, touched).unionByName(fresh.select(*paths.columns))
