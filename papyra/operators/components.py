"""Connected components of an edge list as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each connected component.

    Each round gives every node the least root among its neighbours, and gives it to the
    node's root as well, then follows roots of roots, so that whole trees hang under each
    other and long chains need few rounds. Rounds end when no root changes. Only sums of
    changes reach the driver. Null ends are left out, loops give their node; an empty edge
    list gives no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    kind = e.schema["u"].dataType
    both = scratch.write(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = scratch.write(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")))
    while True:
        near = (
            both.join(roots.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("root").alias("least"))
        )
        named = roots.join(near, "node")
        # The root's own row is an offer too, so each node has one with its root.
        own, passed = F.struct("node", "root", "least"), F.struct(F.col("root").alias("node"), F.lit(None).cast(kind).alias("root"), "least")
        offers = named.select(F.explode(F.when(F.col("least") < F.col("root"), F.array(own, passed)).otherwise(F.array(own))).alias("x")).select("x.*")
        least = F.least(F.max("root"), F.min("least"))
        step = scratch.write(offers.groupBy("node").agg(least.alias("root"), (F.min("least") < F.max("root")).alias("moved")))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = scratch.write(
            step.join(up, "root", "left").select(
                "node",
                F.least(F.col("root"), F.coalesce("top", "root")).alias("root"),
                (F.col("moved") | (F.col("top") < F.col("root"))).alias("moved"),
            )
        )
        moved = jumped.agg(F.max("moved")).first()[0]
        scratch.drop(step)
        scratch.drop(roots)
        roots = jumped
        if not moved:
            return roots.select("node", "root")
