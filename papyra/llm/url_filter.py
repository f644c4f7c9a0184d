"""URL filters by a sort-merge range join, in DataFrame operations only.

A rule (host, path prefix) holds for the host and its subdomains. Each url is keyed
by every parent host it may answer to, and under one host the rules' path prefixes
are intervals of sorted paths, nested or apart. Rules and urls of a host are sorted
together; a sweep carries the stack of nested rules that the last rule opened, and a
url's rule is the innermost of the stack whose interval still holds it. Hosts with
many urls are salted: their rules, which are few, are copied to each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import Scratch

#: Urls of one sweep at least, before a host is salted.
SWEEP_ROWS = 256
#: Copies of a row that one task gives back at a time.
AGAIN_ROWS = 65536
#: Rule hosts are broadcast up to so many; beyond, they are joined by shuffle.
BROADCAST_HOSTS = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to one of ``/?#``, then up to one of ``?#``."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(_url, locate('://', _url) + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    """The labels of a host, last first: the canonical key order."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the stack of rules that hold wherever it does under its host, longest path first."""
    keyed = rules.select("host", "path", "rule", "verdict")
    outer = keyed.select("host", F.col("path").alias("prefix"), F.struct(F.length("path").alias("n"), "path", "rule", "verdict").alias("r"))
    prefixes = keyed.select(
        "host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.expr("path").substr(F.lit(1), i))).alias("prefix")
    )
    return prefixes.join(outer, ["host", "prefix"]).groupBy("host", "path").agg(F.reverse(F.array_sort(F.collect_list("r"))).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule and verdict of every url.

    rules: host, path, verdict. The longest rule (host and path together) wins; of rules
    as long, the one of the longer host; of equal ones, ``block``. No rule: null and
    ``default``. Null urls and urls without ``://`` have empty host and path. Repeated
    rows, null ids too, come back as often, however often that is. Urls are read whole,
    however long; only as many labels of a host as rules have are tried. Other columns
    are not read; an empty table gives no rows, and without rules every url gets
    ``default``.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    rules = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("rule", F.concat("host", "path"))
    )
    stacks = scratch.write(_stacks(rules))
    labels = stacks.agg(F.max(F.size(F.split("host", r"\."))).alias("n"), F.countDistinct("host").alias("hosts")).first()
    host, path = split_url(F.col("_url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url")).select("id", host.alias("host"), path.alias("path"))
    # The whole host always, then its parents, down to the number of labels that rules have.
    parts = F.split("host", r"\.")
    parent = F.transform(
        F.sequence(F.lit(0), F.greatest(F.least(F.size(parts) - 1, F.lit(labels["n"] or 0)), F.lit(0))),
        lambda i: F.when(i == 0, F.col("host")).otherwise(F.array_join(F.slice(parts, F.size(parts) - i + 1, i), ".")),
    )
    keys = urls.select("id", "host", "path", F.posexplode(F.array_distinct(parent)).alias("level", "parent"))
    ruled = scratch.write(stacks.select(F.col("host").alias("parent")).distinct().withColumn("ruled", F.lit(True)))
    small = (labels["hosts"] or 0) <= BROADCAST_HOSTS
    keys = scratch.write(
        keys.join(F.broadcast(ruled) if small else ruled, "parent", "left").where("ruled or level = 0")
    )
    counts = keys.where("ruled").groupBy("parent").agg(F.count("*").alias("n"))
    total = keys.where("ruled").count()
    room = max(SWEEP_ROWS, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = scratch.write(counts.select("parent", F.ceil(F.col("n") / room).cast("int").alias("salts")))
    salts = F.broadcast(salts) if small else salts

    points = keys.where("ruled").join(salts, "parent").select(
        "parent",
        # Rows that repeat whole are dealt as well.
        F.pmod(F.xxhash64("id", "host", "path", F.monotonically_increasing_id()), F.col("salts")).cast("int").alias("salt"),
        reversed_host(F.col("parent")).alias("key"),
        "path",
        F.lit(1).alias("kind"),
        "id",
        "host",
        "level",
        F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"),
    )
    opens = stacks.withColumnRenamed("host", "parent").join(salts, "parent").select(
        "parent",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        reversed_host(F.col("parent")).alias("key"),
        "path",
        F.lit(0).alias("kind"),
        F.lit(None).cast(urls.schema["id"].dataType).alias("id"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("int").alias("level"),
        "stack",
    )
    sweep = Window.partitionBy("key", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = opens.union(points).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    hit = F.get(F.filter("open", lambda r: F.startswith(F.col("path"), r["path"])), 0)
    best = F.when(
        hit.isNotNull(),
        F.struct(
            F.length(hit["rule"]).alias("n"), F.length("parent").alias("h"), hit["verdict"].alias("verdict"), hit["rule"].alias("rule")
        ),
    )
    judged = swept.select("id", "host", "path", "level", best.alias("best"))
    bare = keys.where("ruled is null").select("id", "host", "path", "level", F.lit(None).cast(judged.schema["best"].dataType).alias("best"))
    # level 0 comes once for each row, so its count tells how often a row repeats.
    out = judged.union(bare).groupBy("id", "host", "path").agg(F.max("best").alias("best"), F.sum((F.col("level") == 0).cast("int")).alias("times"))
    # A row that repeats very often comes back from many tasks.
    often = out.where(F.col("times") > AGAIN_ROWS).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / AGAIN_ROWS))))
    left = F.least(F.col("times") - F.col("_run") * AGAIN_ROWS, F.lit(AGAIN_ROWS))
    often = often.withColumn("times", left).repartition("id", "host", "path", "_run").drop("_run")
    again = out.where(F.col("times") <= AGAIN_ROWS).unionByName(often).withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return again.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
