"""Path hypotheses over pair edges: discovery, filters, verification, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy as P
from . import evidence as E
from .scratch import Scratch


_HOP = ["predicates", "support"]


def one_way_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that are no loop and have no reverse."""
    back = pairs.select(F.col("object").alias("_s"), F.col("subject").alias("_o"))
    return pairs.where("subject <> object").join(back, (F.col("subject") == F.col("_s")) & (F.col("object") == F.col("_o")), "left_anti")


def first_hops(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("subject").alias("source"), F.col("object").alias("mid"), *(F.col(c).alias(f"{c}_1") for c in _HOP if c in pairs.columns))


def second_hops(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("subject").alias("mid"), F.col("object").alias("target"), *(F.col(c).alias(f"{c}_2") for c in _HOP if c in pairs.columns))


def still_open(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paths whose ends differ and that no pair joins, either way."""
    ends = pairs.select(F.col("subject").alias("_s"), F.col("object").alias("_o"))
    paths = paths.where("source <> target").join(ends, (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_o")), "left_anti")
    return paths.join(ends, (F.col("source") == F.col("_o")) & (F.col("target") == F.col("_s")), "left_anti")


def as_nodes(nodes: list[str] | DataFrame, like: DataFrame) -> DataFrame:
    """A list or a table (column node) of nodes as a table."""
    if isinstance(nodes, DataFrame):
        return nodes.select("node").distinct()
    return like.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(nodes)], "node string")


def effective_seeds(seeds: list[str] | DataFrame | None, affected: DataFrame) -> DataFrame:
    """Seeds and affected nodes united (column node), each once."""
    mine = as_nodes(seeds if seeds is not None else [], affected)
    return mine.union(affected.select("node")).distinct()


def discovery_paths(pairs: DataFrame, seeds: list[str] | DataFrame | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """A -> B -> C with A, B, C distinct and no edge A-C or C-A nor a way back along either hop.

    pairs: pair edges, hubs already suppressed; predicates and support go along with the
    hops if they are there. Pairs with a reverse drop out of both
    sides before the self-join; edges between the ends are tested against all pairs.
    seeds (a list, or a table with column node) keep paths that start or end in one; none
    at all keep no path. The seed test is a union of two narrowed joins, so it prunes
    before the self-join.
    """
    one_way = one_way_pairs(pairs)
    first, second = first_hops(one_way), second_hops(one_way)
    if stop_words:
        first = first.where(~F.lower("mid").isin([w.lower() for w in stop_words]))
    if seeds is None:
        both = first.join(second, "mid")
    else:
        named = as_nodes(seeds, pairs)
        begin = first.join(named, first["source"] == named["node"], "left_semi").join(second, "mid")
        others = first.join(named, first["source"] == named["node"], "left_anti")
        both = begin.union(others.join(second.join(named, second["target"] == named["node"], "left_semi"), "mid"))
    return still_open(both, pairs)


def hypotheses_of(paths: DataFrame, mode: str = "explore") -> DataFrame:
    """Hypothesis rows: confidence is the weaker hop, predicates follow the hops; ids: ``evidence.hypotheses_with_ids``."""
    said = F.concat(
        F.col("source"), F.lit(" -["), F.array_join("predicates_1", ", "), F.lit("]-> "), F.col("mid"),
        F.lit(" then "), F.col("mid"), F.lit(" -["), F.array_join("predicates_2", ", "), F.lit("]-> "), F.col("target"),
    )
    return paths.select(
        "source",
        "target",
        F.array("source", "mid", "target").alias("path"),
        F.concat("predicates_1", "predicates_2").alias("predicates"),
        said.alias("explanation"),
        F.least("support_1", "support_2").cast("int").alias("confidence"),
        F.lit(mode).alias("mode"),
    )


def boosted(confidence: Column, factor: float) -> Column:
    """floor(confidence * factor), at most 100; the factor is held between 1 and 2."""
    return F.least(F.floor(confidence * F.lit(min(max(factor, 1.0), 2.0))), F.lit(100)).cast("int")


def boost(hypotheses: DataFrame, preferred: list[str], factor: float = P.PREDICATE_BOOST) -> DataFrame:
    """Raise the confidence of hypotheses that use a preferred predicate."""
    names = F.array(*(F.lit(p.lower()) for p in preferred)).cast("array<string>")
    hit = F.arrays_overlap(F.transform("predicates", lambda p: F.lower(p)), names)
    return hypotheses.withColumn("confidence", F.when(hit, boosted(F.col("confidence"), factor)).otherwise(F.col("confidence")))


def all_generic(predicates: Column) -> Column:
    return (F.size(predicates) > 0) & F.forall(predicates, lambda p: F.lower(p).isin(P.GENERIC_PREDICATES))


def filter_hypotheses(hypotheses: DataFrame, all_pairs: DataFrame | None = None, least: int = P.MIN_CONFIDENCE) -> DataFrame:
    """Tier one removes (rejection_type permanent is only reported by ``rejections``), tier two flags.

    Kept rows get passed_filter, filter_reason and rejection_type; weak evidence alone
    is ``extractable``. all_pairs is the graph before hub suppression, for novelty.
    """
    return with_rejection(hypotheses, all_pairs, least).where("rejection_type is null or rejection_type <> 'permanent'")


def with_rejection(hypotheses: DataFrame, all_pairs: DataFrame | None = None, least: int = P.MIN_CONFIDENCE) -> DataFrame:
    """Every hypothesis with its verdict: the first permanent rule that fails, else weak evidence."""
    known = F.lit(False)
    if all_pairs is not None:
        direct = all_pairs.select(F.col("subject").alias("source"), F.col("object").alias("target")).distinct()
        hypotheses = hypotheses.join(direct.withColumn("_direct", F.lit(True)), ["source", "target"], "left")
        known = F.col("_direct").isNotNull()
    weak = F.col("confidence") < least
    reason = (
        F.when(all_generic(F.col("predicates")), F.create_map(F.lit("predicate_semantics"), F.lit("All predicates are generic")))
        .when(known, F.create_map(F.lit("novelty"), F.lit("Direct edge exists")))
        .when(weak, F.create_map(F.lit("evidence_threshold"), F.concat(F.lit("Confidence "), F.col("confidence").cast("string"), F.lit(f" < {least}"))))
    )
    kind = F.when(all_generic(F.col("predicates")) | known, "permanent").when(weak, "extractable")
    return hypotheses.withColumns({"passed_filter": kind.isNull(), "filter_reason": reason, "rejection_type": kind}).drop("_direct")


def is_promising(passed: Column, reason: Column) -> Column:
    """Not passed, and for weak evidence only."""
    only = F.map_keys(reason) == F.array(F.lit("evidence_threshold"))
    return ~passed & F.coalesce(only, F.lit(False))


PATTERNS = ("direct_forward", "direct_reverse", "2hop_forward", "2hop_reverse", "common_cause", "collider")
#: Neighbours of a node that one join key holds about.
BUCKET = 1024


def _neighbours(links: DataFrame, end: str, other: str, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(node, its degree; node, bucket, neighbour and its other columns) of one direction: a hub's neighbours are dealt into many buckets.

    Degrees and hubs are written: hubs are at most one in ``bucket`` of the links, so the
    planner can see that they fit a broadcast and the links need not move to meet them.
    """
    scratch = Scratch(links.sparkSession, "degrees")
    degree = scratch.write(links.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("degree")))
    hubs = scratch.write(degree.where(F.col("degree") > bucket))
    kept = [c for c in links.columns if c not in (end, other)]
    dealt = links.select(F.col(end).alias("node"), F.col(other).alias("mid"), *kept).join(hubs, "node", "left")
    width = F.ceil(F.coalesce("degree", F.lit(1)) / F.lit(float(bucket)))
    return degree, dealt.select("node", F.pmod(F.xxhash64("mid"), width).alias("bucket"), "mid", *kept)


def expansions(asked: DataFrame, links: DataFrame, ways: tuple[str, str], bucket: int = BUCKET) -> DataFrame:
    """source, target, from_source, mid and the links' other columns: for every question the neighbours of its lighter end.

    ways: ``out`` or ``in``, how the source and the target are tied to the middle. A
    question with an end that has no such neighbour has no rows. The end to test a middle
    with is the target where it comes from the source, else the source.
    """
    side = {"out": ("u", "v"), "in": ("v", "u")}
    deg_s, near = _neighbours(links, *side[ways[0]], bucket)
    deg_t, key = deg_s, ["node", "bucket"]
    if ways[0] != ways[1]:
        deg_t, near_t = _neighbours(links, *side[ways[1]], bucket)
        near = near.withColumn("from_source", F.lit(True)).union(near_t.withColumn("from_source", F.lit(False)))
        key = [*key, "from_source"]
    sized = asked.select("source", "target").join(deg_s.withColumnRenamed("node", "source").withColumnRenamed("degree", "ds"), "source")
    sized = sized.join(deg_t.withColumnRenamed("node", "target").withColumnRenamed("degree", "dt"), "target")
    light = F.col("ds") <= F.col("dt")
    width = F.ceil(F.least("ds", "dt") / F.lit(float(bucket)))
    dealt = sized.select(
        "source", "target", light.alias("from_source"), F.when(light, F.col("source")).otherwise(F.col("target")).alias("node"),
        F.explode(F.sequence(F.lit(0).cast("long"), width - 1)).alias("bucket"),
    )
    met = dealt.join(near, key).where((F.col("mid") != F.col("source")) & (F.col("mid") != F.col("target")))
    return met.select("source", "target", "from_source", "mid", *(c for c in links.columns if c not in ("u", "v")))


def _far() -> Column:
    return F.when(F.col("from_source"), F.col("target")).otherwise(F.col("source"))


def wedges(asked: DataFrame, links: DataFrame, ways: tuple[str, str], bucket: int = BUCKET) -> DataFrame:
    """(source, target, mid): the least middle that ties a question's ends so.

    The lighter end is expanded and each middle tested by its link to the other end, so a
    hub costs what its partner has, and its own link only as a key of the test.
    """
    grown = expansions(asked, links.select("u", "v"), ways, bucket).withColumn("far", _far())
    ties = {"out": links.select(F.col("u").alias("far"), F.col("v").alias("mid")), "in": links.select(F.col("v").alias("far"), F.col("u").alias("mid"))}
    hit = grown.where("from_source").join(ties[ways[1]], ["far", "mid"], "left_semi").unionByName(grown.where("not from_source").join(ties[ways[0]], ["far", "mid"], "left_semi"))
    return hit.groupBy("source", "target").agg(F.min("mid").alias("mid"))


#: How a node is tied to another: a link to it, a link from it, or both.
_OUT, _IN = 1, 2
#: The same for a question that is asked of the two.
_ASKED = 4


def _has(bits: Column, bit: int) -> Column:
    return bits.bitwiseAND(F.lit(bit)) != 0


def _turned(tie: Column) -> Column:
    """The tie as the other node has it."""
    return F.when(_has(tie, _OUT), F.lit(_IN)).otherwise(F.lit(0)) + F.when(_has(tie, _IN), F.lit(_OUT)).otherwise(F.lit(0))


def _unordered(pairs: DataFrame, a: str, b: str, bit: int) -> DataFrame:
    """lo, hi and bits of (a, b): the bit if a is lo, twice the bit if not. Pairs with a null stay as they are."""
    turn = F.coalesce(F.col(a) > F.col(b), F.lit(False))
    return pairs.select(
        F.when(turn, F.col(b)).otherwise(F.col(a)).alias("lo"),
        F.when(turn, F.col(a)).otherwise(F.col(b)).alias("hi"),
        F.when(turn, F.lit(2 * bit)).otherwise(F.lit(bit)).alias("bits"),
    )


_WEDGES = ("forward", "backward", "cause", "effect")


def middles(asked: DataFrame, links: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """source, target, forward, backward, cause and effect: the least middle of each kind, null where there is none; no row without any.

    asked: distinct pairs. links: lo, hi and tie, a row for every two nodes that a link
    joins either way, lo not after hi. All four kinds are found in one expansion of the
    end of fewer neighbours, each middle tested by its row with the other end.
    """
    lo, hi, tie = F.col("lo"), F.col("hi"), F.col("tie")
    ends = F.array(F.struct(lo.alias("u"), hi.alias("v"), tie.alias("tie")), F.struct(hi.alias("u"), lo.alias("v"), _turned(tie).alias("tie")))
    grown = expansions(asked, links.where("lo <> hi").select(F.inline(ends)), ("out", "out"), bucket)
    far, mid = _far(), F.col("mid")
    tested = links.withColumnRenamed("tie", "_tie")
    hit = grown.join(tested, (F.least(far, mid) == F.col("lo")) & (F.greatest(far, mid) == F.col("hi")))
    other = F.when(far < mid, F.col("_tie")).otherwise(_turned(F.col("_tie")))
    hit = hit.select(
        "source", "target", "mid",
        F.when(F.col("from_source"), tie).otherwise(other).alias("s"),
        F.when(F.col("from_source"), other).otherwise(tie).alias("t"),
    )
    kinds = zip(_WEDGES, ((_OUT, _IN), (_IN, _OUT), (_IN, _IN), (_OUT, _OUT)), strict=True)
    return hit.groupBy("source", "target").agg(*(F.min(F.when(_has(F.col("s"), x) & _has(F.col("t"), y), mid)).alias(kind) for kind, (x, y) in kinds))


def verify_pairs(questions: DataFrame, edges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """connection_type and path of each (source, target): the first pattern of the ladder that holds.

    Two-hop ways go through the middle of least first-edge position (edge rows in
    order of subject, predicate, object); common causes and colliders through the first
    node in the order of nodes. Ends that the graph lacks give ``none``. Question rows
    are distinct pairs. Links and questions of the same two nodes, either way round, become
    one row, which settles direct ties; what is left open is asked once for both ways.
    """
    scratch = Scratch(edges.sparkSession, "verify")
    links = _unordered(edges.where("subject is not null and object is not null"), "subject", "object", _OUT)
    known = scratch.write(links.union(_unordered(questions, "source", "target", _ASKED)).groupBy("lo", "hi").agg(F.bit_or("bits").alias("bits")))
    known = known.select("lo", "hi", F.col("bits").bitwiseAND(F.lit(_OUT | _IN)).alias("tie"), (F.col("bits") / _ASKED).cast("int").alias("asked"))
    asked = known.where("asked > 0")
    left = asked.where("tie = 0").select(F.col("lo").alias("source"), F.col("hi").alias("target"))
    found = scratch.write(middles(left, known.where("tie > 0").select("lo", "hi", "tie"), bucket)).toDF("lo", "hi", *_WEDGES)
    direct = asked.where("tie > 0").select("*", *(F.lit(None).cast(found.schema[w].dataType).alias(w) for w in _WEDGES))
    both = direct.unionByName(asked.where("tie = 0").join(found, ["lo", "hi"], "left"))

    def way(source: str, target: str, tie: Column, bit: int, forward: str, backward: str) -> Column:
        ends = [F.col(source).alias("source"), F.col(target).alias("target"), tie.alias("tie"), _has(F.col("asked"), bit).alias("asked")]
        return F.struct(*ends, F.col(forward).alias("forward"), F.col(backward).alias("backward"), "cause", "effect")

    two = F.array(way("lo", "hi", F.col("tie"), _OUT, "forward", "backward"), way("hi", "lo", _turned(F.col("tie")), _IN, "backward", "forward"))
    rows = both.select(F.inline(two)).where("asked")
    s, t, tie = F.col("source"), F.col("target"), F.col("tie")
    tests = [(_has(tie, _OUT), F.array(s, t)), (_has(tie, _IN), F.array(t, s))]
    tests += [(F.col(w).isNotNull(), F.array(t, F.col(w), s) if w == "backward" else F.array(s, F.col(w), t)) for w in _WEDGES]
    kind = F.coalesce(*(F.when(holds, F.lit(name)) for name, (holds, _) in zip(PATTERNS, tests, strict=True)), F.lit("none"))
    return rows.select("source", "target", kind.alias("connection_type"), F.coalesce(*(F.when(holds, path) for holds, path in tests)).alias("path"))


def supporting_papers(hypotheses: DataFrame, pairs: DataFrame, edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, target, path, paper_id, predicates): per source of each hop, its predicates with repetition."""
    hops = E.hops_of(hypotheses.withColumn("_path", F.col("path")), "source", "target", "_path").withColumnRenamed("_path", "path")
    ends = hops.select("subject", "object").distinct()
    papers = E.sources_of_pairs(ends, edges, blocks).withColumnRenamed("source_id", "paper_id")
    said = papers.join(pairs.select("subject", "object", "predicates"), ["subject", "object"])
    return (
        hops.join(said, ["subject", "object"])
        .groupBy("source", "target", "path", "paper_id")
        .agg(F.sort_array(F.collect_list(F.struct("hop", "predicates"))).alias("h"))
        .select("source", "target", "path", "paper_id", F.flatten(F.transform("h", lambda x: x["predicates"])).alias("predicates"))
    )


def project_graph(hypotheses: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to plot: nodes of paths, and their hops with predicate, support and use.

    A hop takes the predicates of the edges between its ends, forward first, else
    backward, compared trimmed and in lower case; a hop without an edge keeps its place
    with predicate ``related_to`` and no support.
    """
    hops = (
        hypotheses.select("path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("hop"))
        .select(F.get("path", F.col("hop") - 1).alias("u"), F.get("path", F.col("hop")).alias("v"), F.array_join("path", " > ").alias("p"))
        .groupBy("u", "v")
        .agg(F.countDistinct("p").alias("used_in_hypotheses"))
    )

    def norm(c: str) -> Column:
        return F.lower(F.trim(F.col(c)))

    keyed = edges.groupBy(norm("subject").alias("a"), norm("object").alias("b"), "predicate").agg(F.sum("support").alias("support"))
    hops = hops.withColumns({"ku": norm("u"), "kv": norm("v")})
    forward = hops.join(keyed, (F.col("ku") == F.col("a")) & (F.col("kv") == F.col("b")), "left").drop("a", "b")
    hit = forward.where("predicate is not null")
    miss = forward.where("predicate is null").drop("predicate", "support")
    back = miss.join(keyed, (F.col("ku") == F.col("b")) & (F.col("kv") == F.col("a")), "left").drop("a", "b")
    out = hit.unionByName(back).select(
        "u", "v", F.coalesce("predicate", F.lit(P.FALLBACK_PREDICATE)).alias("predicate"), F.coalesce("support", F.lit(0)).alias("support"), "used_in_hypotheses"
    )
    nodes = hypotheses.select(F.explode("path").alias("node"), F.array_join("path", " > ").alias("p")).groupBy("node").agg(F.countDistinct("p").alias("used_in_hypotheses"))
    return nodes, out


def pair_groups(hypotheses: DataFrame) -> DataFrame:
    """(source, target, pair_score, max_confidence, n, intermediates): 1.0 passed, 0.5 promising, summed by pair."""
    score = F.when(F.col("passed_filter"), 1.0).when(is_promising(F.col("passed_filter"), F.col("filter_reason")), 0.5).otherwise(0.0)
    return (
        hypotheses.withColumn("mid", F.explode_outer(F.slice("path", 2, 1)))
        .groupBy("source", "target")
        .agg(
            F.sum(score).alias("pair_score"),
            F.max("confidence").alias("max_confidence"),
            F.count("*").alias("n"),
            F.sort_array(F.collect_set("mid")).alias("intermediates"),
            F.max(F.col("passed_filter").cast("int")).alias("any_passed"),
        )
    )


def top_pairs(hypotheses: DataFrame, k: int = P.TOP_HYPOTHESES) -> DataFrame:
    """The k pair groups of the highest score, then confidence, then source and target."""
    return pair_groups(hypotheses).orderBy(F.desc("pair_score"), F.desc("max_confidence"), "source", "target").limit(k)


def diverse_leads(hypotheses: DataFrame, k: int = P.LEADS) -> DataFrame:
    """The best hypothesis of each pair, passed ones before promising ones, by confidence; the first k."""
    ready = hypotheses.where(F.col("passed_filter") | is_promising(F.col("passed_filter"), F.col("filter_reason")))
    within = Window.partitionBy("source", "target").orderBy(F.desc("passed_filter"), F.desc("confidence"), F.array_join("path", " > "))
    leaders = ready.withColumn("_r", F.row_number().over(within)).where("_r = 1").drop("_r")
    return leaders.orderBy(F.desc("passed_filter"), F.desc("confidence"), "source", "target").limit(k)


def page(hypotheses: DataFrame, limit: int, offset: int = 0, rejected: bool = True) -> DataFrame:
    """A page of hypotheses by confidence, then source, target and path."""
    if not rejected:
        hypotheses = hypotheses.where("passed_filter")
    return hypotheses.orderBy(F.desc("confidence"), "source", "target", F.array_join("path", " > ")).offset(offset).limit(limit)
