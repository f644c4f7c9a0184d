"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Raking scales the cells to the
target share of each source, then each language, then each topic, and again, until no
share moves. A cell's calibrated weight relative to its tokens is the rate at which
its documents are sampled. DataFrame operations only.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import Scratch

DIMENSIONS = ("source", "lang", "topic")
#: Targets not given are the observed token shares raised to this power.
TEMPER = 0.5
#: Tokens kept, as a share of all.
KEEP = 0.5
#: Rounds of raking in one plan, and the relative miss of a marginal that counts as met.
PER_PLAN, TOLERANCE = 10, 1e-7
#: Plans that leave more than this share of the miss, so many after each other, have stalled.
STALLED, STALLED_PLANS = 0.999, 3
#: Up to so many cells are raked in one task without a shuffle, more by sums of each category.
ONE_TASK_CELLS = 20_000
#: Categories of a dimension up to which its factors are broadcast to the cells.
BROADCAST_CATEGORIES = 100_000

#: What a text is about, told by its form: the first pattern that it holds.
TOPICS = (("table", r"\|[^|\n]*\|"), ("legal", r"(?i)licen[cs]e"), ("data", r"\d{4,}"), ("notice", r"!!"))


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Words between blanks, an estimate of tokens that needs no tokenizer; an empty text has 1."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.translate(t, " \n\t\r", "")) + 1).cast("long")


def _targets(cells: DataFrame, dim: str, given: dict[str, float] | None, temper: float, total: float) -> DataFrame:
    """(dim, target): shares that sum to 1 over the categories present."""
    weight = F.pow(F.sum("tokens") / F.lit(max(total, 1.0)), F.lit(temper))
    sums = cells.groupBy(dim).agg(weight.alias("w"))
    if given:
        fixed = F.create_map(*(F.lit(x) for pair in given.items() for x in pair))
        sums = sums.withColumn("w", F.coalesce(F.element_at(fixed, F.col(dim)).cast("double"), F.col("w")))
    return sums.select(dim, (F.col("w") / F.lit(sums.agg(F.sum("w")).first()[0] or 1.0)).alias(f"target_{dim}"))


def _rounds_in_one_task(cells: DataFrame, total: float, scratch: Scratch) -> DataFrame:
    """cells with weight and off after some rounds; sums are windows over the few cells of one task."""
    start = cells.coalesce(1).drop("off")
    for _ in range(PER_PLAN):
        for dim in DIMENSIONS:
            have = F.sum("weight").over(Window.partitionBy(dim))
            start = start.withColumn("weight", F.col("weight") * F.col(f"target_{dim}") * total / have)
    # The last dimension is met as the rounds leave it; the others tell.
    miss = [F.abs(F.sum("weight").over(Window.partitionBy(d)) / (F.col(f"target_{d}") * total) - 1) for d in DIMENSIONS]
    return scratch.write(start.withColumn("off", F.greatest(*miss)))


def _with_factors(cells: DataFrame, factors: dict[str, DataFrame], few: dict[str, bool]) -> DataFrame:
    for dim, table in factors.items():
        cells = cells.join(F.broadcast(table) if few[dim] else table, dim)
    return cells


def _rounds_by_sums(cells: DataFrame, total: float, scratch: Scratch) -> DataFrame:
    """The same for cells of any number: each step sums the cells by category, which combines in every task.

    What changes is a factor a category; the cells are read, never shuffled whole.
    """
    few = {d: cells.select(d).distinct().count() <= BROADCAST_CATEGORIES for d in DIMENSIONS}
    base = cells.drop("off")
    factors: dict[str, DataFrame] = {}
    for _ in range(PER_PLAN):
        for dim in DIMENSIONS:
            others = {d: t for d, t in factors.items() if d != dim}
            weight = F.col("weight")
            for d in others:
                weight = weight * F.col(f"f_{d}")
            sums = _with_factors(base, others, few).groupBy(dim).agg(F.sum(weight).alias("have"), F.first(f"target_{dim}").alias("t"))
            factors[dim] = scratch.write(sums.select(dim, (F.col("t") * total / F.col("have")).alias(f"f_{dim}")))
    scaled = F.col("weight")
    for d in DIMENSIONS:
        scaled = scaled * F.col(f"f_{d}")
    scaled_cells = scratch.write(_with_factors(base, factors, few).withColumn("weight", scaled).select(*base.columns))
    misses = {}
    for d in DIMENSIONS:
        miss = F.abs(F.sum("weight") / (F.first(f"target_{d}") * total) - 1)
        misses[d] = scaled_cells.groupBy(d).agg(miss.alias(f"off_{d}"))
    told = _with_factors(scaled_cells, misses, few)
    return scratch.write(told.withColumn("off", F.greatest(*(f"off_{d}" for d in DIMENSIONS))).select(*base.columns, "off"))


def rake(cells: DataFrame, scratch: Scratch, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER) -> DataFrame:
    """cells (source, lang, topic, tokens > 0) with weight, raked so that every marginal meets its target.

    Rounds go on until every marginal is within ``TOLERANCE`` of its target, however many
    that takes. Targets that contradict each other (a category lives only in cells of
    others) have no solution; the rounds then end at the last dimension's marginals once
    the others come no nearer, and a warning says so. Column off is the relative miss of
    the cell's worst marginal.
    """
    n = cells.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).first()
    total = float(n["tokens"] or 0)
    goals = [_targets(cells, dim, (targets or {}).get(dim), temper, total) for dim in DIMENSIONS]
    for dim, goal in zip(DIMENSIONS, goals, strict=True):
        cells = cells.join(goal, dim)
    cells = scratch.write(cells.withColumn("weight", F.col("tokens").cast("double")))
    best, stalled, done = float("inf"), 0, 0
    while True:
        moved = (_rounds_in_one_task if n["n"] <= ONE_TASK_CELLS else _rounds_by_sums)(cells, total, scratch)
        scratch.drop(cells)
        cells, done = moved, done + PER_PLAN
        gap = cells.agg(F.max("off")).first()[0]
        if gap is None or gap < TOLERANCE:
            return cells
        stalled = stalled + 1 if gap > STALLED * best else 0
        best = min(best, gap)
        if stalled == STALLED_PLANS:
            break
    warnings.warn(f"targets are not met: a marginal is off by {gap:.2g} of its target after {done} rounds", stacklevel=2)
    return cells


def sampling_rates(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """cells with p: min(1, c * weight / tokens), where c makes the expected tokens kept their share.

    Cells that c fills leave the rest of the budget to the others, which raises c; the
    few rounds until no more cells fill each bring two sums to the driver.
    """
    factor = F.col("weight") / F.col("tokens")
    budget = keep * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    c = 0.0
    while True:
        full = factor * F.lit(c) >= 1
        row = cells.agg(F.sum(F.when(full, F.col("tokens"))).alias("spent"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        if not row["rest"]:
            c = float("inf")
            break
        raised = (budget - float(row["spent"] or 0)) / row["rest"]
        if raised <= c * (1 + 1e-12):
            break
        c = raised
    return cells.select(*DIMENSIONS, "tokens", "weight", F.least(F.lit(1.0), F.lit(c) * factor).alias("p"))


def draw(id_col: str, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by id and seed; null ids share one."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = TEMPER,
    keep: float = KEEP,
    seed: int = 0,
    topic: Column | None = None,
) -> DataFrame:
    """Append topic, tokens, p and sampled to every row; filter on sampled for the mixture.

    topic: each row's topic, such as a classifier's label; by default ``topic_of`` the text.

    targets: shares by dimension (source, lang, topic) and category; categories not
    named get their observed share to the power ``temper``. Null sources or languages
    form the category "". Null text is empty; texts are counted whole, however long. Rows
    that share an id are drawn together.
    Columns of the appended names are replaced; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "mix")
    own = [c for c in df.columns if c not in ("topic", "tokens", "p", "sampled")]
    topic = topic_of(F.col(text_col)) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    with_cell = df.withColumns(
        {
            "_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
            "_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
            "_topic": topic,
            "_tokens": token_count(F.col(text_col)),
        }
    ).drop("topic", "tokens", "p", "sampled").withColumnsRenamed({"_topic": "topic", "_tokens": "tokens"})
    cells = scratch.write(
        with_cell.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), "topic").agg(F.sum("tokens").alias("tokens"))
    )
    rated = scratch.write(sampling_rates(rake(cells, scratch, targets, temper), keep))
    rates = rated.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), "topic", "p")
    few = rated.count() <= ONE_TASK_CELLS
    out = with_cell.join(F.broadcast(rates) if few else rates, ["_source", "_lang", "topic"], "left")
    return out.withColumn("sampled", draw(id_col, seed) < F.col("p")).select(*own, "topic", "tokens", "p", "sampled")
