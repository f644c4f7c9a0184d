import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import mixing, queries
from papyra.operators.scratch import Scratch


def plain_rates(m, keep, temper, targets=None):
    """Raking and water filling over a pandas frame of cells."""
    total = m.tokens.sum()
    cell = m.groupby(list(mixing.DIMENSIONS), as_index=False).tokens.sum()
    goal = {}
    for d in mixing.DIMENSIONS:
        share = (cell.groupby(d).tokens.sum() / total) ** temper
        for k, v in (targets or {}).get(d, {}).items():
            share[k] = v
        goal[d] = share / share.sum()
    w = cell.tokens.astype(float)
    for _ in range(300):
        for d in mixing.DIMENSIONS:
            w = w * cell[d].map(goal[d]) * total / w.groupby(cell[d]).transform("sum")
    cell["weight"], cell["f"] = w, w / cell.tokens
    lo, hi = 0.0, 1e6
    for _ in range(200):
        c = (lo + hi) / 2
        if (cell.tokens * np.minimum(1, c * cell.f)).sum() < total * keep:
            lo = c
        else:
            hi = c
    cell["expected"] = np.minimum(1, hi * cell.f)
    return cell, goal


def test_query_equals_plain_raking(spark, sf_dir):
    m = queries.op2_mixing(spark, sf_dir).toPandas()
    cell, _ = plain_rates(m, mixing.KEEP, mixing.TEMPER)
    j = m.merge(cell, on=list(mixing.DIMENSIONS))
    assert len(j) == len(m)
    assert (j.p - j.expected).abs().max() < 2e-6


def test_given_targets_are_met(spark):
    rows = [("a", "en", "prose", 100), ("a", "fr", "prose", 300), ("b", "en", "prose", 50), ("b", "fr", "prose", 70), ("b", "fr", "table", 40), ("a", "en", "table", 60)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    out = mixing.rake(cells, Scratch(spark, "t"), {"lang": {"en": 0.5, "fr": 0.5}, "source": {"a": 0.25, "b": 0.75}}).toPandas()
    assert abs(out[out.lang == "en"].weight.sum() / out.weight.sum() - 0.5) < 1e-6
    assert abs(out[out.source == "b"].weight.sum() / out.weight.sum() - 0.75) < 1e-6


def test_contradicting_targets_say_so(spark):
    rows = [("a", "en", "prose", 100), ("b", "fr", "prose", 300)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="not met"):
        out = mixing.rake(cells, Scratch(spark, "t"), {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.1, "fr": 0.9}}).toPandas()
    assert abs(out[out.lang == "en"].weight.sum() / out.weight.sum() - 0.1) < 1e-6


def test_slow_targets_are_met_all_the_same(spark, recwarn):
    """Targets at the edge of what the cells allow take hundreds of rounds, and get them."""
    rows = [("a", "en", "prose", 1000), ("a", "fr", "prose", 1), ("b", "en", "prose", 1), ("b", "fr", "prose", 1000)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    out = mixing.rake(cells, Scratch(spark, "t"), {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.4, "fr": 0.6}}).toPandas()
    assert abs(out[out.lang == "en"].weight.sum() / out.weight.sum() - 0.4) < 1e-6
    assert abs(out[out.source == "a"].weight.sum() / out.weight.sum() - 0.5) < 1e-6
    assert not [w for w in recwarn if "not met" in str(w.message)]


@pytest.mark.parametrize("few", [0, 100_000])
def test_many_cells_are_raked_by_sums(spark, monkeypatch, few):
    """The way for many cells gives the same weights, with factors broadcast or joined by shuffle, and no window."""
    rng = np.random.default_rng(4)
    rows = [(f"s{i}", lang, topic, int(rng.integers(1, 900))) for i in range(9) for lang in ("en", "fr", "de") for topic in ("x", "y") if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    goal = {"lang": {"en": 0.2, "fr": 0.3, "de": 0.5}}
    key = list(mixing.DIMENSIONS)
    one = mixing.rake(cells, Scratch(spark, "t"), goal).toPandas().sort_values(key)
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_CATEGORIES", few)
    monkeypatch.setattr(mixing, "PER_PLAN", 5)
    many = mixing.rake(cells, Scratch(spark, "t"), goal).toPandas().sort_values(key)
    assert len(one) == len(many) == len(rows)
    assert np.allclose(one.weight.to_numpy(), many.weight.to_numpy(), rtol=1e-5) and many.off.max() < mixing.TOLERANCE


def test_a_given_topic_takes_the_place_of_the_form(spark):
    df = spark.createDataFrame([(1, "one two", "s", "en", "x"), (2, "three", "s", "en", None)], "doc_id long, text string, source string, lang string, topic string")
    got = mixing.mix(df, topic=F.col("topic"), keep=1.0).orderBy("doc_id").collect()
    assert [(r["topic"], r["tokens"], r["sampled"]) for r in got] == [("x", 2, True), ("", 1, True)]


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = queries.op2_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_edges(edge_docs, empty_docs):
    got = mixing.mix(edge_docs).toPandas()
    assert len(got) == edge_docs.count()
    assert got.p.between(0, 1).all()
    assert got[got.doc_id == 2].sampled.nunique() == 1
    assert mixing.mix(empty_docs).count() == 0


def test_draw_is_uniform(spark):
    u = spark.range(4000).select(mixing.draw("id").alias("u")).toPandas().u
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03
