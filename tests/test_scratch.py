"""Written tables go when their scope ends, and only those."""

import os

from papyra.operators import cluster as C
from papyra.operators.scratch import Scratch, released, shared_folder


def folders(spark):
    base = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    return {f for f in os.listdir(base) if f.startswith("papyra-")}


def test_tables_are_released(spark):
    x = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id long, embedding array<double>")
    outer = Scratch(spark, "outer").write(spark.range(3))
    before = folders(spark)
    with released(spark):
        got = C.clusters(x, 0.9).collect()
        kept = Scratch(spark, "inner").write(spark.range(5))
        with released(spark):
            Scratch(spark, "nested").write(spark.range(1))
            deep = folders(spark)
        assert kept.count() == 5 and len(folders(spark)) == len(deep) - 1 > len(before)
    assert folders(spark) == before and outer.count() == 3 and len(got) == 30
    Scratch(spark, "after").write(spark.range(1))
    assert len(folders(spark)) == len(before) + 1


def test_a_scope_that_fails_is_cleared(spark):
    before = folders(spark)
    try:
        with released(spark):
            Scratch(spark, "lost").write(spark.range(1))
            raise KeyError
    except KeyError:
        pass
    assert folders(spark) == before
