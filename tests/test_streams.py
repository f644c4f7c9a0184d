"""Streams that resume: nothing is lost or repeated over restarts, and late rows are defined."""

from pyspark.sql import functions as F

from papyra.operators import ingest as I
from papyra.streaming import ingest as S


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")


def arrive(spark, folder, rows):
    docs(spark, rows).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def test_blocks_resume(spark, tmp_path):
    first = [(i, f"One {i}. Two {i}! Three?", i) for i in range(20)]
    more = [(i, f"Four {i}. Five {i}!", i) for i in range(20, 30)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        return sorted(map(tuple, S.stream_blocks(S.source(spark, str(tmp_path / "in"), 1), out, state).collect()))

    def want(rows):
        return sorted(map(tuple, I.slice_sources(docs(spark, rows), "doc_id", "text").collect()))

    arrive(spark, tmp_path, first)
    assert go() == want(first)
    kept = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert go() == want(first) and sorted(p.name for p in (tmp_path / "out").iterdir()) == kept
    arrive(spark, tmp_path, more)
    assert go() == want(first + more)


def test_first_seen_over_restarts(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        rows = S.source(spark, str(tmp_path / "in"), 1)
        return {r["key"]: r["first_seen"] for r in S.stream_first_seen(rows, F.col("text"), out, state).collect()}

    arrive(spark, tmp_path, [(5, "a", 0), (7, "b", 0), (3, "b", 0)])
    assert go() == {"a": 5, "b": 3}
    arrive(spark, tmp_path, [(2, "b", 0), (9, "a", 0), (4, "c", 0)])
    assert go() == {"a": 5, "b": 2, "c": 4}


def test_new_papers_over_restarts_and_late(spark, tmp_path):
    """Seen before is dropped, also after a restart; too late is dropped; forgotten is new again."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go(*rows):
        arrive(spark, tmp_path, rows)
        found = S.stream_new(S.source(spark, str(tmp_path / "in"), 1), F.col("text"), "at", out, state, "100 seconds")
        return sorted(r["doc_id"] for r in found.collect())

    assert go((1, "a", 1000), (2, "b", 1010)) == [1, 2]
    assert go((3, "a", 1050), (4, "c", 1060)) == [1, 2, 4]
    assert go((5, "late but in time", 970), (6, "d", 1400)) == [1, 2, 4, 5, 6]
    # The watermark is at 1300 now: an earlier row is dropped, and what was seen up to 1010 is forgotten.
    assert go((7, "too late", 1200), (8, "a", 1390)) == [1, 2, 4, 5, 6, 8]
    assert go((9, "d", 1399)) == [1, 2, 4, 5, 6, 8]
