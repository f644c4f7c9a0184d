"""Job states: any cut of the stream gives the batch's log, and a restart repeats nothing."""

import random

import pytest
from pyspark.sql import functions as F

from papyra.functions import policy as P
from papyra.streaming import jobs as J

RAW = "job_id long, event_id long, s double, kind string, stage string, file string, number int"


def frame(spark, rows):
    return spark.createDataFrame(rows, RAW).withColumn("at", F.timestamp_seconds("s")).drop("s")


def log_of(df):
    return sorted((r["job_id"], r["seq"], r["at"].timestamp(), r["status"], r["cause"]) for r in df.collect())


def told(df, job):
    return [(s, c) for j, _, _, s, c in log_of(df) if j == job]


END = (99, 9999, 100_000.0, "set", "DONE", None, None)


def test_barrier_opens_with_the_last_file(spark):
    rows = [
        (1, 1, 1.0, "expect", None, None, 2), (1, 2, 2.0, "extracted", None, "a", None), (1, 3, 3.0, "extracted", None, "a", None),
        (1, 4, 4.0, "done", "READY_TO_INGEST", None, None), (1, 5, 5.0, "failed", "EXTRACTING", "b", None), (1, 6, 30.0, "extracted", None, "b", None),
        (1, 7, 31.0, "done", "READY_TO_INGEST", None, None), (1, 8, 32.0, "done", "READY_TO_INGEST", None, None), END,
    ]
    got = told(J.status_log(frame(spark, rows)), 1)
    assert got == [("EXTRACTING", "2 files"), ("EXTRACTING", "retry 1 of EXTRACTING b"), ("READY_TO_INGEST", "all files extracted"), ("INGESTED", "READY_TO_INGEST done")]


def test_retries_wait_and_give_up(spark):
    rows = [(1, 0, 0.0, "set", "INGESTED", None, None)] + [(1, i, 10.0 * i, "failed", "INGESTED", None, None) for i in range(1, 6)] + [END]
    rows += [(2, 0, 0.0, "set", "STRUCTURAL_GRAPH_BUILT", None, None), (2, 1, 1.0, "failed", "STRUCTURAL_GRAPH_BUILT", None, None), (2, 2, 5.0, "done", "STRUCTURAL_GRAPH_BUILT", None, None)]
    log = J.status_log(frame(spark, rows))
    assert [(at, c) for j, _, at, _, c in log_of(log) if j == 1] == [
        (0.0, "set"), (11.0, "retry 1 of INGESTED"), (22.0, "retry 2 of INGESTED"), (34.0, "retry 3 of INGESTED"), (40.0, "INGESTED failed"),
    ]
    assert told(log, 2) == [("STRUCTURAL_GRAPH_BUILT", "set"), ("GRAPH_SANITIZED", "STRUCTURAL_GRAPH_BUILT done")]
    assert {r["job_id"]: r["status"] for r in J.statuses(log).collect()} == {1: "FAILED", 2: "GRAPH_SANITIZED", 99: "DONE"}


def some_events(seed, n=300):
    rng = random.Random(seed)
    stages = list(P.STAGE_RETRIES)[:4]
    out = []
    for i in range(n):
        kind = rng.choice(("expect", "extracted", "extracted", "done", "done", "done", "failed", "failed", "set"))
        out.append((rng.randrange(4), i, float(i + rng.randrange(8)), kind, rng.choice(stages), rng.choice(("a", "b", None)), rng.choice((1, 2))))
    return [*out, END]


def stream(spark, folder, rows, cut, delay, shuffle=None):
    """Rows written in files of ``cut`` rows, one file a micro-batch."""
    for k in range(0, len(rows), cut):
        part = rows[k : k + cut]
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    run(spark, folder, delay)


def run(spark, folder, delay):
    schema = frame(spark, [END]).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    J.stream_status(source, str(folder / "out"), str(folder / "state"), delay).awaitTermination()


@pytest.mark.parametrize("cut", [60, 400])
def test_any_cut_gives_the_log_of_the_batch(spark, tmp_path, cut):
    rows = some_events(3)
    stream(spark, tmp_path, rows, cut, "20 seconds")
    want = log_of(J.status_log(frame(spark, rows), "20 seconds"))
    assert len(want) > 60 and log_of(J.read_log(spark, str(tmp_path / "out"))) == want


def test_a_restart_repeats_nothing(spark, tmp_path):
    rows = some_events(5)
    stream(spark, tmp_path, rows[:90], 90, "20 seconds")
    first = log_of(J.read_log(spark, str(tmp_path / "out")))
    assert first == log_of(J.status_log(frame(spark, rows[:90]), "20 seconds"))
    run(spark, tmp_path, "20 seconds")
    assert log_of(J.read_log(spark, str(tmp_path / "out"))) == first
    stream(spark, tmp_path, rows[90:], 80, "20 seconds")
    assert log_of(J.read_log(spark, str(tmp_path / "out"))) == log_of(J.status_log(frame(spark, rows), "20 seconds"))


def test_odd_rows(spark):
    odd = [(1, 1, None, "set", "X", None, None), (None, 2, 1.0, "set", "X", None, None), (1, 3, 1.0, None, None, None, None), (1, 4, 2.0, "done", None, None, None), (1, 5, 2.0, "expect", None, None, None)]
    assert J.status_log(frame(spark, odd)).count() == 0 and J.status_log(frame(spark, odd).limit(0)).count() == 0


def test_a_job_waits_on_one_timer():
    """Each timer that expires reads a job's whole state, so a job has one at its first event, not one at each."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.state, self.timers = None, []

        def getValueState(self, name, kind):
            return self

        def exists(self):
            return self.state is not None

        def get(self):
            return self.state

        def update(self, state):
            self.state = state

        def registerTimer(self, at):
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):
            return 50_000

    held = Held()
    processor = J.JobProcessor()
    processor.init(held)
    rows = pd.DataFrame({"at": pd.to_datetime(range(10, 110), unit="s"), "event_id": range(100), "kind": "set", "stage": "INGESTED", "file": None, "number": 1})
    list(processor.handleInputRows((7,), iter([rows]), held))
    assert held.timers == [10_000]
    out = list(processor.handleExpiredTimer((7,), held, None))
    assert len(out[0]) == 41 and held.timers == [10_000, 51_000]
