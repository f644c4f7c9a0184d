"""Jobs as keyed state: statuses, retries that wait, and a barrier over a job's files.

Events of a job are kept until the watermark has passed them and are then taken in the
order of their time and id, with retries that fall due in between. So the log is the
same for any cut of the stream into micro-batches and any disorder within the delay,
and the same as that of a batch over the same events. A restart goes on from the
checkpoint and repeats no row.

Events have job_id, event_id, at (a timestamp), kind, stage, file and number:

* ``expect``: a number of files must be extracted before the job may be ingested;
* ``extracted``: one of them is; the last one opens the barrier (READY_TO_INGEST);
* ``done``: the stage that a status starts has ended; it counts only if the job still has that status;
* ``failed``: a stage, or the extraction of a file, has failed: it is tried again after its wait, or the job fails;
* ``set``: a status given by hand, which ends whatever was waiting.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..cluster import ship
from ..functions import policy as P
from ..operators.intake import progress_event

EVENT = "job_id long, event_id long, at timestamp, kind string, stage string, file string, number int"
LOG = "job_id long, seq int, at timestamp, status string, cause string"
WAITING, READY, FAILED = "EXTRACTING", "READY_TO_INGEST", "FAILED"


class Job:
    """The state of one job, as JSON between calls; ``log`` collects (seq, at in ms, status, cause)."""

    def __init__(self, state: str | None = None):
        held = json.loads(state) if state else {}
        self.status, self.seq = held.get("status"), held.get("seq", 0)
        self.expected, self.files = held.get("expected", 0), held.get("files", [])
        self.tries, self.due = held.get("tries", {}), held.get("due", [])
        self.events = held.get("events", [])
        self.log: list[tuple[int, int, str, str]] = []

    def state(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("status", "seq", "expected", "files", "tries", "due", "events")})

    def _say(self, at: int, cause: str) -> None:
        self.seq += 1
        self.log.append((self.seq, at, self.status, cause))

    def _move(self, at: int, status: str, cause: str) -> None:
        self.status, self.tries, self.due = status, {}, []
        self._say(at, cause)

    def _fail(self, at: int, stage: str, file: str | None) -> None:
        most, wait = P.STAGE_RETRIES.get(stage, (0, 0))
        name = stage if file is None else f"{stage} {file}"
        tries = self.tries[name] = self.tries.get(name, 0) + 1
        if tries > most:
            self._move(at, FAILED, f"{name} failed")
        else:
            self.due.append([at + 1000 * (2 ** (tries - 1) if wait is None else wait), name, tries])

    def _apply(self, at: int, kind: str, stage: str | None, file: str | None, number: int | None) -> None:
        if kind == "expect" and number:
            if self.status != WAITING:
                self.expected, self.files = 0, []
                self._move(at, WAITING, f"{number} files")
            self.expected += number
        elif kind == "extracted" and self.status == WAITING and file is not None and file not in self.files:
            self.files.append(file)
            self.due = [d for d in self.due if d[1] != f"{WAITING} {file}"]
            if len(self.files) >= self.expected:
                self.expected, self.files = 0, []
                self._move(at, READY, "all files extracted")
        elif kind == "done" and stage is not None and stage == self.status and stage in P.STAGE_AFTER:
            self._move(at, P.STAGE_AFTER[stage], f"{stage} done")
        elif kind == "failed" and stage is not None and stage == self.status and (stage != WAITING or (file is not None and file not in self.files)):
            self._fail(at, stage, file if stage == WAITING else None)
        elif kind == "set" and stage is not None:
            self.expected, self.files = 0, []
            self._move(at, stage, "set")

    def _retry(self, until: int) -> None:
        for due, name, tries in sorted(d for d in self.due if d[0] <= until):
            self.due.remove([due, name, tries])
            self._say(due, f"retry {tries} of {name}")

    def run(self, until: int) -> None:
        """Take all events and due retries up to a time, in order; a retry goes before an event of its time."""
        ready = sorted((e for e in self.events if e[0] <= until), key=lambda e: (e[0], e[1]))
        self.events = [e for e in self.events if e[0] > until]
        for at, _, kind, stage, file, number in ready:
            self._retry(at)
            self._apply(at, kind, stage, file, number)
        self._retry(until)

    def next(self) -> int | None:
        """The time of the first event or retry that waits."""
        return min((x[0] for x in (*self.events, *self.due)), default=None)

    def add(self, rows: pd.DataFrame) -> None:
        for r in rows.itertuples(index=False):
            number = None if pd.isna(r.number) else int(r.number)
            self.events.append([int(pd.Timestamp(r.at).timestamp() * 1000), int(r.event_id), r.kind, _text(r.stage), _text(r.file), number])

    def rows(self, job_id: int) -> pd.DataFrame:
        seq, at, status, cause = zip(*self.log, strict=True) if self.log else ((), (), (), ())
        self.log = []
        # Texts as plain objects: Arrow-backed ones come in chunks, which the stateful operator does not take.
        texts = {k: pd.Series(list(v), dtype=object) for k, v in (("status", status), ("cause", cause))}
        return pd.DataFrame({"job_id": [job_id] * len(seq), "seq": list(seq), "at": pd.to_datetime(list(at), unit="ms"), **texts})


def _text(v) -> str | None:
    return v if isinstance(v, str) else None


class JobProcessor(StatefulProcessor):
    """A job's state, with a timer at the first event or retry that waits; a timer at each would read the state as often."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("job", "state string")

    def _load(self) -> Job:
        return Job(self.held.get()[0] if self.held.exists() else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job = self._load()
        before = job.next()
        for part in rows:
            job.add(part)
        first = job.next()
        if first is not None and first != before:
            self.handle.registerTimer(first)
        self.held.update((job.state(),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self._load()
        # All that the watermark has passed, so a retry that falls due meanwhile needs no further batch.
        job.run(timerValues.getCurrentWatermarkInMs())
        first = job.next()
        if first is not None:
            self.handle.registerTimer(first)
        self.held.update((job.state(),))
        out = job.rows(key[0])
        return iter([out] if len(out) else ())

    def close(self) -> None:
        pass


def _typed(events: DataFrame) -> DataFrame:
    fields = [f.split(" ") for f in EVENT.split(", ")]
    return events.select(*(F.col(name).cast(kind).alias(name) for name, kind in fields)).where("job_id is not null and event_id is not null and at is not null")


def status_log(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The log of all jobs as a batch: of events up to the greatest time less the delay.

    Rows without job, id or time are left out. A task holds one job's events.
    """
    ship(events.sparkSession)
    rows = _typed(events)
    last = F.floor(F.unix_millis(F.max("at") - F.expr(f"INTERVAL {delay}")))
    until = rows.agg(last).first()[0]
    if until is None:
        return rows.sparkSession.createDataFrame([], LOG)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        job = Job()
        job.add(part)
        job.run(until)
        return job.rows(key[0])

    return rows.dropDuplicates(["job_id", "event_id"]).groupBy("job_id").applyInPandas(run, LOG)


def stream_status(events: DataFrame, out: str, checkpoint: str, delay: str = "0 seconds", available_now: bool = True):
    """Start the log of a stream of events: rows go to Parquet files under out, each once; the running query.

    out and checkpoint are the caller's: the same two resume. Events that come later than
    the delay allows are dropped. Repeated events (job and event id) count once while
    within the delay.
    """
    spark = events.sparkSession
    ship(spark)
    rows = _typed(events).withWatermark("at", delay).dropDuplicatesWithinWatermark(["job_id", "event_id"])
    keyed = rows.groupBy("job_id").transformWithStateInPandas(JobProcessor(), LOG, outputMode="append", timeMode="eventTime")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = keyed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def statuses(log: DataFrame) -> DataFrame:
    """job_id, status and at of every job: the last row of its log."""
    return log.groupBy("job_id").agg(F.max(F.struct("seq", "status", "at")).alias("x")).select("job_id", "x.status", "x.at")


def read_log(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(out)


def stream_progress(events: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Progress events (job_id, phase, status, result) with prompt and message, each once, under out; those there now.

    Files become visible by the sink's commit alone: what a failed task or a failed run
    wrote before is never read, and the same folders resume.
    """
    ship(events.sparkSession)
    told = progress_event(events)
    job = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return events.sparkSession.read.schema(told.schema).parquet(out)
