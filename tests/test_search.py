"""Paced calls, queries of any number, streams of queries and of progress events, each once."""

import http.server
import json
import threading
import time
import urllib.parse

import pytest
from pyspark.sql import functions as F

from papyra.sources import search as X
from papyra.streaming import jobs as J


@pytest.fixture
def service():
    """A local service that notes when it was called and with what."""
    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            query = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["query"][0]
            calls.append((time.monotonic(), query))
            body = json.dumps({"data": [{"title": f"{query} {i}"} for i in range(2)]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield calls, [{"name": "s", "endpoint": f"http://127.0.0.1:{server.server_port}/"}]
    server.shutdown()


def gaps(calls):
    at = sorted(t for t, _ in calls)
    return [b - a for a, b in zip(at, at[1:], strict=False)]


def test_calls_keep_their_distance(spark, service):
    """Over all lanes together no more calls than one a wait, and every query once."""
    calls, services = service
    queries = spark.createDataFrame([(f"q{i}",) for i in range(12)] + [("q1",), (None,)], "query string")
    rows = X.search_table(queries, services, lanes=3, wait=0.2).collect()
    assert sorted({r["query"] for r in rows}) == sorted(f"q{i}" for i in range(12)) and len(rows) == 24
    assert sorted(q for _, q in calls) == sorted(f"q{i}" for i in range(12))
    lanes = [sum(1 for t, _ in calls if start <= t < start + 0.6) for start, _ in calls]
    # Lanes start a little apart from each other, so a window of three waits holds their turns and at most one more each.
    assert max(lanes) <= 6 and sum(gaps(calls)) >= 0.2 * 3 * (12 / 3 - 1) * 0.9


def test_one_lane_is_strictly_paced(spark, service):
    calls, services = service
    X.search(spark, [f"q{i}" for i in range(5)], services, lanes=1, wait=0.25).collect()
    # The distance is kept where calls start; the service sees them as late as they get there.
    assert len(calls) == 5 and sum(gaps(calls)) >= 0.9 and min(gaps(calls)) >= 0.12


def test_turns_of_lanes_interleave():
    start = time.monotonic()
    turns = []
    for lane in range(2):
        pace = X.Pace(lane, 2, 0.05)
        pace.next = start + lane * 0.05
        for _ in range(3):
            turns.append(pace.next - start)
            pace.next += pace.step
    assert [round(t, 2) for t in sorted(turns)] == [0.0, 0.05, 0.1, 0.15, 0.2, 0.25]


def test_a_stream_of_queries_asks_each_once(spark, service, tmp_path):
    calls, services = service
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go(*queries):
        spark.createDataFrame([(q,) for q in queries], "query string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("query string").parquet(str(tmp_path / "in"))
        return sorted({r["query"] for r in X.stream_search(stream, services, out, state, lanes=2, wait=0.01).collect()})

    assert go("a", "b") == ["a", "b"] and go("c") == ["a", "b", "c"]
    assert sorted(q for _, q in calls) == ["a", "b", "c"]


def test_progress_after_a_failure_is_there_once(spark, tmp_path):
    """The first run dies in one task after others have written; the second resumes."""
    rows = [(i, "FETCH", "done", {"n": str(i)}) for i in range(40)]
    spark.createDataFrame(rows, "job_id long, phase string, status string, result map<string, string>").repartition(8).write.parquet(str(tmp_path / "in"))
    flag = tmp_path / "broken"
    flag.write_text("x")

    def fail(batches):
        import os

        for batch in batches:
            if os.path.exists(flag) and 17 in batch.column("job_id").to_pylist():
                raise RuntimeError("killed")
            yield batch

    schema = spark.read.parquet(str(tmp_path / "in")).schema

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).mapInArrow(fail, schema)
        return J.stream_progress(stream, str(tmp_path / "out"), str(tmp_path / "state"))

    with pytest.raises(Exception, match="killed"):
        go()
    flag.unlink()
    assert sorted(r["job_id"] for r in go().collect()) == list(range(40))
    assert go().count() == 40
    assert go().select("message").where(F.col("message") == "FETCH/done: n=3").count() == 1
