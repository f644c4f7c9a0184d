"""Search services as a Spark data source, the choice between them, and stored answers.

A query asks the given services in turn until one answers, waiting longer after each 429
and dropping the key once after a 403. Calls are paced: queries are dealt into a fixed
number of lanes, tasks that take turns, so that all lanes together keep the wait between
calls however many executors there are. ``spark.read.format("paper_search")`` takes
queries as an option, ``search_table`` those of a table of any size, ``stream_search``
those that arrive. ``stored`` reads answers kept as files (one JSON file a query, named
by the query's digest) from any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..cluster import ship


RECORDS = "query string, position int, record string, service string"
#: Lanes, and seconds between two calls of all lanes together (fixed by the services' terms).
LANES, WAIT = 4, 2.0


def query_file(query: str) -> str:
    return hashlib.sha256(query.encode()).hexdigest()[:24] + ".json"


def fetch(url: str, key: str | None, timeout: float, retries: int, wait: float = 2.0) -> dict:
    """GET with exponential waits on 429 and one try without a key on 403."""
    for attempt in range(retries + 1):
        request = urllib.request.Request(url, headers={"x-api-key": key} if key else {})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code == 403 and key:
                key = None
            elif e.code == 429 and attempt < retries:
                time.sleep(wait * 2**attempt)
            else:
                raise
    return {"data": []}


class Pace:
    """Turns of one of ``lanes`` lanes that share a wait between calls: every lanes-th turn is its own."""

    def __init__(self, lane: int, lanes: int, wait: float):
        self.step, self.next = lanes * wait, time.monotonic() + lane * wait

    def turn(self) -> None:
        late = self.next - time.monotonic()
        if late > 0:
            time.sleep(late)
        self.next = max(self.next, time.monotonic()) + self.step


def ask(query: str, services: list[dict], pace: Pace) -> Iterator[tuple[str, int, str, str]]:
    """The records of the first service that answers; if all fail, the last error is raised."""
    error = None
    for service in services:
        text = urllib.parse.urlencode({"query": query, "limit": service.get("limit", 10)})
        pace.turn()
        try:
            answer = fetch(f"{service['endpoint']}?{text}", service.get("key"), float(service.get("timeout", 30)), int(service.get("retries", 3)))
            records = [json.dumps(r) for r in answer.get("data") or []]
        except Exception as e:  # any error of a service means: try the next one
            error = e
            continue
        for i, record in enumerate(records):
            yield query, i, record, service["name"]
        return
    if error is not None:
        raise error


class Lane(InputPartition):
    def __init__(self, lane: int, queries: list[str]):
        self.lane, self.queries = lane, queries


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.lanes, self.wait = int(options.get("lanes", LANES)), float(options.get("wait", WAIT))

    def partitions(self) -> list[Lane]:
        queries = json.loads(self.options["queries"])
        return [Lane(k, queries[k :: self.lanes]) for k in range(min(self.lanes, len(queries)))]

    def read(self, partition: Lane) -> Iterator[tuple[str, int, str, str]]:
        pace = Pace(partition.lane, self.lanes, self.wait)
        for query in partition.queries:
            yield from ask(query, json.loads(self.options["services"]), pace)


class PaperSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def services_of(domain: str | None, order: dict[str, list[str]], services: dict[str, dict]) -> list[dict]:
    """The settings of a domain's services (else of ``default``), in order, each with its name; unknown names are left out."""
    names = order.get(domain) or order.get("default") or []
    return [{**services[name], "name": name} for name in names if name in services]


def search(spark: SparkSession, queries: list[str], services: list[dict], lanes: int = LANES, wait: float = WAIT) -> DataFrame:
    """(query, position, record, service): raw records of a few queries.

    services: settings of each (name, endpoint, key, timeout, retries, limit), the first
    that answers a query serves it. Without services, as without answers, there are no rows.
    """
    ship(spark)
    spark.dataSource.register(PaperSearch)
    reader = spark.read.format("paper_search").options(lanes=str(lanes), wait=str(wait))
    return reader.options(queries=json.dumps(queries), services=json.dumps(services)).load()


def search_table(queries: DataFrame, services: list[dict], lanes: int = LANES, wait: float = WAIT) -> DataFrame:
    """(query, position, record, service): raw records of all distinct queries (column query) of a table.

    Null queries are left out. To be written before it is read more than once: each
    evaluation asks again, as a task does that is run again.
    """
    ship(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(TaskContext.get().partitionId(), lanes, wait)
        for batch in batches:
            for query in batch.column("query").to_pylist():
                found = list(ask(query, services, pace))
                if found:
                    columns = list(zip(*found, strict=True))
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query", "position", "record", "service"])

    asked = queries.select("query").where("query is not null").distinct()
    return asked.repartition(lanes, F.xxhash64("query")).mapInArrow(run, RECORDS)


def stream_search(queries: DataFrame, services: list[dict], out: str, checkpoint: str, lanes: int = LANES, wait: float = WAIT) -> DataFrame:
    """Records of queries as they arrive in a stream; returns those of all that is there now.

    Each micro-batch asks its queries and writes its own folder by number, which a batch
    that is run again overwrites, so a record is there once. A later call with the same
    folders asks only what has arrived since.
    """

    def write(batch: DataFrame, number: int) -> None:
        search_table(batch, services, lanes, wait).write.mode("overwrite").parquet(f"{out}/batch={number}")

    job = queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return queries.sparkSession.read.schema(f"{RECORDS}, batch long").parquet(out).drop("batch")


def stored(spark: SparkSession, queries: DataFrame, folder: str) -> DataFrame:
    """(query, position, record) of queries whose answers are kept as files under a folder."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    name = F.concat(F.substring(F.sha2(F.col("query"), 256), 1, 24), F.lit(".json"))
    found = queries.select("query").distinct().withColumn("file", name).join(files, "file")
    return found.select("query", F.posexplode(F.from_json("value", "data array<string>")["data"]).alias("position", "record"))


def batch_of(records: DataFrame, size: int) -> DataFrame:
    """The first ``size`` records of each query."""
    return records.where(F.col("position") < size)


def wait_seconds(attempt: Column, base: float = 2.0) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt)
