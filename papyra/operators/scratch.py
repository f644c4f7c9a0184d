"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..cluster import ship


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master, which is a single machine, gets a temporary
    folder; on a cluster the executors' disks are not shared, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='papyra-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_OPEN: ContextVar[tuple[list, ...]] = ContextVar("open", default=())


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that operators write inside, at the end; results are to be written or collected before.

    Without it they stay until the application ends, since a result that is not yet
    computed reads them.
    """
    mine: list[Scratch] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for scratch in mine:
            scratch.clear()


class Scratch:
    """Writes DataFrames as Parquet and reads them again, which cuts their lineage.

    A table read back has a known size, so the planner broadcasts it only below its
    threshold, and it has no partitioning left over, so skewed joins can be split.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_folder(spark)}/papyra-{name}-{uuid.uuid4().hex}"
        self.n = 0
        for held in _OPEN.get():
            held.append(self)

    def folder(self) -> str:
        """A new path under the base; the application's end removes what is left there."""
        self.n += 1
        if self.n == 1:
            files = self._files(self.base)
            files.mkdirs(self._path(self.base))
            files.deleteOnExit(self._path(self.base))
        return f"{self.base}/{self.n}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._papyra_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        self._files(df._papyra_path).delete(self._path(df._papyra_path), True)

    def clear(self) -> None:
        """Delete all that was written here."""
        self._files(self.base).delete(self._path(self.base), True)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
