"""Shared folder of the session, tables written to it to cut lineage, results held on disk."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session (tests, one machine) may leave it unset; it then gets its own folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="morphloom-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch on the way to Python: batches of whole texts take memory outside of the heap.
BATCH = 1000


def small_batches(spark: SparkSession) -> str:
    """Bound the rows of a batch for what the session plans from now on; returns the setting before."""
    was = spark.conf.get(ARROW_ROWS)
    if not 0 < int(was) <= BATCH:
        spark.conf.set(ARROW_ROWS, str(BATCH))
    return was


@contextmanager
def _bounded(spark: SparkSession) -> Iterator[None]:
    was = small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, was)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors need not redo it."""
    path = fresh_path(df.sparkSession, name)
    with _bounded(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Held:
    """Intermediate results that a few steps read: kept on the executors' disks, never in memory.

    Lineage stays, so what a lost executor held is made again. ``release`` drops all of them,
    once a result that needs them no longer has been written.
    """

    def __init__(self) -> None:
        self._frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        with _bounded(df.sparkSession):  # what is held is planned now
            self._frames.append(df.persist(StorageLevel.DISK_ONLY))
        return self._frames[-1]

    def release(self) -> None:
        for df in self._frames:
            df.unpersist()
        self._frames.clear()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
