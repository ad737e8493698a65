"""Shared working folder, staged tables and checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[str, dict[tuple, tuple]] = {}

# Rows and compressed shuffle bytes that a task should get; a wide row in several sorts at once takes some 600 bytes
TASK_ROWS = 250_000
TASK_BYTES = "16MB"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    on_cluster = not sc.master.startswith("local") or sc.master.startswith("local-cluster")
    if named is None and sc.getCheckpointDir() is None and on_cluster:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="paceline-"))
    return named or sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def parts_of(rows: int) -> int:
    """Partitions that hold ``rows`` with at most ``TASK_ROWS`` each, on average."""
    return max(1, -(-rows // TASK_ROWS))


@contextmanager
def spread(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Shuffles planned inside have tasks that do not grow with ``rows``; the session's settings are put back."""
    if rows is None:
        yield
        return
    count, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {key: spark.conf.get(key, None) for key in (count, size)}
    spark.conf.set(count, max(int(spark.conf.get(count)), parts_of(rows)))
    spark.conf.set(size, TASK_BYTES)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def staged(spark: SparkSession, key: tuple, build: Callable[[], DataFrame], rows: Callable[[], int] | None = None) -> DataFrame:
    """Write ``build()`` once per application as Parquet in the shared folder and read it back.

    The first element of ``key`` names the table. A lost executor re-reads the files instead of
    recomputing the lineage, and later queries prune columns and push filters into them. ``rows`` counts
    the rows that are read, by which the work is dealt to tasks.
    """
    path, schema = staged_files(spark, key, build, rows)
    return spark.read.schema(schema).parquet(path)


def staged_files(spark: SparkSession, key: tuple, build: Callable[[], DataFrame], rows: Callable[[], int] | None = None):
    """Folder and schema of a staged table, written on first use."""
    tables = _STAGED.setdefault(spark.sparkContext.applicationId, {})
    if key not in tables:
        with spread(spark, None if rows is None else rows()):
            frame = build()
            path = new_path(spark, str(key[0]))
            frame.write.parquet(path)
        tables[key] = (path, frame.schema)
    return tables[key]


def forget_staged(spark: SparkSession) -> None:
    """Drop the registry so that changed inputs are read again."""
    _STAGED.pop(spark.sparkContext.applicationId, None)


def fixed(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and pins values such as partition ids."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote and no reader needs any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
