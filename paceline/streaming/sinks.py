"""Drain streams into shared-folder tables and read keyed results back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.session import discard, exists, fixed, new_path
from paceline.sources.merge import create_table, latest_by_key, upsert

# Folders of a level that are folded into one of the next
FOLDERS = 16


def append_stream(stream: DataFrame, name: str) -> str:
    """Run an append-mode stream over the available files into Parquet and return the folder."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", new_path(spark, f"{name}-offsets"))
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return path


def batch_stream(stream: DataFrame, name: str, mode: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Run a stream with a handler per micro-batch."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", new_path(stream.sparkSession, f"{name}-offsets"))
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def keyed_stream(stream: DataFrame, name: str, key: Sequence[str], folders: int = FOLDERS) -> DataFrame:
    """Update-mode stream as a keyed table: each micro-batch lands in its own folder, last wins.

    A retried batch overwrites its folder, so the table stays exact. Levels of folders bound their number: ``folders``
    batches are folded into one of the next level, a row per key, and so on, so that after n batches at most ``folders``
    folders a level are there and a row was written again once per level.
    """
    spark, path = stream.sparkSession, new_path(stream.sparkSession, name)

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_folder(path, 0, number))
        level, at = 0, number
        while at % folders == folders - 1:
            fold(level, at // folders)
            level, at = level + 1, at // folders

    def fold(level: int, to: int) -> None:
        parts = [_folder(path, level, to * folders + i) for i in range(folders)]
        # after a retry some may be folded and gone already; then the folder of the next level is whole
        if all(exists(spark, part) for part in parts):
            rows = latest_by_key(_landed(spark, stream, path, parts), key, ["batch"])
            rows.drop("rank", "batch", "level").write.mode("overwrite").parquet(_folder(path, level + 1, to))
        for part in parts:
            discard(spark, part)

    batch_stream(stream, name, "update", land)
    # a batch of a level is later than all of the levels above it
    rows = _landed(spark, stream, path, [path])
    return latest_by_key(rows, key, ["rank", "batch"]).drop("rank", "batch", "level")


def _folder(path: str, level: int, batch: int) -> str:
    return f"{path}/level={level}/batch={batch}"


def _landed(spark: SparkSession, like: DataFrame, path: str, folders: Sequence[str]) -> DataFrame:
    rows = spark.read.schema(f"{_ddl(like)}, level long, batch long").option("basePath", path).parquet(*folders)
    return rows.withColumn("rank", -F.col("level"))


def merged_stream(
    stream: DataFrame, name: str, key: Sequence[str], partition: str, derive: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Update-mode stream merged into a keyed table, and a result derived from it.

    Each micro-batch upserts its changed keys; the result is then derived again for the partitions
    it touched and replaces them. Untouched partitions are neither read nor written.
    """
    spark = stream.sparkSession
    state, result = new_path(spark, f"{name}-state"), new_path(spark, name)
    create_table(stream, state, partition)

    def land(batch: DataFrame, number: int) -> None:
        changed = fixed(batch)
        upsert(spark, state, changed, key, partition)
        touched = spark.read.schema(stream.schema).parquet(state)
        touched = touched.join(changed.select(partition).distinct(), partition, "left_semi")
        rows = derive(touched).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy(partition).parquet(result)

    batch_stream(stream, name, "update", land)
    return spark.read.parquet(result)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
