"""Keyed upserts and data-quality jobs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators.ordering import sized
from paceline.session import discard, new_path

# Touched partitions up to which they are read by name, and files per partition up to which stored rows are not moved
PARTITIONS = 1_000
FILES = 8

# Keys, references and required columns of the stored tables
TABLE_KEYS = {
    "races": ["race_id"],
    "drivers": ["driver_id"],
    "constructors": ["constructor_id"],
    "results": ["race_id", "driver_id"],
    "qualifying": ["race_id", "driver_id"],
    "practice_sessions": ["race_id", "driver_id", "session_type"],
    "pit_stops": ["race_id", "driver_id", "stop_number"],
    "weather": ["race_id"],
    "standings_snapshot": ["race_id", "driver_id"],
}
REFERENCES = {
    "results": [("race_id", "races"), ("driver_id", "drivers")],
    "qualifying": [("race_id", "races")],
    "practice_sessions": [("race_id", "races")],
    "pit_stops": [("race_id", "races")],
    "weather": [("race_id", "races")],
    "standings_snapshot": [("race_id", "races")],
}
REQUIRED = {
    "races": ["year", "round"],
    "results": ["race_id", "driver_id"],
    "qualifying": ["race_id", "driver_id"],
    "practice_sessions": ["race_id", "driver_id", "session_type"],
    "pit_stops": ["race_id", "driver_id", "stop_number"],
    "standings_snapshot": ["race_id", "driver_id"],
}


def latest_by_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last version of each key in the total order given; partial aggregation absorbs hot keys."""
    fields = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("last"))
    return last.select(*key, *[F.col(f"last.{f}").alias(f) for f in fields])


def merge(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Insert or replace: rows of ``new`` win over ``old``, later rows over earlier."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return latest_by_key(both, key, ["_batch", *order]).drop("_batch")


def upsert(
    spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], partition: str, order: Sequence[str] = (), unique: bool = False
) -> None:
    """Merge into a Parquet table, rewriting only the partitions ``new`` touches.

    ``partition`` must be a part of the key or a function of it, so that no older version sits elsewhere.
    Repeating an upsert changes nothing, so a retried job or micro-batch is safe. Stored rows stay in the tasks that
    read them: those with a new version are left out by a join with the new keys, which are sent to every task if they
    are few and else merged, and only then are stored rows shuffled. ``unique`` says that no key comes twice in ``new``.
    """

    def combine(old: DataFrame, rows: DataFrame, n: int | None) -> DataFrame:
        kept = [c for c in rows.columns if c not in order]
        rows = rows if unique else latest_by_key(rows, key, order or [c for c in kept if c not in key])
        rows = rows.select(*kept)
        keys = rows.select(*[F.col(k).alias(f"_{k}") for k in key])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
        return old.join(sized(keys, math.inf if n is None else n), same, "left_anti").unionByName(rows.hint("rebalance", partition))

    _replace(spark, path, new, partition, combine, order)


def rewrite(
    spark: SparkSession, path: str, new: DataFrame, partition: str, combine: Callable[[DataFrame, DataFrame], DataFrame],
    touched: str | None = None,
) -> None:
    """Replace the partitions of a Parquet table that ``new`` touches by ``combine(old rows, new rows)``.

    Their values are written to ``touched``, from the staged rows, so that ``new`` is worked out once.
    """

    def folded(old: DataFrame, rows: DataFrame, n: int | None) -> DataFrame:
        if touched is not None:
            rows.select(partition).distinct().write.mode("overwrite").parquet(touched)
        return combine(old, rows).hint("rebalance", partition)

    _replace(spark, path, new, partition, folded)


def _replace(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    partition: str,
    combine: Callable[[DataFrame, DataFrame, int | None], DataFrame],
    leave: Sequence[str] = (),
) -> None:
    """``combine`` gets the stored rows of the touched partitions, the new rows and, if partitions are few, the number of new rows.

    The new rows are staged once, because they may come from the table itself. The write keeps what it replaces until
    all its tasks are done, so it may read it. Where a partition has come to many files, all its rows are balanced anew.
    """
    fresh = new_path(spark, "rewrite-new")
    staged = _staged(new, fresh)
    old = spark.read.schema(new.drop(*leave).schema).parquet(path)
    counts = staged.groupBy(partition).agg(F.count(F.lit(1)).alias("n")).limit(PARTITIONS + 1).collect()
    if counts and len(counts) <= PARTITIONS:
        # as literals, so that only these folders are read
        values = [row[0] for row in counts]
        touched = F.col(partition).isin([v for v in values if v is not None])
        touched = old.filter(touched | F.col(partition).isNull() if None in values else touched)
        folders = Counter(unquote(file.rsplit("/", 2)[-2]) for file in old.inputFiles())
        crowded = any(folders[f"{partition}={v}"] > FILES for v in values)
        n = sum(row[1] for row in counts)
    else:
        touched, crowded, n = old.join(staged.select(partition).distinct(), partition, "left_semi"), True, None
    if counts:
        merged = combine(touched, staged, n)
        merged = merged.hint("rebalance", partition) if crowded else merged
        rows = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy(partition).parquet(path)
    discard(spark, fresh)


def _staged(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def create_table(rows: DataFrame, path: str, partition: str) -> None:
    """Empty table for later upserts."""
    rows.sparkSession.createDataFrame([], rows.schema).write.partitionBy(partition).parquet(path)


def first_load(rows: DataFrame, path: str, partition: str) -> None:
    """Table of ``rows``, whose keys are unique; balanced by partition, so that files are few and none outgrows a task."""
    rows.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def orphans(rows: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    return rows.join(parent, column, "left_anti")


def missing_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the count of nulls per required column."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
