"""Row handles and tables in the shared folder that the operators have in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.session import discard, new_path

# While a table is landed: nothing reads its shuffles again, and long texts go to Python a few at a time
LANDING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path, before = new_path(spark, name), {key: spark.conf.get(key) for key in LANDING}
    for key, value in LANDING.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._landed = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete landed tables once everything that is computed from them has landed, too."""
    for table_ in tables:
        discard(table_.sparkSession, table_._landed)


def locator(df: DataFrame) -> Column:
    """File and row number of a row of a table read from Parquet: unique, and the same on every read."""
    meta = df.metadataColumn("_metadata")
    return F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def locatable(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if its rows have locators, else a copy of it in the shared folder."""
    try:
        df.select(locator(df))
    except AnalysisException:
        return landed(df, name)
    return df


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """Sends ``value`` to every executor once; the function returned reads it there.

    Objects are sent as their fields, which workers hold once, and put together where they are used.
    """
    kind = type(value) if hasattr(value, "__dict__") else None
    sent = spark.sparkContext.broadcast(vars(value) if kind else value)

    def read() -> object:
        if kind is None:
            return sent.value
        whole = kind.__new__(kind)
        whole.__dict__.update(sent.value)
        return whole

    return read


def small_batches(spark: SparkSession) -> None:
    """Long texts go to Python a few at a time, also in results that are computed later."""
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        name = f"spark.sql.execution.arrow.{key}"
        spark.conf.set(name, LANDING[name])


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def lowered(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
