"""Input tables and parameterised queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], params: dict | None = None) -> DataFrame:
    """SQL over frames named ``{table}`` in the text, with bound ``:parameters``."""
    return spark.sql(sql, args=params or {}, **tables)


def known_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The listed columns that the source happens to carry."""
    return df.select([name for name in names if name in df.columns])
