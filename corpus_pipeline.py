"""Corpus preparation from raw documents to shuffled shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's ``docs``. All stages but the last return the columns of ``documents`` as they came.

1. language: texts that are in no learnt language go (operator 4, learnt on the stage's own input).
2. near duplicates: one document of each group of linked documents stays (operator 8, on 5-word shingles from 0.8).
3. decontamination: documents that hold a benchmark window go (operator 3).
4. mixing: every document comes as often as the mix of sources to target weights begins it (operator 1), so documents
   of sources above their target may go and others repeat.
5. sharding: the rows are shuffled into 16 shards (operator 7) and gain ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.decontamination import clean_rows
from paceline.llm.jaccard_join import first_of_groups
from paceline.llm.language import recognised_rows
from paceline.llm.mixing import mixed_rows
from paceline.llm.rows import landed, small_batches, table
from paceline.llm.sharding import external_shuffle

# Bytes of text that a task of the last stage shuffles at once, beside the workers of the stages before
BUCKET = 4 << 20
# Near duplicates: words of a shingle, and the coefficient in hundredths
NEAR_SHINGLE = 5
NEAR_LEVEL = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go, too; repeated rows share their fate; no rows give no rows."""
    small_batches(spark)
    return recognised_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of a group stays, null ids last; rows without words all stay."""
    return first_of_groups(docs, NEAR_SHINGLE, NEAR_LEVEL)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts hold no window and stay; repeated rows share their fate."""
    small_batches(spark)
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without words are never begun by the mix; a null source is a source of its own."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """An input column named like one of the two that are added gives way to it."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return external_shuffle(docs, bucket_bytes=BUCKET).select(*[F.col(f"record.`{c}`") for c in kept], F.col("shard").cast("int").alias("shard"), "slot")


STAGES = [
    ("language", language),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# Code lengths of context trees have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name)
    return docs
