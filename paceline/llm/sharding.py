"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly into buckets that fit a task's memory, by a seeded hash. Pass two runs a
Fisher-Yates shuffle over each bucket and deals the shuffled sequence to the shards in turn, so every shard is a
uniform sample and shard row counts differ by at most one (law ``rows``). Text crosses the network once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, LongType, StructField, StructType

from paceline.llm.rows import landed, locatable, locator, release, table, text_of

# Rows with the same key and text that stay in one bucket whatever their size; more than that may fill it
ALIKE = 64
# Kinds of rows up to which they are sent to all tasks
SENT = 200_000


def _hashable(df: DataFrame) -> list:
    """Columns that Spark can hash, for an order of rows that does not depend on how they arrive."""
    plain = [f.name for f in df.schema if isinstance(f.dataType, (AtomicType, ArrayType)) and "map<" not in f.dataType.simpleString()]
    return [F.col(f"`{name}`") for name in plain]


def _deal(seed: int, shards: int):
    def deal(bucket: pa.Table, start: pa.Table) -> pa.Table:
        order = np.lexsort((bucket["tie"].to_numpy(), bucket["mark"].to_numpy()))
        # numpy's permutation is a Fisher-Yates pass over the indices
        number = bucket["bucket"][0].as_py()
        order = order[np.random.Generator(np.random.PCG64([seed, number])).permutation(len(order))]
        place = start["before"][0].as_py() + np.arange(len(order), dtype=np.int64)
        return pa.table({"record": bucket["record"].take(pa.array(order)), "shard": place % shards, "slot": place // shards})

    return deal


def _records(docs: DataFrame, seed: int, mark) -> DataFrame:
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    return docs.select(record, mark.alias("mark"), F.xxhash64(F.lit(seed), *_hashable(docs)).alias("tie"))


def external_shuffle(
    docs: DataFrame, shards: int = 16, seed: int = 20261, bucket_bytes: int = 16 << 20, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(record, shard, slot): every row of ``docs`` as a struct, with its shard and its place in that shard from 0.

    ``bucket_bytes`` bounds the text a task holds; the number of buckets follows the input. The bucket depends on
    the key and the text, so copies of one text under many ids spread over all buckets, and the result does not depend
    on the files that hold the rows. Where more than 64 rows share key and text and fill a quarter of a bucket, as rows
    without a key may, theirs follows from file and place instead: they spread, too, and a rerun over the same files
    agrees. Null keys and texts count like values; repeated rows are all kept and, being interchangeable, may swap
    places; an empty table gives no rows. Input columns live inside ``record``, so their names cannot clash.
    """
    mark = F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.crc32(text_of(text)))
    size = F.octet_length(text_of(text)) + 64
    kinds = landed(docs.groupBy(mark.alias("mark")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")), "shuffle-kinds")
    total = kinds.agg(F.sum("bytes")).first()[0] or 0
    n_buckets = 1 + total // bucket_bytes

    def bucket(spread):
        return F.pmod(F.shiftrightunsigned(spread, 8), F.lit(n_buckets)).alias("bucket")

    many = (F.col("n") > ALIKE) & (F.col("bytes") > bucket_bytes // 4)
    alike = kinds.where(many).select(F.col("mark").alias("alike"))
    n_alike = alike.count() if n_buckets > 1 else 0
    if n_alike:
        docs = locatable(docs, "shuffle-input")
        at = locator(docs)
        rows = _records(docs, seed, mark).withColumn("spread", F.xxhash64("mark", at["file"], at["row"]))
        alike = landed(alike, "shuffle-alike")
        rows = rows.join(F.broadcast(alike) if n_alike <= SENT else alike, F.col("mark") == F.col("alike"), "left")
        rows = rows.select("record", "mark", "tie", bucket(F.when(F.col("alike").isNull(), F.col("mark")).otherwise(F.col("spread"))))
        counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    else:
        rows = _records(docs, seed, mark).select("record", "mark", "tie", bucket(F.col("mark")))
        counts = kinds.groupBy(bucket(F.col("mark"))).agg(F.sum("n").alias("n"))
    # one row per bucket
    before = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")
    starts = landed(counts.select("bucket", before.alias("before")), "shuffle-starts")
    release(kinds)
    schema = StructType(
        [StructField("record", docs.schema), StructField("shard", LongType()), StructField("slot", LongType())]
    )
    return rows.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(_deal(seed, shards), schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write the records as Parquet, one folder per shard, each file in slot order."""
    names = [n for n in shuffled.schema["record"].dataType.names if n.lower() not in ("shard", "slot")]
    rows = shuffled.select(*[F.col(f"record.`{n}`") for n in names], "shard", "slot")
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.coalesce("record.text", F.lit(""))
    return external_shuffle(table(spark, sf_dir, "documents")).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op7_external_shuffle": op7_external_shuffle}
SQL: dict[str, str] = {}
