"""Exact deduplication with streaming state that is never expired.

The documents pass through a streaming aggregation keyed by the digest of the text. Its state lives in RocksDB
on the executors' disks, is checkpointed to the shared folder and keeps per digest the stable identifier (largest
document id), the content locator (file and row) of that document and the number of rows. A later run over the
same checkpoint would only read new files. Every hit is then checked on full bytes against the located text; rows
whose digest agrees but whose text does not are grouped by the text itself, so the digest never decides alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.rows import landed, locator, text_of
from paceline.session import new_path

# State on disk, without files that reserve space ahead of their content
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _read(df: DataFrame, text: str, key: str, digest: Callable[[Column], Column]) -> DataFrame:
    content = text_of(text)
    return df.select(F.col(f"`{key}`").alias("doc_id"), locator(df).alias("at"), content.alias("content")).withColumn(
        "digest", digest(F.col("content"))
    )


def _copies() -> Column:
    """One row for each copy of something that hits of one digest are compared with."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")


def digest_state(
    spark: SparkSession, path: str, text: str, key: str, digest: Callable[[Column], Column], files_per_batch: int | None
) -> DataFrame:
    """(digest, keep (doc_id, at), size) of every digest, from the keyed state of a stream over ``path``."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    state = (
        _read(source.parquet(f"{path[:-1]}[{path[-1]}]"), text, key, digest)  # as a pattern, it may also be one file
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count(F.lit(1)).alias("size"))
    )
    out = new_path(spark, "digest-state")

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", new_path(spark, "digest-offsets"))
            .foreachBatch(land)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    if not query.lastProgress:  # a table without rows starts no batch
        return spark.createDataFrame([], state.schema)
    # the newest version of a digest is the one that has counted most rows
    rows = spark.read.schema(state.schema).parquet(out)
    return rows.groupBy("digest").agg(F.max_by("keep", "size").alias("keep"), F.max("size").alias("size"))


def exact_dedup(
    spark: SparkSession,
    path: str,
    text: str = "text",
    key: str = "doc_id",
    digest: Callable[[Column], Column] | None = None,
    files_per_batch: int | None = None,
    spread: int = 16,
    rows_per_copy: int = 256,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of the Parquet table at ``path``.

    Of equal texts the row with the largest ``key`` is kept, a null ``key`` being the smallest; among rows that also
    share the ``key`` the last locator is kept, so one row stays per group. A null text is the empty text. Repeated
    rows form one group; an empty table gives no rows; further columns, whatever their names, are never read.

    ``digest`` maps the text to the state's key (default SHA-256). ``spread`` is the number of parts that rows of one
    digest are dealt to, ``rows_per_copy`` the number of hits compared with one copy of the located text: a hot
    group is split, and copies stay in proportion to the rows.
    """
    digest = digest or (lambda c: F.sha2(c, 256))
    state = digest_state(spark, path, text, key, digest, files_per_batch)
    repeated = state.where("size > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    rows = _read(spark.read.parquet(path), text, key, digest)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(spread)).cast("int"))
    hit = F.col("size").isNotNull()
    marked = landed(
        rows.join(repeated, ["digest", "part"], "left").select(
            "doc_id",
            "digest",
            "at",
            "keep",
            "size",
            F.when(hit, F.col("content")).alias("content"),
            F.sha2("content", 256).alias("text_sha256"),
        ),
        "digest-hits",
    )
    single = marked.where(~hit).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    hits = marked.where(hit).withColumn("copies", 1 + F.floor(F.col("size") / rows_per_copy))
    located = (
        hits.where(F.col("at") == F.col("keep.at"))
        .select("digest", F.col("content").alias("located"), _copies())
    )
    same = F.col("content") == F.col("located")
    checked = landed(
        hits.withColumn("copy", F.pmod(F.xxhash64("at"), F.col("copies")))
        .join(located, ["digest", "copy"])
        .select("doc_id", "digest", "copy", "copies", "at", "keep", "size", "text_sha256", same.alias("same"), F.when(~same, F.col("content")).alias("content")),
        "digest-checked",
    )
    odd = checked.where("NOT same")
    less = odd.groupBy("digest", "copies").agg(F.count(F.lit(1)).alias("others"))
    less = less.select("digest", "others", _copies())
    equal = checked.where("same").join(less, ["digest", "copy"], "left").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        (F.col("size") - F.coalesce("others", F.lit(0))).alias("group_size"),
        (F.col("at") == F.col("keep.at")).alias("kept"),
        "text_sha256",
    )
    by_text = odd.groupBy("content").agg(F.max(F.struct("doc_id", "at")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    collided = odd.join(by_text, "content").select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("last.at")).alias("kept"), "text_sha256"
    )
    return single.unionByName(equal).unionByName(collided)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
SQL = {
    "op10_exact_dedup": """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS content FROM documents)
    SELECT doc_id,
           max(doc_id) OVER (PARTITION BY content) AS keep_id,
           count(*) OVER (PARTITION BY content) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY content) AS kept,
           sha256(content) AS text_sha256
    FROM d
    """
}
