"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots, each worth one block of ``block`` words. Slot n takes the point n * phi mod 1 (the
golden-ratio sequence, in whole numbers) and belongs to the source whose share of the cumulative weights covers that
point, so every prefix of the mix is close to the targets. Slots are ranked per source, and rank k takes block k of
the source's documents, shuffled by a seeded hash and laid end to end; after the last block the next pass begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.rows import landed, locatable, locator, table, text_of

# Points are n * STEP mod SPAN, with STEP / SPAN the golden ratio's fractional part
SPAN = 2147483648
STEP = 1327217885
PASSES = 3
# Slots ranked together, and cells of the point range (both only partition the work)
SLOTS = 65536
CELLS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(sid, source, size, target, low, high): one row per source, numbered in order of code points, null last.

    ``weights`` repeat over that order. All sizes together are shared by weight; a target stops at ``PASSES`` times
    its source's size and the excess goes to the others by weight until none is above. That fixed point is found in one
    pass: in order of size per weight the stopped sources come first, and the others share what these leave. [low,
    high) is the source's part of the points. The rows are the distinct sources only.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("sid", F.lit(len(weights))).cast("int") + 1)
    found = found.withColumn("sid", number - 1).withColumn("weight", weight.cast("long"))
    # exact comparison of size / weight: over the weights' least common multiple
    whole = 1
    for w in set(weights):
        whole *= w
    ratio = F.col("size") * F.floor(F.lit(whole) / F.col("weight"))
    prior = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    found = (
        found.withColumn("ratio", ratio)
        .withColumn("total", F.sum("size").over(everyone))
        .withColumn("left", F.col("total") - PASSES * F.coalesce(F.sum("size").over(prior), zero))
        .withColumn("rest", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(prior), zero))
        .withColumn("stopped", PASSES * F.col("size") * F.col("rest") <= F.col("left") * F.col("weight"))
        .withColumn("first", F.min(F.when(~F.col("stopped"), F.struct("ratio", "sid", "left", "rest"))).over(everyone))
        .withColumn("stopped", F.col("first").isNull() | (F.struct("ratio", "sid") < F.struct("first.ratio", "first.sid")))
    )
    target = F.when(F.col("stopped"), (PASSES * F.col("size")).cast("double")).otherwise(
        (F.col("first.left") * F.col("weight")).cast("double") / F.col("first.rest")
    )
    share = F.when(F.col("total") > 0, F.floor(F.col("target") * SPAN / F.col("total"))).otherwise(0).cast("long")
    up_to = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    return (
        found.withColumn("target", target)
        .withColumn("share", share)
        .withColumn("high", F.sum("share").over(up_to))
        .select("sid", "source", "size", "target", (F.col("high") - F.col("share")).alias("low"), "high", "total")
    )


def _ranked_slots(spark: SparkSession, sources: DataFrame, total: int, block: int) -> DataFrame:
    """(sid, k, slot): the source of each slot and its rank there."""
    width = SPAN // CELLS
    cells = sources.where("high > low").select(
        "sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell")
    )
    slots = spark.range(0, (total + block - 1) // block).select(
        F.col("id").alias("slot"), ((F.col("id") % SPAN) * STEP % SPAN).alias("point")
    )
    # the shares are rounded down, so the last few points belong to no source; they start again from 0
    end = sources.agg(F.max("high")).first()[0]
    slots = slots.withColumn("point", F.when(F.col("point") >= end, F.col("point") - end).otherwise(F.col("point")))
    slots = (
        slots.withColumn("cell", F.floor(F.col("point") / width))
        .join(cells, "cell")
        .where("low <= point AND point < high")
        .select("slot", "sid", F.floor(F.col("slot") / SLOTS).alias("part"))
    )
    parts = slots.groupBy("sid", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")
    parts = parts.select("sid", "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot"))
    return slots.withColumn("own", own).join(parts, ["sid", "part"]).select("sid", (F.col("before") + F.col("own") - 1).alias("k"), "slot")


def _laid_out(rows: DataFrame) -> DataFrame:
    """Adds ``begin``: words before the document in its source's shuffled order; a hot source is summed in parts."""
    part = F.substring("mark", 1, 3)
    rows = rows.withColumn("part", part)
    parts = rows.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")
    parts = parts.select("sid", "part", before.alias("before"))
    inside = Window.partitionBy("sid", "part").orderBy("mark", "doc_id", "size", "at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("size").over(inside) - F.col("size"))
    return rows.join(parts, ["sid", "part"]).withColumn("begin", F.col("before") + F.col("own")).drop("part", "own", "before")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    block: int = 64,
    seed: int = 20261,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule) of the mix of ``docs``.

    documents: one row per row of ``docs`` with at (locator), doc_id, size, source_size, target, taken, copies (passes
    in which the document begins). schedule: slot, sid, begin, at, start, words: which words of which document fill
    each slot, in order of ``begin``. Nothing is sampled: every row is sized and laid out, and no document gives more
    than ``PASSES`` times its words.

    Null texts have size 0, take nothing and get 0 copies; a null source is a source of its own, last; rows that share
    an id are laid out one after the other; an empty table gives no rows. Only the three named columns are read.
    ``block`` is the number of words per slot: the schedule has one row per block, and a source's taken words
    differ from its target by a few blocks at most.
    """
    docs = locatable(docs, "mix-input")
    spark = docs.sparkSession
    size = F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))))
    rows = landed(
        docs.select(
            locator(docs).alias("at"), F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), mark.alias("mark")
        ),
        "mix-sizes",
    )
    sources = landed(source_targets(rows, weights), "mix-sources")
    count, total = sources.agg(F.count(F.lit(1)), F.max("total")).first()
    small = F.broadcast if count <= 100_000 else (lambda df: df)  # one row per source
    named = sources.select("sid", F.col("source").alias("named"), F.col("size").alias("source_size"), "target")
    rows = rows.join(small(named), F.col("source").eqNullSafe(F.col("named"))).drop("named", "source")
    rows = landed(_laid_out(rows), "mix-layout")
    slots = landed(_ranked_slots(spark, sources, total or 0, block), "mix-slots")
    filled = slots.groupBy("sid").agg((F.count(F.lit(1)) * block).alias("filled"))
    passes = (
        rows.where("size > 0")
        .join(small(filled), "sid")
        .withColumn("pass", F.explode(F.array(*map(F.lit, range(PASSES)))))
        .withColumn("begin_at", F.col("begin") + F.col("pass") * F.col("source_size"))
        .withColumn("end_at", F.least(F.col("begin_at") + F.col("size"), F.col("filled")))
        .where("begin_at < end_at")
    )
    blocks = passes.withColumn("k", F.explode(F.sequence(F.floor(F.col("begin_at") / block), F.floor((F.col("end_at") - 1) / block))))
    first, last = F.greatest(F.col("begin_at"), F.col("k") * block), F.least(F.col("end_at"), (F.col("k") + 1) * block)
    pieces = blocks.select(
        "sid", "k", "at", "begin", "pass", (first - F.col("begin_at")).alias("start"), (last - first).alias("words")
    )
    schedule = pieces.join(slots, ["sid", "k"])
    taken = schedule.groupBy("sid", "begin").agg(
        F.sum("words").alias("taken"), F.sum(F.when(F.col("start") == 0, 1).otherwise(0)).cast("int").alias("copies")
    )
    empty = F.col("size") == 0
    rows = rows.withColumn("begin", F.when(~empty, F.col("begin")))
    mixed = rows.join(taken, ["sid", "begin"], "left").select(
        "at",
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
    )
    return mixed, schedule.select("slot", "sid", "begin", "at", "start", "words")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as a pass begins it, so possibly not at all."""
    docs = locatable(docs, "mix-input")
    mixed, _ = mix(docs, **options)
    copies = mixed.where("copies > 0").select(F.col("at").alias("_at"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), locator(docs).alias("at"))
    return rows.join(copies, F.col("at") == F.col("_at")).select("record.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}
SQL = {
    "op1_mixing": f"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
               md5('20261:' || doc_id) AS mark
        FROM documents
    ), s0 AS (
        SELECT source, sum(size)::BIGINT AS size FROM sized GROUP BY source
    ), s1 AS (
        SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s0
    ), s2 AS (
        SELECT *, sid % 3 + 1 AS weight, size * (6 // (sid % 3 + 1)) AS ratio, (sum(size) OVER ())::BIGINT AS total FROM s1
    ), s3 AS (
        SELECT *,
               total - 3 * coalesce(sum(size) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "left",
               sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
        FROM s2
    ), f AS (
        SELECT * FROM s3 WHERE NOT 3 * size * rest <= "left" * weight ORDER BY ratio, sid LIMIT 1
    ), s4 AS (
        SELECT s3.sid, s3.source, s3.size, s3.total,
               CASE WHEN f.sid IS NULL OR (s3.ratio, s3.sid) < (f.ratio, f.sid) THEN (3 * s3.size)::DOUBLE
                    ELSE (f."left" * s3.weight)::DOUBLE / f.rest::DOUBLE END AS target
        FROM s3 LEFT JOIN f ON TRUE
    ), s5 AS (
        SELECT *, CASE WHEN total > 0 THEN floor(target * {SPAN} / total::DOUBLE)::BIGINT ELSE 0 END AS share FROM s4
    ), s6 AS (
        SELECT *, (sum(share) OVER (ORDER BY sid))::BIGINT AS high, (sum(share) OVER ())::BIGINT AS last_point FROM s5
    ), p AS (
        SELECT (range % {SPAN}) * {STEP} % {SPAN} AS point
        FROM range((SELECT (max(total) + 63) // 64 FROM s6)::BIGINT)
    ), q AS (
        SELECT CASE WHEN point >= last_point THEN point - last_point ELSE point END AS point
        FROM p, (SELECT max(last_point) AS last_point FROM s6)
    ), filled AS (
        SELECT sid, count(*) * 64 AS filled FROM q JOIN s6 ON point >= high - share AND point < high GROUP BY sid
    ), laid AS (
        SELECT d.doc_id, d.size, s6.size AS source_size, s6.target, coalesce(filled, 0) AS filled,
               (sum(d.size) OVER (PARTITION BY s6.sid ORDER BY mark, doc_id))::BIGINT - d.size AS a
        FROM sized d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source LEFT JOIN filled ON filled.sid = s6.sid
    )
    SELECT doc_id, size, source_size, target,
           (SELECT sum(greatest(0, least(a + e.range * source_size + size, filled) - (a + e.range * source_size))) FROM range(3) e)::BIGINT AS taken
    FROM laid
    """
}
