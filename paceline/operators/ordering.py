"""Row numbers, running totals, group totals and top rows that hold for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.session import fixed

# Rows one task may sort for a single window group before the work is split by key range.
GROUP_LIMIT = 2_000_000

# Rows a broadcast side may have; callers pass a bound they can prove, such as the race count.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, rows: float | None) -> DataFrame:
    """Broadcast ``df`` if it is known to have few rows; sort and merge where it is known to have many.

    With no count the join is left to the optimiser, which goes by the size of files: well compressed ones of millions of
    rows look small enough to be collected on the driver.
    """
    if rows is None:
        return df
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows in the largest group; map-side counts make this safe for hot keys."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    *,
    number: str | None = None,
    sums: dict[str, Column] | None = None,
    bound: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Row number and running sums per group in a total order.

    ``bound`` is a known upper limit on rows per group; without it the largest group is counted.
    Groups within ``limit`` use an ordinary window. Beyond it the rows are range-partitioned on
    (group, order), numbered inside each range and shifted by the totals of the ranges before it,
    so no task ever holds a whole group. Both ways give the same rows: null groups are groups, and a
    sum is null until the first value that is not.
    """
    sums = sums or {}
    limit = GROUP_LIMIT if limit is None else limit
    if bound is None:
        bound = largest_group(df, group)
    if bound <= limit:
        rows = Window.partitionBy(*group).orderBy(*order)
        upto = rows.rowsBetween(Window.unboundedPreceding, 0)
        added = {name: F.sum(value).over(upto) for name, value in sums.items()}
        if number:
            added[number] = F.row_number().over(rows).cast("long")
        return df.withColumns(added)

    ranged = df.repartitionByRange(*[F.col(c) for c in group], *order)
    ranged = fixed(ranged.withColumns({"_part": F.spark_partition_id(), **{f"_v_{n}": v for n, v in sums.items()}}))
    keys = [*group, "_part"]
    totals = ranged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.count(f"_v_{n}").alias(f"_k_{n}") for n in sums],
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *[F.col(c).alias(f"_g_{c}") for c in keys],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.coalesce(F.sum(f"_k_{n}").over(earlier), F.lit(0)).alias(f"_k0_{n}") for n in sums],
    )
    rows = Window.partitionBy(*keys).orderBy(*order)
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({"_rn": F.row_number().over(rows), **{f"_c_{n}": F.sum(f"_v_{n}").over(upto) for n in sums}})
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in keys]
    joined = local.join(shifts, same)
    out = [F.col(c) for c in df.columns]
    for n in sums:
        seen = F.col(f"_c_{n}").isNotNull() | (F.col(f"_k0_{n}") > 0)
        out.append(F.when(seen, F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.col(f"_s_{n}")).alias(n))
    if number:
        out.append((F.col("_rn") + F.col("_n0")).cast("long").alias(number))
    return joined.select(*out)


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, place: str = "place") -> DataFrame:
    """First ``k`` rows per group; Spark limits each group before the shuffle."""
    rows = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(place, F.row_number().over(rows)).filter(F.col(place) <= k)


def with_group_totals(df: DataFrame, group: Sequence[str], groups: int | None = None, **totals: Column) -> DataFrame:
    """Attach per-group aggregates by a partially aggregated join instead of a per-group window.

    ``groups`` bounds the number of groups. With few groups the summary is broadcast and the rows
    are not shuffled at all, however many of them one group holds.
    """
    summary = df.groupBy(*group).agg(*[value.alias(name) for name, value in totals.items()])
    return df.join(sized(summary, groups), list(group))
