"""Temporal splits and exact medians for training data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators.ordering import running, sized
from paceline.session import TASK_ROWS, fixed, parts_of

# Accuracy of the sketch that finds where a median lies, and the part of the rows on each side of it that is looked through
SKETCH = 2_000
NEAR = 3 / SKETCH


def year_folds(matrix: DataFrame, validation_years: Sequence[int]) -> DataFrame:
    """Each row with its role per fold: train before v - 1, calibrate on v - 1, validate on v."""
    year = F.col("year")
    folds = matrix.withColumn("fold", F.explode(F.array(*[F.lit(v).cast("long") for v in validation_years])))
    role = (
        F.when(year < F.col("fold") - 1, "train")
        .when(year == F.col("fold") - 1, "calibrate")
        .when(year == F.col("fold"), "validate")
    )
    return folds.withColumn("role", role).filter("role IS NOT NULL")


def final_split(matrix: DataFrame, train_end: int, test_year: int) -> DataFrame:
    """Roles of the final fit: calibrate on ``train_end``, train before it, test on ``test_year``."""
    year = F.col("year")
    role = (
        F.when(year < train_end, "train").when(year == train_end, "calibrate").when(year == test_year, "test")
    )
    return matrix.withColumn("role", role).filter("role IS NOT NULL")


def time_folds(matrix: DataFrame, splits: int = 3) -> DataFrame:
    """Expanding folds by row order: ``test_fold`` 1..splits, 0 for rows that are only trained on.

    Fold f trains on every row before its first test row. Needs a global row number: by one window while the rows fit one
    task, otherwise by numbers inside each race and the rows of the races before it, dealt to tasks by the rows.
    """
    n = matrix.count()
    size = n // (splits + 1)
    start = n - splits * size
    if n <= TASK_ROWS:
        numbered = running(matrix, [], [F.asc("ro"), F.asc("driver_id")], number="row", bound=n)
    else:
        numbered = numbered_by_race(matrix).coalesce(parts_of(n))
    index = F.col("row") - 1
    fold = F.when(index >= start, F.floor((index - start) / size) + 1).otherwise(0).cast("long")
    return numbered.withColumn("test_fold", fold)


def numbered_by_race(matrix: DataFrame) -> DataFrame:
    """``row``: number by race order and driver, without ordering all rows at once."""
    races = fixed(matrix.groupBy("ro").agg(F.count(F.lit(1)).alias("n")))
    known = races.agg(F.count(F.lit(1)).alias("races"), F.max("n").alias("largest")).first()
    before = running(races, [], [F.asc("ro")], sums={"upto": F.col("n")}, bound=known.races)
    before = before.select(F.col("ro").alias("_ro"), (F.col("upto") - F.col("n")).alias("_before"))
    numbered = running(matrix, ["ro"], [F.asc("driver_id")], number="row", bound=known.largest)
    joined = numbered.join(sized(before, known.races), F.col("ro").eqNullSafe(F.col("_ro")))
    return joined.withColumn("row", F.col("row") + F.col("_before")).drop("_ro", "_before")


def exact_medians(rows: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Exact median per column in long form.

    Values are counted first, so only distinct values are ordered; the middle is found from running
    counts instead of holding a column in one task. Without groups only values near the middle are counted one by one: a
    sketch tells where it lies, and where the counts show that it does not lie there, all values are counted.
    """
    names = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    long = rows.selectExpr(*group, f"stack({len(columns)}, {names}) AS (feature, value)").filter("value IS NOT NULL")
    long = long.withColumn("side", F.lit(0))
    if not group:
        counts = fixed(_counts(_near(long, middle_bounds(rows, columns)), ["feature"]))
        found = _middles(counts, ["feature"], len(columns))
        if found.filter("median IS NULL").isEmpty():
            return found
    return _middles(_counts(long, [*group, "feature"]), [*group, "feature"], None if group else len(columns))


def middle_bounds(rows: DataFrame, columns: Sequence[str]) -> dict[str, list[float] | None]:
    """Two values per column between which its median should lie, by a sketch."""
    ends = [F.lit(0.5 - NEAR), F.lit(0.5 + NEAR)]
    sketches = [F.percentile_approx(F.col(c).cast("double"), F.array(*ends), F.lit(SKETCH)).alias(c) for c in columns]
    return rows.agg(*sketches).first().asDict()


def _near(long: DataFrame, bounds: dict[str, list[float] | None]) -> DataFrame:
    """Rows with ``side`` -1 below and 1 above the bounds of their feature; there the value itself is dropped."""
    side = F.lit(0)
    for feature, ends in bounds.items():
        if ends is not None:
            own, value = F.col("feature") == feature, F.col("value")
            side = F.when(own & (value < ends[0]), -1).when(own & (value > ends[1]), 1).otherwise(side)
    return long.withColumn("side", side).withColumn("value", F.when(F.col("side") == 0, F.col("value")))


def _counts(long: DataFrame, key: Sequence[str]) -> DataFrame:
    return long.groupBy(*key, "side", "value").agg(F.count(F.lit(1)).alias("n"))


def _middles(counts: DataFrame, key: Sequence[str], keys: int | None) -> DataFrame:
    """Median per key, null where it lies on a side; ``keys`` is a known number of keys."""
    ranked = running(counts, key, [F.asc("side"), F.asc("value")], sums={"upto": F.col("n")})
    totals = counts.groupBy(*key).agg(F.sum("n").alias("total"))
    joined = ranked.join(sized(totals, keys), key)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1

    def holds(rank):
        return (F.col("side") == 0) & (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)

    return joined.groupBy(*key).agg(
        ((F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2).alias("median")
    )


def imputed(rows: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with given medians (long form, one value per column, read as constants)."""
    fill = {m.feature: m.median for m in medians.collect()}
    return rows.withColumns({c: F.coalesce(c, F.lit(fill[c])) for c in columns if c in fill})
