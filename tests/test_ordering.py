import random

from pyspark.sql import functions as F

from paceline.operators.ordering import BROADCAST_ROWS, largest_group, running, sized, top_rows, with_group_totals


def skewed(spark, n=3000):
    """A third of the rows share one group, some have a null group, and every group begins with null values."""
    pick = random.Random(1)
    groups = [None, *range(1, 40)]
    rows = [(0 if i % 3 == 0 else pick.choice(groups), pick.randint(0, 50), i, pick.choice([None, 1, 2])) for i in range(n)]
    rows = [(g, a, i, None if a > 45 else v) for g, a, i, v in rows]
    return spark.createDataFrame(rows, "g long, a long, id long, v long").repartition(5)


def order():
    return [F.desc("a"), F.asc("id")]


def test_split_equals_window(spark):
    df = skewed(spark)
    window = running(df, ["g"], order(), number="rn", sums={"total": F.col("v")})
    split = running(df, ["g"], order(), number="rn", sums={"total": F.col("v")}, limit=0)
    first = {r.id: (r.g, r.rn, r.total) for r in window.collect()}
    assert {r.id: (r.g, r.rn, r.total) for r in split.collect()} == first
    assert any(g is None for g, _, _ in first.values()) and any(total is None for _, _, total in first.values())


def test_split_keeps_groups_without_any_value(spark):
    df = skewed(spark).withColumn("v", F.when(F.col("g") == 3, F.lit(None)).otherwise(F.col("v")))
    split = running(df, ["g"], order(), sums={"total": F.col("v")}, limit=0)
    assert {r.total for r in split.filter("g = 3").collect()} == {None}


def test_split_uses_many_ranges_for_a_hot_group(spark):
    df = skewed(spark)
    split = running(df, ["g"], order(), number="rn", limit=0)
    hot = [r.rn for r in split.filter("g = 0").collect()]
    assert sorted(hot) == list(range(1, 1001))


def test_global_numbering(spark):
    df = skewed(spark)
    split = running(df, [], [F.asc("id")], number="rn", limit=0)
    assert all(r.rn == r.id + 1 for r in split.collect())


def test_group_totals_and_top_rows(spark):
    df = skewed(spark)
    assert largest_group(df, ["g"]) == 1000
    totals = with_group_totals(df, ["g"], groups=41, n=F.count(F.lit(1)))
    assert totals.filter("g = 0").select("n").distinct().first().n == 1000
    top = top_rows(df, ["g"], order(), 2).filter("g = 0").orderBy("place").collect()
    best = sorted(((-r.a, r.id) for r in df.filter("g = 0").collect()))[:2]
    assert [(-r.a, r.id) for r in top] == best


def test_broadcast_only_behind_a_bound(spark):
    df = skewed(spark)
    assert "hint" not in sized(df, BROADCAST_ROWS + 1)._jdf.queryExecution().analyzed().toString().lower()
    assert "hint" not in sized(df, None)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" in sized(df, 10)._jdf.queryExecution().analyzed().toString().lower()
