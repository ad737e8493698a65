"""Joins of many rows whose Parquet files are small: what is broadcast passes through the driver."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from checks import documents
from paceline.operators import ordering
from paceline.sources import landing, merge

N = 50_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def league(spark, tmp_path_factory):
    """Results of many drivers, which compress to a file far below the size up to which Spark broadcasts."""
    path = str(tmp_path_factory.mktemp("compressed") / "results")
    rows = spark.range(N).select(F.col("id").alias("driver_id"), (F.col("id") % 5).alias("constructor_id"), F.lit(0.0).alias("points"))
    rows.coalesce(1).write.parquet(path)
    ids = spark.range(N).select(F.col("id").alias("driver_id"), (F.col("id") % 3).alias("nation"))
    nations = spark.createDataFrame([(i, f"n{i}") for i in range(3)], "nation long, nationality string")
    drivers = ids.join(F.broadcast(nations), "nation").select(
        "driver_id", F.lit("D").alias("code"), F.concat(F.lit("driver "), "driver_id").alias("full_name"), "nationality"
    )
    teams = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "constructor_id long, name string")
    return SimpleNamespace(results=spark.read.parquet(path), drivers=drivers, constructors=teams, field_bound=N, team_count=5)


def test_names_are_broadcast_and_never_the_rows(league):
    named = documents._named(league.results, league)
    assert "BroadcastHashJoin" in plan(named) and "BuildLeft" not in plan(named)
    assert named.count() == N


def test_names_of_too_many_drivers_are_merged(league, monkeypatch):
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", N - 1)
    named = documents._named(league.results, league)
    assert "SortMergeJoin" in plan(named) and "BuildLeft" not in plan(named)
    assert named.count() == N


def test_a_side_of_many_rows_is_not_left_to_its_file_size(league):
    left, many = league.results.select("driver_id", "points"), league.results.select("driver_id", "constructor_id")
    assert "BroadcastHashJoin" in plan(left.join(ordering.sized(many, 10), "driver_id"))
    assert "BroadcastHashJoin" not in plan(left.join(ordering.sized(many, ordering.BROADCAST_ROWS + 1), "driver_id"))


def test_upsert_of_many_keys_merges_them(spark, league, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(merge, "sized", lambda df, rows: seen.append(rows) or ordering.sized(df, rows))
    monkeypatch.setattr(merge, "PARTITIONS", 1)
    rows = spark.range(100).select("id", F.lit(1).alias("value"), (F.col("id") % 4).alias("part"))
    merge.first_load(rows, str(tmp_path), "part")
    merge.upsert(spark, str(tmp_path), rows.filter("id < 10").withColumn("value", F.lit(2)), ["id", "part"], "part", unique=True)
    assert seen == [float("inf")]
    stored = spark.read.parquet(str(tmp_path))
    assert stored.count() == 100 and stored.filter("value = 2").count() == 10


def test_corrections_merge_driver_rows(spark, tmp_path):
    team = "struct<constructorId:string,name:string,nationality:string>"
    driver = f"struct<points:string,position:string,Driver:struct<driverId:string>,Constructors:array<{team}>>"
    lists = f"season:string,round:string,DriverStandings:array<{driver}>,ConstructorStandings:array<struct<points:string,position:string,Constructor:{team}>>"
    schema = f"MRData struct<StandingsTable:struct<StandingsLists:array<struct<{lists}>>>>, {landing.CORRUPT} string"
    sent = [((([("2000", "1", [("7", "1", (d,), [("t", "T", "")])], [("9", "1", ("t", "T", ""))]),],),), None) for d in ("a",)]
    spark.createDataFrame(sent, schema).write.parquet(f"{tmp_path}/sent")
    documents_sent = spark.read.parquet(f"{tmp_path}/sent")
    stored = spark.createDataFrame(
        [("2000_2", 200002, 2000, d, 1.0, 2, "t", 3.0, 2) for d in ("a", "b")],
        "race_id string, ro long, year long, driver_id string, points double, position long, constructor_id string, "
        "constructor_pts double, constructor_pos long",
    )
    rows = landing.corrected_standings(documents_sent, stored)
    anti = [line for line in plan(rows).splitlines() if "Join" in line and "LeftAnti" in line and "driver_id" in line]
    assert anti and all("SortMergeJoin" in line for line in anti)
    found = {r.driver_id: (r.points, r.constructor_pts) for r in rows.collect()}
    assert found == {"a": (7.0, 9.0), "b": (1.0, 9.0)}


def test_order_of_a_page_does_not_depend_on_the_join(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(200001, 7, 2), (200001, 7, 1), (200001, 3, 3)], "ro long, driver_id long, grid long")
    race = (200001, 2000, 1, "2000-01-01", "c1", "Circuit 1", "Country 1")
    races = spark.createDataFrame([race], documents.RACE_FIELDS)
    read = []
    for n, some in enumerate((rows, rows.orderBy("grid"), rows.orderBy(F.desc("grid")))):
        documents._race_pages(some.coalesce(1), races, F.struct("driver_id", "grid"), "Results", "grid", f"{tmp_path}/{n}")
        read.append(spark.read.json(f"{tmp_path}/{n}").selectExpr("MRData.RaceTable.Races[0].Results r").first().r)
    assert read[0] == read[1] == read[2] == [(3, 3), (7, 2), (7, 1)]
