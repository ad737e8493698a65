"""Tasks of staged tables and of car windows do not grow with the input."""

import pytest
from pyspark.sql import functions as F

from paceline import session
from paceline.operators import laps as lp
from paceline.sources.feeds import Feeds
from paceline.sources.league import League

COUNT, SIZE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_staging_deals_rows_to_more_tasks_and_puts_settings_back(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    before, seen = [spark.conf.get(k, None) for k in (COUNT, SIZE)], []

    def build():
        seen.append((spark.conf.get(COUNT), spark.conf.get(SIZE)))
        return spark.range(1000).groupBy("id").count()

    got = session.staged(spark, ("tasks", "many"), build, lambda: 1000)
    assert got.count() == 1000 and seen == [("100", session.TASK_BYTES)]
    with pytest.raises(ZeroDivisionError):
        session.staged(spark, ("tasks", "broken"), lambda: 1 // 0, lambda: 1000)
    assert [spark.conf.get(k, None) for k in (COUNT, SIZE)] == before


def test_league_tables_are_staged_by_their_rows(spark, small, monkeypatch):
    known = []
    monkeypatch.setattr("paceline.sources.league.staged", lambda spark, key, build, rows=None: known.append((key[0], rows())) or spark.range(7))
    league = League(spark, small)
    assert league.results.count() == 7
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert ("entry", lines) in known and ("results", 7) in known


def test_cars_are_dealt_to_tasks_by_the_laps(spark, small, monkeypatch):
    feeds = Feeds(spark, small)
    want = {tuple(r) for r in lp.feed_features_by_lap(feeds).collect()}
    rows = feeds.timing.count() + feeds.car_laps
    cars = feeds.cars.join(feeds.sessions, "session").agg(F.sum("total_laps")).first()[0]
    assert feeds.car_laps == cars
    monkeypatch.setattr(session, "TASK_ROWS", rows // 20)
    found = lp.feed_features_by_lap(feeds)
    assert f"{session.parts_of(rows)}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == want
