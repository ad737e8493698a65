"""League tables themselves, data-quality jobs and simple table queries."""

from pyspark.sql import functions as F

from checks.ctes import LS, L, T
from checks.registry import check
from paceline.sources.feeds import Feeds
from paceline.sources.league import League


@check(
    L
    + """SELECT race_id, ro, year, round, driver_id, constructor_id, grid, position, status, points, laps_completed,
         is_podium FROM results"""
)
def league_results(spark, sf_dir):
    return League(spark, sf_dir).results.drop("position_text")


@check(L + "SELECT * FROM qualifying")
def league_qualifying(spark, sf_dir):
    return League(spark, sf_dir).qualifying


@check(LS + "SELECT * FROM standings")
def league_standings(spark, sf_dir):
    return League(spark, sf_dir).standings


@check(
    T
    + """SELECT session::VARCHAR AS session, driver_number, lap_number, event_id, lap_duration, total::DOUBLE AS total,
         gap_text, interval, position FROM timing"""
)
def timing_laps(spark, sf_dir):
    return Feeds(spark, sf_dir).timing.select(
        F.col("session").cast("string").alias("session"), "driver_number", "lap_number", "event_id", "lap_duration",
        "total", "gap_text", "interval", "position",
    )
