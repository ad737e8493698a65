"""Landed live feeds in the shape that the live operators read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.sources import landing

CAR = ["session", "driver_number"]


class LandedFeeds:
    """Feeds landed as JSON under one folder per feed; ``paths`` maps feed names to folders.

    Interval and position rows carry a time and no lap. Each is put on the lap that its car had begun
    at that time (lap 0 before the first), and each state row holds the last place and the last gaps
    known by then. A car's rows of one session are ordered in one task; a race bounds their number.
    """

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self.spark, self.paths = spark, paths

    def feed(self, name: str) -> DataFrame:
        return landing.live_feed(self.spark, self.paths[name], name).withColumnRenamed("session_key", "session")

    @property
    def cars(self) -> DataFrame:
        found = self.feed("drivers").filter("session IS NOT NULL AND driver_number IS NOT NULL")
        return found.groupBy(*CAR).agg(F.max("name_acronym").alias("name_acronym"))

    @property
    def laps(self) -> DataFrame:
        return self.feed("laps").select(*CAR, "lap_number", "lap_duration")

    @cached_property
    def sessions(self) -> DataFrame:
        return self.laps.filter("lap_number IS NOT NULL").groupBy("session").agg(F.max("lap_number").alias("total_laps"))

    @cached_property
    def session_count(self) -> int:
        return self.sessions.count()

    @property
    def intervals(self) -> DataFrame:
        null = F.lit(None)
        laps = self.feed("laps").select(
            *CAR, F.col("date_start").alias("ts"), F.lit(0).alias("kind"), "lap_number",
            null.cast("long").alias("position"), null.cast("string").alias("gap_to_leader"), null.cast("string").alias("interval"),
        )
        places = self.feed("position").filter("position IS NOT NULL").select(
            *CAR, F.col("date").alias("ts"), F.lit(1).alias("kind"), null.cast("long").alias("lap_number"),
            "position", null.cast("string").alias("gap_to_leader"), null.cast("string").alias("interval"),
        )
        gaps = self.feed("intervals").select(
            *CAR, F.col("date").alias("ts"), F.lit(2).alias("kind"), null.cast("long").alias("lap_number"),
            null.cast("long").alias("position"), "gap_to_leader", "interval",
        )
        rows = laps.unionByName(places).unionByName(gaps).filter("ts IS NOT NULL")
        values = ["kind", "lap_number", "position", "gap_to_leader", "interval"]
        rows = rows.withColumn("event_id", F.struct(*values))
        upto = Window.partitionBy(*CAR).orderBy("ts", *values).rowsBetween(Window.unboundedPreceding, 0)
        # the lap may begin at the very time of a row: laps sort before other kinds
        gap = F.last(F.when(F.col("kind") == 2, F.struct("gap_to_leader", "interval")), ignorenulls=True).over(upto)
        state = rows.select(
            *CAR, "kind", "ts", "event_id",
            F.coalesce(F.max("lap_number").over(upto), F.lit(0)).alias("lap_number"),
            F.last("position", ignorenulls=True).over(upto).alias("position"),
            gap.alias("gap"),
        )
        return state.filter("kind > 0").select(*CAR, "lap_number", "position", "gap.gap_to_leader", "gap.interval", "ts", "event_id")

    @property
    def pit(self) -> DataFrame:
        return self.feed("pit").select(*CAR, F.col("lap_number").alias("lap"))

    @property
    def stints(self) -> DataFrame:
        return self.feed("stints").select(*CAR, "lap_start", "compound", "tyre_age_at_start")

    @property
    def race_control(self) -> DataFrame:
        rows = self.feed("race_control")
        return rows.select("session", "category", "message", "lap_number", F.col("date").alias("ts"), F.col("message").alias("event_id"))
