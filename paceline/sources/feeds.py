"""Timing feeds (laps, intervals, pit, stints, race control, telemetry) derived from ``events``.

A calendar week is a session and a user is a car. One staged row per event carries the lap number,
running time, gap and position; the feeds are projections of it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators.ordering import running, sized
from paceline.session import fixed, staged, staged_files
from paceline.sources.tables import table

# The league's tyre names by props.k mod 6
TYRES = ["SOFT", "MEDIUM", "HARD", "INTERMEDIATE", "WET", "OTHER"]


class Feeds:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def timing(self) -> DataFrame:
        return staged(self.spark, ("timing", self.sf_dir), lambda: build_timing(self.events), self.events.count)

    def timing_stream(self, files_per_batch: int | None = None) -> DataFrame:
        """The timing rows as a file stream, read like landed feed files."""
        path, schema = staged_files(self.spark, ("timing", self.sf_dir), lambda: build_timing(self.events), self.events.count)
        reader = self.spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(path)

    def event_stream(self) -> DataFrame:
        """The raw events as a file stream with an event-time column for watermarks."""
        reader = self.spark.readStream.schema(self.events.schema).option("pathGlobFilter", "events.parquet")
        return reader.parquet(self.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))

    @property
    def events(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "events")

    @property
    def laps(self) -> DataFrame:
        return self.timing.select("session", "driver_number", "lap_number", "lap_duration", "ts", "event_id")

    @property
    def intervals(self) -> DataFrame:
        return self.timing.select(
            "session", "driver_number", "lap_number", "position", F.col("gap_text").alias("gap_to_leader"), "interval",
            "ts", "event_id",
        )

    @property
    def pit(self) -> DataFrame:
        return self.timing.filter("event_type = 'purchase'").select(
            "session", "driver_number", F.col("lap_number").alias("lap")
        )

    @property
    def stints(self) -> DataFrame:
        """A new set of tyres starts on each pit lap."""
        return self.timing.filter("event_type = 'purchase'").select(
            "session",
            "driver_number",
            F.col("lap_number").alias("lap_start"),
            F.get(F.array(*[F.lit(t) for t in TYRES]), (F.col("k") % 6).cast("int")).alias("compound"),
            (F.col("k") % 4).alias("tyre_age_at_start"),
        )

    @property
    def race_control(self) -> DataFrame:
        message = F.when(F.col("event_type") == "signup", "SAFETY CAR DEPLOYED").otherwise("SAFETY CAR IN THIS LAP")
        return self.timing.filter(F.col("event_type").isin("signup", "error")).select(
            "session", F.lit("SafetyCar").alias("category"), message.alias("message"), "lap_number", "ts", "event_id"
        )

    @property
    def telemetry(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("driver_number"), F.col("value").alias("speed"), "ts", "event_id")

    @property
    def sessions(self) -> DataFrame:
        """Session and its longest lap count."""
        laps = F.max("lap_number").alias("total_laps")
        return staged(self.spark, ("sessions", self.sf_dir), lambda: self.timing.groupBy("session").agg(laps))

    @cached_property
    def session_count(self) -> int:
        """Weeks on the calendar (a footer-only count of the staged table)."""
        return self.sessions.count()

    @cached_property
    def car_laps(self) -> int:
        """Laps of sessions times their cars, from the staged lists."""
        cars = self.cars.groupBy("session").agg(F.count(F.lit(1)).alias("n")).join(self.sessions, "session")
        return cars.agg(F.coalesce(F.sum(F.col("n") * F.col("total_laps")), F.lit(0)).alias("n")).first().n

    @property
    def cars(self) -> DataFrame:
        """Car number and short code of a session; every tenth car has no code."""
        number = F.col("driver_number")
        code = F.when(number % 10 != 0, F.concat(F.lit("S"), number.cast("string")))
        found = staged(
            self.spark, ("cars", self.sf_dir), lambda: self.timing.select("session", "driver_number").distinct()
        )
        return found.withColumn("name_acronym", code)

    @property
    def priors(self) -> DataFrame:
        number = F.col("driver_number")
        cars = self.cars.select("driver_number").distinct()
        return cars.filter(number % 2 == 0).withColumn("prior", (1 + number % 9) / F.lit(10.0))


def build_timing(events: DataFrame) -> DataFrame:
    """Number the laps of each car, run up its total time and rank the cars on every lap."""
    value = F.col("value").cast("decimal(18,2)")
    rows = events.select(
        F.date_trunc("week", F.col("ts")).cast("date").alias("session"),
        F.col("user_id").alias("driver_number"),
        "event_id",
        "ts",
        "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("lap_duration"),
        value.alias("amount"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    car = ["session", "driver_number"]
    order = [F.asc("ts"), F.asc("event_id")]
    timed = running(rows, car, order, number="lap_number", sums={"total": F.col("amount")})
    timed = timed.withColumn("total", F.col("total").cast("decimal(18,2)")).drop("amount")
    lap = ["session", "lap_number"]
    # pinned: the leader of each lap and the car ahead are read from the same rows
    ranked = fixed(running(timed, lap, [F.asc("total"), F.asc("driver_number")], number="position"))
    leaders = ranked.filter("position = 1").select(*lap, F.col("total").alias("fastest"))
    ranked = with_gap(ranked.join(sized(leaders, leaders.count()), lap))
    # the car ahead is the row one place up on the same lap: an equi-join, no window over the field
    ahead = ranked.select(*lap, (F.col("position") + 1).alias("position"), F.col("total").alias("ahead"))
    return (
        ranked.join(ahead, [*lap, "position"], "left")
        .withColumn("interval", (F.col("total") - F.col("ahead")).cast("decimal(18,2)").cast("string"))
        .select(
            "session", "driver_number", "lap_number", "lap_duration", "event_id", "ts", "event_type", "k",
            F.col("total").cast("double").alias("total"), "gap_text", "interval", "position",
        )
    )


def with_gap(ranked: DataFrame) -> DataFrame:
    gap = (F.col("total") - F.col("fastest")).cast("decimal(18,2)").cast("string")
    return ranked.withColumn("gap_text", F.when(F.col("k") % 17 == 0, "+1 LAP").otherwise(gap))
