"""Live features per (session, car) as of chosen laps, for all sessions at once.

Every feed is cut at the lap and reduced with partial aggregates keyed by (session, car,
checkpoint); a car or session with most of the rows is reduced in each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import constants as C
from paceline.functions import rules
from paceline.operators.ordering import sized, top_rows

CAR = ["session", "driver_number", "checkpoint"]


def checkpoints(sessions: DataFrame, laps: Sequence[int], from_end: Sequence[int] = (1,)) -> DataFrame:
    """Chosen laps of every session: fixed ones inside the race, and N minus ``from_end``."""
    total = F.col("total_laps")
    fixed = [F.struct(F.lit(f"lap_{n}").alias("checkpoint"), F.lit(n).cast("long").alias("lap")) for n in laps]
    ends = [
        F.struct(F.lit(f"last_{n}" if n else "last").alias("checkpoint"), (total - n).alias("lap")) for n in from_end
    ]
    points = sessions.select("session", "total_laps", F.explode(F.array(*fixed, *ends)).alias("c"))
    return points.select("session", "total_laps", "c.*").filter("lap <= total_laps")


def latest_checkpoint(sessions: DataFrame) -> DataFrame:
    """The current state: the latest lap of each session, at least one."""
    lap = F.greatest(F.col("total_laps"), F.lit(1))
    return sessions.select("session", "total_laps", F.lit("last").alias("checkpoint"), lap.cast("long").alias("lap"))


def _upto(feed: DataFrame, points: DataFrame, lap: str) -> DataFrame:
    cut = points.select("session", "checkpoint", "lap").withColumnRenamed("lap", "_at")
    return feed.join(cut, "session").filter(F.col(lap) <= F.col("_at"))


def interval_state(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """Latest gaps and place, and the first place, by time; a lap may have any number of rows."""
    rows = _upto(intervals, points, "lap_number")
    seq = F.struct("ts", "event_id")
    state = rows.groupBy(*CAR).agg(
        F.max_by(F.struct("position", "gap_to_leader", "interval"), seq).alias("now"),
        F.min_by("position", F.when(F.col("position").isNotNull(), seq)).alias("start"),
    )
    place = F.coalesce("now.position", F.lit(C.DEFAULT_POSITION))
    return state.select(
        *CAR,
        place.cast("long").alias("current_position"),
        rules.gap_seconds(F.col("now.gap_to_leader")).alias("gap_to_leader"),
        rules.gap_seconds(F.col("now.interval")).alias("gap_to_driver_ahead"),
        (F.coalesce("start", F.lit(C.DEFAULT_POSITION)) - place).cast("long").alias("positions_gained"),
    )


def lap_state(laps: DataFrame, points: DataFrame) -> DataFrame:
    """Best lap, and mean and slope of the last five laps (missing times dropped after the cut)."""
    rows = _upto(laps, points, "lap_number").select(*CAR, "lap_number", "lap_duration")
    best = rows.groupBy(*CAR).agg(F.min("lap_duration").alias("best_lap_time"))
    last5 = top_rows(rows, CAR, [F.desc("lap_number")], 5).filter("lap_duration IS NOT NULL")
    indexed = last5.withColumn("i", F.row_number().over(Window.partitionBy(*CAR).orderBy("lap_number")) - 1)
    slope = F.when(F.count("i") >= 3, F.regr_slope("lap_duration", "i")).otherwise(0.0)
    recent = indexed.groupBy(*CAR).agg(F.avg("lap_duration").alias("avg_lap_time_last5"), slope.alias("lap_time_trend"))
    return best.join(recent, CAR, "left")


def pit_state(pit: DataFrame, points: DataFrame) -> DataFrame:
    rows = _upto(pit, points, "lap")
    return rows.groupBy(*CAR).agg(F.count(F.lit(1)).alias("pit_stops_made"), F.max("lap").alias("last_pit"))


def stint_state(stints: DataFrame, points: DataFrame) -> DataFrame:
    rows = _upto(stints, points, "lap_start")
    stint = F.struct("compound", "tyre_age_at_start", "lap_start")
    return rows.groupBy(*CAR).agg(F.max_by(stint, "lap_start").alias("stint"))


def safety_car_flag() -> tuple[Column, Column]:
    """Whether a message deploys (1) or ends (0) the regime, else null; and whether it is about the safety car."""
    text = F.upper(F.coalesce("message", F.lit("")))
    flag = F.when(text.contains("SAFETY CAR DEPLOYED"), 1).when(
        text.contains("SAFETY CAR IN") | text.contains("VIRTUAL SAFETY CAR ENDING"), 0
    )
    return flag, (F.coalesce("category", F.lit("")) == "SafetyCar") | text.contains("SAFETY CAR")


def safety_car_state(race_control: DataFrame, points: DataFrame, n_points: int | None = None) -> DataFrame:
    """Regime and count per (session, checkpoint).

    Messages are read in time order up to the first one beyond the lap; the last deploy or end
    among them decides.
    """
    flag, about = safety_car_flag()
    messages = race_control.select(
        "session", F.struct("ts", "event_id").alias("seq"), "lap_number", flag.alias("flag"), about.alias("about")
    )
    key = ["session", "checkpoint"]
    cut = points.select(*key, F.col("lap").alias("_at"))
    beyond = F.coalesce(F.col("lap_number"), F.lit(0)) > F.col("_at")
    stops = messages.join(cut, "session").groupBy(*key, "_at")
    stops = stops.agg(F.min(F.when(beyond, F.col("seq"))).alias("stop"))
    read = messages.join(sized(stops, n_points), "session")
    seen = F.col("stop").isNull() | (F.col("seq") < F.col("stop"))
    return read.groupBy(*key).agg(
        F.coalesce(F.max_by(F.when(seen, F.col("flag")), F.when(seen & F.col("flag").isNotNull(), F.col("seq"))), F.lit(0))
        .cast("long")
        .alias("safety_car_active"),
        F.count_if(F.col("about") & ~beyond).alias("safety_car_count"),
    )


def finished(spine: DataFrame, key: list[str]) -> DataFrame:
    """Feature columns from a car's state at a lap, with their defaults."""

    def known(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    lap, total, stint = F.col("lap"), F.col("total_laps"), F.col("stint")
    age = F.coalesce(stint["tyre_age_at_start"], F.lit(0)) + lap - F.coalesce(stint["lap_start"], lap)
    age = F.when(stint.isNotNull(), age).otherwise(0)
    remaining = total - lap
    stops = F.when((remaining > 30) & (age > 15), 1).when(remaining > 50, 2).otherwise(0)
    near_pit = F.coalesce(F.abs(lap - F.col("last_pit")) <= 1, F.lit(False))
    return spine.select(
        *key, "total_laps",
        known("current_position", C.DEFAULT_POSITION).alias("current_position"),
        "gap_to_leader", "gap_to_driver_ahead",
        known("positions_gained", 0).alias("positions_gained"),
        "avg_lap_time_last5",
        known("lap_time_trend", 0.0).alias("lap_time_trend"),
        "best_lap_time",
        known("pit_stops_made", 0).alias("pit_stops_made"),
        near_pit.cast("long").alias("is_pit_phase"),
        age.cast("long").alias("compound_age"),
        F.when(stint.isNotNull(), rules.compound_code(stint["compound"])).otherwise(1).cast("long").alias("current_compound"),
        remaining.alias("laps_remaining"),
        (lap / F.greatest(total, F.lit(1))).alias("race_progress"),
        stops.cast("long").alias("estimated_stops_remaining"),
        known("safety_car_active", 0).alias("safety_car_active"),
        known("safety_car_count", 0).alias("safety_car_count"),
    )


def live_features(
    cars: DataFrame,
    laps: DataFrame,
    intervals: DataFrame,
    pit: DataFrame,
    stints: DataFrame,
    race_control: DataFrame,
    points: DataFrame,
    n_points: int | None = None,
) -> DataFrame:
    """The live feature rows of every car at every checkpoint.

    ``n_points`` bounds the rows of ``points``; when small they are broadcast to the feeds.
    """
    points = sized(points, n_points)
    spine = cars.select("session", "driver_number").join(points, "session")
    for state in (
        interval_state(intervals, points),
        lap_state(laps, points),
        pit_state(pit, points),
        stint_state(stints, points),
    ):
        spine = spine.join(state, CAR, "left")
    spine = spine.join(
        sized(safety_car_state(race_control, points, n_points), n_points), ["session", "checkpoint"], "left"
    )
    return finished(spine, [*CAR, "lap"])


def feed_features(feeds, points: DataFrame, per_session: int) -> DataFrame:
    """Live features of the timing feeds at ``per_session`` checkpoints or fewer."""
    return live_features(
        feeds.cars, feeds.laps, feeds.intervals, feeds.pit, feeds.stints, feeds.race_control, points,
        feeds.session_count * per_session,
    )


def map_cars(cars: DataFrame, drivers: DataFrame) -> DataFrame:
    """Car number to driver id by short code; cars without a known code are dropped."""
    codes = drivers.select(F.col("code").alias("name_acronym"), "driver_id")
    return cars.filter("driver_number IS NOT NULL").join(codes, "name_acronym").select("session", "driver_number", "driver_id")
