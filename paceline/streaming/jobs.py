"""Streaming forms of the live jobs; each equals its batch counterpart on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paceline.functions import rules
from paceline.operators.ordering import sized
from paceline.operators.update import bayesian_update, with_prior
from paceline.sources.feeds import TYRES

CAR = ["session", "driver_number"]


def closing(rows: DataFrame, keep: str | None) -> tuple[DataFrame, list[str]]:
    """Rows whose state ends with their session, and the key that says so.

    A row's event time is the day of its session. Once a session begins that is more than ``keep``
    later than another, the other is closed: its state is removed, and rows that still come for it
    are dropped and counted by Spark as late. Without ``keep`` state stays for ever.
    """
    if keep is None:
        return rows, []
    return rows.withColumn("session_time", F.col("session").cast("timestamp")).withWatermark("session_time", keep), ["session_time"]


def latest_state(timing: DataFrame, keep: str | None = None) -> DataFrame:
    """Newest place, gap and lap of every car (update mode)."""
    newest = F.max_by(F.struct("lap_number", "position", "gap_text", "total"), F.struct("ts", "event_id"))
    timing, ends = closing(timing, keep)
    return timing.groupBy(*ends, *CAR).agg(newest.alias("now"), F.count(F.lit(1)).alias("seen")).select(
        *CAR, "now.lap_number", "now.position", rules.gap_seconds(F.col("now.gap_text")).alias("gap_to_leader"), "seen"
    )


NEWEST_LAPS = "session date, driver_number long, lap_number long, lap_duration double, best double, seen long"


def newest_laps():
    """Map-side step of ``lap_stats``; made here so that it travels to workers by value."""

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per Arrow batch and car: its five newest laps, its best time and its row count (on one row).

        Runs before the shuffle, so a car with most of the rows reaches its task as a few per batch.
        """
        for rows in batches:
            totals = rows.groupby(CAR)["lap_duration"].agg(best="min", seen="size").reset_index()
            newest = rows.sort_values("lap_number").groupby(CAR).tail(5).merge(totals, on=CAR)
            newest["seen"] = newest["seen"].where(~newest.duplicated(CAR), 0)
            yield newest

    return reduce_batches


LAP_STATS = "session date, driver_number long, laps long, best_lap double, last5_mean double, trend double"
LAP_STATE = "cars array<long>, laps array<long>, best array<double>, owners array<long>, numbers array<long>, times array<double>"
RECENT = 5
# Cars of a session share this many states, so that calls and state rows do not grow with the cars
BLOCKS = 4096


def blocked(laps: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Laps with the block of their car; a session's cars are dealt to blocks by hash."""
    return laps.withColumn("block", F.pmod(F.xxhash64("driver_number"), F.lit(blocks)))


def block_fold():
    """Fold and report of a block of cars as arrays; made here so that they travel to workers by value.

    ``cars``, ``laps`` and ``best`` have an entry per car; ``owners``, ``numbers`` and ``times`` one per recent lap, by car
    and lap number. Missing times are NaN.
    """

    def fold(state: tuple, chunk: pd.DataFrame) -> tuple:
        """Fold new laps into the last five and the best of each car; rows may come in any order, later ones win."""
        cars, laps, best, owners, numbers, times = state
        car, found = chunk["driver_number"].to_numpy(dtype=np.int64), chunk["best"].to_numpy(dtype=float)
        known, at = np.unique(np.concatenate([cars, car]), return_inverse=True)
        count, least = np.zeros(len(known), np.int64), np.full(len(known), np.nan)
        np.add.at(count, at, np.concatenate([laps, chunk["seen"].to_numpy(dtype=np.int64)]))
        np.fmin.at(least, at, np.concatenate([best, found]))
        owners = np.concatenate([owners, car])
        numbers = np.concatenate([numbers, chunk["lap_number"].to_numpy(dtype=np.int64)])
        times = np.concatenate([times, chunk["lap_duration"].to_numpy(dtype=float)])
        order = np.lexsort((numbers, owners))
        owners, numbers, times = owners[order], numbers[order], times[order]
        last = np.ones(len(owners), bool)
        last[:-1] = (owners[1:] != owners[:-1]) | (numbers[1:] != numbers[:-1])
        owners, numbers, times = owners[last], numbers[last], times[last]
        newest = np.searchsorted(owners, owners, side="right") - np.arange(len(owners)) <= RECENT
        return known, count, least, owners[newest], numbers[newest], times[newest]

    def report(session, state: tuple, touched: np.ndarray) -> pd.DataFrame:
        """A row of statistics for each touched car."""
        cars, laps, best, owners, _, times = state
        timed = ~np.isnan(times)
        owners, times = owners[timed], times[timed]
        place = np.arange(len(owners)) - np.searchsorted(owners, owners)
        at = np.searchsorted(cars, owners)
        n = np.bincount(at, minlength=len(cars))
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.bincount(at, times, len(cars)) / n
            off = place - (n[at] - 1) / 2
            slope = np.bincount(at, off * times, len(cars)) / np.bincount(at, off**2, len(cars))
        rows = pd.DataFrame(
            {"session": session, "driver_number": cars, "laps": laps, "best_lap": best, "last5_mean": mean, "trend": np.where(n >= 3, slope, 0.0)}
        )
        return rows[np.isin(cars, touched)]

    return fold, report


def no_laps() -> tuple:
    whole, real = np.zeros(0, np.int64), np.zeros(0)
    return whole, whole, real, whole, whole, real


def lap_fold(ends: bool = False):
    """State step of ``lap_stats``; made here so that it travels to workers by value."""
    fold_block, report = block_fold()
    types = [np.int64, np.int64, float, np.int64, np.int64, float]
    nothing = no_laps()

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Fold new laps of a block of cars into its state; a row comes out for each car that had any."""
        if state.hasTimedOut:
            state.remove()
            return
        block, touched = nothing, []
        if state.exists:
            block = tuple(np.array(v, t) for v, t in zip(state.get, types))
        for chunk in chunks:
            block = fold_block(block, chunk)
            touched.append(np.unique(chunk["driver_number"].to_numpy(dtype=np.int64)))
        state.update(tuple(v.tolist() for v in block))
        if ends:
            # the day of the session, after which the watermark closes it
            state.setTimeoutTimestamp(int(pd.Timestamp(key[0]).timestamp() * 1000) + 1)
        yield report(key[0], block, np.concatenate(touched))

    return fold


def lap_stats(timing: DataFrame, keep: str | None = None) -> DataFrame:
    """Running lap statistics per car with five laps of state (update mode).

    Cars of a session share the states of ``BLOCKS`` blocks, each folded by array operations, so a car costs a few
    array entries and no call of its own.
    """
    laps = blocked(timing.select(*CAR, "lap_number", "lap_duration").mapInPandas(newest_laps(), NEWEST_LAPS))
    laps, ends = closing(laps, keep)
    timeout = GroupStateTimeout.EventTimeTimeout if ends else GroupStateTimeout.NoTimeout
    return laps.groupBy("session", "block").applyInPandasWithState(lap_fold(bool(ends)), LAP_STATS, LAP_STATE, "update", timeout)


def safety_car(race_control: DataFrame, keep: str | None = None) -> DataFrame:
    """Current regime per session: the newest deploy or end message (update mode)."""
    text = F.upper(F.col("message"))
    flag = F.when(text.contains("SAFETY CAR DEPLOYED"), 1).when(
        text.contains("SAFETY CAR IN") | text.contains("VIRTUAL SAFETY CAR ENDING"), 0
    )
    seq = F.when(flag.isNotNull(), F.struct("ts", "event_id"))
    race_control, ends = closing(race_control, keep)
    found = race_control.groupBy(*ends, "session").agg(
        F.coalesce(F.max_by(flag, seq), F.lit(0)).cast("long").alias("safety_car_active"),
        F.count(F.lit(1)).alias("messages"),
    )
    return found.drop(*ends)


def car_state(timing: DataFrame, keep: str | None = None) -> DataFrame:
    """Everything the live update needs, one row per car (update mode)."""
    pit = F.col("event_type") == "purchase"
    flag = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 0)
    seq = F.when(flag.isNotNull(), F.struct("ts", "event_id"))
    timing, ends = closing(timing, keep)
    found = timing.groupBy(*ends, *CAR).agg(
        F.max("lap_number").alias("last_lap"),
        F.max_by(F.struct("position", "gap_text"), F.struct("ts", "event_id")).alias("now"),
        F.max(F.when(pit, F.col("lap_number"))).alias("last_pit"),
        F.max_by(F.when(pit, F.col("k")), F.when(pit, F.col("lap_number"))).alias("pit_k"),
        F.max(F.when(flag.isNotNull(), F.struct("ts", "event_id", flag.alias("flag")))).alias("message"),
    )
    return found.drop(*ends)


def posterior(state: DataFrame, priors: DataFrame, n_sessions: int | None = None) -> DataFrame:
    """Live probabilities of whole sessions from their merged car states, by the batch update."""
    sessions = state.groupBy("session").agg(
        F.max("last_lap").alias("lap"), F.coalesce(F.max("message")["flag"], F.lit(0)).alias("safety_car_active")
    )
    tyres = F.get(F.array(*[F.lit(t) for t in TYRES]), (F.col("pit_k") % 6).cast("int"))
    stopped = F.col("last_pit").isNotNull()
    rows = state.join(sized(sessions, n_sessions), "session").select(
        *CAR, "lap", F.col("lap").alias("total_laps"), "safety_car_active",
        F.col("now.position").alias("current_position"),
        rules.gap_seconds(F.col("now.gap_text")).alias("gap_to_leader"),
        F.coalesce(F.abs(F.col("lap") - F.col("last_pit")) <= 1, F.lit(False)).cast("long").alias("is_pit_phase"),
        F.when(stopped, F.col("pit_k") % 4 + F.col("lap") - F.col("last_pit")).otherwise(0).alias("compound_age"),
        F.when(stopped, rules.compound_code(tyres)).otherwise(1).alias("current_compound"),
    )
    return bayesian_update(with_prior(rows, priors, ["driver_number"]), ["session"], n_sessions)


def without_repeats(rows: DataFrame, key: list[str], delay: str, time: str = "ts") -> DataFrame:
    """Rows of re-polled feeds once each (append mode)."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def _speeds(grouped) -> DataFrame:
    return grouped.agg(
        F.count(F.lit(1)).alias("samples"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("top_speed")
    )


def _bounds(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "samples", "mean_speed", "top_speed"
    )


def speed_windows(telemetry: DataFrame, size: str, delay: str, slide: str | None = None) -> DataFrame:
    """Mean and top speed per car in tumbling or sliding windows; late rows are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = telemetry.withWatermark("ts", delay).groupBy("driver_number", window.alias("window"))
    return _bounds(_speeds(grouped), "driver_number")


def activity_windows(telemetry: DataFrame, gap: str, delay: str) -> DataFrame:
    """Stints of activity per car: windows that end after a silence.

    For a car with most of the rows, merge sessions before the shuffle with
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``.
    """
    window = F.session_window("ts", gap).alias("window")
    return _bounds(_speeds(telemetry.withWatermark("ts", delay).groupBy("driver_number", window)), "driver_number")


def with_driver(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Car number to driver id on a stream, from a static table; unknown cars are dropped."""
    return rows.join(mapping, "driver_number")
