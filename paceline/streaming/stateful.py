"""Lap statistics on the state operator with typed state, timers and time to live (RocksDB state).

The state of a block of cars is a value (laps seen and best time of each) and a list (the newest five laps of each). The
map-side step of ``jobs`` still reduces every batch first, so a car with most of the rows reaches its task as a few per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paceline.streaming.jobs import BLOCKS, CAR, LAP_STATS, NEWEST_LAPS, block_fold, blocked, newest_laps, no_laps

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lap_processor(closes: bool, ttl_ms: int | None):
    """The state step; made here so that it travels to workers by value."""
    fold_block, report = block_fold()
    nothing = no_laps()

    class LapProcessor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.totals = handle.getValueState("totals", "cars array<long>, laps array<long>, best array<double>", ttl_ms)
            self.recent = handle.getListState("recent", "driver_number long, lap_number long, lap_duration double", ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            totals = self.totals.get()
            block, touched = nothing, []
            if totals is not None:
                cars, laps, best = totals
                owners, numbers, times = zip(*self.recent.get())
                whole, real = (lambda v: np.array(v, np.int64)), (lambda v: np.array(v, float))
                block = whole(cars), whole(laps), real(best), whole(owners), whole(numbers), real(times)
            for chunk in rows:
                block = fold_block(block, chunk)
                touched.append(np.unique(chunk["driver_number"].to_numpy(dtype=np.int64)))
            self.totals.update(tuple(v.tolist() for v in block[:3]))
            self.recent.put(list(zip(*(v.tolist() for v in block[3:]))))
            if closes and totals is None:
                # once the watermark passes the day of the session, its cars are done
                self.handle.registerTimer(int(pd.Timestamp(key[0]).timestamp() * 1000) + 1)
            yield report(key[0], block, np.concatenate(touched))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.totals.clear()
            self.recent.clear()
            yield pd.DataFrame()

        def close(self) -> None:
            pass

    return LapProcessor()


def lap_state(timing: DataFrame, keep: str | None = None, idle: str | None = None) -> DataFrame:
    """Running lap statistics per car (update mode), equal to ``jobs.lap_stats``.

    With ``keep`` a session that begins more than that later closes a session: a timer in event time removes its state
    and rows that still come for it are dropped. With ``idle`` state instead lives that long after its last change by
    the clock, whatever the sessions; then every car has a state of its own. The session needs the RocksDB state store
    (``rocksdb``).
    """
    if keep and idle:
        raise ValueError("state ends by event time or by the clock, not by both")
    laps = timing.select(*CAR, "lap_number", "lap_duration").mapInPandas(newest_laps(), NEWEST_LAPS)
    laps = laps.withColumn("block", F.col("driver_number")) if idle else blocked(laps, BLOCKS)
    if keep:
        laps = laps.withColumn("session_time", F.col("session").cast("timestamp")).withWatermark("session_time", keep)
    ttl = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    mode = "EventTime" if keep else "ProcessingTime" if idle else "None"
    return laps.groupBy("session", "block").transformWithStateInPandas(lap_processor(bool(keep), ttl), LAP_STATS, "update", mode)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for the streams started inside; the session's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
