"""Several micro-batches give the batch result."""

import time

import pytest
from pyspark.sql import functions as F

from paceline.operators import live as lv
from paceline.operators import update as up
from paceline.sources.feeds import Feeds
from paceline.streaming import jobs, sinks, stateful

CAR = ["session", "driver_number"]


@pytest.fixture(scope="module")
def feeds(spark, small):
    return Feeds(spark, small)


@pytest.fixture(scope="module")
def stream(spark, feeds, tmp_path_factory):
    """The timing rows in five files, one per micro-batch."""
    path = str(tmp_path_factory.mktemp("timing") / "files")
    feeds.timing.repartition(5, "event_id").write.parquet(path)

    def read():
        return spark.readStream.schema(feeds.timing.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return read


def rows(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_latest_state(feeds, stream):
    columns = [*CAR, "lap_number", "position", "gap_to_leader", "seen"]
    got = sinks.keyed_stream(jobs.latest_state(stream()), "latest", CAR)
    assert rows(got, *columns) == rows(jobs.latest_state(feeds.timing), *columns)


def test_folders_of_batches_are_folded(spark, feeds, stream):
    columns = [*CAR, "lap_number", "position", "gap_to_leader", "seen"]
    want = rows(jobs.latest_state(feeds.timing), *columns)
    got = sinks.keyed_stream(jobs.latest_state(stream()), "folded", CAR, folders=2)
    assert rows(got, *columns) == want
    # five batches: four of them twice folded, one left
    folders = {f.rsplit("/", 1)[0].split("/level=")[1] for f in got.inputFiles()}
    assert folders == {"2/batch=0", "0/batch=4"}


def test_folding_again_after_a_failure(spark, monkeypatch):
    """A batch that stops between two folders that it removes is run again, with the same result."""
    batches = [spark.createDataFrame([(i % 3, i)], "k long, v long") for i in range(8)]
    calls, removed = [], []

    def drive(stream, name, mode, handle):
        for number, batch in enumerate(batches):
            while True:
                try:
                    handle(batch, number)
                    break
                except OSError:
                    calls.append(number)

    def stops(session, path):
        removed.append(path)
        if len(removed) in (3, 6, 8, 14):
            raise OSError
        keep(session, path)

    keep = sinks.discard
    monkeypatch.setattr(sinks, "batch_stream", drive)
    monkeypatch.setattr(sinks, "discard", stops)
    got = sinks.keyed_stream(batches[0], "again", ["k"], folders=2)
    assert rows(got, "k", "v") == [(0, 6), (1, 7), (2, 5)] and len(calls) == 4


def test_lap_stats(feeds, stream):
    got = sinks.keyed_stream(jobs.lap_stats(stream()), "stats", CAR)
    points = lv.latest_checkpoint(feeds.sessions)
    want = lv.lap_state(feeds.laps, points).select(*CAR, "best_lap_time", "avg_lap_time_last5", F.coalesce("lap_time_trend", F.lit(0.0)))
    first = {r[:2]: r[2:] for r in rows(want, "*")}
    second = {(r.session, r.driver_number): (r.best_lap, r.last5_mean, r.trend) for r in got.collect()}
    assert first.keys() == second.keys()
    for car, values in first.items():
        for a, b in zip(values, second[car]):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9)


def test_posterior(feeds, stream):
    got = sinks.merged_stream(jobs.car_state(stream()), "post", CAR, "session", lambda s: jobs.posterior(s, feeds.priors))
    live = lv.feed_features(feeds, lv.latest_checkpoint(feeds.sessions), 1)
    want = up.bayesian_update(up.with_prior(live, feeds.priors, ["driver_number"]), ["session"])
    assert rows(got, *CAR, "prob") == rows(want, *CAR, "prob")


def test_repeated_rows(feeds, stream):
    polled = stream().withColumn("ts", F.col("ts").cast("timestamp"))
    unique = jobs.without_repeats(polled.unionByName(polled), ["event_id"], "90 days")
    path = sinks.append_stream(unique, "unique")
    spark = feeds.spark
    assert spark.read.parquet(path).count() == feeds.timing.count()


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "driver_number long, speed double, ts timestamp"
    base = "2024-01-01 {}:00:00"
    for i, (hour, speed) in enumerate([("01", 10.0), ("12", 20.0), ("13", 25.0), ("02", 99.0), ("23", 30.0)]):
        row = spark.createDataFrame([(1, speed, base.format(hour))], "driver_number long, speed double, t string")
        row.select("driver_number", "speed", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    path = sinks.append_stream(jobs.speed_windows(stream, "1 hour", "1 hour"), "late")
    starts = [r.start.hour for r in spark.read.parquet(path).orderBy("start").collect()]
    assert 1 in starts and 12 in starts and 2 not in starts


@pytest.mark.parametrize("job", [jobs.latest_state, jobs.lap_stats, jobs.car_state])
def test_state_ends_with_its_session(spark, feeds, tmp_path, job):
    """State of a closed session is removed; rows that still come for it are dropped and counted."""
    one = feeds.timing.limit(40).withColumn("session", F.lit("2024-01-01").cast("date"))
    for i, day in enumerate(["2024-01-01", "2024-04-01", "2024-04-02", "2024-01-01"]):
        one.withColumn("session", F.lit(day).cast("date")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    cars = one.select("driver_number").distinct().count()
    stream = spark.readStream.schema(feeds.timing.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = (
        job(stream, "14 days").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        .foreachBatch(lambda batch, _: batch.collect()).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert states[0]["numRowsTotal"] == cars
    assert states[-1]["numRowsTotal"] == 2 * cars
    assert sum(s["numRowsDroppedByWatermark"] for s in states) > 0


LAP_COLUMNS = [*CAR, "laps", "best_lap", "last5_mean", "trend"]


def drained(stream, folder, by_the_clock=False):
    """Newest row of every key after one drain into ``folder``, with the stream's progress.

    A stream that counts by the clock always has another batch to run, so it is stopped when its input is done.
    """
    with stateful.rocksdb(stream.sparkSession):
        query = (
            stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/c")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
            .trigger(**({"processingTime": "1 second"} if by_the_clock else {"availableNow": True})).start()
        )
        deadline = time.time() + 40
        while by_the_clock and not any(p["numInputRows"] for p in query.recentProgress) and time.time() < deadline:
            time.sleep(0.2)
        query.stop() if by_the_clock else query.awaitTermination()
    out = sinks.latest_by_key(stream.sparkSession.read.parquet(f"{folder}/out"), CAR, ["batch"])
    return out, [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]


def test_lap_state_over_batches_and_restarts(spark, feeds, tmp_path):
    """Files landed in two parts around a restart give the batch result."""
    parts = feeds.timing.randomSplit([1.0, 1.0, 1.0], 7)
    stream = lambda: spark.readStream.schema(feeds.timing.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    parts[0].union(parts[1]).repartition(2).write.parquet(str(tmp_path / "in/0"))
    drained(stateful.lap_state(stream()), tmp_path)
    parts[2].coalesce(1).write.parquet(str(tmp_path / "in/1"))
    got, _ = drained(stateful.lap_state(stream()), tmp_path)
    want = sinks.keyed_stream(jobs.lap_stats(feeds.timing_stream()), "stats", CAR)
    assert rows(got, *LAP_COLUMNS) == rows(want, *LAP_COLUMNS)


def test_timers_end_lap_state(spark, feeds, tmp_path):
    one = feeds.timing.limit(40).withColumn("session", F.lit("2024-01-01").cast("date"))
    for i, day in enumerate(["2024-01-01", "2024-04-01", "2024-04-02", "2024-01-01"]):
        one.withColumn("session", F.lit(day).cast("date")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    cars = one.select("driver_number").distinct().count()
    stream = spark.readStream.schema(feeds.timing.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out, states = drained(stateful.lap_state(stream, "14 days"), tmp_path)
    # a value and up to five list entries per open car, timers aside: those of the first session are gone
    removed = [s["customMetrics"].get("numDeletedTimers", 0) for s in states]
    assert sum(removed) == cars
    assert sum(s["numRowsDroppedByWatermark"] for s in states) > 0
    assert out.filter("session = '2024-01-01'").agg(F.max("laps")).first()[0] == out.filter("session = '2024-04-01'").agg(F.max("laps")).first()[0]


def test_idle_lap_state_ends_by_the_clock(spark, feeds, tmp_path):
    """State that nothing changed for the given time is gone: a later lap starts the count again."""
    one = feeds.timing.filter("lap_number <= 3")
    stream = lambda: spark.readStream.schema(feeds.timing.schema).parquet(str(tmp_path / "in/*"))
    one.coalesce(1).write.parquet(str(tmp_path / "in/0"))
    first, _ = drained(stateful.lap_state(stream(), idle="1 second"), tmp_path, True)
    most = first.agg(F.max("laps")).first()[0]
    one.coalesce(1).write.parquet(str(tmp_path / "in/1"))
    second, _ = drained(stateful.lap_state(stream(), idle="1 second"), tmp_path, True)
    assert second.agg(F.max("laps")).first()[0] == most
    with pytest.raises(ValueError, match="not by both"):
        stateful.lap_state(stream(), "1 day", "1 day")


def many_cars(spark, folder):
    """Forty cars of a session in five files: each car has laps in all of them, some without a time."""
    cars = spark.range(40).crossJoin(spark.range(1, 16).withColumnRenamed("id", "lap_number"))
    time = F.when((F.col("id") + F.col("lap_number")) % 4 != 0, 80.0 + (F.col("id") * 7 + F.col("lap_number") * 5) % 11)
    laps = cars.select(
        F.lit("2024-01-01").cast("date").alias("session"), F.col("id").alias("driver_number"), "lap_number", time.alias("lap_duration")
    )
    laps.repartition(5, "lap_number").write.parquet(folder)
    return laps, spark.readStream.schema(laps.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def expected_laps(laps):
    want = {}
    for car in range(40):
        times = dict(laps.filter(F.col("driver_number") == car).select("lap_number", "lap_duration").collect())
        timed = [times[n] for n in sorted(times)[-5:] if times[n] is not None]
        centre = (len(timed) - 1) / 2
        trend = sum((i - centre) * t for i, t in enumerate(timed)) / sum((i - centre) ** 2 for i in range(len(timed)))
        want[car] = (15, min(t for t in times.values() if t is not None), sum(timed) / len(timed), trend)
    return want


@pytest.mark.parametrize("typed", [False, True])
def test_cars_share_states_in_blocks(spark, tmp_path, monkeypatch, typed):
    """State rows and calls follow the blocks, not the cars; every car still has its own statistics."""
    monkeypatch.setattr(jobs, "BLOCKS", 3)
    monkeypatch.setattr(jobs.blocked, "__defaults__", (3,))
    monkeypatch.setattr(stateful, "BLOCKS", 3)
    laps, stream = many_cars(spark, str(tmp_path / "in"))
    got, states = drained(stateful.lap_state(stream, "14 days") if typed else jobs.lap_stats(stream, "14 days"), tmp_path)
    found = {r.driver_number: (r.laps, r.best_lap, r.last5_mean, r.trend) for r in got.collect()}
    want = expected_laps(laps)
    assert found.keys() == want.keys()
    for car, values in want.items():
        assert found[car] == pytest.approx(values, abs=1e-9)
    if not typed:
        assert max(s["numRowsTotal"] for s in states) == 3
