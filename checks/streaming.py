"""Streams drained over the available files, compared with batch SQL on the same rows."""

from pyspark.sql import functions as F

from checks.ctes import LEAGUE, TIMING, T, with_ctes
from checks.live import U, plain
from checks.registry import check
from paceline.functions.rules import tidy
from paceline.operators import live as lv
from paceline.sources.feeds import Feeds
from paceline.sources.league import League
from paceline.streaming import jobs, sinks, stateful

CAR = ["session", "driver_number"]
# The files of a season are read in any order, so sessions stay open for all of it
KEEP = "400 days"


@check(
    T + """SELECT session::VARCHAR AS session, driver_number, max(lap_number) AS lap_number,
      arg_max(position, lap_number) AS position, round(arg_max(gap, lap_number), 6) AS gap_to_leader, count(*) AS seen
    FROM timing GROUP BY session, driver_number"""
)
def stream_latest_state(spark, sf_dir):
    stream = jobs.latest_state(Feeds(spark, sf_dir).timing_stream(), KEEP)
    return plain(sinks.keyed_stream(stream, "latest", CAR), "gap_to_leader")


LAP_STATS = (
    with_ctes(TIMING) + """, last5 AS (
      SELECT session, driver_number, lap_duration, row_number() OVER (PARTITION BY session, driver_number ORDER BY lap_number) AS i
      FROM (SELECT *, row_number() OVER (PARTITION BY session, driver_number ORDER BY lap_number DESC) AS r FROM timing)
      WHERE r <= 5 AND lap_duration IS NOT NULL),
    pace AS (SELECT session, driver_number, avg(lap_duration) AS last5_mean,
      CASE WHEN count(*) >= 3 THEN regr_slope(lap_duration, i) ELSE 0 END AS trend FROM last5 GROUP BY ALL)
    SELECT t.session::VARCHAR AS session, t.driver_number, count(*) AS laps, round(min(lap_duration), 6) AS best_lap,
      round(any_value(last5_mean), 6) AS last5_mean, round(coalesce(any_value(trend), 0), 6) + 0.0 AS trend
    FROM timing t LEFT JOIN pace p ON p.session = t.session AND p.driver_number = t.driver_number
    GROUP BY t.session, t.driver_number"""
)


@check(LAP_STATS)
def stream_lap_stats(spark, sf_dir):
    stream = jobs.lap_stats(Feeds(spark, sf_dir).timing_stream(), KEEP)
    return plain(sinks.keyed_stream(stream, "lap_stats", CAR), "best_lap", "last5_mean", "trend")


@check(LAP_STATS)
def stream_lap_state(spark, sf_dir):
    """The same statistics with typed state that timers end."""
    stream = stateful.lap_state(Feeds(spark, sf_dir).timing_stream(), KEEP)
    with stateful.rocksdb(spark):
        rows = sinks.keyed_stream(stream, "lap_state", CAR)
    return plain(rows, "best_lap", "last5_mean", "trend")


@check(
    T + """SELECT session::VARCHAR AS session, arg_max(CASE event_type WHEN 'signup' THEN 1 ELSE 0 END, (ts, event_id))::BIGINT
      AS safety_car_active, count(*) AS messages FROM timing WHERE event_type IN ('signup', 'error') GROUP BY session"""
)
def stream_safety_car(spark, sf_dir):
    message = F.when(F.col("event_type") == "signup", "SAFETY CAR DEPLOYED").otherwise("SAFETY CAR IN THIS LAP")
    rows = Feeds(spark, sf_dir).timing_stream().filter(F.col("event_type").isin("signup", "error"))
    stream = jobs.safety_car(rows.select("session", "ts", "event_id", message.alias("message")), KEEP)
    return plain(sinks.keyed_stream(stream, "safety_car", ["session"]))


@check(
    U + """SELECT session::VARCHAR AS session, driver_number, round(prior, 6) AS prior, round(posterior, 6) AS posterior,
      round(prob, 6) AS prob FROM updated WHERE checkpoint = 'last'"""
)
def stream_posterior(spark, sf_dir):
    feeds = Feeds(spark, sf_dir)
    rows = sinks.merged_stream(
        jobs.car_state(feeds.timing_stream(), KEEP), "posterior", CAR, "session",
        lambda state: jobs.posterior(state, feeds.priors, feeds.session_count),
    )
    return plain(rows.select(*CAR, "prior", "posterior", "prob"), "prior", "posterior", "prob")


@check("SELECT event_id, user_id, value FROM events")
def stream_deduplicated(spark, sf_dir):
    """Every row polled twice arrives once."""
    feeds = Feeds(spark, sf_dir)
    polled = feeds.event_stream().unionByName(feeds.event_stream())
    path = sinks.append_stream(jobs.without_repeats(polled, ["event_id"], "60 days"), "deduplicated")
    return spark.read.parquet(path).select("event_id", "user_id", "value")


def telemetry(feeds):
    return feeds.event_stream().select(F.col("user_id").alias("driver_number"), F.col("value").alias("speed"), "ts")


def window_rows(spark, path):
    rows = spark.read.parquet(path)
    return rows.select(
        "driver_number", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "samples",
        tidy(F.col("mean_speed"), 9).alias("mean_speed"), "top_speed",
    )


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@check(
    f"""SELECT user_id AS driver_number, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS samples,
      round(avg(value), 9) AS mean_speed, max(value) AS top_speed FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {CLOSED} GROUP BY user_id, date_trunc('day', ts)"""
)
def stream_speed_by_day(spark, sf_dir):
    """Tumbling windows closed by the watermark."""
    stream = jobs.speed_windows(telemetry(Feeds(spark, sf_dir)), "1 day", "1 hour")
    return window_rows(spark, sinks.append_stream(stream, "speed_day"))


@check(
    f"""SELECT user_id AS driver_number, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS samples,
      round(avg(value), 9) AS mean_speed, max(value) AS top_speed
    FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events)
    WHERE w + INTERVAL 2 DAY <= {CLOSED} GROUP BY user_id, w"""
)
def stream_speed_sliding(spark, sf_dir):
    """Two-day windows every day, closed by the watermark."""
    stream = jobs.speed_windows(telemetry(Feeds(spark, sf_dir)), "2 days", "1 hour", "1 day")
    return window_rows(spark, sinks.append_stream(stream, "speed_sliding"))


@check(
    f"""WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    stints AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stint FROM gaps)
    SELECT user_id AS driver_number, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS samples,
      round(avg(value), 9) AS mean_speed, max(value) AS top_speed FROM stints GROUP BY user_id, stint
    HAVING max(ts) + INTERVAL 6 HOUR <= {CLOSED}"""
)
def stream_activity(spark, sf_dir):
    """Activity stints closed by the watermark."""
    stream = jobs.activity_windows(telemetry(Feeds(spark, sf_dir)), "6 hours", "1 hour")
    return window_rows(spark, sinks.append_stream(stream, "activity"))


@check(
    with_ctes(LEAGUE) + """SELECT event_id, d.driver_id, value AS speed FROM events e JOIN drivers d
      ON d.code = 'S' || e.user_id::VARCHAR WHERE e.user_id % 10 <> 0"""
)
def stream_driver_ids(spark, sf_dir):
    feeds, league = Feeds(spark, sf_dir), League(spark, sf_dir)
    mapping = lv.map_cars(feeds.cars, league.drivers).select("driver_number", "driver_id").distinct()
    rows = feeds.event_stream().select("event_id", F.col("user_id").alias("driver_number"), F.col("value").alias("speed"))
    path = sinks.append_stream(jobs.with_driver(rows, mapping), "driver_ids")
    return spark.read.parquet(path).select("event_id", "driver_id", "speed")
