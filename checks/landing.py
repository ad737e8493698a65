"""Landing, merge and data-quality jobs. Documents are written from the league by Spark, then landed."""

from pyspark.sql import functions as F

from checks.ctes import LS, LEAGUE, L, T, with_ctes
from checks import documents
from checks.features import MATRIX, rounded, sql_rounded
from checks.registry import check
from paceline.functions.constants import FEATURES
from paceline.functions import rules
from paceline.functions.rules import tidy
from paceline.operators import features, ordering
from paceline.session import new_path
from paceline.sources import landing, merge, schemas, tables
from paceline.sources.feeds import Feeds
from paceline.sources.league import League
from paceline.sources.live_feeds import LandedFeeds

_WRITTEN: dict[tuple, str] = {}


def written(league, kind, write):
    """Folder of the documents of one kind, written once per application and input."""
    key = (league.spark.sparkContext.applicationId, league.sf_dir, kind)
    if key not in _WRITTEN:
        path = new_path(league.spark, kind)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def result_documents(spark, sf_dir):
    league = League(spark, sf_dir)
    path = written(league, "results", lambda p: documents.write_results(league, p))
    return landing.read_documents(spark, path, schemas.RESULTS_DOC)


@check(
    L + """SELECT race_id, ro, year, round, driver_id::VARCHAR AS driver_id, constructor_id::VARCHAR AS constructor_id, grid,
      position, coalesce(position::VARCHAR, 'R') AS position_text, status, points, laps_completed,
      grid AS fastest_lap_rank, is_podium FROM results"""
)
def landed_results(spark, sf_dir):
    return landing.results(result_documents(spark, sf_dir))


@check(
    L + """SELECT race_id, ro, year, round, circuit_id, circuit_name, country, race_date::VARCHAR AS race_date,
      NULL AS total_laps FROM races SEMI JOIN results USING (ro)"""
)
def landed_races(spark, sf_dir):
    rows = landing.races(result_documents(spark, sf_dir))
    return rows.withColumn("race_date", F.col("race_date").cast("string"))


@check(
    L + """SELECT driver_id::VARCHAR AS driver_id, code, full_name, nationality
      FROM drivers WHERE driver_id IN (SELECT driver_id FROM results)"""
)
def landed_drivers(spark, sf_dir):
    return landing.drivers(result_documents(spark, sf_dir))


@check(
    L + """SELECT constructor_id::VARCHAR AS constructor_id, name, '' AS nationality
      FROM constructors WHERE constructor_id IN (SELECT constructor_id FROM results)"""
)
def landed_constructors(spark, sf_dir):
    return landing.constructors(result_documents(spark, sf_dir))


@check(
    L + """SELECT race_id, ro, driver_id::VARCHAR AS driver_id, constructor_id::VARCHAR AS constructor_id, position,
      q1_sec, q2_sec, q3_sec FROM qualifying"""
)
def landed_qualifying(spark, sf_dir):
    league = League(spark, sf_dir)
    path = written(league, "qualifying", lambda p: documents.write_qualifying(league, p))
    rows = landing.qualifying(landing.read_documents(spark, path, schemas.QUALIFYING_DOC))
    return rows.withColumns({c: F.round(c, 3) for c in ("q1_sec", "q2_sec", "q3_sec")})


@check(
    LS + """SELECT race_id, year, round, driver_id::VARCHAR AS driver_id, points, position,
      constructor_id::VARCHAR AS constructor_id, constructor_pts, constructor_pos FROM standings"""
)
def landed_standings(spark, sf_dir):
    league = League(spark, sf_dir)
    path = written(league, "standings", lambda p: documents.write_standings(league, p))
    return landing.standings(landing.read_documents(spark, path + "/*", schemas.STANDINGS_DOC))


@check(
    T + """SELECT year(session)::VARCHAR || '_' || week(session)::VARCHAR AS race_id, driver_number::VARCHAR AS driver_id,
      row_number() OVER (PARTITION BY session, driver_number ORDER BY lap_number) AS stop_number, lap_number AS lap,
      lap_duration AS duration_sec FROM timing WHERE event_type = 'purchase'"""
)
def landed_pit_stops(spark, sf_dir):
    feeds = Feeds(spark, sf_dir)
    stops = feeds.timing.filter("event_type = 'purchase'").select(
        F.year("session").cast("long").alias("year"), F.weekofyear("session").cast("long").alias("round"),
        F.col("driver_number").alias("driver_id"), F.col("lap_number").alias("lap"),
        F.col("lap_duration").alias("duration_sec"),
    )
    stops = ordering.running(stops, ["year", "round", "driver_id"], [F.asc("lap")], number="stop_number")
    path = written(feeds, "pit_stops", lambda p: documents.write_pit_stops(stops, p))
    return landing.pit_stops(landing.read_documents(spark, path, schemas.PIT_STOPS_DOC))


@check(
    L + """SELECT race_id, ro, year, round, circuit_id, circuit_name, country, race_date::VARCHAR AS race_date,
      NULL AS total_laps FROM races"""
)
def landed_calendar(spark, sf_dir):
    league = League(spark, sf_dir)
    path = written(league, "calendar", lambda p: documents.write_calendar(league, p))
    rows = landing.races(landing.read_documents(spark, path, schemas.CALENDAR_DOC))
    return rows.withColumn("race_date", F.col("race_date").cast("string"))


@check(L + "SELECT driver_id::VARCHAR AS driver_id, code, full_name, nationality FROM drivers")
def landed_driver_list(spark, sf_dir):
    league = League(spark, sf_dir)
    path = written(league, "drivers", lambda p: documents.write_drivers(league, p))
    return landing.driver_list(landing.read_documents(spark, path, schemas.DRIVERS_DOC))


@check(L + "SELECT constructor_id::VARCHAR AS constructor_id, name, '' AS nationality FROM constructors")
def landed_constructor_list(spark, sf_dir):
    league = League(spark, sf_dir)
    path = written(league, "constructors", lambda p: documents.write_constructors(league, p))
    return landing.constructor_list(landing.read_documents(spark, path, schemas.TEAMS_DOC))


# Circuit ids as the feed spells them, by round; the last two have no other spelling
SPELLED = ["villeneuve", "catalunya", "red_bull_ring", "marina_bay", "americas", "rodriguez", "losail", "monza", "c9"]


@check(
    L + """SELECT race_id, ro, year, round,
      CASE round % 9 WHEN 0 THEN 'montreal' WHEN 1 THEN 'barcelona' WHEN 2 THEN 'spielberg' WHEN 3 THEN 'singapore'
        WHEN 4 THEN 'cota' WHEN 5 THEN 'mexico_city' WHEN 6 THEN 'lusail' WHEN 7 THEN 'monza' ELSE 'c9' END AS circuit_id,
      circuit_name, country, race_date::VARCHAR AS race_date, NULL AS total_laps FROM races"""
)
def landed_spelled_circuits(spark, sf_dir):
    """Races whose documents name circuits as the feed does."""
    league = League(spark, sf_dir)
    spelled = F.element_at(F.array(*map(F.lit, SPELLED)), (F.col("round") % len(SPELLED) + 1).cast("int"))
    races = league.races.withColumn("circuit_id", spelled)
    path = written(league, "spelled-calendar", lambda p: documents.write_calendar(league, p, races))
    rows = landing.races(landing.read_documents(spark, path, schemas.CALENDAR_DOC))
    return rows.withColumn("race_date", F.col("race_date").cast("string"))


@check(
    L + """SELECT driver_id::VARCHAR AS driver_id, code, CASE driver_id % 5 WHEN 1 THEN split_part(full_name, '#', 2)
      WHEN 2 THEN split_part(full_name, '#', 1) WHEN 3 THEN '' ELSE replace(full_name, '#', ' ') END AS full_name, nationality
    FROM drivers"""
)
def landed_full_names(spark, sf_dir):
    """Names in two parts, of which one, the other or both may be missing, or padded."""
    league = League(spark, sf_dir)
    part, kind = F.split("full_name", "#"), F.col("driver_id") % 5
    given = F.when(kind == 4, F.concat(F.lit("  "), part[0])).when(~kind.isin(1, 3), part[0])
    family = F.when(kind == 4, F.concat(part[1], F.lit(" "))).when(~kind.isin(2, 3), part[1])
    path = written(league, "two-part-names", lambda p: documents.write_drivers(league, p, given, family))
    return landing.driver_list(landing.read_documents(spark, path, schemas.DRIVERS_DOC))


@check(
    L + """, spoiled AS (SELECT race_id, driver_id::VARCHAR AS driver_id, ro, unnest([1, 2, 3]) AS i,
        unnest([q1_sec, q2_sec, q3_sec]) AS sec, (ro + driver_id) % 6 AS kind FROM qualifying),
      landed AS (SELECT race_id, ro, driver_id, i, CASE WHEN kind IN (0, 1) THEN sec WHEN kind = 2 THEN floor(sec % 60) + 60 END AS sec FROM spoiled)
    SELECT race_id, ro, driver_id, round(max(sec) FILTER (i = 1), 3) AS q1_sec, round(max(sec) FILTER (i = 2), 3) AS q2_sec,
      round(max(sec) FILTER (i = 3), 3) AS q3_sec FROM landed GROUP BY ALL"""
)
def landed_spoiled_laps(spark, sf_dir):
    """Lap times as the feed may send them: followed by a note, cut to tenths, without minutes, as words or empty."""
    league = League(spark, sf_dir)
    kind = (F.col("ro") + F.col("driver_id")) % 6

    def spoil(text):
        tenths = F.concat(F.lit("1:"), F.substring(F.split(text, ":")[1], 1, 2), F.lit(".0"))
        cases = {1: F.concat(text, F.lit(" (deleted)")), 2: tenths, 3: F.split(text, ":")[1], 4: F.lit("DNF"), 5: F.lit("")}
        out = F.when(kind == 0, text)
        for number, value in cases.items():
            out = out.when((kind == number) & text.isNotNull(), value)
        return out

    path = written(league, "spoiled-laps", lambda p: documents.write_qualifying(league, p, spoil))
    rows = landing.qualifying(landing.read_documents(spark, path, schemas.QUALIFYING_DOC))
    return rows.select("race_id", "ro", "driver_id", *[F.round(f"q{i}_sec", 3).alias(f"q{i}_sec") for i in (1, 2, 3)])


@check(
    LS + """SELECT race_id, year, round, driver_id::VARCHAR AS driver_id, points, position,
      CASE WHEN driver_id % 3 < 2 THEN constructor_id::VARCHAR ELSE '' END AS constructor_id,
      CASE WHEN driver_id % 3 < 2 THEN constructor_pts END AS constructor_pts,
      CASE WHEN driver_id % 3 < 2 THEN constructor_pos END AS constructor_pos FROM standings"""
)
def landed_several_teams(spark, sf_dir):
    """Standings of drivers with one team, with a second one behind it, and with none."""
    league = League(spark, sf_dir)

    def of(team):
        kind, other = F.col("driver_id") % 3, team.withField("constructorId", F.lit("another"))
        return F.when(kind == 0, F.array(team)).when(kind == 1, F.array(team, other)).otherwise(F.slice(F.array(team), 1, 0))

    path = written(league, "standings-several", lambda p: documents.write_standings(league, p, of=of))
    return landing.standings(landing.read_documents(spark, path + "/*", schemas.STANDINGS_DOC))


FORECAST = """
forecast AS (
  SELECT r.race_id, r.circuit_id, CASE WHEN c.type IS NOT NULL THEN 10.0 + round END::DOUBLE AS temperature,
         CASE WHEN c.type IS NOT NULL THEN (round * 7) % 100 END::DOUBLE AS precipitation_prob,
         CASE WHEN c.type IS NOT NULL THEN 5 + round / 2 END::DOUBLE AS wind_speed,
         CASE WHEN c.type IS NOT NULL THEN 40.0 + round END::DOUBLE AS humidity,
         CASE WHEN c.type IS NOT NULL THEN (ro * 9) % 110 END AS weather_code,
         CASE WHEN c.type IS NULL THEN 'unknown' WHEN (ro * 9) % 110 <= 3 THEN 'dry' WHEN (ro * 9) % 110 <= 49 THEN 'cloudy'
              WHEN (ro * 9) % 110 <= 69 THEN 'rain' WHEN (ro * 9) % 110 <= 79 THEN 'snow'
              WHEN (ro * 9) % 110 <= 99 THEN 'storm' ELSE 'unknown' END AS condition
  FROM races r LEFT JOIN circuits c ON c.circuit_id = r.circuit_id
)"""


def forecasts_of(league):
    path = written(league, "forecast", lambda p: documents.write_forecasts(league.races, p))
    return landing.forecasts(league.spark.read.schema(schemas.FORECAST_DOC).json(path), league.circuits)


@check(with_ctes(LEAGUE, FORECAST) + " SELECT * FROM forecast")
def landed_forecasts(spark, sf_dir):
    return forecasts_of(League(spark, sf_dir))


@check(
    L + """, venues AS (SELECT DISTINCT circuit_id, substr(circuit_id, 2)::INT AS k FROM races)
    SELECT v.circuit_id, (k * 10)::DOUBLE AS lat, (k * -5)::DOUBLE + 0.0 AS lon,
           ['street', 'technical', 'high_speed'][k % 3 + 1] AS type, k / 10 AS overtake_difficulty, count(*) AS entries
    FROM venues v JOIN races r ON r.circuit_id = v.circuit_id JOIN results e ON e.ro = r.ro GROUP BY ALL"""
)
def landed_circuits(spark, sf_dir):
    league = League(spark, sf_dir)
    path = written(league, "circuits", lambda p: documents.write_circuits(league.races, p))
    venues = landing.circuits(spark.read.schema(schemas.CIRCUITS_DOC).json(path))
    per_race = league.results.groupBy("ro").agg(F.count(F.lit(1)).alias("n"))
    per_venue = league.races.join(per_race, "ro").groupBy("circuit_id").agg(F.sum("n").alias("entries"))
    return venues.withColumn("lon", F.col("lon") + 0.0).join(per_venue, "circuit_id")


@check(
    L + """, doc AS (SELECT DISTINCT r.ro, r.year, r.driver_id // 100 AS page FROM results r)
    SELECT year, count(*) FILTER (ro % 7 <> 0) AS ingested, count(*) FILTER (ro % 7 = 0) AS failed FROM doc GROUP BY year"""
)
def ingest_report(spark, sf_dir):
    league = League(spark, sf_dir)
    path = written(league, "damaged", lambda p: documents.write_results(league, p, broken=F.col("ro") % 7 == 0))
    return landing.ingest_report(landing.read_documents(spark, path, schemas.RESULTS_DOC))


def live_documents(feeds, feed):
    """Write one live feed as JSON and land it again."""
    return landing.live_feed(feeds.spark, live_path(feeds, feed), feed)


def session_number(session):
    """Key of a session in the feeds: its day as a number."""
    return F.date_format(session, "yyyyMMdd").cast("long")


KEY = "strftime(session, '%Y%m%d')::BIGINT"


# A compressed file is read by one task
FILE_LINES = 1_000_000
LIVE_TIMES = {"laps": "date_start", "intervals": "date", "position": "date", "race_control": "date"}


def live_frame(feeds, feed):
    """Lines of one live feed as columns: places and gaps come twice a lap."""
    session = session_number(F.col("session")).alias("session_key")
    at = F.col("ts").cast("timestamp")
    later = lambda n: (at + F.make_dt_interval(secs=F.lit(n))).alias("date")
    frames = {
        "laps": lambda: feeds.laps.select(session, "driver_number", "lap_number", "lap_duration", at.alias("date_start")),
        "intervals": lambda: feeds.timing.select(
            session, "driver_number", F.col("gap_text").alias("gap_to_leader"), "interval", at.alias("date")
        ).union(
            feeds.timing.select(session, "driver_number", (F.col("k") % 5).cast("string"), "interval", later(2))
        ),
        "position": lambda: feeds.timing.select(session, "driver_number", "position", at.alias("date")).union(
            feeds.timing.select(session, "driver_number", F.col("position") + F.col("k") % 3, later(1))
        ),
        "car_data": lambda: feeds.timing.select(
            session, "driver_number", F.col("lap_duration").alias("speed"), at.alias("date")
        ),
        "pit": lambda: feeds.pit.select(session, "driver_number", F.col("lap").alias("lap_number")),
        "stints": lambda: feeds.stints.select(session, "driver_number", "compound", "tyre_age_at_start", "lap_start"),
        "race_control": lambda: feeds.race_control.select(
            session, "category", "message", "lap_number", at.alias("date")
        ),
        "weather": lambda: feeds.timing.filter("position = 1").select(
            session, (F.col("k") / 2).alias("air_temperature"), at.alias("date")
        ),
        "drivers": lambda: feeds.cars.select(session, "driver_number", "name_acronym"),
        "sessions": lambda: feeds.sessions.select(
            session, F.year("session").cast("long").alias("year"), F.lit("Race").alias("session_type")
        ),
    }
    return frames[feed]()


def write_live(feeds, feed, rows, path):
    """JSON lines of one feed, compressed and in files that one task can read; every session has an unreadable one."""
    broken = feeds.sessions.select(F.concat(F.lit('{"session_key": '), "session", F.lit(", broken")).alias("value"))
    lines = rows.select(F.to_json(F.struct("*")).alias("value")).union(broken)
    lines.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", FILE_LINES).text(path)


def live_path(feeds, feed):
    """Folder of one live feed, landed at once."""
    return written(feeds, f"feed_{feed}", lambda path: write_live(feeds, feed, live_frame(feeds, feed), path))


def live_drops(feeds):
    """The live feeds in three drops: (paths, function that lands the next drop and says whether there was one).

    The first drop ends within a session and lacks late lines of its last hours; the second has those, repeats the last
    day before it, and goes to the end; the third is the heartbeat. Feeds without a time are dropped by session.
    """
    names = ["laps", "intervals", "position", "pit", "stints", "race_control", "drivers"]
    root = new_path(feeds.spark, "drops")
    paths = {name: f"{root}/{name}" for name in names}
    days = [r.session for r in feeds.sessions.select("session").orderBy("session").collect()]  # weeks of the calendar
    middle = F.lit(days[len(days) // 2]).cast("timestamp") + F.expr("INTERVAL 84 HOURS")
    middle_session = session_number(F.lit(days[len(days) // 2]))
    state = {"drop": 0}

    def land():
        drop = state["drop"] = state["drop"] + 1
        if drop > 3:
            return False
        for name in names:
            rows, at = live_frame(feeds, name), LIVE_TIMES.get(name)
            if drop == 3:
                if at is None:
                    continue
                beat = F.lit(days[-1]).cast("timestamp") + F.expr("INTERVAL 100 DAYS")
                rows = feeds.spark.range(1).select(F.lit(0).alias("session_key"), F.lit(0).alias("driver_number"), F.lit(1).alias("lap_number"), F.lit(1).alias("position"), beat.alias(at))
            elif at is None:
                rows = rows.filter(F.col("session_key") <= middle_session) if drop == 1 else rows.filter(F.col("session_key") >= middle_session)
            else:
                late = F.pmod(F.xxhash64(at), F.lit(7)) == 3
                late = late & (F.col(at) >= middle - F.expr("INTERVAL 12 HOURS"))
                rows = rows.filter((F.col(at) < middle) & ~late) if drop == 1 else rows.filter(F.col(at) >= middle - F.expr("INTERVAL 1 DAY"))
            write_live(feeds, name, rows, paths[name])
        return True

    return paths, land


def landed_feeds(feeds):
    names = ["laps", "intervals", "position", "pit", "stints", "race_control", "drivers"]
    return LandedFeeds(feeds.spark, {name: live_path(feeds, name) for name in names})


@check(T + "SELECT strftime(session, '%Y%m%d')::BIGINT AS session_key, driver_number, lap_number, lap_duration FROM timing")
def landed_laps(spark, sf_dir):
    return live_documents(Feeds(spark, sf_dir), "laps").drop("date_start")


@check(
    T + f"""SELECT {KEY} AS session_key, driver_number, gap_text AS gap_to_leader, interval FROM timing
    UNION ALL SELECT {KEY}, driver_number, (k % 5)::VARCHAR, interval FROM timing"""
)
def landed_intervals(spark, sf_dir):
    return live_documents(Feeds(spark, sf_dir), "intervals").drop("date")


@check(
    T + f"""SELECT {KEY} AS session_key, driver_number, lap_number,
      CASE k % 6 WHEN 0 THEN total::DOUBLE WHEN 1 THEN total::DOUBLE WHEN 2 THEN 180.0 END AS gap,
      CASE k % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'text' WHEN 2 THEN 'text' WHEN 4 THEN 'other' WHEN 5 THEN 'other' END AS kind
    FROM timing WHERE k IS NOT NULL"""
)
def landed_mixed_gaps(spark, sf_dir):
    """A gap as number, numeric text, laps, null, object or truth value, each landed as it is; no line is lost."""
    feeds = Feeds(spark, sf_dir)
    total = F.col("total")
    gaps = [total, total.cast("string"), F.lit("+2 LAPS"), F.lit(None).cast("string"), F.struct(total), F.lit(True)]
    head = [session_number(F.col("session")).alias("session_key"), "driver_number", F.timestamp_seconds("lap_number").alias("date")]
    line = F.coalesce(*[F.when(F.col("k") % 6 == i, F.to_json(F.struct(*head, gap.alias("gap_to_leader")))) for i, gap in enumerate(gaps)])
    path = written(feeds, "mixed_gaps", lambda p: feeds.timing.filter("k IS NOT NULL").select(line.alias("value")).write.text(p))
    schema = schemas.LIVE_FEEDS["intervals"]
    kinds = spark.read.schema(schema).json(path).select("session_key", "driver_number", F.unix_seconds("date").alias("lap_number"), landing.variant_kind(F.col("gap_to_leader")).alias("kind"))
    gap = landing.live_feed(spark, path, "intervals").select("session_key", "driver_number", F.unix_seconds("date").alias("lap_number"), rules.gap_seconds(F.col("gap_to_leader")).alias("gap"))
    return gap.join(kinds, ["session_key", "driver_number", "lap_number"])


@check(
    T + f"""SELECT {KEY} AS session_key, 'race_control' AS feed, count(*) AS n,
        sum(lap_number)::BIGINT AS total FROM timing WHERE event_type IN ('signup', 'error') GROUP BY session
      UNION ALL SELECT {KEY}, 'pit', count(*), sum(lap_number)::BIGINT FROM timing
        WHERE event_type = 'purchase' GROUP BY session
      UNION ALL SELECT {KEY}, 'stints', count(*), sum(k % 4)::BIGINT FROM timing
        WHERE event_type = 'purchase' GROUP BY session
      UNION ALL SELECT {KEY}, 'position', 2 * count(*), (sum(position) * 2 + sum(k % 3))::BIGINT FROM timing GROUP BY session
      UNION ALL SELECT {KEY}, 'car_data', count(*), count(lap_duration) FROM timing GROUP BY session
      UNION ALL SELECT {KEY}, 'weather', count(*), sum(k)::BIGINT FROM timing WHERE position = 1 GROUP BY session
      UNION ALL SELECT {KEY}, 'drivers', count(DISTINCT driver_number),
        count(DISTINCT driver_number) FILTER (driver_number % 10 <> 0) FROM timing GROUP BY session
      UNION ALL SELECT DISTINCT {KEY}, 'sessions', 1, year(session) FROM timing"""
)
def landed_feed_totals(spark, sf_dir):
    feeds = Feeds(spark, sf_dir)
    totals = {
        "race_control": F.sum("lap_number"),
        "pit": F.sum("lap_number"),
        "stints": F.sum("tyre_age_at_start"),
        "position": F.sum("position"),
        "car_data": F.count("speed"),
        "weather": F.sum(F.col("air_temperature") * 2).cast("long"),
        "drivers": F.count("name_acronym"),
        "sessions": F.max("year"),
    }
    out = None
    for feed, total in totals.items():
        rows = live_documents(feeds, feed).groupBy("session_key").agg(F.count(F.lit(1)).alias("n"), total.alias("total"))
        rows = rows.withColumn("feed", F.lit(feed))
        out = rows if out is None else out.unionByName(rows)
    return out


@check(T + f"""SELECT {KEY} AS session_key, count(*) AS ingested, 0::BIGINT AS failed FROM timing GROUP BY session
    UNION ALL SELECT NULL, 0, count(DISTINCT session) FROM timing""")
def feed_quarantine(spark, sf_dir):
    return landing.feed_report(landing.live_lines(spark, live_path(Feeds(spark, sf_dir), "laps"), "laps"))


@check(
    T + """SELECT session::VARCHAR AS session, driver_number, round(min(lap_duration), 6) AS best_lap_sec,
      round(avg(lap_duration), 9) AS avg_lap_sec, count(lap_number) AS lap_count FROM timing GROUP BY ALL"""
)
def practice_summary(spark, sf_dir):
    feeds = Feeds(spark, sf_dir)
    laps = feeds.laps.select(
        F.col("session").cast("string").alias("session"), "driver_number", F.col("lap_number").alias("LapNumber"),
        F.make_dt_interval(secs=F.col("lap_duration").cast("decimal(18,6)")).alias("LapTime"),
    )
    path = written(feeds, "practice", lambda p: laps.write.parquet(p))
    stored = tables.known_columns(
        spark.read.parquet(path), ["session", "driver_number", "LapNumber", "LapTime", "TyreLife"]
    )
    out = landing.practice_summary(stored, ["session", "driver_number"])
    return out.withColumns({"best_lap_sec": tidy(F.col("best_lap_sec")), "avg_lap_sec": tidy(F.col("avg_lap_sec"), 9)})


@check(
    L + """, found AS (
      SELECT a.race_id, min(b.ro) AS session_ro FROM races a JOIN races b ON b.year = a.year
        AND contains(lower(b.country || 'Grand Prix of ' || b.circuit_name), lower(a.country)) GROUP BY a.race_id)
    SELECT race_id, 9995 + session_ro % 100 AS session_key FROM found"""
)
def session_search(spark, sf_dir):
    races = League(spark, sf_dir).races
    sessions = races.select(
        "year", (9995 + F.col("ro") % 100).alias("session_key"), F.lit(None).cast("timestamp").alias("date_start"),
        F.col("country").alias("country_name"),
        F.concat(F.lit("Grand Prix of "), "circuit_name").alias("meeting_name"), F.lit("Race").alias("session_type"),
    )
    return landing.find_session(races, sessions)


MERGED = """
    SELECT l_orderkey, l_linenumber, arg_max(l_partkey, v) AS l_partkey, arg_max(l_suppkey, v) AS l_suppkey,
           arg_max(l_extendedprice, v) AS l_extendedprice
    FROM (SELECT *, (l_returnflag = 'R', l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS v FROM lineitem)
    GROUP BY l_orderkey, l_linenumber"""


@check(MERGED)
def merge_by_key(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag"
    )
    old, new = lines.filter("l_returnflag <> 'R'"), lines.filter("l_returnflag = 'R'")
    merged = merge.merge(
        old, new, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    )
    return merged.drop("l_shipdate", "l_returnflag")


@check(
    L + """SELECT race_id, driver_id, year, CASE WHEN year = 1995 THEN position + 100 ELSE position END AS position,
      CASE WHEN year = 1995 THEN 'Corrected' ELSE status END AS status FROM results"""
)
def upsert_partition(spark, sf_dir):
    """Write results by year, correct one season by upsert and read the table back."""
    league = League(spark, sf_dir)
    rows = league.results.select("race_id", "driver_id", "year", "position", "status")
    path = new_path(spark, "upsert")
    rows.write.partitionBy("year").parquet(path)
    fixed = rows.filter("year = 1995").withColumns(
        {"position": F.col("position") + 100, "status": F.lit("Corrected")}
    )
    merge.upsert(spark, path, fixed, ["race_id", "driver_id"], "year")
    return spark.read.parquet(path).withColumn("year", F.col("year").cast("long"))


@check(
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"
)
def duplicate_keys(spark, sf_dir):
    return merge.duplicate_keys(tables.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@check(
    L + """SELECT q.race_id, q.driver_id, q.position FROM qualifying q
      WHERE NOT EXISTS (SELECT 1 FROM entry e WHERE e.race_id = q.race_id AND e.driver_id = q.driver_id AND e.n > 1)"""
)
def orphan_entrants(spark, sf_dir):
    league = League(spark, sf_dir)
    starters = league.results.select("race_id", F.struct("race_id", "driver_id").alias("entrant")).select("entrant")
    rows = league.qualifying.withColumn("entrant", F.struct("race_id", "driver_id"))
    return merge.orphans(rows, starters, "entrant").select("race_id", "driver_id", "position")


@check(
    LS + """SELECT 'results' AS table_name, count(*) FILTER (driver_id NOT IN (SELECT driver_id FROM drivers)) AS orphans,
        count(*) FILTER (race_id IS NULL) + count(*) FILTER (driver_id IS NULL) AS missing FROM results
      UNION ALL SELECT 'qualifying', count(*) FILTER (race_id NOT IN (SELECT race_id FROM races)),
        count(*) FILTER (race_id IS NULL) + count(*) FILTER (driver_id IS NULL) FROM qualifying
      UNION ALL SELECT 'standings_snapshot', count(*) FILTER (race_id NOT IN (SELECT race_id FROM races)),
        count(*) FILTER (race_id IS NULL) + count(*) FILTER (driver_id IS NULL) FROM standings"""
)
def table_quality(spark, sf_dir):
    league = League(spark, sf_dir)
    stored = {"results": league.results, "qualifying": league.qualifying, "standings_snapshot": league.standings}
    parents = {"results": ("driver_id", league.drivers), "qualifying": ("race_id", league.races),
               "standings_snapshot": ("race_id", league.races)}
    out = None
    for name, rows in stored.items():
        column, parent = parents[name]
        n_orphans = merge.orphans(rows, parent, column).agg(F.count(F.lit(1)).alias("orphans"))
        required = merge.REQUIRED[name]
        nulls = merge.missing_values(rows, required)
        nulls = nulls.select(sum((F.col(c) for c in required), F.lit(0)).cast("long").alias("missing"))
        both = n_orphans.unionByName(nulls, allowMissingColumns=True)
        rows = both.agg(F.sum("orphans").alias("orphans"), F.sum("missing").alias("missing"))
        rows = rows.withColumn("table_name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@check(
    L + """SELECT l.race_id, driver_id, position FROM results l WHERE year = 1996 AND position IS NOT NULL AND ro < 199608"""
)
def parameterised_query(spark, sf_dir):
    return tables.query(
        spark,
        "SELECT race_id, driver_id, position FROM {results} "
        "WHERE year = :year AND ro < :cutoff AND position IS NOT NULL",
        {"results": League(spark, sf_dir).results},
        {"year": 1996, "cutoff": 199608},
    )


CACHE_KEYS = ["race_id", "driver_id", "year"]


@check("WITH " + MATRIX + f" SELECT {sql_rounded(FEATURES, CACHE_KEYS)} FROM matrix WHERE year BETWEEN 1995 AND 1999")
def feature_cache(spark, sf_dir):
    """Write the matrix by year, rebuild one season and read a range of seasons."""
    matrix = features.league_matrix(League(spark, sf_dir))
    path = new_path(spark, "features")
    features.write_cached(matrix, path)
    features.write_cached(matrix.filter("year = 1997"), path)
    out = features.read_cached(spark, path, 1995, 1999)
    return out.withColumn("year", F.col("year").cast("long")).select(*rounded(FEATURES, CACHE_KEYS))


@check(
    "SELECT user_id AS driver_number, count(*) AS n, round(avg(value), 9) AS mean_speed FROM events WHERE value >= 50 "
    "GROUP BY user_id"
)
def telemetry_threshold(spark, sf_dir):
    fast = Feeds(spark, sf_dir).telemetry.filter(F.col("speed") >= 50)
    return fast.groupBy("driver_number").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("speed"), 9).alias("mean_speed"))


def session_rows(league, kind, rows):
    """One session table landed as Parquet, with a column that the table does not know."""
    path = written(league, f"session_{kind}", lambda p: rows.withColumn("Unknown", F.lit(1)).write.parquet(p))
    return landing.session_table(league.spark.read.parquet(path), kind, ["race_id"])


def interval_of(seconds):
    return F.make_dt_interval(secs=F.col(seconds).cast("decimal(18,6)"))


@check(
    L + """SELECT race_id, driver_id::VARCHAR AS "DriverNumber", position AS "Position", round(q1_sec, 6) AS "Q1",
      round(q2_sec, 6) AS "Q2", round(q3_sec, 6) AS "Q3" FROM qualifying"""
)
def qualifying_session(spark, sf_dir):
    league = League(spark, sf_dir)
    rows = league.qualifying.select(
        "race_id", F.col("driver_id").cast("string").alias("DriverNumber"), F.col("position").alias("Position"),
        *[interval_of(f"q{i}_sec").alias(f"Q{i}") for i in (1, 2, 3)],
    )
    out = session_rows(league, "qualifying", rows)
    return out.withColumns({q: tidy(F.col(q)) for q in ("Q1", "Q2", "Q3")})


@check(
    T + """SELECT session::VARCHAR AS race_id, driver_number AS "DriverNumber", lap_number AS "LapNumber", position AS "Position",
      round(lap_duration, 6) AS "LapTimeSec" FROM timing"""
)
def race_laps_session(spark, sf_dir):
    feeds = Feeds(spark, sf_dir)
    rows = feeds.timing.select(
        F.col("session").cast("string").alias("race_id"), F.col("driver_number").alias("DriverNumber"),
        F.col("lap_number").alias("LapNumber"), interval_of("lap_duration").alias("LapTime"), F.col("position").alias("Position"),
    )
    out = session_rows(feeds, "race_laps", rows)
    return out.drop("LapTime").withColumn("LapTimeSec", tidy(F.col("LapTimeSec")))


@check(
    L + """SELECT race_id, driver_id::VARCHAR AS "DriverNumber", position AS "Position", grid AS "GridPosition",
      status AS "Status", points AS "Points" FROM results"""
)
def race_results_session(spark, sf_dir):
    league = League(spark, sf_dir)
    rows = league.results.select(
        "race_id", F.col("driver_id").cast("string").alias("DriverNumber"), F.col("position").alias("Position"),
        F.col("grid").alias("GridPosition"), F.col("status").alias("Status"), F.col("points").alias("Points"),
    )
    return session_rows(league, "race_results", rows)


@check(L + """SELECT race_id, round AS "RoundNumber", circuit_name AS "EventName", country AS "Country" FROM races""")
def schedule_session(spark, sf_dir):
    league = League(spark, sf_dir)
    rows = league.races.select(
        "race_id", F.col("round").alias("RoundNumber"), F.col("circuit_name").alias("EventName"), F.col("country").alias("Country")
    )
    return session_rows(league, "schedule", rows)
