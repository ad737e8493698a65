"""Landed JSON documents to keyed rows: one job over all files of a kind."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions import constants as C
from paceline.functions import rules
from paceline.sources import schemas
from paceline.sources.tables import known_columns

CORRUPT = "_corrupt_record"
# When a document was landed and where it stands: later versions of a key win
ORDER = "_order"


def read_documents(
    spark: SparkSession, path: str, schema: str, whole_file: bool = False, ordered: bool = False
) -> DataFrame:
    """JSON lines, or one document per file; unreadable ones keep their text in ``_corrupt_record``.

    With ``ordered`` rows carry ``_order``: modification time of the file, its name and the place in it.
    """
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").json(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, multiLine=whole_file
    )
    return placed(rows.withColumn(ORDER, _file())) if ordered else rows


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of new files, with what is known of each file; ``placed`` completes the order of a micro-batch."""
    reader = spark.readStream.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path).withColumn(ORDER, _file())


def _file() -> Column:
    return F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """The order of documents extended by their place in the file."""
    return rows.withColumn(ORDER, F.struct(f"{ORDER}.*", F.monotonically_increasing_id().alias("line")))


def _order(rows: DataFrame, *inner: str) -> list[Column]:
    """The document's order extended by places inside it, where documents are ordered."""
    if ORDER not in rows.columns:
        return []
    return [F.struct(F.col(ORDER).alias("document"), *[F.col(c) for c in inner]).alias(ORDER)]


def good(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def ingest_report(documents: DataFrame, items: str = "RaceTable.Races") -> DataFrame:
    """Documents read and quarantined per season; the season of a broken one is taken from its text."""
    broken = F.col(CORRUPT).isNotNull()
    season = F.when(broken, F.regexp_extract(CORRUPT, r'"season"\s*:\s*"(\d+)"', 1)).otherwise(
        F.get(F.col(f"MRData.{items}"), F.lit(0))["season"]
    )
    return documents.groupBy(rules.safe_int(season).alias("year")).agg(
        F.count_if(~broken).alias("ingested"), F.count_if(broken).alias("failed")
    )


def _races(documents: DataFrame) -> DataFrame:
    rows = good(documents)
    return rows.select(*_order(rows), F.posexplode("MRData.RaceTable.Races").alias("race_at", "race"))


def _race_keys() -> list[Column]:
    year, round_ = rules.safe_int(F.col("race.season")), rules.safe_int(F.col("race.round"))
    return [
        rules.race_id(year, round_).alias("race_id"),
        rules.race_order(year, round_).alias("ro"),
        year.alias("year"),
        round_.alias("round"),
    ]


def _entries(documents: DataFrame, items: str) -> DataFrame:
    """One row per element of the race's list, with the race keys."""
    rows = _races(documents).select("*", F.posexplode(f"race.{items}").alias("item_at", "item"))
    return rows.select(*_race_keys(), "item", *_order(rows, "race_at", "item_at"))


def circuit_key(circuit: Column) -> Column:
    """Feed circuit id to metadata key; unknown ids pass through."""
    aliases = F.create_map(*[F.lit(x) for x in chain.from_iterable(C.CIRCUIT_ALIASES.items())])
    return F.coalesce(F.try_element_at(aliases, circuit), circuit)


def races(documents: DataFrame) -> DataFrame:
    """Race rows of result, qualifying or calendar documents; a race split over pages yields one row.

    Of several versions the last landed wins, or without an order the greatest.
    """
    text = {
        "circuit_id": circuit_key(F.coalesce("race.Circuit.circuitId", F.lit(""))),
        "circuit_name": F.coalesce("race.Circuit.circuitName", F.lit("")),
        "country": F.coalesce("race.Circuit.Location.country", F.lit("")),
        "race_date": F.col("race.date").try_cast("date"),
    }
    rows = _races(documents)
    rows = rows.select(
        *_race_keys(), *[c.alias(n) for n, c in text.items()], F.lit(None).cast("long").alias("total_laps"),
        *_order(rows, "race_at"),
    )
    fields = [c for c in rows.columns if c not in ("race_id", ORDER)]
    by = ORDER if ORDER in rows.columns else F.struct(*fields)
    last = rows.groupBy("race_id").agg(F.max_by(F.struct(*fields), by).alias("last"))
    return last.select("race_id", *[f"last.{f}" for f in fields])


def _kept(rows: DataFrame) -> list[str]:
    return [ORDER] if ORDER in rows.columns else []


def results(documents: DataFrame) -> DataFrame:
    position = rules.safe_int(F.col("item.position"))
    rows = _entries(documents, "Results")
    return rows.select(
        "race_id", "ro", "year", "round",
        F.coalesce("item.Driver.driverId", F.lit("")).alias("driver_id"),
        F.coalesce("item.Constructor.constructorId", F.lit("")).alias("constructor_id"),
        rules.safe_int(F.col("item.grid")).alias("grid"),
        position.alias("position"),
        F.coalesce("item.positionText", F.lit("")).alias("position_text"),
        F.coalesce("item.status", F.lit("")).alias("status"),
        rules.safe_float(F.col("item.points")).alias("points"),
        rules.safe_int(F.col("item.laps")).alias("laps_completed"),
        rules.safe_int(F.col("item.FastestLap.rank")).alias("fastest_lap_rank"),
        rules.podium_flag(position).alias("is_podium"),
        *_kept(rows),
    )


def _driver_fields(driver: Column) -> list[Column]:
    def text(name: str) -> Column:
        return F.coalesce(driver[name], F.lit(""))

    full = F.trim(F.concat_ws(" ", text("givenName"), text("familyName")))
    return [
        text("driverId").alias("driver_id"),
        text("code").alias("code"),
        full.alias("full_name"),
        text("nationality").alias("nationality"),
    ]


def _latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last version of every entity; hot entities are reduced before the shuffle.

    Versions of the same race are ordered as they were landed, or else by their values.
    """
    fields = [c for c in rows.columns if c not in (key, order, ORDER)]
    by = F.struct(order, *_kept(rows), *fields)
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), by).alias("last")).select(key, *[f"last.{f}" for f in fields])


def drivers(documents: DataFrame) -> DataFrame:
    rows = _entries(documents, "Results")
    rows = rows.select("ro", *_driver_fields(F.col("item.Driver")), *_kept(rows))
    return _latest(rows, "driver_id", "ro")


def constructors(documents: DataFrame) -> DataFrame:
    team = F.col("item.Constructor")
    rows = _entries(documents, "Results")
    rows = rows.select(
        "ro",
        F.coalesce(team["constructorId"], F.lit("")).alias("constructor_id"),
        F.coalesce(team["name"], F.lit("")).alias("name"),
        F.coalesce(team["nationality"], F.lit("")).alias("nationality"),
        *_kept(rows),
    )
    return _latest(rows, "constructor_id", "ro")


def qualifying(documents: DataFrame) -> DataFrame:
    rows = _entries(documents, "QualifyingResults")
    return rows.select(
        "race_id", "ro",
        F.coalesce("item.Driver.driverId", F.lit("")).alias("driver_id"),
        F.coalesce("item.Constructor.constructorId", F.lit("")).alias("constructor_id"),
        rules.safe_int(F.col("item.position")).alias("position"),
        *[rules.lap_seconds(F.col(f"item.Q{i}")).alias(f"q{i}_sec") for i in (1, 2, 3)],
        *_kept(rows),
    )


def pit_stops(documents: DataFrame) -> DataFrame:
    rows = _entries(documents, "PitStops")
    return rows.select(
        "race_id",
        F.coalesce("item.driverId", F.lit("")).alias("driver_id"),
        rules.safe_int(F.col("item.stop")).alias("stop_number"),
        rules.safe_int(F.col("item.lap")).alias("lap"),
        rules.safe_float(F.col("item.duration")).alias("duration_sec"),
        *_kept(rows),
    )


def _last(rows: DataFrame, key: list[str]) -> DataFrame:
    """Last landed version of every key; where documents are not ordered, the greatest."""
    fields = [c for c in rows.columns if c not in (*key, ORDER)]
    by = F.struct(*_kept(rows), *fields)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*fields), by).alias("last"))
    return last.select(*key, *[f"last.{f}" for f in fields])


def standing_lists(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Driver and team rows of the snapshots before round r, from the tables after round r - 1.

    Each list is reduced to the last version of its rows by itself, so a table sent again, whole or in part, never meets
    rows of an earlier version. Drivers take the first team of their list.
    """
    rows = good(documents)
    lists = rows.select(*_order(rows), F.posexplode("MRData.StandingsTable.StandingsLists").alias("list_at", "list"))
    year, round_ = rules.safe_int(F.col("list.season")), rules.safe_int(F.col("list.round")) + 1
    lists = lists.select(year.alias("year"), round_.alias("round"), "list", "list_at", *_kept(lists))

    def items(name: str) -> DataFrame:
        entries = lists.select("*", F.posexplode(f"list.{name}").alias("item_at", "item"))
        return entries.select("year", "round", "item", *_order(entries, "list_at", "item_at"))

    teams = items("ConstructorStandings")
    teams = teams.select(
        "year", "round",
        F.col("item.Constructor.constructorId").alias("constructor_id"),
        rules.safe_float(F.col("item.points")).alias("constructor_pts"),
        rules.safe_int(F.col("item.position")).alias("constructor_pos"),
        *_kept(teams),
    )
    drivers = items("DriverStandings")
    drivers = drivers.select(
        "year", "round",
        F.col("item.Driver.driverId").alias("driver_id"),
        rules.safe_float(F.col("item.points")).alias("points"),
        rules.safe_int(F.col("item.position")).alias("position"),
        F.coalesce(F.get(F.col("item.Constructors"), F.lit(0))["constructorId"], F.lit("")).alias("constructor_id"),
        *_kept(drivers),
    )
    return _last(drivers, ["year", "round", "driver_id"]), _last(teams, ["year", "round", "constructor_id"])


def with_teams(drivers: DataFrame, teams: DataFrame) -> DataFrame:
    """Snapshot rows; a team missing from its table leaves nulls."""
    rows = drivers.join(teams, ["year", "round", "constructor_id"], "left")
    return rows.withColumn("race_id", rules.race_id(F.col("year"), F.col("round")))


def standings(documents: DataFrame) -> DataFrame:
    """Snapshot before round r from the last version of the table after round r - 1, with team points looked up."""
    return with_teams(*standing_lists(documents))


def corrected_standings(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshot rows that a load changes: its own, and stored ones of the same rounds where either list came alone.

    Stored drivers whose round got new team points take them, and new driver rows find the team points stored before.
    """
    drivers, teams = standing_lists(documents)
    rounds = drivers.select("year", "round").union(teams.select("year", "round")).distinct()
    old = stored.withColumn("round", F.col("ro") % 100).join(rounds, ["year", "round"], "left_semi")
    fields = [c for c in drivers.columns if c not in ("year", "round", "driver_id")]
    # as many rows as stored ones: merged, whatever the size of their files
    kept = old.select("year", "round", "driver_id", *fields).join(drivers.hint("merge"), ["year", "round", "driver_id"], "left_anti")
    known = old.filter("constructor_pts IS NOT NULL OR constructor_pos IS NOT NULL").select(*teams.columns).distinct()
    known = known.join(teams, ["year", "round", "constructor_id"], "left_anti")
    return with_teams(drivers.unionByName(kept), teams.unionByName(known))


def driver_list(documents: DataFrame) -> DataFrame:
    rows = good(documents).select(F.explode("MRData.DriverTable.Drivers").alias("item"))
    return rows.select(*_driver_fields(F.col("item")))


def constructor_list(documents: DataFrame) -> DataFrame:
    rows = good(documents).select(F.explode("MRData.ConstructorTable.Constructors").alias("item"))
    return rows.select(F.col("item.constructorId").alias("constructor_id"), "item.name", "item.nationality")


def circuits(documents: DataFrame) -> DataFrame:
    """Circuit dimension from a map document."""
    return documents.select(F.explode("circuits").alias("circuit_id", "c")).select("circuit_id", "c.*")


def known_circuits(spark: SparkSession) -> DataFrame:
    """The built-in circuit dimension."""
    rows = [(key, *facts) for key, facts in C.CIRCUITS.items()]
    return spark.createDataFrame(rows, "circuit_id string, lat double, lon double, type string, overtake_difficulty double")


def forecasts(documents: DataFrame, circuits: DataFrame) -> DataFrame:
    """First day of each daily array; races at unknown circuits get nulls and 'unknown'."""
    known = circuits.select("circuit_id", F.lit(True).alias("_known"))
    joined = documents.join(known, "circuit_id", "left")

    def first(name: str) -> Column:
        return F.when(F.col("_known"), F.get(F.col(f"daily.{name}"), F.lit(0)))

    code = first("weathercode")
    return joined.select(
        "race_id",
        "circuit_id",
        first("temperature_2m_max").alias("temperature"),
        first("precipitation_probability_max").alias("precipitation_prob"),
        first("windspeed_10m_max").alias("wind_speed"),
        first("relative_humidity_2m_max").alias("humidity"),
        code.alias("weather_code"),
        rules.weather_condition(code).alias("condition"),
    )


def live_feed(spark: SparkSession, path: str, feed: str, stream: bool = False) -> DataFrame:
    """The readable rows of one live feed, as a batch or as a file stream."""
    return good(live_lines(spark, path, feed, stream))


def live_lines(spark: SparkSession, path: str, feed: str, stream: bool = False) -> DataFrame:
    """All lines of one live feed; unreadable ones keep their text in ``_corrupt_record``."""
    reader = spark.readStream if stream else spark.read
    schema = f"{schemas.LIVE_FEEDS[feed]}, {CORRUPT} string"
    lines = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    mixed = [f.name for f in lines.schema if isinstance(f.dataType, T.VariantType)]
    return lines.withColumns({c: scalar_text(F.col(c)) for c in mixed})


def variant_kind(value: Column) -> Column:
    """``number``, ``text``, ``other`` (truth values, lists and objects) or null."""
    kind = F.schema_of_variant(value)
    number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(number, "number").when(kind == "STRING", "text").when(kind != "VOID", "other")


def scalar_text(value: Column) -> Column:
    """Numbers and text of a variant as text; what is neither says nothing."""
    return F.when(variant_kind(value).isin("number", "text"), F.try_variant_get(value, "$", "string"))


def feed_report(lines: DataFrame) -> DataFrame:
    """Lines read and quarantined per session; unreadable lines have no session."""
    broken = F.col(CORRUPT).isNotNull()
    return lines.groupBy("session_key").agg(F.count_if(~broken).alias("ingested"), F.count_if(broken).alias("failed"))


# Columns of the session tables, each kept where the source has it
SESSION_COLUMNS = {
    "qualifying": ["DriverNumber", "Abbreviation", "TeamName", "Position", "Q1", "Q2", "Q3"],
    "race_laps": [
        "DriverNumber", "Driver", "Team", "LapNumber", "LapTime", "Position", "Compound", "TyreLife", "Stint",
    ],
    "race_results": ["DriverNumber", "Abbreviation", "TeamName", "Position", "GridPosition", "Status", "Points"],
    "schedule": ["RoundNumber", "EventName", "Country", "Location", "EventDate", "EventFormat"],
}


def session_table(rows: DataFrame, kind: str, key: list[str]) -> DataFrame:
    """A session table: known columns only, times (day-time intervals) in seconds.

    Race laps keep the interval and gain ``LapTimeSec``; qualifying times are replaced.
    """
    out = known_columns(rows, [*key, *SESSION_COLUMNS[kind]])
    if kind == "race_laps" and "LapTime" in out.columns:
        return out.withColumn("LapTimeSec", rules.interval_seconds(F.col("LapTime")))
    times = [c for c in ("Q1", "Q2", "Q3") if kind == "qualifying" and c in out.columns]
    return out.withColumns({c: rules.interval_seconds(F.col(c)) for c in times})


def practice_summary(laps: DataFrame, key: list[str]) -> DataFrame:
    """Best and mean lap in seconds and lap count; lap times are day-time intervals."""
    seconds = rules.interval_seconds(F.col("LapTime"))
    return laps.groupBy(*key).agg(
        F.min(seconds).alias("best_lap_sec"), F.avg(seconds).alias("avg_lap_sec"), F.count("LapNumber").alias("lap_count")
    )


def find_session(races: DataFrame, sessions: DataFrame, session_type: str = "Race") -> DataFrame:
    """First session of the year whose country and meeting name contain the race's search text.

    The text is the race's country, or its circuit name where the country is empty. The first is the
    earliest by start, then by number of its key. Races meet only the sessions of their year, a few
    dozen by the calendar.
    """
    kind = sessions.filter(F.col("session_type") == session_type)
    where = F.lower(F.concat(F.coalesce("country_name", F.lit("")), F.coalesce("meeting_name", F.lit(""))))
    start = F.col("date_start") if "date_start" in sessions.columns else F.lit(None).cast("timestamp")
    text = F.lower(F.when(F.coalesce("country", F.lit("")) != "", F.col("country")).otherwise(F.col("circuit_name")))
    candidates = races.select("race_id", "year", text.alias("_text")).join(
        kind.select("year", F.struct(start.isNull(), start, "session_key").alias("_first"), where.alias("_where")), "year"
    )
    found = candidates.filter(F.col("_where").contains(F.col("_text")))
    return found.groupBy("race_id").agg(F.min("_first")["session_key"].alias("session_key"))
