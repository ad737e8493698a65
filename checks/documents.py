"""Writers of landing documents from tables, for the checks of ``landing``.

Documents are paged by key range (at most ``PAGE`` entrants each), as the history feed pages its
answers, so that no task builds a document that grows with the field.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions import rules
from paceline.operators.ordering import sized

PAGE = 100


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _page(number: str) -> Column:
    return F.floor(F.col(number) / PAGE)


def _write_lines(documents: DataFrame, path: str, broken: Column | None = None) -> None:
    """JSON lines; rows where ``broken`` holds lose the end of their text."""
    line = F.to_json(F.struct("MRData"))
    if broken is not None:
        line = F.when(broken, F.expr("left(to_json(struct(MRData)), length(to_json(struct(MRData))) - 5)")).otherwise(line)
    documents.select(line.alias("value")).write.text(path)


def _driver(given: Column | None = None, family: Column | None = None) -> Column:
    return F.struct(
        _text("driver_id").alias("driverId"),
        F.col("code"),
        (F.col("full_name") if given is None else given).alias("givenName"),
        (F.lit("") if family is None else family).alias("familyName"),
        F.col("nationality"),
    )


def _team(name: str = "team_name") -> Column:
    return F.struct(_text("constructor_id").alias("constructorId"), F.col(name).alias("name"), F.lit("").alias("nationality"))


def _race(items: Column | None = None, name: str | None = None) -> Column:
    head = [
        _text("year").alias("season"),
        _text("round").alias("round"),
        F.concat_ws(" ", "country", F.lit("GP")).alias("raceName"),
        _text("race_date").alias("date"),
        F.struct(
            F.col("circuit_id").alias("circuitId"),
            F.col("circuit_name").alias("circuitName"),
            F.struct(F.col("country")).alias("Location"),
        ).alias("Circuit"),
    ]
    race = F.struct(*head, *([items.alias(name)] if items is not None else []))
    return F.struct(F.struct(F.array(race).alias("Races")).alias("RaceTable")).alias("MRData")


RACE_FIELDS = ["ro", "year", "round", "race_date", "circuit_id", "circuit_name", "country"]


def _race_pages(rows: DataFrame, races: DataFrame, item: Column, name: str, place: str, path: str, broken: Column | None = None):
    """Items stand by driver; of a driver with several rows the one of the first place stands last, however rows were joined."""
    ordered = F.sort_array(F.collect_list(F.struct("driver_id", (-F.col(place)).alias("place"), item.alias("item"))))
    pages = rows.groupBy("ro", _page("driver_id").alias("page")).agg(ordered["item"].alias("items"))
    documents = pages.join(races.select(*RACE_FIELDS), "ro").select("ro", _race(F.col("items"), name))
    _write_lines(documents, path, broken)


def _named(rows: DataFrame, league) -> DataFrame:
    """Rows with the names of driver and team; the names are sent to tasks or merged, never the rows."""
    names = league.drivers.select("driver_id", "code", "full_name", "nationality")
    teams = league.constructors.select("constructor_id", F.col("name").alias("team_name"))
    return rows.join(sized(names, league.field_bound), "driver_id").join(sized(teams, league.team_count), "constructor_id")


def write_results(league, path: str, broken: Column | None = None, rows: DataFrame | None = None) -> None:
    item = F.struct(
        _text("position").alias("position"), F.col("position_text").alias("positionText"), _text("grid").alias("grid"),
        _text("points").alias("points"), _text("laps_completed").alias("laps"), "status",
        F.struct(_text("grid").alias("rank")).alias("FastestLap"),
        _driver().alias("Driver"), _team().alias("Constructor"),
    )
    rows = _named(league.results if rows is None else rows, league)
    _race_pages(rows, league.races, item, "Results", "grid", path, broken)


def write_qualifying(league, path: str, spoil: Callable[[Column], Column] = lambda text: text) -> None:
    """``spoil`` changes the text of every lap time."""
    item = F.struct(
        _text("position").alias("position"),
        *[spoil(rules.lap_text(F.col(f"q{i}_sec"))).alias(f"Q{i}") for i in (1, 2, 3)],
        _driver().alias("Driver"), _team().alias("Constructor"),
    )
    rows = _named(league.qualifying, league)
    _race_pages(rows, league.races, item, "QualifyingResults", "position", path)


def write_standings(
    league, path: str, factor: int = 1, only: Column | None = None, lists=("drivers", "teams"),
    of: Callable[[Column], Column] = F.array,
) -> None:
    """Tables after each round: the snapshot of round r is the table after round r - 1.

    ``factor`` multiplies points and ``only`` selects rows, for tables that are sent again with corrections; ``of`` makes
    a driver's list of teams from the driver's team.
    """
    rows = _named(league.standings if only is None else league.standings.filter(only), league)
    rows = rows.withColumns({c: F.col(c) * factor for c in ("points", "constructor_pts")})
    driver = F.struct(
        _text("points").alias("points"), _text("position").alias("position"),
        _driver().alias("Driver"), of(_team()).alias("Constructors"),
    )
    pages = rows.groupBy("year", "round", _page("driver_id").alias("page")).agg(F.collect_list(driver).alias("items"))
    teams = rows.select("year", "round", "constructor_id", "team_name", "constructor_pts", "constructor_pos").distinct()
    team = F.struct(
        _text("constructor_pts").alias("points"), _text("constructor_pos").alias("position"),
        _team().alias("Constructor"),
    )
    team_pages = teams.groupBy("year", "round", _page("constructor_id").alias("page"))
    team_pages = team_pages.agg(F.collect_list(team).alias("items"))

    def document(name: str) -> Column:
        table = F.struct(
            _text("year").alias("season"), (F.col("round") - 1).cast("string").alias("round"), F.col("items").alias(name)
        )
        return F.struct(F.struct(F.array(table).alias("StandingsLists")).alias("StandingsTable")).alias("MRData")

    if "drivers" in lists:
        _write_lines(pages.select(document("DriverStandings")), f"{path}/drivers")
    if "teams" in lists:
        _write_lines(team_pages.select(document("ConstructorStandings")), f"{path}/teams")


def write_calendar(league, path: str, races: DataFrame | None = None) -> None:
    _write_lines((league.races if races is None else races).select(_race()), path)


def write_drivers(league, path: str, given: Column | None = None, family: Column | None = None) -> None:
    pages = league.drivers.groupBy(_page("driver_id")).agg(F.collect_list(_driver(given, family)).alias("Drivers"))
    _write_lines(pages.select(F.struct(F.struct("Drivers").alias("DriverTable")).alias("MRData")), path)


def write_constructors(league, path: str) -> None:
    teams = league.constructors.groupBy(_page("constructor_id")).agg(F.collect_list(_team("name")).alias("Constructors"))
    _write_lines(teams.select(F.struct(F.struct("Constructors").alias("ConstructorTable")).alias("MRData")), path)


def write_pit_stops(stops: DataFrame, path: str) -> None:
    """``stops``: year, round, driver_id, stop_number, lap, duration_sec; paged by driver and stop."""
    item = F.struct(
        _text("driver_id").alias("driverId"), _text("stop_number").alias("stop"), _text("lap").alias("lap"),
        _text("duration_sec").alias("duration"),
    )
    pages = stops.groupBy("year", "round", _page("driver_id"), _page("stop_number"))
    pages = pages.agg(F.collect_list(item).alias("PitStops"))
    race = F.struct(_text("year").alias("season"), _text("round").alias("round"), "PitStops")
    _write_lines(pages.select(F.struct(F.struct(F.array(race).alias("Races")).alias("RaceTable")).alias("MRData")), path)


def write_forecasts(races: DataFrame, path: str) -> None:
    """One daily forecast per race, with values that follow the calendar."""
    n = F.col("round").cast("double")

    def day(value: Column, name: str) -> Column:
        return F.array(value, value + 1).alias(name)

    daily = F.struct(
        day(10 + n, "temperature_2m_max"),
        day((n * 7) % 100, "precipitation_probability_max"),
        day(5 + n / 2, "windspeed_10m_max"),
        day(40 + n, "relative_humidity_2m_max"),
        day((F.col("ro") * 9) % 110, "weathercode"),
    )
    races.select("race_id", "circuit_id", daily.alias("daily")).write.json(path)


def write_circuits(races: DataFrame, path: str) -> None:
    """Map document of the circuits on the calendar; the map is as small as the list of venues."""
    number = F.substring("circuit_id", 2, 9).cast("int")
    facts = F.struct(
        (number * 10).cast("double").alias("lat"),
        (number * -5).cast("double").alias("lon"),
        F.element_at(F.array(F.lit("street"), F.lit("technical"), F.lit("high_speed")), number % 3 + 1).alias("type"),
        (number / 10).alias("overtake_difficulty"),
    )
    venues = races.select("circuit_id").distinct().select(F.struct("circuit_id", facts).alias("entry"))
    venues.agg(F.map_from_entries(F.collect_list("entry")).alias("circuits")).write.json(path)
