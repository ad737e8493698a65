"""The pre-race feature matrix: one row per (race, driver) for all races in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import constants as C
from paceline.functions import rules
from paceline.operators.history import circuit_history, form_columns, or_default, team_history
from paceline.operators.ordering import sized, top_rows

META = ["race_id", "ro", "year", "round", "driver_id", "constructor_id", "is_podium", "finish_position"]
QUALI_COLUMNS = ["grid_position", "quali_gap_to_pole", "quali_q3_reached", "quali_consistency"]
STANDING_COLUMNS = [
    "driver_championship_pos", "driver_championship_pts", "constructor_championship_pos", "constructor_championship_pts",
]


def spread_of_times(*times: str) -> Column:
    """Population standard deviation of the present session times, null below two of them."""
    present = F.filter(F.array(*times), lambda t: t.isNotNull())
    n = F.size(present)
    mean = F.aggregate(present, F.lit(0.0), lambda a, t: a + t) / n
    squares = F.aggregate(present, F.lit(0.0), lambda a, t: a + (t - mean) * (t - mean))
    return F.when(n >= 2, F.sqrt(squares / n))


def race_context(races: DataFrame, circuits: DataFrame) -> DataFrame:
    """Calendar position and circuit facts per race."""
    length = F.max("round").over(Window.partitionBy("year"))
    progress = F.when(length > 0, F.col("round") / F.greatest(length, F.lit(1)))
    return races.join(circuits, "circuit_id", "left").select(
        "ro", "year", "round", "circuit_id",
        rules.circuit_type_code(F.col("type")).alias("circuit_type"),
        or_default(F.col("overtake_difficulty"), "circuit_overtake_difficulty").alias("circuit_overtake_difficulty"),
        or_default(progress, "season_progress").alias("season_progress"),
    )


def quali_columns(place: str, pole: str, *times: str) -> dict[str, Column]:
    """Qualifying features from an entrant's place and times (null without a qualifying row)."""
    last = F.col(times[-1])
    return {
        "grid_position": or_default(F.col(place), "grid_position"),
        "quali_gap_to_pole": F.when(F.col(pole) > 0, last - F.col(pole)),
        "quali_q3_reached": last.isNotNull().cast("long"),
        "quali_consistency": spread_of_times(*times),
    }


def qualifying_features(roster: DataFrame, qualifying: DataFrame, n_races: int | None = None) -> DataFrame:
    """Grid place, gap to pole, final-session flag and consistency of times."""
    pole = sized(qualifying.groupBy("ro").agg(F.min("q3_sec").alias("pole")), n_races)
    mine = qualifying.select("ro", "driver_id", "position", "q1_sec", "q2_sec", "q3_sec")
    joined = roster.join(mine, ["ro", "driver_id"], "left").join(pole, "ro", "left")
    columns = quali_columns("position", "pole", "q1_sec", "q2_sec", "q3_sec")
    return joined.withColumns(columns).drop("position", "pole", "q1_sec", "q2_sec", "q3_sec")


def teammate_gaps(qualifying: DataFrame, n_team_races: int | None = None) -> DataFrame:
    """Own best time minus that of the best-placed other entrant of the team.

    The team's two best-placed entrants are enough: the second is the team-mate of the first and
    the first of everybody else.
    """
    team = ["ro", "constructor_id"]
    best = F.coalesce("q3_sec", "q2_sec", "q1_sec")
    mine = qualifying.select(*team, "driver_id", "position", best.alias("best"))
    pair = top_rows(mine, team, [F.asc("position"), F.asc("driver_id")], 2)
    pair = pair.groupBy(*team).agg(
        F.max(F.when(F.col("place") == 1, F.struct("driver_id", "best"))).alias("first"),
        F.max(F.when(F.col("place") == 2, F.struct("driver_id", "best"))).alias("second"),
    )
    other = F.when(F.col("driver_id") == F.col("first.driver_id"), F.col("second.best")).otherwise(F.col("first.best"))
    gap = F.when(other > 0, F.col("best") - other)
    return mine.join(sized(pair, n_team_races), team).select(
        "ro", "driver_id", or_default(gap, "teammate_quali_gap").alias("teammate_quali_gap")
    )


def standing_columns(place: str, points: str, team_place: str, team_points: str) -> dict[str, Column]:
    values = (place, points, team_place, team_points)
    return {name: or_default(F.col(c), name) for name, c in zip(STANDING_COLUMNS, values)}


def standings_features(roster: DataFrame, standings: DataFrame) -> DataFrame:
    """Championship places and points before the race."""
    values = ["position", "points", "constructor_pos", "constructor_pts"]
    joined = roster.join(standings.select("ro", "driver_id", *values), ["ro", "driver_id"], "left")
    return joined.withColumns(standing_columns(*values)).drop(*values)


def home_flags(
    roster: DataFrame, drivers: DataFrame, homes: DataFrame, n_homes: int | None = None
) -> DataFrame:
    """1 where the circuit is one of the home circuits of the driver's nationality."""
    home = sized(homes.distinct(), n_homes).withColumn("_home", F.lit(1).cast("long"))
    joined = roster.join(drivers.select("driver_id", "nationality"), "driver_id", "left")
    joined = joined.join(home, ["nationality", "circuit_id"], "left")
    return joined.withColumn("home_race", or_default(F.col("_home"), "home_race")).drop("_home", "nationality")


def entrant_rows(results: DataFrame, qualifying: DataFrame, standings: DataFrame, gaps: DataFrame) -> DataFrame:
    """The full roster with each entrant's own rows of all four tables, partitioned by driver.

    The tables are stacked and folded per (driver, race), so every row is shuffled exactly once and
    the result keeps the partitioning the driver windows need.
    """
    parts = {
        "result": (results, ["race_id", "constructor_id", "is_podium", "position", "status"]),
        "quali": (qualifying, ["race_id", "constructor_id", "position", "q1_sec", "q2_sec", "q3_sec"]),
        "standing": (standings, ["position", "points", "constructor_pos", "constructor_pts"]),
        "gap": (gaps, ["teammate_quali_gap"]),
    }
    stacked = [df.select("driver_id", "ro", F.struct(*columns).alias(name)) for name, (df, columns) in parts.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    folded = rows.repartition("driver_id").groupBy("driver_id", "ro")
    folded = folded.agg(*[F.first(name, ignorenulls=True).alias(name) for name in parts])
    raced = F.col("result").isNotNull()
    return folded.filter(raced | F.col("quali").isNotNull()).withColumns(
        {
            "race_id": F.coalesce("result.race_id", "quali.race_id"),
            "constructor_id": F.when(raced, F.col("result.constructor_id")).otherwise(F.col("quali.constructor_id")),
            "is_podium": F.coalesce("result.is_podium", F.lit(0)),
            "finish_position": F.col("result.position"),
            "status": F.when(raced, F.col("result.status")).otherwise("Unknown"),
        }
    )


def feature_matrix(
    results: DataFrame,
    qualifying: DataFrame,
    standings: DataFrame,
    races: DataFrame,
    drivers: DataFrame,
    circuits: DataFrame,
    homes: DataFrame,
    n_races: int | None = None,
    n_teams: int | None = None,
    n_homes: int | None = None,
) -> DataFrame:
    """All features for the full roster of every race.

    Entrant rows are shuffled once, by driver; all driver windows and the join with the drivers
    reuse that partitioning. ``n_races``, ``n_teams`` and ``n_homes`` are known counts: race and
    (team, race) facts are broadcast where these prove them small.
    """
    n_team_races = n_races * n_teams if n_races is not None and n_teams is not None else None
    context = sized(race_context(races, circuits), n_races)
    pole = sized(qualifying.groupBy("ro").agg(F.min("q3_sec").alias("pole")), n_races)
    team_races = results.select("constructor_id", "ro").unionByName(qualifying.select("constructor_id", "ro")).distinct()
    teams = team_history(results, team_races.join(context, "ro"))

    rows = entrant_rows(results, qualifying, standings, teammate_gaps(qualifying, n_team_races))
    rows = rows.join(context, "ro").join(pole, "ro", "left")
    rows = circuit_history(form_columns(rows))
    rows = rows.withColumns(
        {
            **quali_columns("quali.position", "pole", "quali.q1_sec", "quali.q2_sec", "quali.q3_sec"),
            **standing_columns(
                "standing.position", "standing.points", "standing.constructor_pos", "standing.constructor_pts"
            ),
            "teammate_quali_gap": or_default(F.col("gap.teammate_quali_gap"), "teammate_quali_gap"),
        }
    )
    rows = home_flags(rows, drivers, homes, n_homes)
    rows = rows.join(sized(teams, n_team_races), ["constructor_id", "ro"], "left")
    return rows.select(*META, "circuit_id", *C.FEATURES)


def league_matrix(league) -> DataFrame:
    """The staged feature matrix of a league."""
    return league._staged(
        "matrix",
        lambda: feature_matrix(
            league.results, league.qualifying, league.standings, league.races, league.drivers, league.circuits,
            league.homes, league.race_count, league.team_count, league.home_count,
        ),
    )


def training_columns(matrix: DataFrame) -> tuple[list[str], list[str]]:
    """Feature columns and the rest."""
    features = [c for c in C.FEATURES if c in matrix.columns]
    return features, [c for c in matrix.columns if c not in features]


def read_cached(spark, path: str, start_year: int, end_year: int) -> DataFrame:
    """Seasons of a feature cache partitioned by year; only their folders are read."""
    return spark.read.parquet(path).filter(F.col("year").between(start_year, end_year))


def write_cached(matrix: DataFrame, path: str) -> None:
    """Write seasons to the cache; seasons not in ``matrix`` stay as they are."""
    (
        matrix.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )
