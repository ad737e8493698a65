"""User-facing listings and race documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import constants as C
from paceline.functions import rules
from paceline.operators.distribution import place_probabilities, top_combinations
from paceline.operators.history import latest_team_reliability
from paceline.operators.ordering import running, sized, top_rows
from paceline.operators.podium import actual_podium, ordered_ids, podium, ranking_scores

RACE = ["race_id", "ro", "year", "round"]


def calendar(races: DataFrame, year: int | None = None) -> DataFrame:
    rows = races if year is None else races.filter(F.col("year") == year)
    return rows.orderBy("year", "round")


def venues(races: DataFrame) -> DataFrame:
    return races.select("circuit_id", "circuit_name", "country").distinct().orderBy("circuit_name")


def race_listing(results: DataFrame, races: DataFrame, drivers: DataFrame, n_races: int | None = None) -> DataFrame:
    """Results with names, classified rows first."""
    dates = sized(races.select("race_id", "circuit_name"), n_races)
    return (
        results.join(dates, "race_id")
        .join(drivers.select("driver_id", "full_name", "code"), "driver_id")
        .select(*RACE, "circuit_name", "position", "position_text", rules.title(F.col("full_name")).alias("driver"), "code",
                "points", "status")
        .orderBy("ro", F.col("position").asc_nulls_last(), "code")
    )


def driver_recent_results(results: DataFrame, n: int = 5, before: int | None = None) -> DataFrame:
    """Each driver's last ``n`` results, newest first, before the race order ``before`` where it is given."""
    rows = results if before is None else results.filter(F.col("ro") < before)
    last = top_rows(rows, ["driver_id"], [F.desc("ro")], n, "recent")
    return last.select("driver_id", *RACE, "position", "grid", "is_podium", "status", "recent")


def driver_circuit_results(results: DataFrame, races: DataFrame, n_races: int | None = None) -> DataFrame:
    """Each driver's results at each circuit, numbered from the first visit."""
    at = sized(races.select("race_id", "circuit_id"), n_races)
    visits = Window.partitionBy("driver_id", "circuit_id").orderBy("ro")
    rows = results.join(at, "race_id").withColumn("visit", F.row_number().over(visits))
    return rows.select("driver_id", "circuit_id", "race_id", "year", "position", "grid", "is_podium", "visit")


def season_points(results: DataFrame, entities: DataFrame, entity: str, labels: list[str]) -> DataFrame:
    """Championship by points per season; points are summed per entity before names are joined."""
    totals = results.groupBy("year", entity).agg(F.sum("points").alias("points"))
    return totals.join(entities.select(entity, *labels), entity).orderBy("year", F.desc("points"), entity)


def latest_standings(
    standings: DataFrame, drivers: DataFrame, year: int | None = None, n_races: int | None = None
) -> DataFrame:
    """Snapshot before the last race of each season (or of one season), with names."""
    rows = standings if year is None else standings.filter(F.col("year") == year)
    last = rows.groupBy("year").agg(F.max("ro").alias("ro"))
    latest = rows.join(sized(last, n_races), ["year", "ro"], "left_semi")
    return latest.join(drivers.select("driver_id", "full_name", "code"), "driver_id").orderBy("year", "position")


def starting_grid(results: DataFrame, drivers: DataFrame) -> DataFrame:
    """Grid order with finishing places; drivers without one are left out of the listing."""
    rows = results.filter("position IS NOT NULL").join(drivers.select("driver_id", "full_name"), "driver_id")
    label = rules.title(F.col("full_name")).alias("driver")
    return rows.select("race_id", "ro", "driver_id", "grid", "position", label).orderBy("ro", "grid")


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of ``first``, and those of ``second`` for keys ``first`` does not have."""
    rest = second.join(first.select(key).distinct(), key, "left_anti")
    return first.unionByName(rest)


def backtest_predictions(documents: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Predicted places of stored backtests: probability 0.5 where absent, full confidence."""
    places = documents.select("race_id", F.posexplode("predicted").alias("i", "driver_id"))
    joined = places.join(probabilities, ["race_id", "driver_id"], "left")
    return joined.select(
        "race_id",
        F.col("driver_id").cast("string").alias("driver_id"),
        (F.col("i") + 1).cast("long").alias("predicted_position"),
        F.coalesce("prob", F.lit(0.5)).alias("probability"),
        F.lit(1.0).alias("confidence"),
        F.lit("backtest").alias("source"),
    )


def model_predictions(scored: DataFrame, position: str | None, groups: int | None = None) -> DataFrame:
    """Predicted places from scores, rounded as served."""
    answer = podium(scored, ["race_id"], position, groups=groups)
    return answer.select(
        "race_id",
        F.col("driver_id").cast("string").alias("driver_id"),
        "predicted_position",
        F.round("probability", 4).alias("probability"),
        F.round("confidence", 4).alias("confidence"),
        F.lit("model").alias("source"),
    )


def podium_check(predictions: DataFrame, results: DataFrame) -> DataFrame:
    """Every actual podium place of completed races with the verdict on the prediction."""
    actual = actual_podium(results, ["race_id"]).withColumn("driver_id", F.col("driver_id").cast("string"))
    named = predictions.select("race_id", "driver_id", "predicted_position")
    verdict = (
        F.when(F.col("predicted_position") == F.col("position"), "exact")
        .when(F.col("predicted_position").isNotNull(), "podium")
        .otherwise("miss")
    )
    return actual.join(named, ["race_id", "driver_id"], "left").select("race_id", "position", "driver_id", verdict.alias("verdict"))


def race_center(races: DataFrame, predictions: DataFrame, results: DataFrame) -> DataFrame:
    """One row per race: both podiums, completion and, for completed races, the hits."""
    predicted = predictions.groupBy("race_id").agg(
        ordered_ids("predicted_position", "driver_id").alias("predicted"), F.first("source").alias("source")
    )
    actual = actual_podium(results, ["race_id"]).withColumn("driver_id", F.col("driver_id").cast("string"))
    actual = actual.groupBy("race_id").agg(ordered_ids("position", "driver_id").alias("actual"))
    joined = races.join(predicted, "race_id", "left").join(actual, "race_id", "left")
    done = F.col("actual").isNotNull()
    hits = F.when(
        done & (F.size("predicted") == 3), F.size(F.array_intersect("predicted", "actual")).cast("long")
    )
    return joined.select(
        "race_id", "circuit_name", "country", "predicted", "source", "actual",
        done.cast("long").alias("is_completed"), hits.alias("correct_podiums"),
    )


def race_lengths(spark) -> DataFrame:
    rows = [(key, *facts) for key, facts in C.RACE_LENGTHS.items()]
    return spark.createDataFrame(rows, "circuit_id string, laps int, lap_distance_km double")


def race_card(
    scored: DataFrame,
    results: DataFrame,
    constructors: DataFrame,
    bound: int | None = None,
    groups: int | None = None,
    n_teams: int | None = None,
) -> DataFrame:
    """Entrants in predicted order with place probabilities, lap estimate and retirement risk.

    ``n_teams`` bounds the constructors: few teams hold all entrants, and are broadcast to them.
    """
    placed = place_probabilities(scored, ["race_id"], groups=groups)
    ordered = running(placed, ["race_id"], [F.asc("predicted_place"), F.asc("driver_id")], number="position", bound=bound)
    reliability = latest_team_reliability(results).join(constructors, "constructor_id", "left")
    joined = ordered.join(sized(reliability, n_teams), "constructor_id", "left")
    rate = F.coalesce("reliability", F.lit(C.FEATURE_DEFAULTS["constructor_reliability"]))
    return joined.select(
        "race_id", "position", "driver_id", "constructor_id",
        *[F.round(c, 4).alias(c) for c in ("podium_prob", "p1", "p2", "p3")],
        F.round(rules.estimated_lap(F.col("predicted_place")), 3).alias("expected_lap_sec"),
        F.round(1 - rate, 3).alias("dnf_risk"),
        rules.dnf_note(F.coalesce("name", F.lit("")), rate).alias("dnf_note"),
    )


def race_card_head(
    scored: DataFrame, races: DataFrame, forecasts: DataFrame, circuits: DataFrame, lengths: DataFrame,
    groups: int | None = None,
) -> DataFrame:
    """Race facts, weather and the likeliest trio in its best order."""
    best = top_combinations(scored, ["race_id"], 1, groups=groups)
    best = best.select(
        "race_id",
        F.array("member_1", "member_2", "member_3").alias("podium"),
        "combo_prob",
        F.when(F.col("combo_prob") > C.CARD_CONFIDENCE, "high").otherwise("medium").alias("confidence_level"),
    )
    laps, distance = C.DEFAULT_RACE_LENGTH
    facts = races.join(circuits, "circuit_id", "left").join(lengths, "circuit_id", "left")
    facts = facts.select(
        "race_id", "circuit_id", "circuit_name", "country",
        F.coalesce("type", F.lit("technical")).alias("circuit_type"),
        F.coalesce("overtake_difficulty", F.lit(C.FEATURE_DEFAULTS["circuit_overtake_difficulty"])).alias("overtake_difficulty"),
        F.coalesce("laps", F.lit(laps)).cast("long").alias("laps"),
        F.coalesce("lap_distance_km", F.lit(distance)).alias("lap_distance_km"),
    )
    weather = forecasts.drop("circuit_id")
    return facts.join(weather, "race_id", "left").join(best, "race_id", "left")


def pre_race_answer(scored: DataFrame, races: DataFrame, position: str | None, groups: int | None = None) -> DataFrame:
    """Podium prediction with race facts."""
    answer = podium(scored, ["race_id"], position, groups=groups)
    facts = sized(races.select("race_id", "circuit_name", "country", "race_date"), groups)
    return answer.join(facts, "race_id").select(
        "race_id", "circuit_name", "country", "race_date", "predicted_position", "driver_id",
        F.round("probability", 4).alias("probability"), F.round("confidence", 4).alias("confidence"),
        "confidence_level", F.lit("pre_race").alias("prediction_type"),
    )


def full_grid(
    scored: DataFrame, position: str | None, bound: int | None = None, groups: int | None = None
) -> DataFrame:
    """Every entrant in order of probability, with its ranking score."""
    scores = ranking_scores(scored, ["race_id"], position, groups)
    ordered = running(scores, ["race_id"], [F.desc("prob"), F.asc("driver_id")], number="grid_order", bound=bound)
    return ordered.select(
        "race_id", "driver_id", F.round("prob", 4).alias("podium_probability"), F.round("score", 6).alias("score"), "grid_order"
    ).orderBy("race_id", "grid_order")


def leaders(probs: DataFrame, key: list[str], n: int = 10, value: str = "prob") -> DataFrame:
    """Top n per race by a probability, as text with one decimal."""
    top = top_rows(probs, key, [F.desc(value), F.asc("driver_id")], n, "place")
    return top.withColumn("label", rules.percent(F.col(value)))
