"""Point-in-time history: what was known about a driver or team strictly before each race.

Windows here are per driver or per team over races, so their size is bounded by the calendar, not
by the field: team rows are reduced to a few per race before any window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import constants as C
from paceline.functions import rules
from paceline.operators.ordering import top_rows

D = C.FEATURE_DEFAULTS


def or_default(value: Column, name: str) -> Column:
    return F.coalesce(value, F.lit(D[name]))


def full_roster(results: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Everyone with a result, plus those known from qualifying only (label 0, no position)."""
    key = ["ro", "driver_id"]
    columns = ["race_id", *key, "constructor_id"]
    only_qualified = qualifying.join(results, key, "left_anti").select(
        *columns,
        F.lit(0).cast("long").alias("is_podium"),
        F.lit(None).cast("long").alias("finish_position"),
        F.lit("Unknown").alias("status"),
    )
    raced = results.select(*columns, "is_podium", F.col("position").alias("finish_position"), "status")
    return raced.unionByName(only_qualified)


def _state_before(state: Column, entity: str) -> Column:
    """Latest non-null state of the entity before the current race."""
    before = Window.partitionBy(entity).orderBy("ro").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(state, ignorenulls=True).over(before)


def recent_form(roster: DataFrame) -> DataFrame:
    """Average place, podium rate and DNF rate over the last classified races before this one.

    The state after each classified race is taken over classified rows only, so an unclassified
    race takes no slot; every row then reads the latest state before it. Both windows share one
    partitioning by driver.
    """
    return form_columns(roster.repartition("driver_id"))


def form_columns(roster: DataFrame) -> DataFrame:
    """``recent_form`` of rows that are already partitioned by driver."""
    classified = F.col("finish_position").isNotNull()
    past = Window.partitionBy("driver_id", classified).orderBy("ro")
    last3, last5 = past.rowsBetween(-2, 0), past.rowsBetween(-4, 0)
    place = F.col("finish_position")
    state = F.when(
        classified,
        F.struct(
            F.avg(place).over(last3).alias("avg3"),
            F.avg(place).over(last5).alias("avg5"),
            F.avg("is_podium").over(last5).alias("podium"),
            F.avg((~rules.finished(F.col("status"))).cast("int")).over(last5).alias("dnf"),
        ),
    )
    seen = roster.withColumn("_state", state)
    seen = seen.withColumn("_state", _state_before(F.col("_state"), "driver_id"))
    return seen.withColumns(
        {
            "driver_last3_avg_pos": or_default(F.col("_state.avg3"), "driver_last3_avg_pos"),
            "driver_last5_podium_rate": or_default(F.col("_state.podium"), "driver_last5_podium_rate"),
            "driver_last5_avg_pos": or_default(F.col("_state.avg5"), "driver_last5_avg_pos"),
            "driver_recent_dnf_rate": or_default(F.col("_state.dnf"), "driver_recent_dnf_rate"),
        }
    ).drop("_state")


def circuit_history(roster: DataFrame) -> DataFrame:
    """Average and best earlier place of the driver at this circuit."""
    earlier = (
        Window.partitionBy("driver_id", "circuit_id").orderBy("ro").rangeBetween(Window.unboundedPreceding, -1)
    )
    return roster.withColumns(
        {
            "driver_circuit_avg_pos": or_default(F.avg("finish_position").over(earlier), "driver_circuit_avg_pos"),
            "driver_circuit_best_pos": or_default(F.min("finish_position").over(earlier), "driver_circuit_best_pos"),
        }
    )


def team_history(results: DataFrame, roster: DataFrame) -> DataFrame:
    """Finish rates of each team before each of its races, at (team, race) grain.

    Only the last 20 entries of a team in a race can be among its last 20 overall, so each
    (team, race) is cut to 20 rows before the team window; season and circuit rates use counts.
    """
    team_race = ["constructor_id", "ro"]
    finished = rules.finished(F.col("status")).cast("long")
    counts = results.groupBy(*team_race).agg(F.count(F.lit(1)).alias("n"), F.sum(finished).alias("ok"))

    latest = top_rows(results.select(*team_race, "driver_id", finished.alias("ok")), team_race, [F.desc("driver_id")], 20)
    last20 = Window.partitionBy("constructor_id").orderBy("ro", "driver_id").rowsBetween(-19, 0)
    rates = latest.withColumn("rate", F.avg("ok").over(last20))
    rates = rates.groupBy(*team_race).agg(F.max_by("rate", "driver_id").alias("rate"))

    spine = roster.groupBy(*team_race).agg(F.first("year").alias("year"), F.first("circuit_id").alias("circuit_id"))
    spine = spine.join(counts, team_race, "left").join(rates, team_race, "left")

    def share(*scope: str, at_least: int = 1) -> Column:
        earlier = Window.partitionBy("constructor_id", *scope).orderBy("ro").rowsBetween(Window.unboundedPreceding, -1)
        rows = F.sum("n").over(earlier)
        return F.when(rows >= at_least, F.sum("ok").over(earlier) / rows)

    recent = or_default(_state_before(F.col("rate"), "constructor_id"), "constructor_reliability")
    spine = spine.withColumns({"recent": recent, "season": share("year", at_least=2), "circuit": share("circuit_id")})
    season, circuit = F.coalesce("season", "recent"), F.coalesce("circuit", "recent")
    w_season, w_recent, w_circuit = C.SURVIVAL_WEIGHTS
    return spine.select(
        *team_race,
        F.col("recent").alias("constructor_reliability"),
        season.alias("constructor_season_reliability"),
        circuit.alias("constructor_circuit_reliability"),
        (w_season * season + w_recent * F.col("recent") + w_circuit * circuit).alias("constructor_survival_prob"),
    )


def latest_team_reliability(results: DataFrame, entries: int = 20) -> DataFrame:
    """Share of finishes in each team's latest entries, and its complement the DNF rate.

    Each task keeps ``entries`` rows per team before the shuffle, so a team with most rows is safe.
    """
    order = [F.desc("ro"), F.desc("driver_id")]
    finished = rules.finished(F.col("status")).cast("long").alias("ok")
    latest = top_rows(results.select("constructor_id", "ro", "driver_id", finished), ["constructor_id"], order, entries)
    rate = F.avg("ok")
    return latest.groupBy("constructor_id").agg(rate.alias("reliability"), (1 - rate).alias("dnf_rate"))
