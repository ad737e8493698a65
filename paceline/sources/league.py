"""League tables (races, entrants, results, qualifying, standings) derived from the order tables.

A month is a race, a supplier is a driver, a region is a constructor. Each table is built once and
staged as Parquet, so that later queries read narrow keyed tables as they would from a store.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions import rules
from paceline.operators.ordering import running
from paceline.session import staged
from paceline.sources.tables import table

# Points for places 1 to 10, and the league's circuits (c4 is left out on purpose)
POINTS = [25, 18, 15, 12, 10, 8, 6, 4, 2, 1]
LEAGUE_CIRCUITS = [("c0", "street", 0.8), ("c1", "technical", 0.3), ("c2", "high_speed", 0.35), ("c3", "technical", 0.45)]


class League:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _staged(self, name, build):
        """Dealt to tasks by the rows that are read: lines for entrants, entrants for the other tables."""
        rows = (lambda: self._table("lineitem").count()) if name == "entry" else (lambda: self.entry.count())
        return staged(self.spark, (name, self.sf_dir), build, rows)

    def _table(self, name):
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def field_bound(self) -> int:
        """Entrants per race cannot exceed the suppliers (a footer-only count)."""
        return self._table("supplier").count()

    @cached_property
    def race_count(self) -> int:
        """Months on the calendar (a footer-only count of the staged table)."""
        return self.races.count()

    @cached_property
    def team_count(self) -> int:
        return self._table("region").count()

    @cached_property
    def home_count(self) -> int:
        return self._table("nation").count()

    @property
    def entry(self) -> DataFrame:
        return self._staged("entry", self._build_entry)

    @property
    def races(self) -> DataFrame:
        return self._staged("races", self._build_races)

    @property
    def results(self) -> DataFrame:
        return self._staged("results", self._build_results)

    @property
    def qualifying(self) -> DataFrame:
        return self._staged("qualifying", self._build_qualifying)

    @property
    def standings(self) -> DataFrame:
        return self._staged("standings", self._build_standings)

    @property
    def drivers(self) -> DataFrame:
        """One row per driver; ``home_circuit_id`` follows the nationality."""
        nation = self._table("nation").select("n_nationkey", "n_name", "n_regionkey")
        return (
            self._table("supplier")
            .select("s_suppkey", "s_name", "s_nationkey")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("driver_id"),
                F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"),
                F.col("s_name").alias("full_name"),
                F.col("n_name").alias("nationality"),
                F.col("n_regionkey").cast("long").alias("constructor_id"),
            )
        )

    @property
    def homes(self) -> DataFrame:
        """Nationality and its home circuits."""
        return self._table("nation").select(
            F.col("n_name").alias("nationality"),
            F.concat(F.lit("c"), (F.col("n_nationkey") % 5).cast("string")).alias("circuit_id"),
        )

    @property
    def constructors(self) -> DataFrame:
        return self._table("region").select(
            F.col("r_regionkey").cast("long").alias("constructor_id"), F.col("r_name").alias("name")
        )

    @property
    def circuits(self) -> DataFrame:
        return self.spark.createDataFrame(LEAGUE_CIRCUITS, "circuit_id string, type string, overtake_difficulty double")

    def _build_entry(self) -> DataFrame:
        line, number = F.col, F.col("l_linenumber")
        lines = self._table("lineitem").select(
            "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"
        )
        orders = self._table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.year("o_orderdate").cast("long").alias("year"),
            F.month("o_orderdate").cast("long").alias("round"),
        )
        pace = line("l_extendedprice") / line("l_quantity")
        money = "decimal(18,2)"
        entries = (
            lines.join(orders, "l_orderkey")
            .groupBy("year", "round", F.col("l_suppkey").alias("driver_id"))
            .agg(
                F.sum(line("l_extendedprice").cast(money)).alias("rev"),
                F.sum(line("l_quantity").cast(money)).alias("qty"),
                F.count(F.lit(1)).alias("n"),
                F.count_if(line("l_returnflag") == "R").alias("nr"),
                F.count_if(line("l_linestatus") == "F").alias("nf"),
                *[
                    F.round(F.min(F.when(number.isin(*sessions), pace)).cast("decimal(18,9)"), 3).cast("double").alias(name)
                    for name, sessions in (("q1_sec", (1, 2)), ("q2_sec", (3, 4)), ("q3_sec", (5, 6, 7)))
                ],
            )
        )
        return (
            entries.join(self.drivers.select("driver_id", "constructor_id"), "driver_id")
            .withColumn("ro", rules.race_order(F.col("year"), F.col("round")))
            .withColumn("race_id", rules.race_id(F.col("year"), F.col("round")))
        )

    def _build_races(self) -> DataFrame:
        circuit = (F.col("round") % 5).cast("string")
        return (
            self.entry.select("year", "round", "ro", "race_id")
            .distinct()
            .select(
                "race_id",
                "ro",
                "year",
                "round",
                F.concat(F.lit("c"), circuit).alias("circuit_id"),
                F.concat(F.lit("Circuit "), circuit).alias("circuit_name"),
                F.concat(F.lit("Country "), circuit).alias("country"),
                F.make_date("year", "round", F.lit(1)).alias("race_date"),
                F.lit(None).cast("long").alias("total_laps"),
            )
        )

    def _build_results(self) -> DataFrame:
        retired = F.col("status") == "Retired"
        classified = ~(retired & (F.col("driver_id") % 2 == 0))
        started = self.entry.filter("n > 1").select(
            "race_id", "ro", "year", "round", "driver_id", "constructor_id", "rev", "qty",
            F.when(2 * F.col("nr") > F.col("n"), "Retired")
            .when(2 * F.col("nf") > F.col("n"), "+1 Lap")
            .otherwise("Finished")
            .alias("status"),
            F.col("n").alias("laps_completed"),
        ).withColumn("classified", classified)
        placed = running(
            started, ["ro"], [F.desc("classified"), F.desc("rev"), F.asc("driver_id")],
            number="place", bound=self.field_bound,
        )
        gridded = running(placed, ["ro"], [F.desc("qty"), F.asc("driver_id")], number="grid", bound=self.field_bound)
        position = F.when(F.col("classified"), F.col("place"))
        points = F.coalesce(F.get(F.array(*[F.lit(float(p)) for p in POINTS]), (position - 1).cast("int")), F.lit(0.0))
        return gridded.select(
            "race_id", "ro", "year", "round", "driver_id", "constructor_id", "grid",
            position.alias("position"),
            F.coalesce(position.cast("string"), F.lit("R")).alias("position_text"),
            "status",
            points.alias("points"),
            "laps_completed",
            rules.podium_flag(position).alias("is_podium"),
        )

    def _build_qualifying(self) -> DataFrame:
        runs = self.entry.filter("n <> 2").select(
            "race_id", "ro", "driver_id", "constructor_id", "q1_sec", "q2_sec", "q3_sec"
        )
        best = F.coalesce("q3_sec", "q2_sec", "q1_sec")
        return running(
            runs, ["ro"], [best.asc_nulls_last(), F.asc("driver_id")], number="position", bound=self.field_bound
        )

    def _build_standings(self) -> DataFrame:
        return standings_before(self.results, self.races, self.field_bound)


def points_after(results: DataFrame, races: DataFrame, entity: str) -> DataFrame:
    """Cumulative season points of ``entity``, labelled with every later round they apply to.

    The table after round r counts for r + 1 and for each further round until the entity scores a
    row again, so an absent entrant keeps its place and round one has no rows.
    """
    season = Window.partitionBy(entity, "year").orderBy("round")
    last_round = races.groupBy("year").agg(F.max("round").alias("last_round"))
    per_race = results.groupBy(entity, "year", "round").agg(F.sum("points").alias("points"))
    held = per_race.join(last_round, "year").select(
        entity,
        "year",
        F.sum("points").over(season).alias("points"),
        (F.col("round") + 1).alias("from_round"),
        F.coalesce(F.lead("round").over(season), F.col("last_round")).alias("to_round"),
    )
    spans = held.filter("from_round <= to_round")
    return spans.select(entity, "year", "points", F.explode(F.sequence("from_round", "to_round")).alias("round"))


def standings_before(results: DataFrame, races: DataFrame, field_bound: int | None = None) -> DataFrame:
    """Snapshot of both championships before each race, from the results alone."""
    labels = races.select("year", "round", "ro", "race_id")
    drivers = points_after(results, races, "driver_id").join(labels, ["year", "round"])
    drivers = running(drivers, ["ro"], [F.desc("points"), F.asc("driver_id")], number="position", bound=field_bound)
    teams = points_after(results, races, "constructor_id").join(labels.select("year", "round", "ro"), ["year", "round"])
    teams = running(teams, ["ro"], [F.desc("points"), F.asc("constructor_id")], number="team_place", bound=field_bound)
    membership = results.groupBy("driver_id").agg(F.max_by("constructor_id", "ro").alias("constructor_id"))
    teams = teams.select(
        "ro", "constructor_id", F.col("points").alias("constructor_pts"), F.col("team_place").alias("constructor_pos")
    )
    return (
        drivers.join(membership, "driver_id")
        .join(teams, ["ro", "constructor_id"], "left")
        .select(
            "race_id", "ro", "year", "round", "driver_id", "points", "position",
            "constructor_id", "constructor_pts", "constructor_pos",
        )
    )
