"""The stored tables: ingest of landed documents by keyed upsert, and the matrix built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions import constants as C
from paceline.functions import rules
from paceline.operators.features import feature_matrix
from paceline.session import discard, exists, new_path
from paceline.sources import landing, merge, schemas

BUCKETS = 32  # partitions of the two entity tables, by key hash


# Schema of each kind of landed documents, where its races stand, and the tables it fills, in the order of loading
DOCUMENTS = {
    "calendar": (schemas.CALENDAR_DOC, "RaceTable.Races", {"races": landing.races}),
    "qualifying": (schemas.QUALIFYING_DOC, "RaceTable.Races", {"races": landing.races, "qualifying": landing.qualifying}),
    "results": (
        schemas.RESULTS_DOC, "RaceTable.Races",
        {"races": landing.races, "drivers": landing.drivers, "constructors": landing.constructors, "results": landing.results},
    ),
    "standings": (schemas.STANDINGS_DOC, "StandingsTable.StandingsLists", {"standings_snapshot": landing.standings}),
    "pit_stops": (schemas.PIT_STOPS_DOC, "RaceTable.Races", {"pit_stops": landing.pit_stops}),
}


def home_circuits(spark: SparkSession) -> DataFrame:
    """Built-in nationality and home circuit pairs."""
    pairs = [(nation, circuit) for nation, circuits in C.HOME_CIRCUITS.items() for circuit in circuits]
    return spark.createDataFrame(pairs, "nationality string, circuit_id string")


class Store:
    """Nine keyed Parquet tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.progress: dict[str, list] = {}
        self.loaded: dict[str, tuple[int, int]] = {}

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @staticmethod
    def _partition(name: str) -> str:
        return "bucket" if name in ("drivers", "constructors") else "year"

    def table(self, name: str, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
        """A stored table; a year range reads only those partitions."""
        rows = self.spark.read.schema(schemas.TABLES[name]).parquet(self._path(name))
        if start_year is not None:
            rows = rows.filter(F.col("year") >= start_year)
        return rows if end_year is None else rows.filter(F.col("year") <= end_year)

    def save(self, name: str, rows: DataFrame) -> None:
        """Insert or replace by key. Missing columns become null; race order and year follow the race id.

        Of several versions of a key in ``rows`` the last landed wins (``_order``), or without an
        order the greatest, so the result never depends on task timing.
        """
        key = merge.TABLE_KEYS[name]
        if self._partition(name) == "bucket":
            rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key[0]), F.lit(BUCKETS)))
        else:
            parts = F.split("race_id", "_")
            year, number = parts[0].cast("long"), parts[1].cast("long")
            rows = rows.withColumns({"year": year, "ro": rules.race_order(year, number)})
        fields = T.StructType.fromDDL(schemas.TABLES[name]).fields
        typed = rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in fields
            ],
            *[c for c in (landing.ORDER,) if c in rows.columns],
        )
        partition = self._partition(name)
        order = [landing.ORDER] if landing.ORDER in typed.columns else [f.name for f in fields if f.name not in (*key, partition)]
        typed = merge.latest_by_key(typed, [*key, partition], order).drop(landing.ORDER)
        seen = Observation()
        missing = [F.count_if(F.col(c).isNull()) for c in merge.REQUIRED.get(name, [])]
        counted = typed.observe(seen, F.count(F.lit(1)).alias("n_rows"), reduce(lambda a, b: a + b, missing, F.lit(0)).alias("missing"))
        if exists(self.spark, self._path(name)):
            merge.upsert(self.spark, self._path(name), counted, [*key, partition], partition, unique=True)
        else:
            merge.first_load(counted, self._path(name), partition)
        before = self.loaded.get(name, (0, 0))
        self.loaded[name] = (before[0] + seen.get["n_rows"], before[1] + seen.get["missing"])

    def load_quality(self) -> DataFrame:
        """Rows written and required values missing in them, per table, over the loads of this reader.

        Both are counted by the writes themselves; no table is read for them.
        """
        rows = [(name, *counts) for name, counts in self.loaded.items()]
        return self.spark.createDataFrame(rows, "table_name string, n_rows long, missing long")

    def ingest(
        self,
        results: str | None = None,
        qualifying: str | None = None,
        standings: str | None = None,
        pit_stops: str | None = None,
        calendar: str | None = None,
        forecasts: str | None = None,
        practice: str | None = None,
        circuits: DataFrame | None = None,
    ) -> DataFrame | None:
        """Land document folders into the tables; returns read and failed documents per kind and season.

        Documents that cannot be read are left out and counted, so one bad race does not stop a load.
        Races come from calendar, qualifying and result documents, so that a race without results is
        known too. ``practice`` is a Parquet folder of laps (race_id, driver_id, session_type,
        LapNumber, LapTime); ``circuits`` are those whose forecasts are kept (default the built-in).
        """
        reports = []
        for kind, path in zip(DOCUMENTS, (calendar, qualifying, results, standings, pit_stops), strict=True):
            if path:
                documents = landing.read_documents(self.spark, path, DOCUMENTS[kind][0], ordered=True)
                reports.append(self._land(kind, documents))
        if forecasts:
            documents = landing.read_documents(self.spark, forecasts, schemas.FORECAST_DOC)
            known = landing.known_circuits(self.spark) if circuits is None else circuits
            self.save("weather", landing.forecasts(landing.good(documents), known))
        if practice:
            summary = landing.practice_summary(self.spark.read.parquet(practice), merge.TABLE_KEYS["practice_sessions"])
            self.save("practice_sessions", summary.withColumnRenamed("lap_count", "laps_completed"))
        return reduce(DataFrame.unionByName, reports) if reports else None

    def _land(self, kind: str, documents: DataFrame) -> DataFrame:
        """Fill the tables of one kind of documents; parsed once to columns, of which tables and report read a few."""
        parsed = new_path(self.spark, f"parsed-{kind}")
        documents.write.parquet(parsed)
        documents = self.spark.read.schema(documents.schema).parquet(parsed)
        _, lists, tables = DOCUMENTS[kind]
        for name, rows_of in tables.items():
            self.save(name, self._standings(documents) if kind == "standings" else rows_of(documents))
        report = landing.ingest_report(documents, lists).withColumn("kind", F.lit(kind))
        report = self.spark.createDataFrame(report.collect(), report.schema)  # one row per season
        discard(self.spark, parsed)
        return report

    def follow(self, **folders: str) -> DataFrame:
        """Land only what is new in document folders since the last call; returns the report of all calls so far.

        Folders are named like those of ``ingest``. Each kind is a file stream with its own progress under the store, so
        a file is read once, also by a later process. Files of one call are one load, ordered as in ``ingest``; a later
        call wins over an earlier one. A load that is run again after a failure upserts the same rows and replaces its
        own part of the report.
        """
        unknown = set(folders) - set(DOCUMENTS)
        if unknown:
            raise ValueError(f"no documents of kind {sorted(unknown)}")
        for kind in (k for k in DOCUMENTS if k in folders):
            reports = f"{self.root}/_reports/{kind}"

            def land(batch: DataFrame, number: int, kind: str = kind, reports: str = reports) -> None:
                report = self._land(kind, landing.placed(batch))
                report.coalesce(1).write.mode("overwrite").parquet(f"{reports}/batch={number}")

            query = (
                landing.document_stream(self.spark, folders[kind], DOCUMENTS[kind][0])
                .writeStream.option("checkpointLocation", f"{self.root}/_progress/{kind}")
                .foreachBatch(land)
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
            self.progress[kind] = query.recentProgress
        return self.report()

    def report(self) -> DataFrame:
        """Documents read and failed per kind and season over all calls of ``follow``."""
        schema = "year long, ingested long, failed long, kind string"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/_reports/*/*")
        except AnalysisException:
            rows = self.spark.createDataFrame([], schema)
        return rows.groupBy("kind", "year").agg(F.sum("ingested").alias("ingested"), F.sum("failed").alias("failed"))

    def _standings(self, documents: DataFrame) -> DataFrame:
        try:
            return landing.corrected_standings(documents, self.table("standings_snapshot"))
        except AnalysisException:  # the first load
            return landing.standings(documents)

    def matrix(
        self,
        start_year: int | None = None,
        end_year: int | None = None,
        circuits: DataFrame | None = None,
        homes: DataFrame | None = None,
    ) -> DataFrame:
        """Feature matrix of a range of seasons; history reaches back to the first stored season."""
        races = self.table("races", end_year=end_year)
        rows = feature_matrix(
            self.table("results", end_year=end_year),
            self.table("qualifying", end_year=end_year),
            self.table("standings_snapshot", end_year=end_year),
            races,
            self.table("drivers"),
            landing.known_circuits(self.spark) if circuits is None else circuits,
            home_circuits(self.spark) if homes is None else homes,
            n_races=races.count(),
            n_teams=self.table("constructors").count(),
        )
        return rows if start_year is None else rows.filter(F.col("year") >= start_year)

    def quality(self) -> DataFrame:
        """Duplicate keys, orphans and missing required values of all tables, one row each.

        A table that was never loaded counts as empty.
        """
        tables = {}
        for name in merge.TABLE_KEYS:
            try:
                tables[name] = self.table(name)
            except AnalysisException:
                tables[name] = self.spark.createDataFrame([], schemas.TABLES[name])
        frames = []
        for name, rows in tables.items():
            found = [merge.duplicate_keys(rows, merge.TABLE_KEYS[name]).agg(F.count(F.lit(1)).alias("duplicates"))]
            for column, parent in merge.REFERENCES.get(name, []):
                lost = merge.orphans(rows, tables[parent], column)
                found.append(lost.agg(F.count(F.lit(1)).alias("orphans")))
            missing = [F.count_if(F.col(c).isNull()) for c in merge.REQUIRED.get(name, [])]
            found.append(rows.agg(reduce(lambda a, b: a + b, missing, F.lit(0).cast("long")).alias("missing")))
            stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
            if "orphans" not in stacked.columns:
                stacked = stacked.withColumn("orphans", F.lit(0).cast("long"))
            totals = [F.sum(c).alias(c) for c in ("duplicates", "orphans", "missing")]
            frames.append(stacked.agg(*totals).withColumn("table_name", F.lit(name)))
        return reduce(DataFrame.unionByName, frames)
