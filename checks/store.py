"""Documents to stored tables to features, end to end."""

from pyspark.sql import functions as F

from checks.ctes import LEAGUE, LS, with_ctes
from checks import documents
from checks.features import CIRCUIT_COLUMNS, FORM_COLUMNS, MATRIX, rounded, sql_rounded
from checks.landing import written
from checks.registry import check
from paceline.operators import features
from paceline.plans.store import Store
from paceline.session import new_path
from paceline.sources import landing, schemas
from paceline.sources.league import League

_STORES: dict[tuple, str] = {}


def stored(league) -> Store:
    """The league's documents ingested once per application and input, one season loaded twice."""
    key = (league.spark.sparkContext.applicationId, league.sf_dir)
    if key not in _STORES:
        store = Store(league.spark, new_path(league.spark, "store"))
        paths = {
            "results": written(league, "results", lambda p: documents.write_results(league, p)),
            "qualifying": written(league, "qualifying", lambda p: documents.write_qualifying(league, p)),
            "standings": written(league, "standings", lambda p: documents.write_standings(league, p)) + "/*",
            "calendar": written(league, "calendar", lambda p: documents.write_calendar(league, p)),
        }
        store.ingest(**paths)
        store.save("results", store.table("results", 1996, 1996))
        _STORES[key] = store.root
    return Store(league.spark, _STORES[key])


STORE_COLUMNS = [*FORM_COLUMNS, *CIRCUIT_COLUMNS, *features.QUALI_COLUMNS, *features.STANDING_COLUMNS]


@check(
    "WITH " + MATRIX + f""" SELECT {sql_rounded(STORE_COLUMNS, ['race_id', 'is_podium', 'finish_position'])},
      driver_id::VARCHAR AS driver_id FROM matrix WHERE year >= 1994"""
)
def stored_matrix(spark, sf_dir):
    league = League(spark, sf_dir)
    rows = stored(league).matrix(1994, circuits=league.circuits, homes=league.homes)
    return rows.select(*rounded(STORE_COLUMNS, ["race_id", "driver_id", "is_podium", "finish_position"]))


@check(
    """SELECT table_name, 0::BIGINT AS duplicates, 0::BIGINT AS orphans, 0::BIGINT AS missing
    FROM (VALUES ('races'), ('drivers'), ('constructors'), ('results'), ('qualifying'), ('practice_sessions'), ('pit_stops'),
                 ('weather'), ('standings_snapshot')) t(table_name)"""
)
def stored_quality(spark, sf_dir):
    return stored(League(spark, sf_dir)).quality()


@check(
    with_ctes(LEAGUE) + """SELECT race_id, driver_id::VARCHAR AS driver_id, position, points, status FROM results
      WHERE year BETWEEN 1995 AND 1997"""
)
def stored_results(spark, sf_dir):
    rows = stored(League(spark, sf_dir)).table("results", 1995, 1997)
    return rows.select("race_id", "driver_id", "position", "points", "status")


@check(
    with_ctes(LEAGUE) + """SELECT race_id, driver_id::VARCHAR AS driver_id, (1000 + driver_id % 7)::DOUBLE AS points
      FROM results WHERE year = 1996"""
)
def stored_last_version(spark, sf_dir):
    """A key sent twice in one load: the later entry of a document wins."""
    league = League(spark, sf_dir)

    def write(path):
        entry = lambda points: F.struct(
            points.cast("string").alias("points"), F.struct(F.col("driver_id").cast("string").alias("driverId")).alias("Driver")
        )
        rows = league.results.filter("year = 1996")
        twice = F.array(entry(F.lit(5000) + F.col("driver_id") % 5), entry(F.lit(1000) + F.col("driver_id") % 7))
        race = F.struct(
            F.lit("1996").alias("season"), F.col("round").cast("string").alias("round"), twice.alias("Results")
        )
        rows.select(F.struct(F.struct(F.array(race).alias("Races")).alias("RaceTable")).alias("MRData")).write.json(path)

    store = Store(spark, new_path(spark, "store"))
    store.ingest(results=written(league, "sent-twice", write))
    return store.table("results").select("race_id", "driver_id", "points")


CORRECTED = LS + """, sent AS (
      SELECT race_id, driver_id::VARCHAR AS driver_id, points * CASE WHEN year % 3 = 0 THEN 2 ELSE 1 END AS points, position,
        constructor_id::VARCHAR AS constructor_id, constructor_pos,
        constructor_pts * CASE WHEN year % 3 = 0 THEN 2 WHEN year % 3 = 1 THEN 5 ELSE 1 END AS constructor_pts FROM standings)
    SELECT * FROM sent"""


def _corrections(league):
    """Standings, then tables sent again: both lists of some seasons, the team list alone of others."""
    season = lambda rest: F.col("year") % 3 == rest
    return [
        written(league, "standings", lambda p: documents.write_standings(league, p)) + "/*",
        written(league, "standings-both", lambda p: documents.write_standings(league, p, 2, season(0))) + "/*",
        written(league, "standings-teams", lambda p: documents.write_standings(league, p, 5, season(1), ["teams"])) + "/*",
    ]


SNAPSHOT = ["race_id", "driver_id", "points", "position", "constructor_id", "constructor_pts", "constructor_pos"]


@check(CORRECTED)
def corrected_standings(spark, sf_dir):
    """Tables landed again in one load: the last version of either list counts."""
    rows = [landing.read_documents(spark, path, schemas.STANDINGS_DOC, ordered=True) for path in _corrections(League(spark, sf_dir))]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return landing.standings(both).select(*SNAPSHOT)


@check(CORRECTED)
def stored_corrections(spark, sf_dir):
    """The same tables in three loads: stored rows take what came alone."""
    store = Store(spark, new_path(spark, "store"))
    for path in _corrections(League(spark, sf_dir)):
        store.ingest(standings=path)
    return store.table("standings_snapshot").select(*SNAPSHOT)


_FOLLOWED: dict[tuple, str] = {}


def followed(league) -> Store:
    """Results landed in three drops, each followed by a new reader: the second sends some seasons again and breaks
    documents of others, which the third brings whole."""
    key = (league.spark.sparkContext.applicationId, league.sf_dir)
    if key not in _FOLLOWED:
        root, folder = new_path(league.spark, "followed-store"), new_path(league.spark, "drops")
        season = lambda *rest: league.results.filter((F.col("year") % 3).isin(*rest))
        again = season(1).withColumn("points", F.col("points") + 1000)
        drops = [
            (season(1, 2), None),
            (again.unionByName(season(0)), (F.col("ro") % 7 == 0) & (F.floor(F.col("ro") / 100) % 3 == 0)),
            (season(0).filter("ro % 7 = 0"), None),
        ]
        for number, (rows, broken) in enumerate(drops):
            documents.write_results(league, f"{folder}/{number}", broken, rows)
            Store(league.spark, root).follow(results=f"{folder}/*")
        _FOLLOWED[key] = root
    return Store(league.spark, _FOLLOWED[key])


@check(
    with_ctes(LEAGUE) + """SELECT race_id, driver_id::VARCHAR AS driver_id, position, status,
      points + CASE WHEN year % 3 = 1 THEN 1000 ELSE 0 END AS points FROM results"""
)
def followed_results(spark, sf_dir):
    """Stored results after drops of files of which only new ones were read."""
    return followed(League(spark, sf_dir)).table("results").select("race_id", "driver_id", "position", "status", "points")


@check(
    with_ctes(LEAGUE) + """, doc AS (SELECT DISTINCT ro, year, driver_id // 100 AS page FROM results),
    sent AS (SELECT year, CASE WHEN year % 3 = 1 THEN 2 ELSE 1 END AS read, (year % 3 = 0 AND ro % 7 = 0)::INT AS broken FROM doc)
    SELECT 'results' AS kind, year, sum(read)::BIGINT AS ingested, sum(broken)::BIGINT AS failed FROM sent GROUP BY year"""
)
def followed_report(spark, sf_dir):
    """Documents read and failed over all drops: a file is counted once."""
    return followed(League(spark, sf_dir)).report()


@check(
    with_ctes(LEAGUE) + """SELECT 'races' AS table_name, count(*) AS n_rows, 0::BIGINT AS missing FROM races
      UNION ALL SELECT 'qualifying', count(*), 0 FROM qualifying
      UNION ALL SELECT 'pit_stops', count(*), count(*) FILTER (position IS NULL) FROM results"""
)
def load_quality(spark, sf_dir):
    """Counts of a load as its own writes observe them, missing required values included."""
    league = League(spark, sf_dir)
    store = Store(spark, new_path(spark, "store"))
    store.ingest(calendar=written(league, "calendar", lambda p: documents.write_calendar(league, p)))
    store.save("qualifying", league.qualifying.withColumn("driver_id", F.col("driver_id").cast("string")))
    stops = league.results.select("race_id", F.col("driver_id").cast("string").alias("driver_id"), F.col("position").alias("stop_number"))
    store.save("pit_stops", stops)
    return store.load_quality()
