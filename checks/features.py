"""Feature groups and the full matrix."""

from pyspark.sql import functions as F

from checks.ctes import LEAGUE, ROSTER, STANDINGS, LR, L, with_ctes
from checks.registry import check
from paceline.functions.constants import FEATURES
from paceline.functions.rules import tidy
from paceline.operators import features, history
from paceline.sources.league import League

FINISHED = "(coalesce({0}.status, '') = 'Finished' OR coalesce({0}.status, '') LIKE '+%')"

FORM = """
form AS (
  SELECT r.ro, r.driver_id,
         coalesce(avg(h.position) FILTER (h.rn <= 3), 15.0) AS driver_last3_avg_pos,
         coalesce(avg(h.is_podium), 0.0) AS driver_last5_podium_rate,
         coalesce(avg(h.position), 15.0) AS driver_last5_avg_pos,
         coalesce(avg(CASE WHEN h.driver_id IS NULL THEN NULL WHEN """ + FINISHED.format("h") + """ THEN 0 ELSE 1 END), 0.0)
           AS driver_recent_dnf_rate
  FROM roster r LEFT JOIN (
    SELECT a.ro AS at_ro, b.*, row_number() OVER (PARTITION BY a.ro, a.driver_id ORDER BY b.ro DESC) AS rn
    FROM roster a JOIN results b ON b.driver_id = a.driver_id AND b.ro < a.ro AND b.position IS NOT NULL
  ) h ON h.at_ro = r.ro AND h.driver_id = r.driver_id AND h.rn <= 5
  GROUP BY r.ro, r.driver_id
)"""

CIRCUIT_HISTORY = """
at_circuit AS (
  SELECT r.ro, r.driver_id, coalesce(avg(b.position), 10.0) AS driver_circuit_avg_pos,
         coalesce(min(b.position), 10) AS driver_circuit_best_pos
  FROM roster r
  LEFT JOIN (SELECT e.*, x.circuit_id FROM results e JOIN races x ON x.ro = e.ro) b
    ON b.driver_id = r.driver_id AND b.circuit_id = r.circuit_id AND b.ro < r.ro AND b.position IS NOT NULL
  GROUP BY r.ro, r.driver_id
)"""

TEAM = """
team_entries AS (
  SELECT e.constructor_id, e.ro, e.driver_id, x.year, x.circuit_id,
         CASE WHEN """ + FINISHED.format("e") + """ THEN 1 ELSE 0 END AS ok
  FROM results e JOIN races x ON x.ro = e.ro
),
team_spine AS (SELECT DISTINCT constructor_id, ro, year, circuit_id FROM roster),
team_past AS (
  SELECT s.constructor_id, s.ro, s.year, s.circuit_id, e.year AS e_year, e.circuit_id AS e_circuit, e.ok,
         row_number() OVER (PARTITION BY s.constructor_id, s.ro ORDER BY e.ro DESC, e.driver_id DESC) AS rn
  FROM team_spine s JOIN team_entries e ON e.constructor_id = s.constructor_id AND e.ro < s.ro
),
team_rates AS (
  SELECT s.constructor_id, s.ro, coalesce(avg(p.ok) FILTER (p.rn <= 20), 0.9) AS recent,
         CASE WHEN count(*) FILTER (p.e_year = s.year) >= 2 THEN avg(p.ok) FILTER (p.e_year = s.year) END AS season,
         avg(p.ok) FILTER (p.e_circuit = s.circuit_id) AS circuit
  FROM team_spine s LEFT JOIN team_past p ON p.constructor_id = s.constructor_id AND p.ro = s.ro
  GROUP BY s.constructor_id, s.ro
),
team AS (
  SELECT constructor_id, ro, recent AS constructor_reliability,
         coalesce(season, recent) AS constructor_season_reliability,
         coalesce(circuit, recent) AS constructor_circuit_reliability,
         0.5 * coalesce(season, recent) + 0.3 * recent + 0.2 * coalesce(circuit, recent) AS constructor_survival_prob
  FROM team_rates
)"""

QUALI = """
quali AS (
  SELECT r.ro, r.driver_id, coalesce(q.position, 20) AS grid_position,
         CASE WHEN p.pole > 0 THEN q.q3_sec - p.pole END AS quali_gap_to_pole,
         CASE WHEN q.q3_sec IS NULL THEN 0 ELSE 1 END::BIGINT AS quali_q3_reached,
         (SELECT CASE WHEN count(t) >= 2 THEN stddev_pop(t) END
          FROM (SELECT unnest([q.q1_sec, q.q2_sec, q.q3_sec]) AS t)) AS quali_consistency
  FROM roster r LEFT JOIN qualifying q ON q.ro = r.ro AND q.driver_id = r.driver_id
  LEFT JOIN (SELECT ro, min(q3_sec) AS pole FROM qualifying GROUP BY ro) p ON p.ro = r.ro
)"""

MATE = """
mate AS (
  SELECT r.ro, r.driver_id, coalesce(CASE WHEN m.best > 0 THEN m.own - m.best END, 0.0) AS teammate_quali_gap
  FROM roster r LEFT JOIN (
    SELECT q.ro, q.driver_id, coalesce(q.q3_sec, q.q2_sec, q.q1_sec) AS own,
           arg_min(coalesce(o.q3_sec, o.q2_sec, o.q1_sec), o.position) AS best
    FROM qualifying q JOIN qualifying o
      ON o.ro = q.ro AND o.constructor_id = q.constructor_id AND o.driver_id <> q.driver_id
    GROUP BY q.ro, q.driver_id, own
  ) m ON m.ro = r.ro AND m.driver_id = r.driver_id
)"""

CONTEXT = """
context AS (
  SELECT r.ro, r.driver_id,
         CASE c.type WHEN 'street' THEN 0 WHEN 'high_speed' THEN 2 ELSE 1 END::BIGINT AS circuit_type,
         coalesce(c.overtake_difficulty, 0.5) AS circuit_overtake_difficulty,
         CASE WHEN d.home_circuit_id = r.circuit_id THEN 1 ELSE 0 END::BIGINT AS home_race,
         r.round / max(r.round) OVER (PARTITION BY r.year) AS season_progress
  FROM roster r LEFT JOIN circuits c ON c.circuit_id = r.circuit_id LEFT JOIN drivers d ON d.driver_id = r.driver_id
)"""

CHAMPIONSHIP = """
championship AS (
  SELECT r.ro, r.driver_id, coalesce(s.position, 20) AS driver_championship_pos,
         coalesce(s.points, 0.0) AS driver_championship_pts,
         coalesce(s.constructor_pos, 10) AS constructor_championship_pos,
         coalesce(s.constructor_pts, 0.0) AS constructor_championship_pts
  FROM roster r LEFT JOIN standings s ON s.ro = r.ro AND s.driver_id = r.driver_id
)"""

MATRIX = ",".join(
    [LEAGUE, STANDINGS, ROSTER, FORM, CIRCUIT_HISTORY, TEAM, QUALI, MATE, CONTEXT, CHAMPIONSHIP]
) + """,
matrix AS (
  SELECT r.race_id, r.ro, r.year, r.round, r.driver_id, r.constructor_id, r.is_podium, r.finish_position, r.circuit_id,
         f.* EXCLUDE (ro, driver_id), h.* EXCLUDE (ro, driver_id), t.* EXCLUDE (ro, constructor_id),
         q.* EXCLUDE (ro, driver_id), m.* EXCLUDE (ro, driver_id), c.* EXCLUDE (ro, driver_id),
         s.* EXCLUDE (ro, driver_id)
  FROM roster r JOIN form f ON f.ro = r.ro AND f.driver_id = r.driver_id
  JOIN at_circuit h ON h.ro = r.ro AND h.driver_id = r.driver_id
  JOIN team t ON t.ro = r.ro AND t.constructor_id = r.constructor_id
  JOIN quali q ON q.ro = r.ro AND q.driver_id = r.driver_id
  JOIN mate m ON m.ro = r.ro AND m.driver_id = r.driver_id
  JOIN context c ON c.ro = r.ro AND c.driver_id = r.driver_id
  JOIN championship s ON s.ro = r.ro AND s.driver_id = r.driver_id
)"""

KEY = ["ro", "driver_id"]
WHOLE = {"grid_position", "quali_q3_reached", "driver_circuit_best_pos", "driver_championship_pos",
         "constructor_championship_pos", "circuit_type", "home_race"}


def rounded(columns, keys=KEY):
    return [*keys, *[F.col(c) if c in WHOLE else tidy(F.col(c)).alias(c) for c in columns]]


def sql_rounded(columns, keys=KEY):
    return ", ".join([*keys, *[c if c in WHOLE else f"round({c}, 6) + 0.0 AS {c}" for c in columns]])


FORM_COLUMNS = ["driver_last3_avg_pos", "driver_last5_podium_rate", "driver_last5_avg_pos", "driver_recent_dnf_rate"]
CIRCUIT_COLUMNS = ["driver_circuit_avg_pos", "driver_circuit_best_pos"]
TEAM_COLUMNS = ["constructor_reliability", "constructor_season_reliability", "constructor_circuit_reliability",
                "constructor_survival_prob"]
CONTEXT_COLUMNS = ["circuit_type", "circuit_overtake_difficulty", "home_race", "season_progress"]


def roster_of(league):
    context = features.race_context(league.races, league.circuits)
    return history.full_roster(league.results, league.qualifying).join(context, "ro")


@check(LR + "SELECT race_id, ro, driver_id, constructor_id, is_podium, finish_position, status FROM roster")
def full_roster(spark, sf_dir):
    league = League(spark, sf_dir)
    return history.full_roster(league.results, league.qualifying)


@check(LR + "," + FORM + f" SELECT {sql_rounded(FORM_COLUMNS)} FROM form")
def recent_form(spark, sf_dir):
    return history.recent_form(roster_of(League(spark, sf_dir))).select(*rounded(FORM_COLUMNS))


@check(LR + "," + CIRCUIT_HISTORY + f" SELECT {sql_rounded(CIRCUIT_COLUMNS)} FROM at_circuit")
def driver_circuit_history(spark, sf_dir):
    return history.circuit_history(roster_of(League(spark, sf_dir))).select(*rounded(CIRCUIT_COLUMNS))


@check(LR + "," + TEAM + f" SELECT {sql_rounded(TEAM_COLUMNS, ['constructor_id', 'ro'])} FROM team")
def team_reliability(spark, sf_dir):
    league = League(spark, sf_dir)
    return history.team_history(league.results, roster_of(league)).select(
        *rounded(TEAM_COLUMNS, ["constructor_id", "ro"])
    )


@check(
    L
    + """SELECT constructor_id, round(avg(ok), 6) AS reliability, round(1 - avg(ok), 6) + 0.0 AS dnf_rate
    FROM (SELECT constructor_id, CASE WHEN status = 'Finished' OR status LIKE '+%' THEN 1 ELSE 0 END AS ok,
          row_number() OVER (PARTITION BY constructor_id ORDER BY ro DESC, driver_id DESC) AS rn FROM results)
    WHERE rn <= 20 GROUP BY constructor_id"""
)
def latest_team_reliability(spark, sf_dir):
    return history.latest_team_reliability(League(spark, sf_dir).results).select(
        "constructor_id", tidy(F.col("reliability")).alias("reliability"), tidy(F.col("dnf_rate")).alias("dnf_rate")
    )


@check(LR + "," + QUALI + f" SELECT {sql_rounded(features.QUALI_COLUMNS)} FROM quali")
def qualifying_features(spark, sf_dir):
    league = League(spark, sf_dir)
    return features.qualifying_features(
        history.full_roster(league.results, league.qualifying), league.qualifying, league.race_count
    ).select(*rounded(features.QUALI_COLUMNS))


@check(
    LR + "," + MATE + " SELECT m.ro, m.driver_id, round(m.teammate_quali_gap, 6) + 0.0 AS teammate_quali_gap "
    "FROM mate m JOIN qualifying q ON q.ro = m.ro AND q.driver_id = m.driver_id"
)
def teammate_gap(spark, sf_dir):
    league = League(spark, sf_dir)
    return features.teammate_gaps(league.qualifying, league.race_count * league.team_count).select(*rounded(["teammate_quali_gap"]))


@check(
    with_ctes(LEAGUE, STANDINGS, ROSTER, CHAMPIONSHIP)
    + f" SELECT {sql_rounded(features.STANDING_COLUMNS)} FROM championship"
)
def championship_features(spark, sf_dir):
    league = League(spark, sf_dir)
    return features.standings_features(
        history.full_roster(league.results, league.qualifying), league.standings
    ).select(*rounded(features.STANDING_COLUMNS))


@check(LR + "," + CONTEXT + f" SELECT {sql_rounded(CONTEXT_COLUMNS)} FROM context")
def race_context_features(spark, sf_dir):
    league = League(spark, sf_dir)
    return features.home_flags(roster_of(league), league.drivers, league.homes).select(*rounded(CONTEXT_COLUMNS))


MATRIX_KEYS = [*features.META, "circuit_id"]


@check("WITH " + MATRIX + f" SELECT {sql_rounded(FEATURES, MATRIX_KEYS)} FROM matrix")
def feature_matrix(spark, sf_dir):
    return features.league_matrix(League(spark, sf_dir)).select(*rounded(FEATURES, MATRIX_KEYS))
