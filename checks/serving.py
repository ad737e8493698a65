"""Listings, race documents, splits and imputation."""

from pyspark.sql import functions as F

from checks.ctes import LS, L, with_ctes
from checks.features import MATRIX
from checks.landing import FORECAST, forecasts_of
from checks.metrics import BASE, PODIUM, B, backtest_files, scored_of
from checks.registry import check
from paceline.functions import rules
from paceline.functions.rules import tidy
from paceline.operators.features import league_matrix, training_columns
from paceline.operators.podium import actual_podium
from paceline.plans import backtest, serving, splits
from paceline.sources.league import League


def text_date(df):
    return df.withColumn("race_date", F.col("race_date").cast("string"))


@check(L + "SELECT race_id, ro, year, round, circuit_id, circuit_name, country, race_date::VARCHAR AS race_date FROM races")
def season_calendar(spark, sf_dir):
    return text_date(serving.calendar(League(spark, sf_dir).races).drop("total_laps"))


@check(L + "SELECT race_id, round, circuit_name, race_date::VARCHAR AS race_date FROM races WHERE year = 1998")
def one_season_calendar(spark, sf_dir):
    return text_date(serving.calendar(League(spark, sf_dir).races, 1998).select("race_id", "round", "circuit_name", "race_date"))


@check(L + "SELECT DISTINCT circuit_id, circuit_name, country FROM races")
def venues(spark, sf_dir):
    return serving.venues(League(spark, sf_dir).races)


@check(
    L + """SELECT r.race_id, r.ro, r.year, r.round, x.circuit_name, r.position, coalesce(r.position::VARCHAR, 'R') AS position_text,
      d.full_name AS driver, d.code, r.points, r.status
    FROM results r JOIN races x ON x.ro = r.ro JOIN drivers d ON d.driver_id = r.driver_id"""
)
def race_listing(spark, sf_dir):
    league = League(spark, sf_dir)
    return serving.race_listing(league.results, league.races, league.drivers, league.race_count)


@check(
    L + """SELECT r.year, r.driver_id, sum(r.points) AS points, d.full_name, d.code
    FROM results r JOIN drivers d ON d.driver_id = r.driver_id GROUP BY ALL"""
)
def driver_championship(spark, sf_dir):
    league = League(spark, sf_dir)
    return serving.season_points(league.results, league.drivers, "driver_id", ["full_name", "code"])


@check(
    L + """SELECT r.year, r.constructor_id, sum(r.points) AS points, c.name
    FROM results r JOIN constructors c ON c.constructor_id = r.constructor_id GROUP BY ALL"""
)
def constructor_championship(spark, sf_dir):
    league = League(spark, sf_dir)
    return serving.season_points(league.results, league.constructors, "constructor_id", ["name"])


@check(
    LS + """SELECT s.*, d.full_name, d.code FROM standings s JOIN drivers d ON d.driver_id = s.driver_id
    WHERE s.ro = (SELECT max(ro) FROM standings z WHERE z.year = s.year)"""
)
def latest_standings(spark, sf_dir):
    league = League(spark, sf_dir)
    return serving.latest_standings(league.standings, league.drivers, n_races=league.race_count)


@check(
    L + """SELECT r.race_id, r.ro, r.driver_id, r.grid, r.position, d.full_name AS driver
    FROM results r JOIN drivers d ON d.driver_id = r.driver_id WHERE position IS NOT NULL"""
)
def starting_grid(spark, sf_dir):
    league = League(spark, sf_dir)
    return serving.starting_grid(league.results, league.drivers)


ACTUAL = """
actual AS (SELECT race_id, ro, driver_id, position FROM results
           WHERE position <= 3 AND ro IN (SELECT ro FROM results WHERE position <= 3 GROUP BY ro HAVING count(*) >= 3))"""


@check(L + "," + ACTUAL + " SELECT race_id, driver_id, position FROM actual")
def completed_podiums(spark, sf_dir):
    return actual_podium(League(spark, sf_dir).results, ["race_id"])


PREDICTIONS = PODIUM + """,
predictions AS (
  SELECT race_id, driver_id::VARCHAR AS driver_id, predicted_position,
         CASE WHEN year <= 1997 THEN probability ELSE round(probability, 4) END AS probability,
         CASE WHEN year <= 1997 THEN 1.0 ELSE round(confidence, 4) END::DOUBLE AS confidence,
         CASE WHEN year <= 1997 THEN 'backtest' ELSE 'model' END AS source
  FROM podium
)"""
BQ = with_ctes(BASE, PREDICTIONS)


def served_predictions(league):
    """Stored backtests up to 1997, model scores for the other races."""
    path = backtest_files(league)
    stored = backtest.read_backtest(league.spark, path + "/races").filter("year <= 1997")
    probabilities = backtest.probabilities_of(backtest.read_backtest(league.spark, path + "/probabilities"))
    fresh = serving.model_predictions(scored_of(league), "predicted_place", league.race_count)
    return serving.prefer(serving.backtest_predictions(stored, probabilities), fresh, "race_id")


@check(BQ + " SELECT * FROM predictions")
def race_center_predictions(spark, sf_dir):
    return served_predictions(League(spark, sf_dir))


VERDICTS = PREDICTIONS + "," + ACTUAL


@check(
    with_ctes(BASE, VERDICTS) + """SELECT a.race_id, a.position, a.driver_id::VARCHAR AS driver_id,
      CASE WHEN p.predicted_position = a.position THEN 'exact' WHEN p.driver_id IS NOT NULL THEN 'podium' ELSE 'miss' END AS verdict
    FROM actual a LEFT JOIN predictions p ON p.race_id = a.race_id AND p.driver_id = a.driver_id::VARCHAR"""
)
def race_center_podium(spark, sf_dir):
    league = League(spark, sf_dir)
    return serving.podium_check(served_predictions(league), league.results)


@check(
    with_ctes(BASE, VERDICTS) + """,
    p AS (SELECT race_id, string_agg(driver_id, ', ' ORDER BY predicted_position) AS predicted, any_value(source) AS source,
          count(*) AS n FROM predictions GROUP BY race_id),
    a AS (SELECT race_id, string_agg(driver_id::VARCHAR, ', ' ORDER BY position) AS actual FROM actual GROUP BY race_id),
    h AS (SELECT race_id, count(*) AS hits FROM actual JOIN predictions USING (race_id)
          WHERE actual.driver_id::VARCHAR = predictions.driver_id GROUP BY race_id)
    SELECT x.race_id, x.circuit_name, x.country, p.predicted, p.source, a.actual, (a.actual IS NOT NULL)::INT::BIGINT AS is_completed,
      CASE WHEN a.actual IS NOT NULL AND p.n = 3 THEN coalesce(h.hits, 0) END AS correct_podiums
    FROM races x LEFT JOIN p ON p.race_id = x.race_id LEFT JOIN a ON a.race_id = x.race_id LEFT JOIN h ON h.race_id = x.race_id"""
)
def race_center(spark, sf_dir):
    league = League(spark, sf_dir)
    out = serving.race_center(league.races, served_predictions(league), league.results)
    return out.withColumns({c: F.array_join(c, ", ") for c in ("predicted", "actual")})


PLACES = """
w AS (
  SELECT race_id, ro, driver_id, constructor_id, predicted_place,
         CASE WHEN count(*) FILTER (prob > 0) OVER g >= 3 THEN prob / sum(prob) OVER g ELSE 1.0 / count(*) OVER g END AS w
  FROM scored WINDOW g AS (PARTITION BY ro)
),
pairs AS (
  SELECT i.ro, i.driver_id, sum(j.w * i.w / (1 - j.w)) AS p2,
         sum(i.w * j.w * (1 / (1 - i.w) + 1 / (1 - j.w)) / (1 - i.w - j.w)) AS r
  FROM w i JOIN w j ON j.ro = i.ro AND j.driver_id <> i.driver_id
  WHERE i.ro IN (SELECT ro FROM w GROUP BY ro HAVING count(*) >= 3) GROUP BY ALL
),
places AS (
  SELECT w.*, coalesce(p2, 0) AS p2, coalesce(w * (sum(r) OVER (PARTITION BY w.ro) / 2 - r), 0) AS p3
  FROM w LEFT JOIN pairs p ON p.ro = w.ro AND p.driver_id = w.driver_id
),
rates AS (
  SELECT constructor_id, avg(ok) AS rate FROM (
    SELECT constructor_id, CASE WHEN status = 'Finished' OR status LIKE '+%' THEN 1 ELSE 0 END AS ok,
           row_number() OVER (PARTITION BY constructor_id ORDER BY ro DESC, driver_id DESC) AS rn FROM results)
  WHERE rn <= 20 GROUP BY constructor_id
)"""


@check(
    B + "," + PLACES + """
    SELECT race_id, row_number() OVER (PARTITION BY p.ro ORDER BY predicted_place, driver_id) AS position, driver_id,
      p.constructor_id, round(w + p2 + p3, 4) AS podium_prob, round(w, 4) AS p1, round(p2, 4) AS p2, round(p3, 4) AS p3,
      round(82 + 0.3 * (predicted_place - 1), 3) AS expected_lap_sec, round(1 - r.rate, 3) + 0.0 AS dnf_risk,
      CASE WHEN r.rate >= 0.95 THEN 'Low' WHEN r.rate >= 0.85 THEN 'Moderate' ELSE 'Elevated' END || ' — '
        || CASE c.name WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE c.name[1] || lower(c.name[2:]) END
        || ' reliability ' || round(r.rate * 100)::INT::VARCHAR || '%' AS dnf_note
    FROM places p JOIN rates r ON r.constructor_id = p.constructor_id JOIN constructors c ON c.constructor_id = p.constructor_id"""
)
def race_card(spark, sf_dir):
    league = League(spark, sf_dir)
    return serving.race_card(
        scored_of(league), league.results, league.constructors, league.field_bound, league.race_count, league.team_count
    )


@check(
    with_ctes(BASE, FORECAST) + """,
    w AS (
      SELECT race_id, ro, driver_id, CASE WHEN count(*) FILTER (prob > 0) OVER g >= 3 THEN prob / sum(prob) OVER g
             ELSE 1.0 / count(*) OVER g END AS w,
             row_number() OVER (PARTITION BY ro ORDER BY prob DESC, driver_id) AS place
      FROM scored WINDOW g AS (PARTITION BY ro)),
    best AS (
      SELECT race_id, string_agg(driver_id::VARCHAR, ', ' ORDER BY place) AS podium, max(w) FILTER (place = 1) AS a,
             max(w) FILTER (place = 2) AS b, max(w) FILTER (place = 3) AS c
      FROM w WHERE place <= 3 GROUP BY race_id HAVING count(*) = 3)
    SELECT r.race_id, r.circuit_id, r.circuit_name, r.country, coalesce(k.type, 'technical') AS circuit_type,
      coalesce(k.overtake_difficulty, 0.5) AS overtake_difficulty, 58::BIGINT AS laps, 5.278::DOUBLE AS lap_distance_km,
      f.* EXCLUDE (race_id, circuit_id), podium, round(p, 6) AS combo_prob,
      CASE WHEN p IS NULL THEN NULL WHEN p > 0.05 THEN 'high' ELSE 'medium' END AS confidence_level
    FROM races r LEFT JOIN circuits k ON k.circuit_id = r.circuit_id JOIN forecast f ON f.race_id = r.race_id
    LEFT JOIN (SELECT *, a * b * c * (1 / ((1 - a) * (1 - a - b)) + 1 / ((1 - b) * (1 - a - b)) + 1 / ((1 - a) * (1 - a - c))
      + 1 / ((1 - c) * (1 - a - c)) + 1 / ((1 - b) * (1 - b - c)) + 1 / ((1 - c) * (1 - b - c))) AS p FROM best) b
      ON b.race_id = r.race_id"""
)
def race_card_head(spark, sf_dir):
    league = League(spark, sf_dir)
    out = serving.race_card_head(
        scored_of(league), league.races, forecasts_of(league), league.circuits, serving.race_lengths(spark),
        league.race_count,
    )
    return out.withColumns({"podium": F.array_join("podium", ", "), "combo_prob": tidy(F.col("combo_prob"))})


@check(
    with_ctes(BASE, PODIUM) + """SELECT p.race_id, r.circuit_name, r.country, r.race_date::VARCHAR AS race_date, predicted_position,
      driver_id, round(probability, 4) AS probability, round(confidence, 4) + 0.0 AS confidence, confidence_level,
      'pre_race' AS prediction_type FROM podium p JOIN races r ON r.ro = p.ro"""
)
def pre_race_answer(spark, sf_dir):
    league = League(spark, sf_dir)
    return text_date(serving.pre_race_answer(scored_of(league), league.races, "predicted_place", league.race_count))


@check(
    with_ctes(BASE, PODIUM) + """SELECT race_id, driver_id, round(prob, 4) AS podium_probability, round(score, 6) AS score,
      row_number() OVER (PARTITION BY ro ORDER BY prob DESC, driver_id) AS grid_order FROM ranked"""
)
def full_grid(spark, sf_dir):
    league = League(spark, sf_dir)
    return serving.full_grid(scored_of(league), "predicted_place", league.field_bound, league.race_count)


@check(
    B + """SELECT race_id, driver_id, place, prob, printf('%.1f%%', prob * 100) AS label
    FROM (SELECT *, row_number() OVER (PARTITION BY ro ORDER BY prob DESC, driver_id) AS place FROM scored) WHERE place <= 10"""
)
def probability_leaders(spark, sf_dir):
    scored = scored_of(League(spark, sf_dir)).select("race_id", "driver_id", "prob")
    return serving.leaders(scored, ["race_id"])


@check(
    L + """SELECT race_id, driver_id, CASE WHEN q3_sec IS NULL THEN NULL ELSE
      printf('%d:%02d.%03d', round(q3_sec * 1000)::BIGINT // 60000, round(q3_sec * 1000)::BIGINT % 60000 // 1000,
             round(q3_sec * 1000)::BIGINT % 1000) END AS lap FROM qualifying"""
)
def lap_labels(spark, sf_dir):
    rows = League(spark, sf_dir).qualifying
    return rows.select("race_id", "driver_id", rules.lap_text(F.col("q3_sec")).alias("lap"))


@check(
    "WITH " + MATRIX + """, folds AS (SELECT unnest([1998, 1999, 2000])::BIGINT AS fold)
    SELECT fold, CASE WHEN year < fold - 1 THEN 'train' WHEN year = fold - 1 THEN 'calibrate' ELSE 'validate' END AS role,
      count(*) AS n, sum(is_podium)::BIGINT AS podiums FROM matrix JOIN folds ON year <= fold GROUP BY ALL"""
)
def year_folds(spark, sf_dir):
    rows = splits.year_folds(league_matrix(League(spark, sf_dir)), [1998, 1999, 2000])
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("is_podium").alias("podiums"))


@check(
    "WITH " + MATRIX + """, numbered AS (SELECT ro, driver_id, row_number() OVER (ORDER BY ro, driver_id) - 1 AS i,
      count(*) OVER () AS n FROM matrix)
    SELECT ro, driver_id, CASE WHEN i < n - 3 * (n // 4) THEN 0 ELSE (i - (n - 3 * (n // 4))) // (n // 4) + 1 END AS test_fold
    FROM numbered"""
)
def time_folds(spark, sf_dir):
    return splits.time_folds(league_matrix(League(spark, sf_dir)).select("ro", "driver_id")).drop("row")


NULLABLE = ["quali_gap_to_pole", "quali_consistency"]


@check(
    "WITH " + MATRIX + """, med AS (SELECT median(quali_gap_to_pole) AS g, median(quali_consistency) AS c
      FROM matrix WHERE year < 2000)
    SELECT ro, driver_id, round(coalesce(quali_gap_to_pole, g), 6) + 0.0 AS quali_gap_to_pole,
      round(coalesce(quali_consistency, c), 6) + 0.0 AS quali_consistency FROM matrix, med"""
)
def median_imputation(spark, sf_dir):
    matrix = league_matrix(League(spark, sf_dir))
    medians = splits.exact_medians(matrix.filter("year < 2000"), NULLABLE)
    filled = splits.imputed(matrix.select("ro", "driver_id", *NULLABLE), medians, NULLABLE)
    return filled.select("ro", "driver_id", *[tidy(F.col(c)).alias(c) for c in NULLABLE])


@check(
    "WITH " + MATRIX + """SELECT year, count(*) AS n, count(finish_position) AS labelled, sum(is_podium)::BIGINT AS podiums,
      23::BIGINT AS n_features FROM matrix GROUP BY year"""
)
def feature_target_split(spark, sf_dir):
    matrix = league_matrix(League(spark, sf_dir))
    names, rest = training_columns(matrix)
    targets = matrix.select(*rest).groupBy("year")
    return targets.agg(
        F.count(F.lit(1)).alias("n"), F.count("finish_position").alias("labelled"), F.sum("is_podium").alias("podiums"),
        F.lit(len(names)).cast("long").alias("n_features"),
    )


@check(
    L + """SELECT driver_id, race_id, ro, year, round, position, grid, is_podium, status, recent FROM (
      SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY ro DESC) AS recent FROM results WHERE ro < 199707)
    WHERE recent <= 5"""
)
def driver_recent_results(spark, sf_dir):
    return serving.driver_recent_results(League(spark, sf_dir).results, 5, 199707)


@check(
    L + """SELECT driver_id, circuit_id, r.race_id, r.year, r.position, r.grid, r.is_podium,
      row_number() OVER (PARTITION BY driver_id, circuit_id ORDER BY r.ro) AS visit
    FROM results r JOIN races a ON a.race_id = r.race_id"""
)
def driver_circuit_results(spark, sf_dir):
    league = League(spark, sf_dir)
    return serving.driver_circuit_results(league.results, league.races, league.race_count)
