"""Podium answers, exact place probabilities and evaluation reports over the baseline score."""

from pyspark.sql import functions as F

from checks.ctes import with_ctes
from checks.features import MATRIX
from checks.registry import check
from paceline.functions import rules
from paceline.functions.rules import tidy
from paceline.operators import distribution, metrics
from paceline.operators import podium as pod
from paceline.operators.features import league_matrix
from paceline.plans import backtest
from paceline.session import new_path
from paceline.sources.league import League

BASE = MATRIX + """,
scored AS (
  SELECT race_id, ro, year, round, driver_id, constructor_id, is_podium, finish_position,
         round(0.6 * driver_last5_avg_pos + 0.4 * grid_position, 6) AS predicted_place,
         round(1 / (1 + exp(-(4 - (0.6 * driver_last5_avg_pos + 0.4 * grid_position)) / 3)), 6) AS prob
  FROM matrix
)"""

PODIUM = """
weighted AS (
  SELECT *, exp((-predicted_place - max(-predicted_place) OVER (PARTITION BY ro)) / 3.0) AS weight FROM scored
),
ranked AS (
  SELECT *, weight / sum(weight) OVER (PARTITION BY ro) AS score,
         row_number() OVER (PARTITION BY ro ORDER BY weight DESC, driver_id) AS place FROM weighted
),
margins AS (
  SELECT ro, coalesce(max(score) FILTER (place = 3), 0) - coalesce(max(score) FILTER (place = 4), 0) AS confidence
  FROM ranked GROUP BY ro
),
podium AS (
  SELECT race_id, r.ro, year, round, driver_id, is_podium, place AS predicted_position, prob AS probability, confidence,
         CASE WHEN confidence >= 0.1 THEN 'high' WHEN confidence >= 0.05 THEN 'medium' ELSE 'low' END AS confidence_level
  FROM ranked r JOIN margins m ON m.ro = r.ro WHERE place <= 3
)"""

AUC = """
score_counts AS (
  SELECT ro, prob, sum(is_podium) AS pos, sum(1 - is_podium) AS neg FROM scored GROUP BY ro, prob
),
aucs AS (
  SELECT a.ro, sum(a.pos * (SELECT coalesce(sum(b.neg), 0) FROM score_counts b WHERE b.ro = a.ro AND b.prob < a.prob)
                   + a.pos * a.neg / 2.0) / nullif(sum(a.pos) * sum(a.neg), 0) AS auc
  FROM score_counts a GROUP BY a.ro
)"""

LOSS = """avg(-CASE WHEN is_podium = 1 THEN ln(greatest(prob, 2.220446049250313e-16))
          ELSE ln(1 - least(prob, 1 - 2.220446049250313e-16)) END)"""

RECORDS = PODIUM + "," + AUC + """,
answers AS (
  SELECT race_id, ro, year, round, string_agg(driver_id::VARCHAR, ', ' ORDER BY predicted_position) AS predicted,
         sum(is_podium)::BIGINT AS correct, any_value(confidence) AS margin, any_value(confidence_level) AS confidence_level
  FROM podium GROUP BY ALL
),
actuals AS (
  SELECT ro, coalesce(string_agg(driver_id::VARCHAR, ', ' ORDER BY finish_position) FILTER (is_podium = 1), '') AS actual,
         """ + LOSS + """ AS log_loss, avg((prob - is_podium) ** 2) AS brier,
         avg(abs(finish_position - predicted_place)) AS position_mae
  FROM scored GROUP BY ro
),
records AS (
  SELECT a.*, b.actual, b.log_loss, b.brier, b.position_mae, c.auc
  FROM answers a JOIN actuals b ON b.ro = a.ro JOIN aucs c ON c.ro = a.ro
)"""

B = with_ctes(BASE)
BP = with_ctes(BASE, PODIUM)
BR = with_ctes(BASE, RECORDS)


def scored_of(league):
    return league._staged("scored", lambda: pod.baseline_scores(league_matrix(league)))


def records_of(league):
    return league._staged("records", lambda: backtest.race_records(scored_of(league), bound=league.field_bound, groups=league.race_count))


def r6(*names):
    return [tidy(F.col(n)).alias(n) for n in names]


@check(B + "SELECT * FROM scored")
def baseline_scores(spark, sf_dir):
    return pod.baseline_scores(league_matrix(League(spark, sf_dir)))


@check(
    BP + """SELECT race_id, ro, driver_id, predicted_position, probability, round(confidence, 6) + 0.0 AS confidence,
            confidence_level FROM podium"""
)
def podium_by_position(spark, sf_dir):
    league = League(spark, sf_dir)
    return pod.podium(scored_of(league), ["race_id", "ro"], "predicted_place", groups=league.race_count).select(
        "race_id", "ro", "driver_id", "predicted_position", "probability", *r6("confidence"), "confidence_level"
    )


@check(
    B + """, shares AS (
      SELECT *, prob / (sum(prob) OVER (PARTITION BY ro) + 1e-9) AS score,
             row_number() OVER (PARTITION BY ro ORDER BY prob DESC, driver_id) AS place FROM scored)
    SELECT ro, driver_id, place AS predicted_position, prob AS probability,
           round(coalesce(max(CASE WHEN place = 3 THEN score END) OVER (PARTITION BY ro), 0)
                 - coalesce(max(CASE WHEN place = 4 THEN score END) OVER (PARTITION BY ro), 0), 6) + 0.0 AS confidence
    FROM shares QUALIFY place <= 3"""
)
def podium_by_probability(spark, sf_dir):
    league = League(spark, sf_dir)
    return pod.podium(scored_of(league), ["ro"], groups=league.race_count).select(
        "ro", "driver_id", "predicted_position", "probability", *r6("confidence")
    )


@check(
    BP + """SELECT ro, sum(is_podium)::BIGINT AS correct FROM podium GROUP BY ro"""
)
def podium_hits(spark, sf_dir):
    league = League(spark, sf_dir)
    answer = pod.podium(scored_of(league), ["ro"], "predicted_place", groups=league.race_count)
    return backtest.podium_hits(answer, scored_of(league))


@check(
    B + """, w AS (
      SELECT ro, driver_id, CASE WHEN count(*) FILTER (prob > 0) OVER g >= 3 THEN prob / sum(prob) OVER g
             ELSE 1.0 / count(*) OVER g END AS w FROM scored WINDOW g AS (PARTITION BY ro)),
    second AS (
      SELECT i.ro, i.driver_id, sum(j.w * i.w / (1 - j.w)) AS p2
      FROM w i JOIN w j ON j.ro = i.ro AND j.driver_id <> i.driver_id GROUP BY ALL),
    third AS (
      SELECT i.ro, i.driver_id, sum(j.w * k.w / (1 - j.w) * i.w / (1 - j.w - k.w)) AS p3
      FROM w i JOIN w j ON j.ro = i.ro AND j.driver_id <> i.driver_id
      JOIN w k ON k.ro = i.ro AND k.driver_id <> i.driver_id AND k.driver_id <> j.driver_id GROUP BY ALL)
    SELECT w.ro, w.driver_id, round(w, 4) AS p1, round(coalesce(p2, 0), 4) AS p2, round(coalesce(p3, 0), 4) AS p3,
           round(w + coalesce(p2, 0) + coalesce(p3, 0), 4) AS podium_prob
    FROM w LEFT JOIN second s ON s.ro = w.ro AND s.driver_id = w.driver_id
    LEFT JOIN third t ON t.ro = w.ro AND t.driver_id = w.driver_id"""
)
def place_probabilities(spark, sf_dir):
    league = League(spark, sf_dir)
    return distribution.place_probabilities(scored_of(league), ["ro"], groups=league.race_count).select(
        "ro", "driver_id", *[F.round(c, 4).alias(c) for c in ("p1", "p2", "p3", "podium_prob")]
    )


@check(
    B + """, w AS (
      SELECT ro, driver_id, CASE WHEN count(*) FILTER (prob > 0) OVER g >= 3 THEN prob / sum(prob) OVER g
             ELSE 1.0 / count(*) OVER g END AS w,
             row_number() OVER (PARTITION BY ro ORDER BY prob DESC, driver_id) AS place
      FROM scored WINDOW g AS (PARTITION BY ro)),
    trios AS (
      SELECT a.ro, a.driver_id AS member_1, b.driver_id AS member_2, c.driver_id AS member_3,
             a.place AS pa, b.place AS pb, c.place AS pc,
             a.w * b.w * c.w * (
               1 / ((1 - a.w) * (1 - a.w - b.w)) + 1 / ((1 - b.w) * (1 - a.w - b.w))
             + 1 / ((1 - a.w) * (1 - a.w - c.w)) + 1 / ((1 - c.w) * (1 - a.w - c.w))
             + 1 / ((1 - b.w) * (1 - b.w - c.w)) + 1 / ((1 - c.w) * (1 - b.w - c.w))) AS p
      FROM w a JOIN w b ON b.ro = a.ro AND b.place > a.place JOIN w c ON c.ro = a.ro AND c.place > b.place)
    SELECT ro, member_1, member_2, member_3, round(p, 6) AS combo_prob,
           row_number() OVER (PARTITION BY ro ORDER BY round(p, 12) DESC, pa, pb, pc) AS combo_rank
    FROM trios QUALIFY combo_rank <= 5"""
)
def top_podium_combinations(spark, sf_dir):
    league = League(spark, sf_dir)
    return distribution.top_combinations(scored_of(league), ["ro"], groups=league.race_count).select(
        "ro", "member_1", "member_2", "member_3", *r6("combo_prob"), "combo_rank"
    )


@check(
    BR + """SELECT race_id, ro, predicted, actual, correct, round(margin, 6) + 0.0 AS margin, confidence_level,
            round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(position_mae, 6) AS position_mae,
            round(auc, 6) AS auc FROM records"""
)
def race_evaluation(spark, sf_dir):
    return records_of(League(spark, sf_dir)).select(
        "race_id", "ro", F.array_join("predicted", ", ").alias("predicted"),
        F.array_join("actual", ", ").alias("actual"), "correct", *r6("margin"), "confidence_level",
        *r6("log_loss", "brier", "position_mae", "auc"),
    )


SUMMARY = ["avg_position_mae", "avg_brier", "avg_log_loss", "all_3_pct", "at_least_2_pct", "at_least_1_pct",
           "high_confidence_pct"]


@check(
    BR + """SELECT year, count(*) AS total_races, count(*) FILTER (correct = 3) AS all_3_correct,
      count(*) FILTER (correct >= 2) AS at_least_2_correct, count(*) FILTER (correct >= 1) AS at_least_1_correct,
      round(avg((correct = 3)::INT) * 100, 6) AS all_3_pct, round(avg((correct >= 2)::INT) * 100, 6) AS at_least_2_pct,
      round(avg((correct >= 1)::INT) * 100, 6) AS at_least_1_pct, round(avg(position_mae), 6) AS avg_position_mae,
      round(avg(brier), 6) AS avg_brier, round(avg(log_loss), 6) AS avg_log_loss,
      round(avg((confidence_level = 'high')::INT) * 100, 6) AS high_confidence_pct
    FROM records GROUP BY year"""
)
def season_summary(spark, sf_dir):
    out = metrics.season_summary(records_of(League(spark, sf_dir)), ["year"])
    return out.select(*[c for c in out.columns if c not in SUMMARY], *r6(*SUMMARY))


@check(
    B + """SELECT year, round(avg(((prob >= 0.5) = (is_podium = 1))::INT), 6) AS accuracy,
      round(coalesce(count(*) FILTER (prob >= 0.5 AND is_podium = 1) / nullif(count(*) FILTER (prob >= 0.5), 0), 0), 6)
        AS precision,
      round(coalesce(count(*) FILTER (prob >= 0.5 AND is_podium = 1) / nullif(sum(is_podium), 0), 0), 6) AS recall,
      round(coalesce(2 * count(*) FILTER (prob >= 0.5 AND is_podium = 1)
        / nullif(count(*) FILTER (prob >= 0.5) + sum(is_podium), 0), 0), 6) AS f1,
      sum(is_podium)::BIGINT AS n_pos, (count(*) - sum(is_podium))::BIGINT AS n_neg,
      round((count(*) - sum(is_podium)) / greatest(sum(is_podium), 1), 6) AS pos_weight
    FROM scored GROUP BY year"""
)
def classification_report(spark, sf_dir):
    reports = metrics.threshold_report() | metrics.class_balance()
    out = scored_of(League(spark, sf_dir)).groupBy("year").agg(*[c.alias(n) for n, c in reports.items()])
    return out.select("year", "n_pos", "n_neg", *r6("accuracy", "precision", "recall", "f1", "pos_weight"))


@check(
    B + """, binned AS (SELECT *, (CASE WHEN prob <= 0.1 THEN 0 WHEN prob <= 0.2 THEN 1 WHEN prob <= 0.3 THEN 2
        WHEN prob <= 0.4 THEN 3 WHEN prob <= 0.5 THEN 4 WHEN prob <= 0.6 THEN 5 WHEN prob <= 0.7 THEN 6
        WHEN prob <= 0.8 THEN 7 WHEN prob <= 0.9 THEN 8 ELSE 9 END)::BIGINT AS bin FROM scored)
    SELECT year, bin, count(*) AS n, round(avg(prob), 12) AS mean_predicted, round(avg(is_podium), 12) AS observed_rate
    FROM binned GROUP BY year, bin"""
)
def reliability_curve(spark, sf_dir):
    return metrics.reliability_curve(scored_of(League(spark, sf_dir)), ["year"]).select(
        "year", "bin", "n", *[F.round(c, 12).alias(c) for c in ("mean_predicted", "observed_rate")]
    )


@check(
    BR + """SELECT year, round, predicted, actual, round(correct / 3, 6) AS hit_rate,
      round(avg(correct / 3) OVER (PARTITION BY year ORDER BY round), 6) AS cumulative_hit_rate,
      CASE WHEN correct = 0 THEN '❌' ELSE repeat('✅', correct) END AS marks FROM records"""
)
def backtest_report(spark, sf_dir):
    out = backtest.backtest_rows(records_of(League(spark, sf_dir)))
    return out.select("year", "round", "predicted", "actual", "marks", *r6("hit_rate", "cumulative_hit_rate"))


@check(
    BR + """SELECT year, count(*) AS races, count(*) FILTER (correct = 3) AS perfect,
      count(*) FILTER (correct >= 1) AS at_least_one, round(avg(correct / 3), 6) AS mean_hit_rate,
      sum(correct)::BIGINT AS total_correct, (count(*) * 3)::BIGINT AS total_possible, round(avg(brier), 6) AS mean_brier
    FROM records GROUP BY year"""
)
def backtest_kpis(spark, sf_dir):
    out = backtest.backtest_kpis(records_of(League(spark, sf_dir)))
    return out.select(
        "year", "races", "perfect", "at_least_one", "total_correct", "total_possible", *r6("mean_hit_rate", "mean_brier")
    )


@check(
    B + """SELECT year, CASE WHEN prob > 0.5 THEN 'favourite' WHEN prob > 0.2 THEN 'contender' ELSE 'outsider' END AS band,
      count(*) AS n FROM scored GROUP BY ALL"""
)
def probability_bands(spark, sf_dir):
    scored = scored_of(League(spark, sf_dir))
    return scored.groupBy("year", rules.probability_band(F.col("prob")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def backtest_files(league):
    """Write the backtest documents of a league once and return their folder."""
    path = new_path(league.spark, "backtest")
    backtest.write_backtest(records_of(league), scored_of(league), path)
    return path


@check(
    BR + """SELECT r.race_id, r.year, r.round, r.predicted, r.actual, r.correct, round(r.brier, 6) AS brier_score
    FROM records r"""
)
def backtest_documents(spark, sf_dir):
    documents = backtest.read_backtest(spark, backtest_files(League(spark, sf_dir)) + "/races")
    return documents.select(
        "race_id", "year", "round", F.array_join("predicted", ", ").alias("predicted"),
        F.array_join("actual", ", ").alias("actual"), "correct", *r6("brier_score"),
    )


@check(B + "SELECT race_id, driver_id::VARCHAR AS driver_id, prob FROM scored")
def backtest_probabilities(spark, sf_dir):
    path = backtest_files(League(spark, sf_dir)) + "/probabilities"
    return backtest.probabilities_of(backtest.read_backtest(spark, path))
