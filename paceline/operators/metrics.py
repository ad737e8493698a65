"""Evaluation metrics grouped by any key (race, season, fold)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.operators.ordering import running

EPS = 2.220446049250313e-16  # double precision step, the clip of the logarithm


def brier(label: str = "is_podium", prob: str = "prob") -> Column:
    return F.avg(F.pow(F.col(prob) - F.col(label), F.lit(2)))


def log_loss(label: str = "is_podium", prob: str = "prob") -> Column:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(prob)))
    return F.avg(-F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def position_error(actual: str = "finish_position", predicted: str = "predicted_place") -> Column:
    """Mean absolute error; rows without a finishing position are skipped by the average."""
    return F.avg(F.abs(F.col(actual) - F.col(predicted)))


def auc(scored: DataFrame, key: Sequence[str], label: str = "is_podium", prob: str = "prob", bound: int | None = None):
    """Rank-sum AUC with ties counted half, null where one class is missing.

    Rows are first counted per distinct score; each score then needs the negatives below it.
    """
    per_score = scored.groupBy(*key, prob).agg(
        F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg")
    )
    ranked = running(per_score, key, [F.asc(prob)], sums={"upto": F.col("neg")}, bound=bound)
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*key).agg(F.try_divide(wins, pairs).alias("auc"))


def threshold_report(label: str = "is_podium", prob: str = "prob", cut: float = 0.5) -> dict[str, Column]:
    """Accuracy, precision, recall and F1 of ``prob >= cut``; zero where undefined."""
    said, true = F.col(prob) >= cut, F.col(label) == 1
    hit = F.count_if(said & true)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return {
        "accuracy": F.avg((said == true).cast("int")),
        "precision": ratio(hit, F.count_if(said)),
        "recall": ratio(hit, F.count_if(true)),
        "f1": ratio(2 * hit, F.count_if(said) + F.count_if(true)),
    }


def class_balance(label: str = "is_podium") -> dict[str, Column]:
    """Class counts and the weight of a positive row."""
    pos = F.sum(label)
    neg = F.count(label) - pos
    return {"n_pos": pos, "n_neg": neg, "pos_weight": neg / F.greatest(pos, F.lit(1))}


def reliability_curve(
    scored: DataFrame, key: Sequence[str], bins: int = 10, label: str = "is_podium", prob: str = "prob"
) -> DataFrame:
    """Mean prediction against observed rate in uniform bins, right edges included; no empty bins."""
    below = F.lit(0)
    for i in range(1, bins):
        below = below + (F.col(prob) > i / bins).cast("int")
    binned = scored.withColumn("bin", below.cast("long"))
    return binned.groupBy(*key, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_predicted"), F.avg(label).alias("observed_rate")
    )


def season_summary(records: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts and shares of races with all, two or one podium place right, and mean errors."""
    hits = {"all_3_correct": 3, "at_least_2_correct": 2, "at_least_1_correct": 1}
    counts = [F.count_if(F.col("correct") >= n).alias(name) for name, n in hits.items()]
    shares = [
        (F.avg((F.col("correct") >= n).cast("int")) * 100).alias(name.replace("correct", "pct"))
        for name, n in hits.items()
    ]
    return records.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_races"),
        *counts,
        *shares,
        F.avg("position_mae").alias("avg_position_mae"),
        F.avg("brier").alias("avg_brier"),
        F.avg("log_loss").alias("avg_log_loss"),
        (F.avg((F.col("confidence_level") == "high").cast("int")) * 100).alias("high_confidence_pct"),
    )
