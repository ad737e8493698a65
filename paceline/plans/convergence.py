"""How the live probabilities approach the outcome over a race."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators.metrics import brier
from paceline.operators.ordering import top_rows


def final_podium(timing: DataFrame) -> DataFrame:
    """First three by laps completed, then by total time."""
    last = timing.groupBy("session", "driver_number").agg(
        F.max("lap_number").alias("laps"), F.max_by("total", "lap_number").alias("total")
    )
    return top_rows(last, ["session"], [F.desc("laps"), F.asc("total"), F.asc("driver_number")], 3, "position")


def _labelled(probs: DataFrame, outcome: DataFrame) -> DataFrame:
    won = outcome.select("session", "driver_number", F.lit(1).alias("_won"))
    return probs.join(won, ["session", "driver_number"], "left").withColumn("is_podium", F.coalesce("_won", F.lit(0)))


def checkpoint_briers(probs: DataFrame, outcome: DataFrame) -> DataFrame:
    """Brier score per session and checkpoint; the prior is the checkpoint of lap zero."""
    return _labelled(probs, outcome).groupBy("session", "checkpoint").agg(brier().alias("brier"))


def lap_briers(probs: DataFrame, outcome: DataFrame) -> DataFrame:
    """Brier score and cars per session and lap, from probabilities at every lap."""
    return _labelled(probs, outcome).groupBy("session", "lap").agg(brier().alias("brier"), F.count(F.lit(1)).alias("cars"))


def convergence_table(briers: DataFrame, names: list[str]) -> DataFrame:
    """One row per session with a column per checkpoint (null where the race was shorter)."""
    return briers.groupBy("session").pivot("checkpoint", names).agg(F.first("brier"))


def convergence_verdict(table: DataFrame, names: list[str]) -> DataFrame:
    """Season averages and the check: last below prior, third below second."""
    averages = table.groupBy(F.year("session").cast("long").alias("year")).agg(*[F.avg(n).alias(n) for n in names])
    prior, early, middle, last = (F.col(n) for n in names)
    return averages.withColumn("converges", ((last < prior) & (middle < early)).cast("long"))
