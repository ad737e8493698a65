"""Podium answers: ranking scores, the three places, margin and confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import constants as C
from paceline.functions import rules
from paceline.operators.ordering import sized, top_rows


def _gain(position: str | None) -> Column:
    """What entrants are ranked by: a low predicted position, or the probability itself."""
    return F.col("prob") if position is None else -F.coalesce(F.col(position), F.lit(C.RANK_DEFAULT_POSITION))


def _race_totals(probs: DataFrame, key: Sequence[str], position: str | None, groups: int | None) -> DataFrame:
    """Per race: the best gain and the total weight that scores are shares of."""
    gain = _gain(position)
    if position is None:
        return probs.groupBy(*key).agg(F.max(gain).alias("_top"), (F.sum(gain) + 1e-9).alias("_total"))
    best = sized(probs.groupBy(*key).agg(F.max(gain).alias("_top")), groups)
    weights = probs.join(best, list(key)).groupBy(*key, "_top")
    return weights.agg(F.sum(F.exp((gain - F.col("_top")) / C.RANK_TEMPERATURE)).alias("_total"))


def _score(position: str | None) -> Column:
    gain = _gain(position)
    weight = gain if position is None else F.exp((gain - F.col("_top")) / C.RANK_TEMPERATURE)
    return weight / F.col("_total")


def ranking_scores(
    probs: DataFrame, key: Sequence[str], position: str | None = None, groups: int | None = None
) -> DataFrame:
    """Adds ``score``: softmax of the negative predicted position, or the share of probability."""
    totals = sized(_race_totals(probs, key, position, groups), groups)
    return probs.join(totals, list(key)).withColumn("score", _score(position)).drop("_top", "_total")


def podium(
    probs: DataFrame,
    key: Sequence[str],
    position: str | None = None,
    threshold: float = C.CONFIDENCE_THRESHOLD,
    entity: str = "driver_id",
    groups: int | None = None,
) -> DataFrame:
    """The three places of every race with the original probability and the margin to fourth.

    Scores order entrants as their gain does, so four rows per race are taken first and only those
    meet the race totals. ``groups`` bounds the number of races.
    """
    first4 = top_rows(probs, key, [F.desc(_gain(position)), F.asc(entity)], 4, "predicted_position")
    totals = sized(_race_totals(probs, key, position, groups), groups)
    scored = first4.join(totals, list(key)).withColumn("score", _score(position))
    race = Window.partitionBy(*key)

    def score_of(place: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("predicted_position") == place, F.col("score"))).over(race), F.lit(0.0))

    margin = score_of(3) - score_of(4)
    return (
        scored.withColumn("confidence", margin)
        .filter("predicted_position <= 3")
        .select(
            *key,
            entity,
            F.col("predicted_position").cast("long").alias("predicted_position"),
            F.col("prob").alias("probability"),
            "confidence",
            rules.confidence_level(F.col("confidence"), threshold).alias("confidence_level"),
        )
    )


def actual_podium(results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Podium rows of races that have all three places."""
    placed = results.filter("position <= 3")
    complete = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select(*key)
    return placed.join(complete, list(key), "left_semi").select(*key, "driver_id", "position")


def ordered_ids(place: str, entity: str) -> Column:
    """At most three ids in order of place."""
    return F.transform(F.array_sort(F.collect_list(F.struct(place, entity))), lambda s: s[entity])


def baseline_scores(matrix: DataFrame) -> DataFrame:
    """A fixed arithmetic score that stands in for trained models where SQL has to check a job."""
    place = 0.6 * F.col("driver_last5_avg_pos") + 0.4 * F.col("grid_position")
    return matrix.select(
        "race_id", "ro", "year", "round", "driver_id", "constructor_id", "is_podium", "finish_position",
        F.round(place, 6).alias("predicted_place"),
        F.round(rules.logistic((4 - place) / 3), 6).alias("prob"),
    )
