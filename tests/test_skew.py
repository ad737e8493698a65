"""Hot keys and no-shortcut plans: a third of the rows on one key, groups split by range, no broadcasts."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import checks
from checks.compare import compare, connect
from paceline.operators import ordering

NAMES = [
    "league_results", "league_qualifying", "league_standings", "feature_matrix", "team_reliability", "podium_by_position",
    "place_probabilities", "race_evaluation", "race_card", "time_folds", "median_imputation", "timing_laps",
    "live_features", "bayesian_update", "scenario_effects", "landed_pit_stops", "merge_by_key", "stream_lap_stats",
    "stream_posterior",
]


@pytest.fixture(scope="module")
def skewed(spark, small, tmp_path_factory):
    """Copy of the smallest tables with a third of lines and events moved to one key."""
    root = tmp_path_factory.mktemp("skewed")
    for file in Path(small).glob("*.parquet"):
        if file.stem not in ("lineitem", "events"):
            shutil.copyfile(file, root / file.name)
    moved = {"lineitem": ("l_suppkey", "l_orderkey"), "events": ("user_id", "event_id")}
    for name, (hot, key) in moved.items():
        df = spark.read.parquet(f"{small}/{name}.parquet")
        value = F.when(F.col(key) % 3 == 0, 1).otherwise(F.col(hot)).cast("long")
        df.withColumn(hot, value).toPandas().to_parquet(root / f"{name}.parquet", index=False, coerce_timestamps="us")
    return str(root)


@pytest.mark.parametrize("name", NAMES)
def test_hot_key_with_split_groups(spark, skewed, name, monkeypatch):
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 0)
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ok, message = compare(spark, connect(skewed), skewed, name, checks.queries()[name], checks.oracle_sql().get(name))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ok, message
