"""Registered queries by area; each module pairs a Spark query with its SQL."""

from checks import registry

# Queries timed by the benchmark, in this order: the first ones also stage the tables they need
HEADLINE = [
    "league_results",
    "league_standings",
    "recent_form",
    "team_reliability",
    "qualifying_features",
    "feature_matrix",
    "podium_by_position",
    "place_probabilities",
    "top_podium_combinations",
    "race_evaluation",
    "season_summary",
    "reliability_curve",
    "race_listing",
    "driver_championship",
    "race_center",
    "race_card",
    "time_folds",
    "median_imputation",
    "timing_laps",
    "live_features",
    "live_every_lap",
    "bayesian_update",
    "live_podium",
    "scenario_effects",
    "projection_to_flag",
    "lap_convergence",
    "landed_results",
    "stored_matrix",
    "merge_by_key",
    "upsert_partition",
    "duplicate_keys",
    "stream_latest_state",
    "stream_lap_stats",
    "stream_lap_state",
    "stream_posterior",
    "stream_landed_podium",
    "stream_speed_by_day",
    "model_temporal_cv",
]


def _load():
    from checks import features, landing, league, live, metrics, serving, store, streaming, training  # noqa: F401


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.SQL)
