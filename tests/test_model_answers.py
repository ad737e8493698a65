"""What is served and reported from trained scores, against SQL over the same scores.

Fitted trees have no SQL form, but everything after them has: the scores are written as a table, and the registered
queries that start from scores run on it, next to their own SQL.
"""

import pytest
from pyspark.sql import functions as F

from checks import metrics, queries, serving, training
from checks.compare import compare, connect
from checks.features import MATRIX
from checks.registry import SQL
from paceline.functions.rules import tidy
from paceline.operators.features import league_matrix
from paceline.plans import backtest
from paceline.sources.league import League

SCORED = metrics.BASE[len(MATRIX) :]
COLUMNS = ["race_id", "ro", "year", "round", "driver_id", "constructor_id", "is_podium", "finish_position", "predicted_place", "prob"]
queries()
# ``baseline_scores`` is the fixed score itself
NAMES = sorted(n for n, sql in SQL.items() if SCORED in sql and n != "baseline_scores")


@pytest.fixture(scope="module")
def trained(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "scored")
    league = League(spark, small)
    scored = training.final_model(league).score(league_matrix(league))
    scored = scored.withColumns({c: tidy(F.col(c)) for c in ("predicted_place", "prob")})
    scored.select(*COLUMNS).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def duck(small, trained):
    con = connect(small)
    con.execute(f"CREATE VIEW model_scored AS SELECT * FROM read_parquet('{trained}/*.parquet')")
    return con


def test_scores_are_those_of_every_entrant(duck):
    """Every entrant once, with its label, a probability and a place."""
    sql = "WITH " + MATRIX + " SELECT race_id, driver_id, is_podium FROM matrix"
    want = duck.execute(sql + " ORDER BY ALL").fetchall()
    good = "prob BETWEEN 0 AND 1 AND predicted_place IS NOT NULL"
    assert duck.execute(f"SELECT race_id, driver_id, is_podium FROM model_scored WHERE {good} ORDER BY ALL").fetchall() == want
    assert duck.execute("SELECT count(DISTINCT prob) > 3 AND count(DISTINCT predicted_place) > 3 FROM model_scored").fetchone()[0]


@pytest.mark.parametrize("name", NAMES)
def test_answer(spark, small, duck, trained, monkeypatch, name):
    scored = spark.read.parquet(trained)
    for module in (metrics, serving):
        monkeypatch.setattr(module, "scored_of", lambda league: scored)
    records = lambda league: backtest.race_records(scored, bound=league.field_bound, groups=league.race_count)
    monkeypatch.setattr(metrics, "records_of", records)
    monkeypatch.setattr(League, "_staged", lambda league, key, build: build())
    sql = SQL[name].replace(SCORED, ",\nscored AS (SELECT * FROM model_scored)")
    ok, message = compare(spark, duck, small, name, queries()[name], sql)
    assert ok, message
