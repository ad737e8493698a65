"""Isotonic blocks against Spark ML, and the search on surfaces whose best place is known."""

import math
import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from paceline.operators import isotonic
from paceline.operators.features import league_matrix
from paceline.plans import search
from paceline.plans import training as tr
from paceline.sources.league import League


def rows_of(kind, n=3000):
    draw = random.Random(kind)
    if kind == "continuous":
        xs = [draw.random() for _ in range(n)]
        return [(x, float(draw.random() < x * x), draw.choice([1.0, 2.0, 0.5])) for x in xs]
    if kind == "ties":
        return [(draw.randrange(12) / 4, float(draw.random() < 0.5), 1.0) for _ in range(n)]
    if kind == "falling":
        return [(float(i), float(n - i), 1.0) for i in range(n)]
    if kind == "rising":
        return [(float(i), float(i // 3), 1.0) for i in range(n)]
    return [(0.5, 1.0, 1.0)]


@pytest.mark.parametrize("ranges", [1, 5, 40])
@pytest.mark.parametrize("kind", ["continuous", "ties", "falling", "rising", "single"])
def test_blocks_equal_the_plain_fit(spark, kind, ranges):
    df = spark.createDataFrame(rows_of(kind), "x double, y double, w double").repartition(7)
    blocks = isotonic.isotonic_blocks(df, "x", F.col("y"), F.col("w"), ranges)
    got = blocks.orderBy("low").collect()
    assert all(a.value < b.value and a.high < b.low for a, b in zip(got, got[1:]))
    plain = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(df)
    again = IsotonicRegression(featuresCol="score", labelCol="value", weightCol="weight").fit(isotonic.boundaries(blocks))
    asked = spark.createDataFrame([(-1 + 0.013 * i,) for i in range(250)], "x double").withColumn("score", F.col("x"))
    asked = asked.unionByName(df.select("x", F.col("x").alias("score")).limit(200))
    want = [r.prediction for r in plain.transform(asked).orderBy("x").collect()]
    assert [r.prediction for r in again.transform(asked).orderBy("x").collect()] == pytest.approx(want, abs=1e-9)


def test_blocks_without_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, 0.0)], "x double, y double, w double")
    assert isotonic.isotonic_blocks(df, "x", F.col("y"), F.col("w"), 4).collect() == []


def surface(params, fold=1):
    """Best at depth 5, a step of 0.05, rows 0.9, columns 0.6, four rows a leaf; many trees help a little."""
    return -(
        ((params.depth - 5) / 3) ** 2 + (math.log(params.step / 0.05) / 0.7) ** 2 + ((params.row_share - 0.9) / 0.1) ** 2
        + ((params.column_share - 0.6) / 0.1) ** 2 + ((params.min_rows - 4) / 3) ** 2
    ) + 0.01 * math.log(params.trees)


def test_sampler_beats_random_draws():
    learnt, drawn = [], []
    for seed in range(20):
        trials = search.study(tr.CLASSIFIER_RANGES, surface, 60, folds=1, width=4, rungs=1, seed=seed)
        learnt.append(max(t.score for t in trials))
        drawn.append(max(surface(p) for p in tr.draw_params(tr.CLASSIFIER_RANGES, 60, seed)))
    assert sum(a > b for a, b in zip(learnt, drawn)) >= 15
    assert sum(learnt) / 20 > 0.5 * sum(drawn) / 20


def test_settings_stay_in_their_ranges():
    for ranges in (tr.CLASSIFIER_RANGES, tr.REGRESSOR_RANGES):
        trials = search.study(ranges, surface, 40, folds=1, rungs=1, width=8, seed=3)
        for t in trials:
            for name, (low, high, _) in ranges.items():
                value = getattr(t.params, name)
                assert low <= value <= high and isinstance(value, type(low))
    again = search.study(tr.REGRESSOR_RANGES, surface, 40, folds=1, rungs=1, width=8, seed=3)
    assert [t.params for t in again] == [t.params for t in trials]


def test_halving_spends_little_on_weak_trials():
    spent = []

    def judge(params, fold):
        spent.append((params.trees, fold))
        return surface(params) + 0.001 * fold

    trials = [search.Trial(p) for p in tr.draw_params(tr.CLASSIFIER_RANGES, 8, 5)]
    best = max(trials, key=lambda t: surface(t.params))
    search.halving(trials, judge, folds=4, rungs=3, factor=2, parallel=3)
    assert [sum(t.rung == r for t in trials) for r in range(3)] == [4, 2, 2]
    assert [t.pruned for t in trials].count(False) == 2 and not best.pruned
    assert all(len(t.scores) == [1, 2, 4][t.rung] for t in trials)
    assert sum(trees for trees, _ in spent) < 0.6 * sum(4 * t.params.trees for t in trials)


def test_study_of_the_matrix(spark, small):
    matrix = league_matrix(League(spark, small)).filter("year < 1996")
    short = {"trees": (2, 4, False), "depth": (2, 3, False)}
    for head, ranges in (("classifier", tr.CLASSIFIER_RANGES), ("regressor", tr.REGRESSOR_RANGES)):
        found = search.optimise(matrix, head, 4, ranges | short, folds=2, width=4, rungs=2)
        rows = found.collect()
        assert len(rows) == 4 and sum(not r.pruned for r in rows) == 2 and rows[0].rung == 1
        assert all(len(r.fold_scores) == (2 if r.rung else 1) for r in rows)
        best = search.best_params(found)
        assert 2 <= best.trees <= 4 and best.depth <= 3


def test_fits_of_a_fold_share_medians_and_class_weight(spark, small, monkeypatch):
    matrix = league_matrix(League(spark, small)).filter("year < 1996 AND finish_position IS NOT NULL")
    calls, exact = [], tr.splits.exact_medians
    monkeypatch.setattr(tr.splits, "exact_medians", lambda *given: calls.append(given) or exact(*given))
    rows = tr.splits.time_folds(matrix, 2).persist()
    for head in ("classifier", "regressor"):
        judge, tried = search.matrix_judge(rows, head), [tr.Params(2, 2), tr.Params(2, 3)]
        calls.clear()
        shared = [judge(p, fold) for p in tried for fold in (1, 2)]
        assert len(calls) == 2
        alone = [search.matrix_judge(rows, head)(p, fold) for p in tried for fold in (1, 2)]
        assert len(calls) == 6 and shared == alone
    rows.unpersist()


def test_study_query_has_the_whole_search(spark, small, monkeypatch):
    """Fifty trials of each head in the full ranges, the survivors fitted with all their trees on all folds."""
    from checks import training

    asked = {"classifier": [], "regressor": []}

    def judged(rows, head):
        return lambda params, fold: asked[head].append((params, fold)) or surface(params)

    monkeypatch.setattr(search, "matrix_judge", judged)
    table = training.model_study(spark, small).collect()
    for head, ranges in (("classifier", tr.CLASSIFIER_RANGES), ("regressor", tr.REGRESSOR_RANGES)):
        mine = [r for r in table if r["head"] == head]
        assert len(mine) == 50 and {f for _, f in asked[head]} == {1, 2, 3}
        for name, (low, high, _) in ranges.items():
            values = [r[name] for r in mine]
            assert low <= min(values) and max(values) <= high
            assert max(values) - min(values) > (high - low) / 2
        best = [r for r in mine if not r.pruned]
        assert all(len(r.fold_scores) == 3 and {(p.trees, f) for p, f in asked[head]} >= {(r.trees, f) for f in (1, 2, 3)} for r in best)
