import random

import pytest
from pyspark.sql import functions as F

from paceline.operators import metrics
from paceline.operators.features import league_matrix
from paceline.plans import backtest, serving, splits
from paceline.plans import training as tr
from paceline.sources.league import League

TINY = tr.Params(trees=3, depth=3)


@pytest.fixture(scope="module")
def matrix(spark, small):
    return league_matrix(League(spark, small))


def test_expanding_folds(spark):
    df = spark.range(10).select(F.col("id").alias("ro"), F.lit(1).alias("driver_id"))
    folds = {r.ro: r.test_fold for r in splits.time_folds(df).collect()}
    assert folds == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2, 7: 2, 8: 3, 9: 3}


def test_exact_medians(spark):
    pick = random.Random(3)
    rows = [(float(pick.randint(0, 30)), None if pick.random() < 0.3 else pick.random()) for _ in range(501)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {r.feature: r.median for r in splits.exact_medians(df, ["a", "b"]).collect()}
    want = df.agg(F.median("a").alias("a"), F.median("b").alias("b")).first()
    assert got == pytest.approx(want.asDict())


def test_medians_where_the_sketch_is_wrong(spark, monkeypatch):
    """Bounds of the sketch save work only: medians outside them are found as well, and absent columns stay absent."""
    df = spark.createDataFrame([(float(i % 7), None) for i in range(100)] + [(None, None)], "a double, b double")
    want = [("a", 3.0)]
    assert [tuple(r) for r in splits.exact_medians(df, ["a", "b"]).collect()] == want
    for ends in ([5.0, 6.0], [-2.0, -1.0], [3.0, 3.0]):
        monkeypatch.setattr(splits, "middle_bounds", lambda rows, columns, ends=ends: {"a": ends, "b": None})
        assert [tuple(r) for r in splits.exact_medians(df, ["a", "b"]).collect()] == want
    grouped = splits.exact_medians(df.withColumn("g", F.lit(1)), ["a"], ["g"])
    assert [r.median for r in grouped.collect()] == [3.0]


def test_medians_count_values_near_the_middle_only(spark):
    """Of 20,000 different values the counts that are shuffled hold a few hundred."""
    df = spark.range(20_000).select(F.col("id").cast("double").alias("a"))
    bounds = splits.middle_bounds(df, ["a"])
    long = df.select(F.lit("a").alias("feature"), F.col("a").alias("value"))
    assert splits._counts(splits._near(long, bounds), ["feature"]).count() < 400
    assert splits.exact_medians(df, ["a"]).first().median == 9999.5


def test_folds_of_many_rows_are_dealt_to_tasks(spark, monkeypatch):
    pick = random.Random(5)
    rows = [(pick.choice([None, *range(12)]), i) for i in pick.sample(range(1000), 1000)]
    df = spark.createDataFrame(rows, "ro long, driver_id long")
    want = sorted(map(str, splits.time_folds(df).collect()))
    monkeypatch.setattr(splits, "TASK_ROWS", 250)
    monkeypatch.setattr(splits, "parts_of", lambda n: -(-n // 250))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        folds = splits.time_folds(df)
        assert 1 < folds.rdd.getNumPartitions() <= 4
    finally:
        spark.conf.unset(merging)
    assert sorted(map(str, folds.collect())) == want


def test_fits_at_once():
    assert tr.at_once(5_000_000, 3) == 3 and tr.at_once(0, 4) == 4
    assert tr.at_once(6_000_000, 4) == 2 and tr.at_once(30_000_000, 4) == 1


def test_auc_and_reports(spark):
    pick = random.Random(4)
    rows = [(1, round(pick.random(), 1), int(pick.random() < 0.4)) for _ in range(200)] + [(2, 0.5, 0), (2, 0.6, 0)]
    df = spark.createDataFrame(rows, "k long, prob double, is_podium long")
    got = {r.k: r.auc for r in metrics.auc(df, ["k"]).collect()}
    pos = [p for k, p, y in rows if k == 1 and y]
    neg = [p for k, p, y in rows if k == 1 and not y]
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert got[1] == pytest.approx(wins / len(pos) / len(neg)) and got[2] is None
    report = metrics.threshold_report()
    none = df.filter("k = 2").withColumn("prob", F.lit(0.1)).agg(*[c.alias(n) for n, c in report.items()]).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_backtest_kpis(spark):
    rows = [(2025, i + 1, c, b) for i, (c, b) in enumerate(zip((1, 2, 2, 2, 3), (0.079813, 0.046537, 0.039816, 0.084389, 0.037916)))]
    df = spark.createDataFrame(rows, "year long, round long, correct long, brier double")
    kpi = backtest.backtest_kpis(df).first()
    assert (kpi.total_correct, kpi.total_possible, kpi.perfect, kpi.at_least_one) == (10, 15, 1, 5)
    assert kpi.mean_brier == pytest.approx(0.05769, abs=1e-5)
    named = df.withColumns({"predicted": F.array(F.lit("a")), "actual": F.array(F.lit("a"))})
    curve = [r.cumulative_hit_rate for r in backtest.backtest_rows(named).orderBy("round").collect()]
    assert curve == pytest.approx([0.3333, 0.5, 0.5556, 0.5833, 0.6667], abs=1e-4)


def test_model_round_trip(spark, matrix, tmp_path):
    model = tr.train_final(matrix, 1999, TINY, TINY)
    rows = matrix.filter("year = 2000")
    first = model.score(rows).orderBy("ro", "driver_id").collect()
    again = tr.PodiumModel.load(model.save(str(tmp_path / "model"))).score(rows).orderBy("ro", "driver_id").collect()
    assert first == again and all(0 <= r.prob <= 1 for r in first)
    roles = {r.role: r.n for r in tr.split_report(model, matrix, 1999, 2000).collect()}
    assert set(roles) == {"train", "calibrate", "test"} and roles["test"] == len(first)
    top = model.importance(spark, 5).collect()
    assert len(top) == 5 and top[0].importance >= top[-1].importance


def test_grouped_calibration_equals_row_fit(matrix):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    head = tr.fit_classifier(matrix.filter("year < 1999"), TINY)
    rows = matrix.filter("year = 1999")
    grouped = tr.fit_calibration(head, rows)
    raw = head.transform(tr._numeric(rows, tr.C.FEATURES)).select(
        vector_to_array("probability")[1].alias("raw_prob"), F.col("is_podium").cast("double").alias("y")
    )
    plain = IsotonicRegression(featuresCol="raw_prob", labelCol="y", predictionCol="prob").fit(raw)
    a = [r.prob for r in plain.transform(raw).orderBy("raw_prob").collect()]
    b = [r.prob for r in grouped.transform(raw).orderBy("raw_prob").collect()]
    assert a == pytest.approx(b, abs=1e-9)


def test_temporal_cv_and_search(matrix):
    report = {r.fold: r for r in tr.temporal_cv(matrix, 1999, TINY, TINY).collect()}
    assert set(report) == {1997, 1998, 1999} and all(r.n == r.validate_size for r in report.values())
    drawn = tr.draw_params(tr.CLASSIFIER_RANGES, 4)
    assert drawn == tr.draw_params(tr.CLASSIFIER_RANGES, 4) and all(3 <= p.depth <= 10 for p in drawn)
    table = tr.search(matrix, [TINY, tr.Params(trees=2, depth=2)], "regressor").collect()
    assert len(table) == 2 and table[0].score >= table[1].score


def test_rolling_backtest_sees_only_the_past(matrix):
    scored = tr.rolling_backtest(matrix.filter("ro <= 199603"), 1996, TINY, TINY)
    assert {r.ro for r in scored.select("ro").distinct().collect()} == {199601, 199602, 199603}
    model = tr.fit_model(matrix.filter("ro < 199602"), None, TINY, TINY)
    want = {r.driver_id: r.prob for r in model.score(matrix.filter("ro = 199602")).collect()}
    got = {r.driver_id: r.prob for r in scored.filter("ro = 199602").collect()}
    assert got == pytest.approx(want)


def test_stored_backtest_document(spark, tmp_path):
    """One array per file with a probability map per race."""
    import json

    race = {"round": 1, "race_name": "X GP (R1)", "predicted": ["a", "b", "c"], "actual": ["b", "a", "d"], "correct": 2,
            "brier_score": 0.05, "probabilities": {"a": 0.5, "b": 0.25}}
    (tmp_path / "season.json").write_text(json.dumps([race, {**race, "round": 2, "probabilities": {}}], indent=2))
    docs = backtest.read_backtest(spark, str(tmp_path / "season.json"), whole_file=True).withColumn(
        "race_id", F.concat(F.lit("2025_"), "round")
    )
    assert docs.count() == 2
    probs = {(r.race_id, r.driver_id): r.prob for r in backtest.probabilities_of(docs).collect()}
    assert probs == {("2025_1", "a"): 0.5, ("2025_1", "b"): 0.25}
    named = serving.backtest_predictions(docs, backtest.probabilities_of(docs)).orderBy("race_id", "predicted_position").collect()
    assert [r.probability for r in named] == [0.5, 0.25, 0.5, 0.5, 0.5, 0.5] and {r.confidence for r in named} == {1.0}


def test_rolling_queries_fit_models_of_full_size(spark, small, monkeypatch):
    """The rolling season is scored by models of the library's default size, one for each of its races."""
    from checks import training

    asked = []

    def fit(train, calibrate, classifier, regressor):
        asked.append((classifier, regressor))
        return known

    league = League(spark, small)
    known = training.final_model(league)
    monkeypatch.setattr(tr, "fit_model", fit)
    monkeypatch.setattr(training, "staged", lambda spark, key, build: build())
    n_races = league_matrix(league).filter("year = 2001").select("ro").distinct().count()
    for query in (training.model_rolling_backtest, training.model_rolling_records):
        asked.clear()
        assert query(spark, small).count() > 0
        assert asked == [(tr.CLASSIFIER, tr.REGRESSOR)] * n_races
    assert (tr.CLASSIFIER.trees, tr.CLASSIFIER.depth, tr.REGRESSOR.trees, tr.REGRESSOR.depth) == (300, 6, 400, 8)


def test_fits_fill_the_cores(spark):
    rows = spark.range(1)
    cores = spark.sparkContext.defaultParallelism
    assert tr.fits_of(rows, 1000) == cores and tr.fits_of(rows, 2 * tr.parts_of(1) * 250_000) == cores // 2
    assert tr.fits_of(rows, 30_000_000) == 1
