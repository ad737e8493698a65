"""Podium classifier, place regressor, calibration and model evaluation on Spark ML."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions import constants as C
from paceline.operators import metrics
from paceline.operators.isotonic import boundaries, isotonic_blocks
from paceline.plans import splits
from paceline.plans.backtest import race_records
from paceline.session import fixed, parts_of, shared_dir

# Columns that can be null in the matrix; the others have defaults
NULLABLE = ["quali_gap_to_pole", "quali_consistency"]
META = ["race_id", "ro", "year", "round", "driver_id", "constructor_id", "is_podium", "finish_position"]


@dataclass(frozen=True)
class Params:
    """Tree settings of one head."""

    trees: int
    depth: int
    step: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    min_rows: int = 3
    seed: int = 42


# Default settings of the two heads
CLASSIFIER = Params(trees=300, depth=6)
REGRESSOR = Params(trees=400, depth=8, min_rows=10)

# Rows that fits under way hold in memory together, at some 250 bytes each in binned form
FIT_ROWS = 16_000_000


def at_once(rows: int, parallel: int) -> int:
    """How many of ``parallel`` fits over ``rows`` run at a time: one fit of many rows keeps all cores busy by itself, and
    the binned rows of several would push each other out of memory."""
    return max(1, min(parallel, FIT_ROWS // max(rows, 1)))


def fits_of(rows: DataFrame, n: int) -> int:
    """How many fits over ``n`` rows it takes to keep all cores busy, at a task per ``TASK_ROWS`` rows.

    A fit starts a job per tree level, so few rows in many tasks cost more than they save.
    """
    return at_once(n, max(1, rows.sparkSession.sparkContext.defaultParallelism // parts_of(n)))


def medians_of(rows: DataFrame) -> dict[str, float]:
    """Exact medians of the features that can be null."""
    return {m.feature: m.median for m in splits.exact_medians(rows, NULLABLE).collect()}


def balance_of(rows: DataFrame) -> float:
    """Weight of a positive row."""
    return float(rows.agg(metrics.class_balance()["pos_weight"].alias("w")).first().w)


def _vectors(rows: DataFrame, features: Sequence[str], medians: dict[str, float] | None = None) -> list:
    """Imputation by the exact medians of the training rows, kept in the fitted pipeline, and assembly."""
    medians = medians_of(rows) if medians is None else medians
    inputs = [f"{c}_filled" if c in medians else c for c in features]
    filled = ", ".join(["*", *(f"coalesce({c}, {m!r}D) AS {c}_filled" for c, m in medians.items())])
    stages = [SQLTransformer(statement=f"SELECT {filled} FROM __THIS__")] if medians else []
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]


def _settings(p: Params) -> dict:
    return {
        "maxIter": p.trees,
        "maxDepth": p.depth,
        "stepSize": p.step,
        "subsamplingRate": p.row_share,
        "featureSubsetStrategy": str(p.column_share),
        "minInstancesPerNode": p.min_rows,
        "seed": p.seed,
    }


def _numeric(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in columns})


@dataclass
class PodiumModel:
    """Fitted heads: classifier, place regressor and an optional isotonic calibration."""

    classifier: PipelineModel
    regressor: PipelineModel
    calibration: IsotonicRegressionModel | None = None
    features: list[str] = field(default_factory=lambda: list(C.FEATURES))

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``prob`` and ``predicted_place``."""
        keep = rows.columns
        numeric = _numeric(rows.select("*", *[F.col(c).alias(f"_{c}") for c in self.features]), self.features)
        raw = self.classifier.transform(numeric).withColumn("raw_prob", vector_to_array("probability")[1])
        if self.calibration is None:
            scored = raw.withColumn("prob", F.col("raw_prob"))
        else:
            scored = self.calibration.transform(raw)
        scored = scored.select(*[c for c in numeric.columns], "prob")
        placed = self.regressor.transform(scored).withColumnRenamed("prediction", "predicted_place")
        restored = placed.withColumns({c: F.col(f"_{c}") for c in self.features})
        return restored.select(*keep, "prob", "predicted_place")

    def importance(self, spark, top: int = 15) -> DataFrame:
        """Largest classifier importances."""
        weights = self.classifier.stages[-1].featureImportances.toArray()
        rows = [(name, float(w)) for name, w in zip(self.features, weights)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance")).limit(top)

    def save(self, path: str) -> str:
        self.classifier.write().overwrite().save(f"{path}/classifier")
        self.regressor.write().overwrite().save(f"{path}/regressor")
        if self.calibration is not None:
            self.calibration.write().overwrite().save(f"{path}/calibration")
        return path

    @classmethod
    def load(cls, path: str, calibrated: bool = True) -> "PodiumModel":
        return cls(
            PipelineModel.load(f"{path}/classifier"),
            PipelineModel.load(f"{path}/regressor"),
            IsotonicRegressionModel.load(f"{path}/calibration") if calibrated else None,
        )


def fit_classifier(
    rows: DataFrame, params: Params = CLASSIFIER, medians: dict[str, float] | None = None, balance: float | None = None
) -> PipelineModel:
    """Boosted trees with positive rows weighted by the class ratio.

    Boosting cuts its lineage every few rounds in the shared folder, which is therefore set first. ``medians`` and
    ``balance`` of the same rows save their jobs.
    """
    shared_dir(rows.sparkSession)
    balance = balance_of(rows) if balance is None else balance
    weight = F.when(F.col("is_podium") == 1, F.lit(balance)).otherwise(1.0)
    data = _numeric(rows, C.FEATURES).withColumns({"label": F.col("is_podium").cast("double"), "weight": weight})
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", **_settings(params))
    return Pipeline(stages=[*_vectors(rows, C.FEATURES, medians), trees]).fit(data)


def fit_regressor(rows: DataFrame, params: Params = REGRESSOR, medians: dict[str, float] | None = None) -> PipelineModel:
    """Boosted trees on rows with a finishing position, of which ``medians`` may be given."""
    shared_dir(rows.sparkSession)
    placed = rows.filter("finish_position IS NOT NULL")
    data = _numeric(placed, C.FEATURES).withColumn("label", F.col("finish_position").cast("double"))
    trees = GBTRegressor(featuresCol="features", labelCol="label", lossType="squared", **_settings(params))
    return Pipeline(stages=[*_vectors(placed, C.FEATURES, medians), trees]).fit(data)


def fit_calibration(classifier: PipelineModel, rows: DataFrame) -> IsotonicRegressionModel:
    """Isotonic fit of outcome on raw probability over a later year.

    Scores are pooled to blocks on the cluster; the stored model is fitted to the ends of the blocks, which are in order
    already, so the driver holds blocks and never scores, however many a head gives.
    """
    scored = classifier.transform(_numeric(rows, C.FEATURES))
    raw = scored.select(vector_to_array("probability")[1].alias("raw_prob"), "is_podium")
    ends = boundaries(isotonic_blocks(raw, "raw_prob", F.col("is_podium"))).withColumnRenamed("score", "raw_prob")
    fit = IsotonicRegression(
        featuresCol="raw_prob", labelCol="value", weightCol="weight", predictionCol="prob", isotonic=True
    )
    return fit.fit(ends)


def fit_model(
    train: DataFrame,
    calibrate: DataFrame | None = None,
    classifier: Params = CLASSIFIER,
    regressor: Params = REGRESSOR,
) -> PodiumModel:
    """Both heads, with calibration when later rows are given."""
    head = fit_classifier(train, classifier)
    calibration = None if calibrate is None else fit_calibration(head, calibrate)
    return PodiumModel(head, fit_regressor(train, regressor), calibration)


def model_report(scored: DataFrame, key: Sequence[str], bound: int | None = None) -> DataFrame:
    """Classification and place metrics of scored rows per key."""
    values: dict[str, Column] = metrics.threshold_report() | {
        "log_loss": metrics.log_loss(),
        "brier": metrics.brier(),
        "position_mae": metrics.position_error(),
        "n": F.count(F.lit(1)),
    }
    scored = fixed(scored.select(*key, "prob", "predicted_place", "is_podium", "finish_position"))
    report = scored.groupBy(*key).agg(*[v.alias(n) for n, v in values.items()])
    return report.join(metrics.auc(scored, key, bound=bound), list(key))


def _stacked(job, items: Sequence, parallel: int) -> DataFrame:
    """Union of ``job(item)`` frames; jobs are started ``parallel`` at a time."""
    with ThreadPoolExecutor(parallel) as pool:
        frames = list(pool.map(job, items))
    return reduce(DataFrame.unionByName, frames)


def temporal_cv(
    matrix: DataFrame,
    train_end: int,
    classifier: Params = CLASSIFIER,
    regressor: Params = REGRESSOR,
    parallel: int = 3,
) -> DataFrame:
    """Report per validation year: train before v - 1, calibrate on v - 1, validate on v.

    Three folds end at ``train_end``; folds without rows in any role are skipped. Each fit is a
    distributed Spark ML job, ``parallel`` of them at a time, and all folds form one scored frame.
    """
    folds = splits.year_folds(matrix, [train_end - 2, train_end - 1, train_end])
    present = folds.groupBy("fold").agg(F.countDistinct("role").alias("roles")).filter("roles = 3")

    def validate(fold: int) -> DataFrame:
        mine = folds.filter(F.col("fold") == fold)
        model = fit_model(
            mine.filter("role = 'train'"), mine.filter("role = 'calibrate'"), classifier, regressor
        )
        return model.score(mine.filter("role = 'validate'"))

    scored = _stacked(validate, sorted(r.fold for r in present.collect()), at_once(matrix.count(), parallel))
    sizes = folds.groupBy("fold").agg(
        *[F.count_if(F.col("role") == r).alias(f"{r}_size") for r in ("train", "calibrate", "validate")]
    )
    return model_report(scored, ["fold"]).join(sizes, "fold")


def train_final(
    matrix: DataFrame, train_end: int, classifier: Params = CLASSIFIER, regressor: Params = REGRESSOR
) -> PodiumModel:
    """Final model: trained before ``train_end`` and calibrated on it."""
    rows = splits.final_split(matrix, train_end, train_end + 1)
    return fit_model(rows.filter("role = 'train'"), rows.filter("role = 'calibrate'"), classifier, regressor)


def split_report(model: PodiumModel, matrix: DataFrame, train_end: int, test_year: int, bound: int | None = None) -> DataFrame:
    """Metrics of the final model on its training, calibration and test rows."""
    return model_report(model.score(splits.final_split(matrix, train_end, test_year)), ["role"], bound)


# Search ranges of the two heads (low, high, logarithmic)
CLASSIFIER_RANGES = {
    "depth": (3, 10, False),
    "step": (0.01, 0.3, True),
    "trees": (100, 600, False),
    "row_share": (0.6, 1.0, False),
    "column_share": (0.5, 1.0, False),
    "min_rows": (1, 10, False),
}
REGRESSOR_RANGES = {
    "depth": (3, 12, False),
    "step": (0.01, 0.3, True),
    "trees": (100, 800, False),
    "row_share": (0.6, 1.0, False),
    "column_share": (0.5, 1.0, False),
    "min_rows": (5, 30, False),
}


def draw_params(ranges: dict, trials: int, seed: int = 42) -> list[Params]:
    """Seeded random settings inside the ranges."""
    source = random.Random(seed)
    drawn = []
    for _ in range(trials):
        values = {}
        for name, (low, high, logarithmic) in ranges.items():
            if logarithmic:
                values[name] = low * (high / low) ** source.random()
            elif isinstance(low, int):
                values[name] = source.randint(low, high)
            else:
                values[name] = source.uniform(low, high)
        drawn.append(Params(**values))
    return drawn


def fold_facts(rows: DataFrame, head: str) -> Callable[[int], tuple[dict, int]]:
    """What all fits of a fold share, found once: arguments of the fit, and the number of test rows."""
    found, lock = {}, Lock()

    def facts(fold: int) -> tuple[dict, int]:
        with lock:
            if fold not in found:
                train = rows.filter(F.col("test_fold") < fold)
                known = {"medians": medians_of(train)} | ({"balance": balance_of(train)} if head == "classifier" else {})
                found[fold] = known, rows.filter(F.col("test_fold") == fold).count()
            return found[fold]

    return facts


def search(
    matrix: DataFrame,
    candidates: Sequence[Params],
    head: str = "classifier",
    splits_: int = 3,
    parallel: int = 2,
) -> DataFrame:
    """Mean score of each candidate over expanding folds, best first.

    The classifier is judged by AUC, the regressor by negative mean absolute error. Fits run as
    Spark jobs, ``parallel`` of them at a time.
    """
    spark = matrix.sparkSession
    if head == "regressor":
        matrix = matrix.filter("finish_position IS NOT NULL")
    rows = splits.time_folds(matrix, splits_).persist()
    facts = fold_facts(rows, head)

    def judge(job: tuple[int, int]) -> tuple[int, float]:
        candidate, fold = job
        # rows that are only trained on have fold 0 and always lie before the test rows
        train, test = rows.filter(F.col("test_fold") < fold), rows.filter(F.col("test_fold") == fold)
        known, n_test = facts(fold)
        if head == "classifier":
            scored = fit_classifier(train, candidates[candidate], **known).transform(_numeric(test, C.FEATURES))
            scored = scored.withColumn("prob", F.round(vector_to_array("probability")[1], 9))
            return candidate, metrics.auc(scored.select("test_fold", "is_podium", "prob"), ["test_fold"], bound=n_test).first().auc
        scored = fit_regressor(train, candidates[candidate], **known).transform(_numeric(test, C.FEATURES))
        return candidate, -scored.agg(metrics.position_error(predicted="prediction").alias("e")).first().e

    jobs = [(c, f) for c in range(len(candidates)) for f in range(1, splits_ + 1)]
    with ThreadPoolExecutor(at_once(rows.count(), parallel)) as pool:
        scores = list(pool.map(judge, jobs))
    rows.unpersist()
    table = spark.createDataFrame(
        [(c, score, *vars(candidates[c]).values()) for c, score in scores],
        "candidate long, score double, trees long, depth long, step double, row_share double, column_share double, "
        "min_rows long, seed long",
    )
    settings = ["candidate", "trees", "depth", "step", "row_share", "column_share", "min_rows"]
    return table.groupBy(*settings).agg(F.avg("score").alias("score")).orderBy(F.desc("score"), "candidate")


def rolling_backtest(
    matrix: DataFrame,
    year: int,
    classifier: Params = CLASSIFIER,
    regressor: Params = REGRESSOR,
    parallel: int | None = None,
) -> DataFrame:
    """Scores of every race of a season, each from a model trained on all races before it.

    One fit per race, each on the cluster over the cached matrix. A fit needs only earlier rows,
    not earlier models, so ``parallel`` of them run at a time, by default as many as the cores hold.
    """
    known = matrix.filter(F.col("year") <= year)
    n = known.count()
    cached = known.coalesce(parts_of(n)).persist()
    rounds = [r.ro for r in cached.filter(F.col("year") == year).select("ro").distinct().orderBy("ro").collect()]

    def predict(ro: int) -> DataFrame:
        model = fit_model(cached.filter(F.col("ro") < ro), None, classifier, regressor)
        return model.score(cached.filter(F.col("ro") == ro))

    scored = fixed(_stacked(predict, rounds, fits_of(cached, n) if parallel is None else at_once(n, parallel)))
    cached.unpersist()
    return scored


def season_report(model: PodiumModel, matrix: DataFrame, year: int, bound: int | None = None) -> DataFrame:
    """Race records of one season under a fitted model."""
    return race_records(fixed(model.score(matrix.filter(F.col("year") == year))), "predicted_place", bound)


def latest_priors(scored: DataFrame) -> DataFrame:
    """(driver_id, prior): each driver's probability in its latest scored race, for live updates."""
    return scored.groupBy("driver_id").agg(F.max_by("prob", "ro").alias("prior"))
