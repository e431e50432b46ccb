"""Sequence regression (M4), boosted trees with random search (M5–M7, M13),
plus the menu's forest and linear regressions (M14, M15).

All fits are MLlib estimators on DataFrames; the rows here are already
aggregated to one per day (or per timestamp), so fits are small while the
feature building before them scales with the invoice lines.
"""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The search space and budget of the boosted-tree tuning.
N_DRAWS = 10
N_FOLDS = 5
SEARCH_SEED = 42
TREES = (100, 500)          # integers, upper bound open
RATE = (0.01, 0.31)         # uniform(start 0.01, width 0.3)
DEPTH = (3, 10)             # integers, upper bound open
FRACTION = (0.5, 1.0)       # uniform(start 0.5, width 0.5), rows and columns


def sequence_regression(train: DataFrame, test: DataFrame, seq_col: str = "sequence",
                        target_col: str = "target", model: str = "linear",
                        reg: float = 1e-4, seed: int = 42):
    """M4: next-value regression on fixed-length input windows.

    ``model='linear'`` (ridge) or ``'gbt'``; returns (fitted model, test rows
    with ``prediction``)."""
    tr = train.withColumn("_features", array_to_vector(seq_col))
    te = test.withColumn("_features", array_to_vector(seq_col))
    if model == "linear":
        est = LinearRegression(featuresCol="_features", labelCol=target_col, regParam=reg,
                               elasticNetParam=0.0)
    elif model == "gbt":
        est = GBTRegressor(featuresCol="_features", labelCol=target_col, seed=seed, maxIter=50)
    else:
        raise ValueError("model must be 'linear' or 'gbt'")
    fitted = est.fit(tr)
    return fitted, fitted.transform(te).drop("_features")


def random_param_draws(n_draws: int = N_DRAWS, seed: int = SEARCH_SEED) -> list[dict]:
    """M6: seeded draws from the search space (driver-side, ``n_draws`` small dicts)."""
    rng = random.Random(seed)
    draws = []
    for _ in range(n_draws):
        draws.append({
            "maxIter": rng.randrange(*TREES),
            "stepSize": RATE[0] + (RATE[1] - RATE[0]) * rng.random(),
            "maxDepth": rng.randrange(*DEPTH),
            "subsamplingRate": FRACTION[0] + (FRACTION[1] - FRACTION[0]) * rng.random(),
            "colsample": FRACTION[0] + (FRACTION[1] - FRACTION[0]) * rng.random(),
        })
    return draws


def _strategy(frac: float, n_features: int) -> str:
    """Column fraction → MLlib feature subset (per node, not per tree)."""
    return str(min(1.0, max(frac, 1.0 / max(n_features, 1))))


def tune_gbt(train: DataFrame, features: list[str], target: str, n_draws: int = N_DRAWS,
             n_folds: int = N_FOLDS, seed: int = SEARCH_SEED, parallelism: int | None = None):
    """M5 + M6 + W8: random search by cross-validated MSE; returns
    (best PipelineModel, best params dict, table of draws with mean CV MSE)."""
    spark = train.sparkSession
    asm = VectorAssembler(inputCols=features, outputCol="_features")
    # the candidates are independent: evaluate them concurrently (boosting
    # keeps its periodic checkpoints, which bound the lineage of long runs)
    gbt = GBTRegressor(featuresCol="_features", labelCol=target, seed=seed, lossType="squared")
    pipe = Pipeline(stages=[asm, gbt])
    draws = random_param_draws(n_draws, seed)
    maps = []
    for dr in draws:
        maps.append({gbt.maxIter: dr["maxIter"], gbt.stepSize: dr["stepSize"],
                     gbt.maxDepth: dr["maxDepth"], gbt.subsamplingRate: dr["subsamplingRate"],
                     gbt.featureSubsetStrategy: _strategy(dr["colsample"], len(features))})
    ev = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="mse")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, numFolds=n_folds,
                        seed=seed, parallelism=parallelism or min(len(maps), 16))
    cvm = cv.fit(train)
    scores = [float(s) for s in cvm.avgMetrics]
    best = min(range(len(scores)), key=lambda i: scores[i])
    table = spark.createDataFrame(
        [(i, d["maxIter"], float(d["stepSize"]), d["maxDepth"], float(d["subsamplingRate"]),
          float(d["colsample"]), scores[i]) for i, d in enumerate(draws)],
        "draw int, trees int, rate double, depth int, subsample double, colsample double, cv_mse double")
    return cvm.bestModel, draws[best], table


def fit_gbt(train: DataFrame, features: list[str], target: str, params: dict,
            val: DataFrame | None = None, seed: int = SEARCH_SEED):
    """M5 second model: given parameters; with a validation frame, also the
    validation loss after every iteration (``evaluateEachIteration``)."""
    asm = VectorAssembler(inputCols=features, outputCol="_features")
    gbt = GBTRegressor(featuresCol="_features", labelCol=target, seed=seed,
                       maxIter=params["maxIter"], stepSize=params["stepSize"],
                       maxDepth=params["maxDepth"], subsamplingRate=params["subsamplingRate"],
                       featureSubsetStrategy=_strategy(params["colsample"], len(features)))
    model = Pipeline(stages=[asm, gbt]).fit(train)
    curve = None
    if val is not None:
        losses = model.stages[-1].evaluateEachIteration(asm.transform(val), "squared")
        curve = train.sparkSession.createDataFrame(
            [(i + 1, float(v)) for i, v in enumerate(losses)], "iteration int, val_loss double")
    return model, curve


def predict_both(quantity_model: PipelineModel, total_model: PipelineModel, test: DataFrame,
                 q_features: list[str], t_features: list[str]) -> DataFrame:
    """M7: both predictions onto the test rows."""
    a = quantity_model.transform(test).withColumnRenamed("prediction", "predicted_quantity").drop("_features")
    b = total_model.transform(a).withColumnRenamed("prediction", "predicted_total").drop("_features")
    return b


def fit_simple(train: DataFrame, features: list[str], target: str, kind: str = "forest",
               seed: int = SEARCH_SEED) -> PipelineModel:
    """M14 random forest / M15 linear regression on the same features."""
    asm = VectorAssembler(inputCols=features, outputCol="_features")
    if kind == "forest":
        est = RandomForestRegressor(featuresCol="_features", labelCol=target, seed=seed)
    elif kind == "linear":
        est = LinearRegression(featuresCol="_features", labelCol=target)
    else:
        raise ValueError("kind must be 'forest' or 'linear'")
    return Pipeline(stages=[asm, est]).fit(train)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (overwrites)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

