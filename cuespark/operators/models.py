"""Training, cross-validation, tuning and persistence of Spark ML classifiers.

Settings follow the published study where Spark has them.  Deliberate differences:
* boosted trees are those of `boosting`: histograms, by leaf or by level, a softmax for three classes;
* the network is that of `network`, or Spark's multilayer perceptron (sigmoid units, L-BFGS);
* forests are those of `forest`: 32 bins, at most 30 levels, trees grown in tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespark.operators.boosting import BoostedTrees
from cuespark.operators.evaluate import accuracy, best_model
from cuespark.operators.forest import RandomForest, grid_accuracy
from cuespark.operators.network import MiniBatchNetwork
from cuespark.operators.prepare import Prepared, prepare
from cuespark.operators.sampling import class_counts, stratified_folds, stratified_split

LASSO, FOREST, MLP = "Lasso Logistic", "Random Forest", "MLP"
BOOSTED_SLOW, BOOSTED_DEEP = "Boosted Trees 0.05", "Boosted Trees 0.1"
MAX_DEPTH = 30

RESULTS = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("cv_accuracy_mean", T.DoubleType()),
        T.StructField("cv_accuracy_std", T.DoubleType()),
        T.StructField("training_samples", T.LongType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("test_samples", T.LongType()),
        T.StructField("dimension", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


class LassoLogistic(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter):
    """L1 logistic regression with inverse strength C on the *summed* loss.

    Spark averages the loss, so its penalty is 1 / (C * rows); the rows are those of the data
    at hand, which makes it right for every fold as well.
    """

    C = Param(Params._dummy(), "C", "inverse penalty of the summed loss", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", C=1000.0, maxIter=2000):
        super().__init__()
        self._setDefault(C=1000.0, maxIter=2000)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        rows = dataset.count()
        return LogisticRegression(
            featuresCol=self.getFeaturesCol(),
            labelCol=self.getLabelCol(),
            elasticNetParam=1.0,
            regParam=1.0 / (self.getOrDefault(self.C) * rows),
            standardization=False,
            maxIter=self.getMaxIter(),
            tol=1e-8,
        ).fit(dataset)


def registry(
    dim: int,
    n_classes: int,
    seed: int = 42,
    trees: int = 300,
    depth: int = MAX_DEPTH,
    rounds: int = 300,
    max_iter: int = 2000,
    mlp_layers: tuple[int, ...] = (512, 256, 128),
    mlp_iter: int = 100,
    mlp_batch: int | None = None,
    C: float = 1000.0,
    models: list[str] | None = None,
) -> dict[str, Estimator]:
    """Name -> estimator, in training order.

    With `mlp_batch` the network is the study's, trained by mini-batches of so many rows for 20 epochs;
    else Spark's, which takes all rows in a step.
    """

    # the study's two boosters: best leaf first, and level by level with its own regularisation
    by_leaf = BoostedTrees(rounds=rounds, rate=0.05, growth="leaf", leaves=31, seed=seed)
    by_level = BoostedTrees(
        rounds=rounds, rate=0.1, growth="level", depth=6, bins=256, l2=1.0, minRows=1, minHessian=1.0,
        seed=seed,
    )
    def network(dim: int, n_classes: int) -> Estimator:
        sizes = [dim, *mlp_layers, n_classes]
        if mlp_batch:
            return MiniBatchNetwork(layers=sizes, batch=mlp_batch, seed=seed)
        return MultilayerPerceptronClassifier(layers=sizes, maxIter=mlp_iter, seed=seed)

    made = {
        LASSO: LassoLogistic(C=C, maxIter=max_iter),
        FOREST: RandomForest(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=1),
        MLP: network(dim, n_classes),
        BOOSTED_SLOW: by_leaf,
        BOOSTED_DEEP: by_level,
    }
    return {name: made[name] for name in (models or made)}


def accuracy_evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(metricName="accuracy")


def cross_validator(
    estimator: Estimator, grid: list | None = None, folds: int = 5, parallelism: int = 4
) -> CrossValidator:
    """Cross-validation over a given `fold` column; refits on all rows."""
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=grid or [{}], evaluator=accuracy_evaluator(),
        numFolds=folds, foldCol="fold", parallelism=parallelism,
    )


def train_models(
    data: Prepared,
    estimators: dict[str, Estimator],
    cv_folds: int | None = 5,
    key: str = "vec_id",
    target: str = "gender",
    seed: int = 42,
) -> tuple[dict[str, object], dict[str, dict]]:
    """Fit every estimator; a failure is recorded and the others go on.

    The network is trained on all training rows and not cross-validated.
    """
    models, results = {}, {}
    folded = None
    for name, estimator in estimators.items():
        try:
            mean = std = None
            if cv_folds and name != MLP:
                if folded is None:
                    folded = stratified_folds(data.train, target, key, cv_folds, seed).persist()
                model, mean, std = _validated(estimator, folded, cv_folds)
            else:
                model = estimator.fit(data.train)
            models[name] = model
            results[name] = {
                "cv_accuracy_mean": mean, "cv_accuracy_std": std, "training_samples": data.n_train
            }
        except Exception as problem:  # one model's failure must not stop the others
            results[name] = {"error": _short(problem)}
    if folded is not None:
        folded.unpersist()
    return models, results


def _validated(estimator: Estimator, folded: DataFrame, folds: int) -> tuple[object, float, float]:
    """The model of all rows, and mean and population std of the folds' accuracies."""
    if isinstance(estimator, BoostedTrees):  # fits all folds in the same passes
        model, *own = estimator.fit_folds(folded, folds)
        tables = [
            own[f].transform(folded.filter(F.col("fold") == f)).select("fold", "label", "prediction")
            for f in range(folds)
        ]
        rows = accuracy(reduce(DataFrame.unionByName, tables), ["fold"]).collect()
        scores = [r["accuracy"] for r in rows]
        mean = sum(scores) / len(scores)
        return model, mean, math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores))
    validated = cross_validator(estimator, folds=folds).fit(folded)
    return validated.bestModel, float(validated.avgMetrics[0]), float(validated.stdMetrics[0])


def _short(problem: Exception) -> str:
    return str(problem).strip() or type(problem).__name__


def predict(models: dict[str, object], data: DataFrame, key: str = "vec_id") -> DataFrame:
    """Predictions of all models as one table: key, label, prediction, probability, model.

    `probability` is NULL for a model that gives none.
    """
    if not models:
        raise ValueError("no trained models")

    def table(name: str, model) -> DataFrame:
        made = model.transform(data)
        if "probability" in made.columns:
            probability = vector_to_array("probability")
        else:
            probability = F.lit(None).cast("array<double>")
        return made.select(
            key, "label", "prediction", probability.alias("probability"), F.lit(name).alias("model")
        )

    return reduce(DataFrame.unionByName, [table(n, m) for n, m in models.items()])


def evaluate_models(models: dict[str, object], data: Prepared, key: str = "vec_id") -> dict:
    """Test accuracy and size per model; the predictions stay a table (see `predict`)."""
    out = {}
    for name, model in models.items():
        try:
            row = accuracy(predict({name: model}, data.test, key)).first()
            out[name] = {"accuracy": row["accuracy"], "test_samples": row["test_samples"]}
        except Exception as problem:
            out[name] = {"error": _short(problem)}
    return out


def run_method(
    df: DataFrame,
    method: str,
    make_estimators: Callable[[int, int], dict[str, Estimator]] = registry,
    target: str = "gender",
    key: str = "vec_id",
    cv_folds: int | None = 5,
    seed: int = 42,
    test_size: float = 0.2,
) -> tuple[list[tuple], dict[str, object], PipelineModel | None]:
    """Prepare, train and evaluate one embedding table: (result rows, models, preprocessing)."""
    try:
        data = prepare(df, target, key, test_size=test_size, seed=seed)
    except Exception as problem:
        error = (method, None, 0, None, None, None, None, None, None, _short(problem))
        return [error], {}, None
    estimators = make_estimators(data.dim, len(data.classes))
    models, trained = train_models(data, estimators, cv_folds, key, target, seed)
    tested = evaluate_models(models, data, key)
    data.unpersist()
    rows = []
    for order, name in enumerate(estimators):
        fit, test = trained.get(name, {}), tested.get(name, {})
        rows.append(
            (
                method, name, order, fit.get("cv_accuracy_mean"), fit.get("cv_accuracy_std"),
                fit.get("training_samples"), test.get("accuracy"), test.get("test_samples"),
                data.dim, fit.get("error") or test.get("error"),
            )
        )
    return rows, models, data.preprocessing


def compare_methods(
    df: DataFrame,
    make_estimators: Callable[[int, int], dict[str, Estimator]] = registry,
    target: str = "gender",
    key: str = "vec_id",
    cv_folds: int | None = 5,
    seed: int = 42,
    save_to: str | None = None,
) -> DataFrame:
    """Result rows of every `method` in a table; the data of a method is one partition of it.

    With `save_to`, the models of each method are saved in a folder of its name.
    """
    rows = []
    for method in sorted(class_counts(df, "method")):
        part = df.filter(F.col("method") == method)
        found, fitted, preprocessing = run_method(
            part, method, make_estimators, target, key, cv_folds, seed
        )
        rows += found
        if save_to and preprocessing is not None:
            fit = {
                r[1]: {"cv_accuracy_mean": r[3], "cv_accuracy_std": r[4], "training_samples": r[5],
                       "error": None if r[1] in fitted else r[9]}
                for r in found
            }
            save_models(df.sparkSession, f"{save_to}/{method}", fitted, preprocessing, fit)
    return df.sparkSession.createDataFrame(rows, RESULTS)


def comparison(results: DataFrame) -> DataFrame:
    """Best model per method with the dimension of its vectors."""
    failed = F.max("model").isNull()  # a method fails as a whole, or it has models
    dims = results.groupBy("method").agg(
        F.max("dimension").alias("embedding_dimension"),
        F.when(failed, F.min("error")).alias("error"),
    )
    return best_model(results.filter(F.col("model").isNotNull())).join(dims, "method", "right")


def param_grid(name: str, estimator: Estimator) -> list | None:
    """The grid of a model, or None if it has none."""
    if name == LASSO:
        return ParamGridBuilder().addGrid(estimator.C, [0.01, 0.1, 1.0, 10.0, 100.0]).build()
    if name == FOREST:
        # min_samples_split s lets a node split from s rows on; leaves then hold about s / 2.
        leaf_sizes = [math.ceil(s / 2) for s in (2, 5, 10)]
        return (
            ParamGridBuilder()
            .addGrid(estimator.numTrees, [50, 100, 200])
            .addGrid(estimator.maxDepth, [5, 10, 15, MAX_DEPTH])
            .addGrid(estimator.minInstancesPerNode, leaf_sizes)
            .build()
        )
    return None


def tune(
    data: Prepared,
    name: str = LASSO,
    estimators: dict[str, Estimator] | None = None,
    grid: list | None = None,
    cv_folds: int = 3,
    key: str = "vec_id",
    target: str = "gender",
    seed: int = 42,
) -> dict:
    """Grid search: best parameters and score, all scores, and the refitted `{name}_tuned`."""
    estimators = estimators or registry(data.dim, len(data.classes), seed)
    if name not in estimators:
        raise ValueError(f"there is no model called {name}; choose from {list(estimators)}")
    estimator = estimators[name]
    grid = grid or param_grid(name, estimator)
    if grid is None:
        return {}
    try:
        folded = stratified_folds(data.train, target, key, cv_folds, seed)
        if isinstance(estimator, RandomForest):
            scores, stds, model = _forest_grid(estimator, grid, folded, cv_folds)
        else:
            found = cross_validator(estimator, grid, cv_folds).fit(folded)
            scores, stds, model = list(map(float, found.avgMetrics)), found.stdMetrics, found.bestModel
    except Exception as problem:  # reported like a failed training
        return {"error": _short(problem)}
    best = max(range(len(scores)), key=scores.__getitem__)
    readable = [{p.name: v for p, v in params.items()} for params in grid]
    return {
        "best_params": readable[best],
        "best_score": scores[best],
        "cv_results": [
            {"params": p, "mean": m, "std": float(s)}
            for p, m, s in zip(readable, scores, stds)
        ],
        "models": {f"{name}_tuned": model},
    }


def _forest_grid(
    estimator: RandomForest, grid: list[dict], folded: DataFrame, folds: int
) -> tuple[list[float], list[float], object]:
    """(means, population stds, the model of all rows at the first best point) of a forest's grid.

    Points that differ in numbers of trees and depths alone share the fits of the largest: fewer trees
    are its first ones, and lower trees the upper parts of its own.
    """
    points = [{**estimator.extractParamMap(), **p} for p in grid]
    shape = [(p[estimator.numTrees], p[estimator.maxDepth]) for p in points]
    rest = [
        {q: v for q, v in p.items() if q not in (estimator.numTrees, estimator.maxDepth)} for p in points
    ]
    folded = folded.persist()
    scores: list[list[float]] = [[] for _ in points]
    for own in [r for i, r in enumerate(rest) if r not in rest[:i]]:
        at = [i for i, r in enumerate(rest) if r == own]
        counts, depths = ({shape[i][k] for i in at} for k in (0, 1))
        largest = {**own, estimator.numTrees: max(counts), estimator.maxDepth: max(depths)}
        for f in range(folds):
            model = estimator.fit(folded.filter(F.col("fold") != f), largest)
            found = grid_accuracy(model, folded.filter(F.col("fold") == f), list(counts), list(depths))
            for i in at:
                scores[i].append(found[shape[i]])
    means = [sum(s) / folds for s in scores]
    stds = [math.sqrt(sum((x - m) ** 2 for x in s) / folds) for s, m in zip(scores, means)]
    best = estimator.fit(folded, grid[max(range(len(means)), key=means.__getitem__)])
    folded.unpersist()
    return means, stds, best


def _slug(name: str) -> str:
    return re.sub(r"[^a-z0-9.]+", "_", name.lower())


def save_models(
    spark: SparkSession, path: str, models: dict[str, object], preprocessing: PipelineModel,
    results: dict[str, dict] | None = None,
) -> None:
    """Write models, preprocessing and training results below `path`."""
    for name, model in models.items():
        PipelineModel([model]).write().overwrite().save(f"{path}/models/{_slug(name)}")
    preprocessing.write().overwrite().save(f"{path}/preprocessing")
    rows = [
        (n, _slug(n), r.get("cv_accuracy_mean"), r.get("cv_accuracy_std"),
         r.get("training_samples"), r.get("error"))
        for n in {**models, **(results or {})}
        for r in [(results or {}).get(n, {})]
    ]
    spark.createDataFrame(rows, _CATALOG).coalesce(1).write.mode("overwrite").json(
        f"{path}/catalog"
    )


_CATALOG = (
    "name string, folder string, cv_accuracy_mean double, cv_accuracy_std double, "
    "training_samples bigint, error string"
)


def load_models(spark: SparkSession, path: str):
    """(models, preprocessing, training results) as written by `save_models`."""
    try:
        rows = spark.read.schema(_CATALOG).json(f"{path}/catalog").collect()
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(f"no saved models below {path}") from problem
        raise
    models = {
        r["name"]: PipelineModel.load(f"{path}/models/{r['folder']}").stages[0]
        for r in rows
        if r["error"] is None
    }
    results = {
        r["name"]: {k: v for k, v in r.asDict().items() if k not in ("name", "folder")}
        for r in rows
    }
    return models, PipelineModel.load(f"{path}/preprocessing"), results
