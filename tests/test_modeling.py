import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cuespark.functions.vectors import MAX_DOUBLE, fill_gaps
from cuespark.operators import evaluate, models, prepare, sampling

NAMES = ("A", "B", "C")


def blobs(spark, n=120, dim=6, classes=2, seed=0, shift=4.0, method=None):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = i % classes
        v = rng.normal(size=dim)
        v[c % dim] += shift
        rows.append((i, NAMES[c], v.tolist()))
    schema = "vec_id bigint, gender string, embedding array<double>"
    return spark.createDataFrame(rows, schema).coalesce(1)


def small(dim, k):
    return models.registry(dim, k, trees=5, depth=3, rounds=2, max_iter=30, mlp_layers=(8,), mlp_iter=60)


def test_gaps(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([1.0, nan, inf],), ([None, -inf, 2.0],)], "embedding array<double>")
    row = prepare.nan_audit(df).first()
    assert (row.n_rows, row.rows_with_gaps, row.any_gap) == (2, 2, True)
    got = [r[0] for r in df.select(fill_gaps(df.embedding)).collect()]
    assert got == [[1.0, 0.0, MAX_DOUBLE], [0.0, -MAX_DOUBLE, 2.0]]
    whole = spark.createDataFrame([([1.0, inf],)], "embedding array<double>")
    assert prepare.clean_features(whole) is whole  # infinities alone are left as they are


def test_moments_and_scaling_equal_numpy(spark):
    df = blobs(spark, 50)
    x = np.array([r.embedding for r in df.collect()])
    got = prepare.feature_moments(df).orderBy("dim").collect()
    np.testing.assert_allclose([r["mean"] for r in got], x.mean(0))
    np.testing.assert_allclose([r["std"] for r in got], x.std(0))
    data = prepare.prepare(df)
    train = {r.vec_id: r.features.toArray() for r in data.train.collect()}
    test = {r.vec_id: r.features.toArray() for r in data.test.collect()}
    assert len(train) == data.n_train == 40 and len(test) == data.n_test == 10
    base = x[sorted(train)]
    for i, v in {**train, **test}.items():
        np.testing.assert_allclose(v, (x[i] - base.mean(0)) / base.std(0), atol=1e-9)
    assert data.classes == ["A", "B"] and data.dim == 6


def test_constant_dimension_is_centred(spark):
    rows = [(i, NAMES[i % 2], [7.0, float(i)]) for i in range(20)]
    data = prepare.prepare(spark.createDataFrame(rows, "vec_id bigint, gender string, embedding array<double>"))
    assert {r.features[0] for r in data.train.collect()} == {0.0}


def test_labels_are_numbered_alphabetically(spark):
    df = blobs(spark, 90, classes=3)
    codes = {(r.gender, r.label) for r in prepare.prepare(df).train.collect()}
    assert codes == {("A", 0.0), ("B", 1.0), ("C", 2.0)}


def test_lasso_satisfies_the_optimality_conditions(spark):
    rng = np.random.default_rng(4)
    n, d, C = 400, 6, 1.0
    x = rng.normal(size=(n, d))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0).astype(float)
    df = spark.createDataFrame([(float(t), Vectors.dense(v)) for t, v in zip(y, x)], ["label", "features"])
    model = models.LassoLogistic(C=C).fit(df)
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = C * x.T @ (p - y)  # of the summed loss; the penalty is |w|
    for g, weight in zip(gradient, w):
        if weight != 0:
            assert g + np.sign(weight) == pytest.approx(0, abs=1e-2)
        else:
            assert abs(g) <= 1 + 1e-2
    assert (p - y).sum() == pytest.approx(0, abs=1e-2)


@pytest.mark.parametrize("classes", [2, 3])
def test_every_model_learns_separable_data(spark, classes):
    data = prepare.prepare(blobs(spark, 150, classes=classes))
    estimators = small(data.dim, classes)
    fitted, trained = models.train_models(data, estimators, cv_folds=None)
    assert set(fitted) == set(estimators)
    assert all(r["training_samples"] == data.n_train for r in trained.values())
    tested = models.evaluate_models(fitted, data)
    assert all(r["accuracy"] >= 0.85 for r in tested.values()), tested
    table = models.predict(fitted, data.test)
    assert table.count() == len(fitted) * data.n_test


def test_network_solves_xor(spark):
    rows = [(float(a ^ b), Vectors.dense([a, b])) for a in (0, 1) for b in (0, 1)] * 25
    df = spark.createDataFrame(rows, ["label", "features"])
    made = models.registry(2, 2, mlp_layers=(8,), mlp_iter=200, seed=1)[models.MLP]
    predicted = made.fit(df).transform(df)
    assert predicted.filter("label = prediction").count() == 100


def test_cross_validation_equals_its_folds(spark):
    df = blobs(spark, 100, shift=1.0)
    data = prepare.prepare(df)
    estimator = {models.LASSO: small(data.dim, 2)[models.LASSO]}
    _, trained = models.train_models(data, estimator, cv_folds=4)
    folded = sampling.stratified_folds(data.train, k=4)
    scores = []
    for f in range(4):
        model = estimator[models.LASSO].fit(folded.filter(f"fold != {f}"))
        scores.append(evaluate.accuracy(model.transform(folded.filter(f"fold = {f}"))).first().accuracy)
    got = trained[models.LASSO]
    assert got["cv_accuracy_mean"] == pytest.approx(np.mean(scores))
    assert got["cv_accuracy_std"] == pytest.approx(np.std(scores))


class Broken(Estimator):
    def _fit(self, dataset):
        raise RuntimeError("Training failed")


def test_a_failing_model_or_table_does_not_stop_the_others(spark):
    from pyspark.sql import functions as F

    good = blobs(spark).withColumn("method", F.lit("good"))
    tiny = good.limit(3).withColumn("method", F.lit("tiny"))
    make = lambda d, k: {"broken": Broken(), models.FOREST: small(d, k)[models.FOREST]}
    results = models.compare_methods(good.unionByName(tiny), make, cv_folds=None)
    rows = {(r.method, r.model): r for r in results.collect()}
    assert rows[("good", "broken")].error == "Training failed"
    assert rows[("good", models.FOREST)].accuracy > 0.85
    assert rows[("tiny", None)].error
    best = {r.method: r for r in models.comparison(results).collect()}
    assert best["good"].best_model == models.FOREST and best["good"].embedding_dimension == 6
    assert best["tiny"].best_model is None and best["tiny"].error


def test_tuning(spark):
    data = prepare.prepare(blobs(spark, 80, shift=1.0))
    estimators = small(data.dim, 2)
    found = models.tune(data, models.LASSO, estimators, cv_folds=2)
    assert len(found["cv_results"]) == 5
    assert found["best_score"] == max(r["mean"] for r in found["cv_results"])
    assert list(found["models"]) == ["Lasso Logistic_tuned"]
    assert len(models.param_grid(models.FOREST, estimators[models.FOREST])) == 36
    assert models.tune(data, models.MLP, estimators) == {}
    with pytest.raises(ValueError, match="Logistic Regression"):
        models.tune(data, "Logistic Regression", estimators)


def test_saved_models_predict_the_same(spark, tmp_path):
    data = prepare.prepare(blobs(spark, 90, classes=3))
    fitted, trained = models.train_models(data, small(data.dim, 3), cv_folds=None)
    path = f"{tmp_path}/models"
    models.save_models(spark, path, fitted, data.preprocessing, trained)
    loaded, preprocessing, results = models.load_models(spark, path)
    assert set(loaded) == set(fitted)
    assert results[models.LASSO]["training_samples"] == data.n_train
    again = preprocessing.transform(blobs(spark, 90, classes=3))
    rows = lambda df: sorted(df.collect(), key=str)
    test_ids = data.test.select("vec_id")
    assert rows(models.predict(fitted, data.test)) == rows(
        models.predict(loaded, again.join(test_ids, "vec_id")))
    with pytest.raises(FileNotFoundError):
        models.load_models(spark, f"{tmp_path}/nothing")


def test_errors_are_saved_and_loaded(spark, tmp_path):
    data = prepare.prepare(blobs(spark, 90))
    chosen = {models.LASSO: small(data.dim, 2)[models.LASSO], "broken": object()}
    fitted, trained = models.train_models(data, chosen, cv_folds=None)
    assert "fit" in trained["broken"]["error"]
    models.save_models(spark, f"{tmp_path}/m", fitted, data.preprocessing, trained)
    loaded, _, results = models.load_models(spark, f"{tmp_path}/m")
    assert set(loaded) == {models.LASSO} and results["broken"]["error"] == trained["broken"]["error"]
    assert "error" in models.tune(data, "broken", chosen, grid=[{}], cv_folds=2)


def test_a_comparison_saves_the_models_of_every_method(spark, tmp_path):
    both = blobs(spark, 60).withColumn("method", F.lit("a")).unionByName(
        blobs(spark, 60).withColumn("method", F.lit("b")))
    make = lambda d, k: {models.LASSO: small(d, k)[models.LASSO], "broken": object()}
    results = models.compare_methods(both, make, cv_folds=None, save_to=str(tmp_path))
    assert {r.method: r.error for r in models.comparison(results).collect()} == {"a": None, "b": None}
    for method in "ab":
        loaded, _, kept = models.load_models(spark, f"{tmp_path}/{method}")
        assert set(loaded) == {models.LASSO} and kept["broken"]["error"]


def test_defaults_follow_the_study():
    made = models.registry(768, 2)
    lasso, forest = made[models.LASSO], made[models.FOREST]
    assert lasso.getOrDefault(lasso.C) == 1000.0 and lasso.getMaxIter() == 2000
    assert forest.getNumTrees() == 300 and forest.getMaxDepth() == 30
    assert list(made[models.MLP].getLayers()) == [768, 512, 256, 128, 2]
    assert made[models.BOOSTED_SLOW].getStepSize() == 0.05
    assert made[models.BOOSTED_DEEP].getMaxDepth() == 6
    assert models.registry(4, 2, seed=0)[models.FOREST].getSeed() == 0


PAIRS = [("A", "A")] * 5 + [("A", "B")] * 2 + [("B", "B")] * 3 + [("C", "A")] * 1 + [("B", "D")] * 2


@pytest.fixture
def judged(spark):
    return spark.createDataFrame(PAIRS, "label string, prediction string")


def test_confusion_matrix_has_zero_cells(judged):
    got = {(r.label, r.prediction): r.n for r in evaluate.confusion_matrix(judged).collect()}
    assert len(got) == 16 and sum(got.values()) == len(PAIRS)
    assert got[("A", "B")] == 2 and got[("D", "D")] == 0 and got[("C", "A")] == 1


def test_classification_report(judged):
    got = {r["class"]: r for r in evaluate.classification_report(judged).collect()}
    assert got["A"].precision == pytest.approx(5 / 6) and got["A"].recall == pytest.approx(5 / 7)
    assert got["C"].precision == 0 and got["D"].recall == 0 and got["D"].support == 0
    assert got["accuracy"].precision == pytest.approx(8 / 13)
    per_class = [got[c] for c in "ABCD"]
    assert got["macro avg"].f1_score == pytest.approx(np.mean([r.f1_score for r in per_class]))
    weighted = sum(r.recall * r.support for r in per_class) / 13
    assert got["weighted avg"].recall == pytest.approx(weighted)


def test_best_model_first_wins_ties(spark):
    rows = [("m", "x", 0, 0.5), ("m", "y", 1, 0.7), ("m", "z", 2, 0.7), ("m", "e", 3, None),
            ("n", "e", 0, None)]
    best = evaluate.best_model(
        spark.createDataFrame(rows, "method string, model string, ord bigint, accuracy double"))
    got = {r.method: r for r in best.collect()}
    assert (got["m"].best_model, got["m"].best_accuracy) == ("y", 0.7)
    assert got["m"].model_results == {"x": 0.5, "y": 0.7, "z": 0.7}
    assert got["n"].best_model == "e" and got["n"].best_accuracy is None
    assert [r.method for r in evaluate.method_ranking(best).collect()] == ["m", "n"]
