"""Boosted trees against an implementation that looks at every value of every leaf."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from test_modeling import blobs

from cuespark.operators import boosting, evaluate, models, prepare, sampling


def table(spark, x, y, parts=3, folds=None):
    rows = [
        (i, float(t), Vectors.dense(v), int(folds[i]) if folds is not None else 0)
        for i, (t, v) in enumerate(zip(y, x))
    ]
    return spark.createDataFrame(rows, ["id", "label", "features", "fold"]).repartition(parts)


def data_of(seed, n=240, d=5, classes=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(3)
    y = np.digitize(x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + 0.1 * rng.normal(size=n), [0.0, 0.6][: classes - 1])
    return x, y


def simple_fit(x, y, s, classes):
    """Margins of all rows after every round: leaf by leaf, every value a cut, nothing sampled."""
    outputs = 1 if classes == 2 else classes
    share = np.bincount(y, minlength=classes) / len(y)
    margin = np.tile([np.log(share[1] / share[0])] if outputs == 1 else np.log(share), (len(y), 1))
    for turn in range(s.rounds):
        new = margin.copy()
        for o in range(outputs):
            if outputs == 1:
                p = 1 / (1 + np.exp(-margin[:, 0]))
                g, h = p - (y == 1), p * (1 - p)
            else:
                e = np.exp(margin)
                p = e[:, o] / e.sum(1)
                g, h = p - (y == o), p * (1 - p) * classes / (classes - 1)

            def gain(at):
                best = (0.0, None)
                g0, h0 = g[at].sum(), h[at].sum()
                for j in range(x.shape[1]):
                    for cut in np.unique(x[at, j])[:-1]:
                        left = at & (x[:, j] <= cut)
                        right = at & ~left
                        if min(left.sum(), right.sum()) < s.min_rows:
                            continue
                        v = (g[left].sum() ** 2 / (h[left].sum() + s.l2)
                             + g[right].sum() ** 2 / (h[right].sum() + s.l2) - g0**2 / (h0 + s.l2))
                        if v > best[0] + 1e-9:
                            best = (v, (left, right))
                return best

            leaves = [(np.ones(len(y), bool), 0)]
            gains = [gain(leaves[0][0])]
            while len(leaves) < s.leaves:
                open_ = [i for i in range(len(leaves)) if gains[i][1] and (not s.depth or leaves[i][1] < s.depth)]
                if not open_:
                    break
                i = max(open_, key=lambda k: gains[k][0])
                (_, depth), (_, pair) = leaves.pop(i), gains.pop(i)
                for part in pair:
                    leaves.append((part, depth + 1))
                    gains.append(gain(part))
            for at, _ in leaves:
                new[at, o] -= s.rate * g[at].sum() / (h[at].sum() + s.l2)
        margin = new
    return margin


@pytest.mark.parametrize("classes, growth", [(2, "leaf"), (3, "leaf"), (2, "level")])
def test_trees_equal_an_exhaustive_search(spark, classes, growth):
    x, y = data_of(classes, classes=classes)
    level = growth == "level"
    estimator = boosting.BoostedTrees(
        rounds=4, rate=0.3, growth=growth, leaves=7, depth=3 if level else 0, rowShare=1.0, columnShare=1.0,
        l2=0.5, minRows=8, minHessian=0.0,
    )
    s = estimator.settings()
    model = estimator.fit(table(spark, x, y))
    want = simple_fit(x, y, boosting.Settings(**{**s.__dict__, "leaves": 10**6 if level else 7}), classes)
    e = np.exp(want - want.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True) if classes > 2 else np.c_[1 / (1 + np.exp(want)), 1 / (1 + np.exp(-want))]
    found = {r.id: r for r in model.transform(table(spark, x, y)).collect()}
    got = np.array([found[i].probability.toArray() for i in range(len(y))])
    np.testing.assert_allclose(got, p, atol=1e-5)
    assert [found[i].prediction for i in range(len(y))] == got.argmax(1).tolist()
    _, _, turns = boosting.trees_of(model.getOrDefault(model.content))
    assert all(t.feature.count(-1) <= (8 if level else 7) for turn in turns for t in turn)


def test_trees_do_not_depend_on_the_tasks(spark):
    x, y = data_of(5, n=3000)
    estimator = boosting.BoostedTrees(rounds=3, bins=15)
    contents = {
        (m := estimator.fit(table(spark, x, y, parts))).getOrDefault(m.content) for parts in (1, 5)
    }
    assert len(contents) == 1


def test_samples_are_shares_of_rows_and_columns():
    key = boosting._row_keys(np.random.default_rng(1).normal(size=(20_000, 3)), np.zeros(20_000, int))
    kept = [boosting.chosen_rows(key, 0.8, 42, turn) for turn in range(3)]
    assert all(abs(k.mean() - 0.8) < 0.02 for k in kept) and (kept[0] != kept[1]).any()
    assert len(boosting.chosen_columns(10, boosting.Settings(), 3)) == 8
    assert boosting.chosen_rows(key, 1.0, 42, 0).all()


def test_folds_equal_separate_fits(spark):
    x, y = data_of(8, n=300)
    folds = np.arange(300) % 3
    estimator = boosting.BoostedTrees(rounds=5, leaves=6, bins=400)
    together = estimator.fit_folds(table(spark, x, y, folds=folds), 3)
    assert len(together) == 4
    for fold in (None, 0, 2):
        rows = table(spark, x, y, folds=folds)
        alone = estimator.fit(rows if fold is None else rows.filter(f"fold <> {fold}"))
        both = [
            {r.id: r.prediction for r in m.transform(rows).collect()}
            for m in (alone, together[0 if fold is None else fold + 1])
        ]
        # the cut points come from all rows there, and from the fold's rows here
        same = sum(both[0][i] == both[1][i] for i in both[0]) / 300
        assert same == 1.0 if fold is None else same > 0.93


def test_cut_points_are_ranks(spark):
    values = np.random.default_rng(3).integers(0, 40, 5000).astype(float)
    points = boosting._summary(values[:1000])
    for i in range(1000, 5000, 1000):
        points = boosting._merged(points, boosting._summary(values[i : i + 1000]))
    ordered = np.sort(values)
    want = {ordered[int(np.ceil(k * 5000 / 16)) - 1] for k in range(1, 16)}
    assert boosting._cuts(*points, 16).tolist() == sorted(want)
    big = boosting._summary(np.arange(100_000.0))
    assert len(big[0]) == boosting.POINTS and big[1].sum() == 100_000


def test_many_blocks_are_merged_within_bounds():
    points = boosting._summary(np.arange(2048.0))
    for i in range(1, 200):
        points = boosting._merged(points, boosting._summary(np.arange(2048.0) + i * 2048))
    assert len(points[0]) <= 64 * boosting.POINTS and points[1].sum() == 200 * 2048
    cuts = boosting._cuts(*points, 10)
    np.testing.assert_allclose(cuts, np.arange(1, 10) * 40_960 - 1, atol=400)


def test_odd_tables(spark, tmp_path):
    x = np.c_[np.full(60, 7.0), np.arange(60) % 2]
    one = boosting.BoostedTrees(rounds=2, minRows=1).fit(table(spark, x, np.arange(60) % 2))
    out = one.transform(table(spark, x, np.arange(60) % 2))
    assert out.filter("label = prediction").count() == 60
    same = boosting.BoostedTrees(rounds=2, rowShare=1.0).fit(table(spark, x[:, :1], np.arange(60) % 2))
    assert {tuple(r.probability.toArray()) for r in same.transform(table(spark, x[:, :1], x[:, 1])).collect()} == {(0.5, 0.5)}
    PipelineModel([one]).write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m")).stages[0]
    assert loaded.transform(out.drop("probability", "prediction")).filter("label = prediction").count() == 60


def test_cross_validation_uses_the_fold_models(spark):
    data = prepare.prepare(blobs(spark, 120, shift=2.0))
    estimator = boosting.BoostedTrees(rounds=4, minRows=3)
    fitted, results = models.train_models(data, {models.BOOSTED_SLOW: estimator}, cv_folds=3)
    folded = sampling.stratified_folds(data.train, k=3)
    made = estimator.fit_folds(folded, 3)
    scores = [
        evaluate.accuracy(made[f + 1].transform(folded.filter(f"fold = {f}"))).first().accuracy
        for f in range(3)
    ]
    got = results[models.BOOSTED_SLOW]
    assert got["cv_accuracy_mean"] == pytest.approx(np.mean(scores))
    assert got["cv_accuracy_std"] == pytest.approx(np.std(scores))


@pytest.mark.parametrize("parts", [1, 4])
def test_cuts_of_large_blocks_are_exact_ranks(spark, parts):
    rng = np.random.default_rng(8)
    x = np.stack([rng.normal(size=30_000), rng.integers(0, 40, 30_000), rng.normal(size=30_000) ** 5], 1)
    x[::3, 2] = 7.0  # a heavy value
    none = np.zeros(0)
    blocks = spark.sparkContext.parallelize([(b, none, none) for b in np.array_split(x, parts)], parts)
    ranks = np.ceil(np.arange(1, 255) * 30_000 / 255 - 1e-9).astype(int) - 1
    for found, column in zip(boosting._edges(blocks, 255), x.T):
        assert found.tolist() == np.unique(np.sort(column)[ranks]).tolist()


@pytest.mark.parametrize("classes, growth", [(3, "leaf"), (2, "level")])
def test_a_task_grows_the_trees_of_the_passes(spark, monkeypatch, classes, growth):
    x, y = data_of(classes, n=600, d=6, classes=classes)
    x[:90, 1] = 0.25  # many equal values
    rows = table(spark, x, y, folds=np.arange(600) % 2).persist()
    estimator = boosting.BoostedTrees(
        rounds=2, growth=growth, leaves=6, depth=3 if growth == "level" else 0, bins=31, minRows=5
    )

    def contents():
        return [m.getOrDefault(m.content) for m in estimator.fit_folds(rows, 2)]

    local = contents()
    monkeypatch.setattr(boosting, "KEPT_CELLS", 0)
    assert contents() == local and len(set(local)) == 3
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 0)
    assert contents() == local
