"""The mini-batch network: gradients, steps, and what it learns."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from test_modeling import blobs

from cuespark.operators import network, prepare


def table(spark, x, y):
    return spark.createDataFrame([(float(t), Vectors.dense(v)) for t, v in zip(y, x)], ["label", "features"])


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 3, 9)
    weights = network.start_weights([4, 6, 5, 3], 1)

    def loss(w):
        return network.gradients(w, x, y, 0.3, np.random.default_rng(5))[0]

    _, found = network.gradients(weights, x, y, 0.3, np.random.default_rng(5))
    for i in network.trained(weights):
        for at in list(np.ndindex(weights[i].shape))[:6]:
            up, down = ([w.copy() for w in weights] for _ in range(2))
            up[i][at] += 1e-6
            down[i][at] -= 1e-6
            assert found[i][at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-4)


def test_training_equals_the_same_steps_in_one_place(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(70, 3)), rng.integers(0, 2, 70)
    s = network.Settings((5,), epochs=2, batch=16, per_step=2, dropout=0.2, validation=0.0)
    data = table(spark, x, y).repartition(3)
    one, scores = network.fit_network(data, s, tasks=1)
    many, same = network.fit_network(data.repartition(5), s, tasks=6)
    assert scores == same and all(np.allclose(a, b, atol=1e-12) for a, b in zip(one, many))

    made, n = network._batches(_rows(data, s), s, 2)
    batches = {i: (bx, by) for i, bx, by in made.collect()}
    assert n == 5 and sorted(len(b[0]) for b in batches.values()) == [6, 16, 16, 16, 16]
    weights = network.start_weights([3, 5, 2], s.seed)
    adam, best = network.Adam(weights, s.rate), (-1, None)
    for epoch in range(2):
        place = network.epoch_order(n, s.seed, epoch)
        for step in range(3):
            parts = [
                (network.gradients(weights, *batches[i], 0.2, np.random.default_rng([s.seed, epoch, i]))[1],
                 len(batches[i][0]))
                for i in range(n) if place[i] // 2 == step
            ]
            rows = sum(k for _, k in parts)
            mean = [sum(g[i] for g, _ in parts) / rows for i in range(len(weights))]
            weights = adam.move(weights, mean)
            for i in (4, 5):
                weights[i] = 0.9 * weights[i] + 0.1 * mean[i]
        score = (network.forward(weights, x).argmax(1) == y).mean()
        if score > best[0]:
            best = (score, [w.copy() for w in weights])
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(one, best[1]))
    assert max(scores) == best[0]


def test_steps_of_one_batch_are_no_jobs_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 2, 400)
    data = table(spark, x, y)
    s = network.Settings((5,), epochs=2, batch=8, dropout=0.2, validation=0.0)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    one, scores = network.fit_network(data, s, tasks=3)
    assert len(tracker.getJobIdsForGroup("chain")) < 25  # 100 steps
    spark.sparkContext.setJobGroup("other", "other")
    monkeypatch.setattr(network, "RUN_ROWS", 56)
    many, same = network.fit_network(data.repartition(4), s, tasks=2)
    assert scores == same and all(np.array_equal(a, b) for a, b in zip(one, many))

    made, n = network._batches(_rows(data, s), s, 2)
    batches = {i: (bx, by) for i, bx, by in made.collect()}
    weights = network.start_weights([3, 5, 2], s.seed)
    adam, best = network.Adam(weights, s.rate), (-1, None)
    for epoch in range(2):
        for i in np.argsort(network.epoch_order(n, s.seed, epoch)):
            g = network.gradients(weights, *batches[i], 0.2, np.random.default_rng([s.seed, epoch, i]))[1]
            mean = [v / len(batches[i][0]) for v in g]
            moved = adam.move(weights, mean)
            for k in (4, 5):
                moved[k] = 0.9 * weights[k] + 0.1 * mean[k]
            weights = moved
        score = (network.forward(weights, x).argmax(1) == y).mean()
        if score > best[0]:
            best = (score, [w.copy() for w in weights])
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(one, best[1]))


def _rows(data, s):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    return data.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label")).withColumn(
        "_hash", F.xxhash64(F.lit(s.seed), "x", "label"))


def test_no_epoch_leaves_the_start(spark):
    s = network.Settings((4,), epochs=0)
    weights, scores = network.fit_network(table(spark, np.eye(4), [0, 1, 0, 1]), s)
    assert scores == [] and [w.shape for w in weights] == [(4, 4), (4,), (4,), (4,), (4,), (4,), (4, 2), (2,)]
    assert network.forward(weights, np.ones((10, 4))).shape == (10, 2)


def test_it_learns_what_no_line_parts(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    made = network.MiniBatchNetwork(
        layers=[2, 24, 2], epochs=20, batch=64, rate=0.03, dropout=0.0, seed=1
    ).fit(table(spark, x, y).repartition(2))
    assert made.transform(table(spark, x, y)).filter("label = prediction").count() >= 380
    PipelineModel([made]).write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m")).stages[0]
    assert loaded.transform(table(spark, x, y)).filter("label = prediction").count() >= 380


def test_three_classes(spark):
    data = prepare.prepare(blobs(spark, 180, classes=3))
    made = network.MiniBatchNetwork(
        layers=[data.dim, 16, 3], epochs=10, perStep=2, rate=0.02, dropout=0.1).fit(data.train)
    out = made.transform(data.test)
    assert out.filter("label = prediction").count() >= 0.85 * data.n_test
    assert made.transform(data.test.limit(0)).count() == 0
