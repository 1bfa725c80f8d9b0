"""A network trained by mini-batches: synchronous steps over rows that stay in their tasks.

Rows are dealt once, in the order of a hash, into batches of equal size.  A step takes some of them:
every task computes the gradients of its batches, they are added up as a tree, and Adam moves the
weights.  Where a step is one batch, nothing can be computed side by side: an epoch is cut into runs
of batches, and a task takes the weights through one run and hands them on.  A batch is normalised by its own mean and variance, and its dropout comes from its number,
so that the weights do not depend on how many tasks there are.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON, MOMENTUM = 1e-5, 0.1  # of batch normalisation
RUN_ROWS = 65_536  # rows of the steps that a task takes one after another


@dataclass
class Settings:
    hidden: tuple[int, ...] = (512, 256, 128)
    epochs: int = 20
    batch: int = 32  # rows that are normalised together
    per_step: int = 1  # batches of a step
    rate: float = 1e-3
    dropout: float = 0.3
    validation: float = 0.2
    seed: int = 42


Weights = list[np.ndarray]  # per hidden layer W, b, gain, shift, mean, variance; then W, b


def start_weights(sizes: list[int], seed: int) -> Weights:
    """Uniform within 1 / sqrt(inputs), as usual for linear layers."""
    rng = np.random.default_rng(seed)
    out: Weights = []
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        bound = 1 / np.sqrt(a)
        out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
        if i < len(sizes) - 2:
            out += [np.ones(b), np.zeros(b), np.zeros(b), np.ones(b)]
    return out


def trained(weights: Weights) -> list[int]:
    """Which of the weights gradients move: all but means and variances."""
    return [i for i in range(len(weights)) if i % 6 < 4]


def gradients(
    weights: Weights, x: np.ndarray, label: np.ndarray, dropout: float, rng: np.random.Generator
) -> tuple[float, list[np.ndarray]]:
    """Of a batch: the summed loss, and per weight the gradient of the summed loss, or for means and
    variances the batch's own times its rows.
    """
    n = len(x)
    steps = []
    h = x
    layers = len(weights) // 6
    for k in range(layers):
        w, b, gain, shift = weights[6 * k : 6 * k + 4]
        z = h @ w + b
        mean, variance = z.mean(0), z.var(0)
        scale = 1 / np.sqrt(variance + EPSILON)
        even = (z - mean) * scale
        y = even * gain + shift
        mask = (rng.random(y.shape) >= dropout) / (1 - dropout) if dropout else np.ones(y.shape)
        steps.append((h, even, scale, y > 0, mask, mean, variance))
        h = np.maximum(y, 0) * mask
    w, b = weights[-2:]
    logits = h @ w + b
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(n), label], 1e-300)).sum()
    d = p
    d[np.arange(n), label] -= 1
    out: list[np.ndarray] = [h.T @ d, d.sum(0)]
    d = d @ w.T
    for k in range(layers - 1, -1, -1):
        below, even, scale, open_, mask, mean, variance = steps[k]
        w, _, gain, _ = weights[6 * k : 6 * k + 4]
        d = d * mask * open_
        g_gain, g_shift = (d * even).sum(0), d.sum(0)
        d = d * gain
        d = scale * (d - d.mean(0) - even * (d * even).mean(0))
        unbiased = variance * n / max(1, n - 1)
        out = [below.T @ d, d.sum(0), g_gain, g_shift, mean * n, unbiased * n, *out]
        d = d @ w.T
    return float(loss), out


def forward(weights: Weights, x: np.ndarray) -> np.ndarray:
    """Probabilities, normalised by the running means and variances."""
    h = x
    for k in range(len(weights) // 6):
        w, b, gain, shift, mean, variance = weights[6 * k : 6 * k + 6]
        h = np.maximum(((h @ w + b) - mean) / np.sqrt(variance + EPSILON) * gain + shift, 0)
    logits = h @ weights[-2] + weights[-1]
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Adam:
    def __init__(self, weights: Weights, rate: float):
        self.rate, self.turn = rate, 0
        self.first = [np.zeros_like(w) for w in weights]
        self.second = [np.zeros_like(w) for w in weights]

    def move(self, weights: Weights, gradient: Weights) -> Weights:
        self.turn += 1
        out = list(weights)
        for i in trained(weights):
            first, second, g = self.first[i], self.second[i], gradient[i]
            first *= 0.9
            first += 0.1 * g
            second *= 0.999
            square = 0.001 * g
            square *= g
            second += square
            np.divide(second, 1 - 0.999**self.turn, out=square)
            np.sqrt(square, out=square)
            square += 1e-8
            np.divide(first, square, out=square)
            square *= self.rate / (1 - 0.9**self.turn)
            out[i] = weights[i] - square
        return out

    def state(self) -> tuple[int, Weights, Weights]:
        return self.turn, self.first, self.second

    def resume(self, state: tuple[int, Weights, Weights]) -> Adam:
        self.turn, self.first, self.second = state[0], *([w.copy() for w in part] for part in state[1:])
        return self


def moved(weights: Weights, adam: Adam, total: Weights, n: int) -> Weights:
    """The weights after a step over n rows with these summed gradients."""
    mean = [t / n for t in total]
    after = adam.move(weights, mean)
    for i in range(len(weights)):
        if i % 6 >= 4:
            after[i] = (1 - MOMENTUM) * weights[i] + MOMENTUM * mean[i]
    return after


def epoch_order(batches: int, seed: int, epoch: int) -> np.ndarray:
    """The step order of the batches: batch number -> its place in the epoch."""
    return np.random.default_rng([seed, epoch]).permutation(batches)


def _batches(data: DataFrame, s: Settings, tasks: int):
    """(number, x, label) of batches of `s.batch` rows in the order of a hash, and how many there are."""
    dealt = data.repartitionByRange("_hash", "x").sortWithinPartitions("_hash", "x").select("x", "label")
    numbered = dealt.rdd.map(lambda r: (r[0], r[1])).zipWithIndex()
    size = s.batch

    def packed(item):
        number, rows = item
        rows = sorted(rows)
        return number, np.array([x for _, x, _ in rows]), np.array([y for _, _, y in rows], np.int64)

    grouped = numbered.map(lambda r: (r[1] // size, (r[1], r[0][0], r[0][1]))).groupByKey(tasks)
    made = grouped.map(packed).persist(StorageLevel.MEMORY_AND_DISK)
    return made, made.count()


def fit_network(
    data: DataFrame, s: Settings, features: str = "features", label: str = "label", tasks: int | None = None
) -> tuple[Weights, list[float]]:
    """The weights of the best epoch by accuracy on rows set aside, the first of equals; and the
    accuracy of each epoch.

    Rows are set aside by a hash of their values, `s.validation` of them; without any, the training
    rows are judged.  With 0 epochs the weights are those of the start.  data should be stored or
    persisted.
    """
    sc = data.sparkSession.sparkContext
    tasks = tasks or sc.defaultParallelism
    rows = data.select(
        vector_to_array(features).alias("x"), F.col(label).cast("int").alias("label")
    ).withColumn("_hash", F.xxhash64(F.lit(s.seed), "x", "label"))
    ends = rows.agg(F.max("label"), F.max(F.size("x"))).first()
    aside = F.pmod(F.xxhash64(F.lit(-1 - s.seed), "x", "label"), F.lit(10_000)) < int(10_000 * s.validation)
    weights = start_weights([ends[1], *s.hidden, max(1, ends[0]) + 1], s.seed)
    train, batches = _batches(rows.filter(~aside), s, tasks)
    held, n_held = _batches(rows.filter(aside), Settings(batch=1024, seed=s.seed), tasks)
    judged = held if n_held else train
    adam, best, scores = Adam(weights, s.rate), (-1.0, weights), []
    steps = -(-batches // s.per_step)
    for epoch in range(s.epochs):
        place = epoch_order(batches, s.seed, epoch)
        if s.per_step == 1:
            weights = _chain(sc, train, place, weights, adam, s, epoch)
        else:
            for step in range(steps):
                chosen = frozenset(np.flatnonzero(place // s.per_step == step).tolist())
                weights = moved(weights, adam, *_step(sc, train, chosen, weights, s, epoch))
        score = _accuracy(sc, judged, weights)
        scores.append(score)
        if score > best[0]:
            best = (score, [w.copy() for w in weights])
    train.unpersist()
    held.unpersist()
    return best[1], scores


def _chain(sc, train, place: np.ndarray, weights: Weights, adam: Adam, s: Settings, epoch: int) -> Weights:
    """The weights after an epoch of steps of one batch each; adam moves along."""
    size = max(1, RUN_ROWS // s.batch)
    order = sc.broadcast(place)
    runs = train.map(lambda item: (int(order.value[item[0]]), item)).partitionBy(
        -(-len(place) // size), lambda at: at // size
    )
    seed, dropout, rate = s.seed, s.dropout, s.rate
    for run in range(runs.getNumPartitions()):
        held = sc.broadcast((weights, adam.state()))

        def follow(items, held=held):
            weights, state = held.value
            own = Adam(weights, rate).resume(state)
            for _, (number, x, label) in sorted(items, key=lambda item: item[0]):
                rng = np.random.default_rng([seed, epoch, number])
                weights = moved(weights, own, gradients(weights, x, label, dropout, rng)[1], len(x))
            return [(weights, own.state())]

        weights, state = sc.runJob(runs, follow, [run])[0]
        adam.resume(state)
        held.unpersist()
    order.unpersist()
    return weights


def _step(sc, train, chosen: frozenset, weights: Weights, s: Settings, epoch: int) -> tuple[Weights, int]:
    """Summed gradients of the chosen batches, and their rows."""
    held = sc.broadcast(weights)
    seed, dropout = s.seed, s.dropout

    def own(items):
        total, n = None, 0
        for number, x, label in items:
            if number in chosen:
                rng = np.random.default_rng([seed, epoch, number])
                _, g = gradients(held.value, x, label, dropout, rng)
                total = g if total is None else [a + b for a, b in zip(total, g)]
                n += len(x)
        return [(total, n)] if n else []

    def add(a, b):
        return [x + y for x, y in zip(a[0], b[0])], a[1] + b[1]

    found = train.mapPartitions(own).treeReduce(add)
    held.unpersist()
    return found


def _accuracy(sc, rows, weights: Weights) -> float:
    held = sc.broadcast(weights)

    def own(item):
        _, x, label = item
        return int((forward(held.value, x).argmax(1) == label).sum()), len(x)

    hits, n = rows.map(own).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    held.unpersist()
    return hits / n


# Spark ML.


class _Network(HasFeaturesCol, HasLabelCol, HasSeed):
    pass


class MiniBatchNetwork(Estimator, _Network):
    """The study's network as an estimator; see `fit_network`.  `layers` holds all sizes."""

    layers = Param(Params._dummy(), "layers", "inputs, hidden sizes, classes", TypeConverters.toListInt)
    epochs = Param(Params._dummy(), "epochs", "passes over the rows", TypeConverters.toInt)
    batch = Param(Params._dummy(), "batch", "rows that are normalised together", TypeConverters.toInt)
    perStep = Param(Params._dummy(), "perStep", "batches of a step", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "Adam's step", TypeConverters.toFloat)
    dropout = Param(Params._dummy(), "dropout", "share of dropped units", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", seed=42, layers=None, epochs=20, batch=32,
        perStep=1, rate=1e-3, dropout=0.3,
    ):
        super().__init__()
        self._set(**{
            "featuresCol": "features", "labelCol": "label", "seed": 42, "epochs": 20, "batch": 32,
            "perStep": 1, "rate": 1e-3, "dropout": 0.3, **self._input_kwargs,
        })

    def getLayers(self) -> list[int]:
        return self.getOrDefault(self.layers)

    def _fit(self, dataset: DataFrame) -> MiniBatchNetworkModel:
        def get(p):
            return self.getOrDefault(p)

        s = Settings(
            tuple(get(self.layers)[1:-1]), get(self.epochs), get(self.batch), get(self.perStep),
            get(self.rate), get(self.dropout), seed=self.getSeed(),
        )
        weights, scores = fit_network(dataset, s, self.getFeaturesCol(), self.getLabelCol())
        made = [[w.shape, base64.b64encode(w.astype("<f8").tobytes()).decode()] for w in weights]
        return MiniBatchNetworkModel(
            featuresCol=self.getFeaturesCol(), content=json.dumps({"weights": made, "scores": scores})
        )


def weights_of(content: str) -> Weights:
    return [
        np.frombuffer(base64.b64decode(data), "<f8").reshape(shape)
        for shape, data in json.loads(content)["weights"]
    ]


class MiniBatchNetworkModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `probability` (vector) and `prediction`; of equal probabilities the first class."""

    content = Param(Params._dummy(), "content", "weights and validation scores as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", content=None):
        super().__init__()
        self._set(**{"featuresCol": featuresCol, **self._input_kwargs})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = dataset.sparkSession.sparkContext.broadcast(self.getOrDefault(self.content))

        @F.pandas_udf("array<double>")
        def probability(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights = weights_of(held.value)
            for column in columns:
                x = np.stack(column.to_numpy()) if len(column) else np.empty((0, len(weights[0])))
                yield pd.Series(list(forward(weights, x)), dtype=object)

        found = dataset.withColumn("_p", probability(vector_to_array(self.getFeaturesCol())))
        return found.withColumn("probability", array_to_vector("_p")).withColumn(
            "prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        ).drop("_p")
