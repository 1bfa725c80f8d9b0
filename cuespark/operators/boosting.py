"""Gradient boosted trees from histograms: leaf by leaf or level by level, several fits in one pass.

A pass over the rows adds up, for every open leaf of every tree that grows, first and second order
gradients by feature and bin; the sums are reduced by key, and the best split of each leaf is found
where they meet.  Only splits reach the driver.

Trees that do not depend on each other grow in the same passes: those of all classes, and those of
all folds of a cross-validation.  Where all rows are few enough for a task, a task takes them through all
rounds of a fit, and passes are calls.  Gradients are added up as whole numbers, so that the trees do not
depend on how the rows are dealt.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.session import stored, work_folder

UNIT = float(1 << 24)  # gradients are whole multiples of 1 / UNIT
BLOCK_ROWS = 65_536  # rows that are taken together in a task
BLOCK_FEATURES = 64  # features whose sums are reduced together
POINTS = 2_048  # order statistics that stand for a block's values of a feature
NEAR = 16  # points near each cut between which rows are counted
CUT_ROUNDS = 25  # rounds after which the rows' state is written and lineage cut
LOCAL_CELLS = 1 << 25  # rows times features up to which one task makes all rounds of a fit
KEPT_CELLS = 1 << 16  # cells of a node up to which such a task keeps its sums for the children


# Trees.


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1.  Rows with value <= threshold go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, threshold: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.threshold[node] = feature, bin_, threshold
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for column, new in (
            (self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0),
            (self.value, 0.0),
        ):
            column += [new, new]
        return self.left[node], self.right[node]

    def leaves(self, rows: np.ndarray, binned: bool, node: np.ndarray | None = None) -> np.ndarray:
        """The leaf of every row; rows hold bins or values, `node` where they have got to before."""
        node = np.zeros(len(rows), np.int32) if node is None else node
        feature, left, right = (np.array(x, np.int32) for x in (self.feature, self.left, self.right))
        cut = np.array(self.bin if binned else self.threshold)
        while True:
            own = feature[node]
            inner = np.flatnonzero(own >= 0)
            if not len(inner):
                return node
            at = node[inner]
            lower = rows[inner, own[inner]] <= cut[at]
            node[inner] = np.where(lower, left[at], right[at])


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    #: (gradient, hessian, rows) of the node, and of its left child
    total: tuple[int, int, int]
    left: tuple[int, int, int]

    def right(self) -> tuple[int, int, int]:
        return tuple(t - x for t, x in zip(self.total, self.left))


@dataclass
class Settings:
    rounds: int = 300
    rate: float = 0.1
    leaves: int = 31
    depth: int = 0  # 0: no limit
    by_level: bool = False
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 255
    l2: float = 0.0
    min_rows: int = 20
    min_hessian: float = 1e-3
    seed: int = 42


def leaf_value(total: tuple[int, int, int], s: Settings) -> float:
    return -(total[0] / UNIT) / (total[1] / UNIT + s.l2 + 1e-12)


def score(g, h, l2: float):
    return (g / UNIT) ** 2 / (h / UNIT + l2 + 1e-12)


def best_split(sums: np.ndarray, features: np.ndarray, s: Settings) -> Split | None:
    """Of sums (features, bins, 3): the split of the largest gain, of equal ones the first feature and
    bin.  A node without a gain above zero keeps its totals with feature -1.
    """
    left = np.cumsum(np.moveaxis(sums, -1, 0), axis=2)  # (3, features, bins)
    total = left[:, :1, -1:]
    right = total - left
    fits = (
        (left[2] >= s.min_rows) & (right[2] >= s.min_rows)
        & (left[1] >= s.min_hessian * UNIT) & (right[1] >= s.min_hessian * UNIT)
    )
    gains = (
        score(left[0], left[1], s.l2) + score(right[0], right[1], s.l2)
        - score(total[0, 0, 0], total[1, 0, 0], s.l2)
    )
    gains[~fits] = -np.inf
    row, bin_ = np.unravel_index(np.argmax(gains), gains.shape)
    whole = tuple(int(x) for x in total[:, 0, 0])
    if not gains[row, bin_] > 1e-9:
        return Split(0.0, -1, 0, whole, whole)
    return Split(
        float(gains[row, bin_]), int(features[row]), int(bin_), whole,
        tuple(int(x) for x in left[:, row, bin_]),
    )


class Growth:
    """One tree that grows: which leaves are open, and which split is next."""

    def __init__(self, s: Settings, columns: np.ndarray):
        self.s, self.columns = s, columns
        self.tree = Tree()
        self.depth = {0: 0}
        self.splits: dict[int, Split] = {}
        self.kept: list[int] = []  # nodes that were split, in order
        #: nodes whose children are already known, though it is not yet their turn
        self.ahead: dict[int, tuple[int, int]] = {}

    def wanted(self) -> list[int]:
        """Nodes whose sums the next pass must give."""
        if not self.splits:
            return [0]
        return [c for pair in self.ahead.values() for c in pair if c not in self.splits]

    def learn(self, found: dict[int, Split], edges: list[np.ndarray]) -> None:
        """Take the splits of the nodes that were wanted; open the next ones."""
        self.splits.update(found)
        while True:
            done = self._leaves() >= self.s.leaves and not self.s.by_level
            front = self._front()
            if done or not front:
                self.ahead = {n: c for n, c in self.ahead.items() if n in self.kept}
                return
            node = front[0]
            children = self.ahead.get(node)
            if children is None or any(c not in self.splits for c in children):
                break
            self.kept.append(node)
        # the splits that may still be made, by gain: their children are looked at in one pass
        room = len(front) if self.s.by_level else self.s.leaves - self._leaves()
        for node in front[:room]:
            if node not in self.ahead:
                split = self.splits[node]
                cut = float(edges[split.feature][split.bin])
                pair = self.tree.split(node, split.feature, split.bin, cut)
                self.ahead[node] = pair
                for child in pair:
                    self.depth[child] = self.depth[node] + 1

    def _leaves(self) -> int:
        return len(self.kept) + 1

    def _front(self) -> list[int]:
        """Leaves of the tree so far that can be split, the largest gain first."""
        open_ = [0] if not self.kept else []
        for node in self.kept:
            open_ += [c for c in self.ahead[node] if c not in self.kept]
        limit = self.s.depth or 1 << 30
        fit = [n for n in open_ if self.splits[n].gain > 0 and self.depth[n] < limit]
        return sorted(fit, key=lambda n: (-self.splits[n].gain, n))

    def finish(self) -> Tree:
        """The tree of the splits that were made, with values."""
        out = Tree()
        stack = [(0, 0)]
        while stack:
            old, new = stack.pop()
            if old in self.kept:
                t = self.tree
                a, b = out.split(new, t.feature[old], t.bin[old], t.threshold[old])
                stack += [(t.left[old], a), (t.right[old], b)]
            else:
                out.value[new] = self.s.rate * leaf_value(self.splits[old].total, self.s)
        return out


# Rows.


#: Rows of a task: bins (rows x features), class, fold, a hash, and margins (fit x row x output).  What
#: travels between tasks is plain data, since executors need no copy of this module.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _row_keys(values: np.ndarray, label: np.ndarray) -> np.ndarray:
    key = _mixed(label.astype(np.int64).view(np.uint64) + np.uint64(1))
    for column in np.ascontiguousarray(values.T).view(np.uint64):
        key = _mixed(key ^ column)
    return key


def chosen_rows(key: np.ndarray, share: float, seed: int, turn: int) -> np.ndarray:
    """The rows that a round uses; rows of equal values share their fate."""
    if share >= 1:
        return np.ones(len(key), bool)
    salt = np.uint64((seed * 1_000_003 + turn + 1) & (1 << 63) - 1)
    return _mixed(key ^ _mixed(np.array([salt], np.uint64))) < np.uint64(int(share * float(1 << 63)) * 2)


def chosen_columns(d: int, s: Settings, turn: int) -> np.ndarray:
    n = max(1, round(d * s.column_share))
    return np.sort(np.random.default_rng([s.seed, turn]).permutation(d)[:n])


def gradients(margin: np.ndarray, label: np.ndarray, output: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole first and second order gradients of the log loss by the output's margin."""
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-margin[:, 0]))
        g, h = p - (label == 1), p * (1 - p)
    else:
        p = np.exp(margin - margin.max(1, keepdims=True))
        p = p[:, output] / p.sum(1)
        k = margin.shape[1]
        g, h = p - (label == output), p * (1 - p) * k / (k - 1)
    return np.rint(g * UNIT), np.rint(h * UNIT)


def histograms(
    block: Block, fit: int, output: int, tree: Tree, nodes: list[int], columns: np.ndarray,
    s: Settings, turn: int,
) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((node, first of a block of columns), whole sums (columns, bins, 3)) of one fit and output."""
    bins, label, fold, key, margin = block
    used = chosen_rows(key, s.row_share, s.seed, turn)
    if fit:
        used &= fold != fit - 1
    slot = _slots(tree, nodes)[tree.leaves(bins, True)]
    g, h = gradients(margin[fit], label, output)
    at = np.flatnonzero(used & (slot >= 0))
    slot, g, h = slot[at], g[at], h[at]
    some = np.bincount(slot, minlength=len(nodes)) > 0
    for first in range(0, len(columns), BLOCK_FEATURES):
        own = columns[first : first + BLOCK_FEATURES]
        added = _added((bins[:, j][at] for j in own), len(own), slot, len(nodes), g, h, s)
        for node, part, has_rows in zip(nodes, added, some):
            if has_rows:
                yield (node, first), part


def _slots(tree: Tree, nodes: list[int]) -> np.ndarray:
    """By node of the tree its place among the nodes, or -1."""
    places = np.full(len(tree.feature), -1)
    places[nodes] = np.arange(len(nodes))
    return places


def _added(
    columns: Iterable[np.ndarray], n_columns: int, slot: np.ndarray, n: int, g: np.ndarray, h: np.ndarray,
    s: Settings,
) -> np.ndarray:
    """Whole sums (node, column, bin, 3) of rows; slot numbers their nodes from 0 to n - 1."""
    base = slot * s.bins
    out = np.empty((3, n, n_columns, s.bins), np.int64)
    for i, column in enumerate(columns):
        cell = base + column
        for k, w in enumerate((g, h, None)):
            out[k, :, i] = np.bincount(cell, w, n * s.bins).reshape(n, s.bins)
    return np.moveaxis(out, 0, -1)


def _grown(block: Block, start: np.ndarray, edges: list[np.ndarray], s: Settings) -> list[list[dict]]:
    """The trees of a fit by round and output, as plain data; all its rows are in the block."""
    bins, label, _, key, _ = block
    margin = np.repeat(start[None, :], len(label), axis=0)
    made = []
    for turn in range(s.rounds):
        columns = chosen_columns(len(edges), s, turn)
        used = np.flatnonzero(chosen_rows(key, s.row_share, s.seed, turn))
        rows = bins.T.take(used, 1).T  # a feature's bins lie together
        trees = []
        for output in range(margin.shape[1]):
            g, h = gradients(margin[used], label[used], output)
            trees.append(_tree(rows, g, h, columns, edges, s))
        for output, tree in enumerate(trees):
            margin[:, output] += np.array(tree.value)[tree.leaves(bins, True)]
        made.append([t.__dict__ for t in trees])
    return made


def _tree(
    rows: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, edges: list[np.ndarray], s: Settings
) -> Tree:
    """A tree of these rows.  Of two children the sums of the smaller are added up, those of the larger are
    what is left of their parent's."""
    growth = Growth(s, columns)
    leaf = np.zeros(len(rows), np.int32)
    sums: dict[int, np.ndarray] = {}
    keeps = len(columns) * s.bins <= KEPT_CELLS

    def split(node: int, own: np.ndarray) -> Split:
        if keeps:
            sums[node] = own
        return best_split(own, columns, s)

    while nodes := growth.wanted():
        left_over: dict[int, tuple[int, int]] = {}
        if keeps:
            for parent, (a, b) in growth.ahead.items():
                if a in nodes:
                    lower = growth.splits[parent]
                    small, large = (a, b) if 2 * lower.left[2] <= lower.total[2] else (b, a)
                    left_over[large] = parent, small
        leaf = growth.tree.leaves(rows, True, leaf)
        asked = [n for n in nodes if n not in left_over]
        slot = _slots(growth.tree, asked)[leaf]
        at = np.flatnonzero(slot >= 0)
        found = {}
        # a few nodes at a time where the sums of all would be large
        step = max(1, (KEPT_CELLS << 5) // (len(columns) * s.bins))
        for i in range(0, len(asked), step):
            part = at if len(asked) <= step else at[(slot[at] >= i) & (slot[at] < i + step)]
            own = (rows[:, j][part] for j in columns)
            added = _added(own, len(columns), slot[part] - i, len(asked[i : i + step]), g[part], h[part], s)
            found.update({n: split(n, x) for n, x in zip(asked[i : i + step], added)})
        for large, (parent, small) in left_over.items():
            found[large] = split(large, sums.pop(parent) - sums[small])
        growth.learn(found, edges)
    return growth.finish()


# Cut points.


def _summary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, weights) of a column; exact up to POINTS rows."""
    values = np.sort(values)
    if len(values) <= POINTS:
        return values, np.ones(len(values))
    ranks = np.ceil(np.arange(1, POINTS + 1) * len(values) / POINTS).astype(np.int64) - 1
    return values[ranks], np.diff(ranks, prepend=-1).astype(np.float64)


def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    points, weights = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(points, kind="stable")
    points, weights = points[order], weights[order]
    if len(points) > 64 * POINTS:
        ends = np.cumsum(weights)
        at = np.searchsorted(ends, np.arange(1, 16 * POINTS + 1) * ends[-1] / (16 * POINTS))
        at = np.unique(np.minimum(at, len(points) - 1))
        points, weights = points[at], np.diff(ends[at], prepend=0.0)
    return points, weights


def _cuts(points: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """The values of the ranks ceil(i * n / bins), i = 1 .. bins - 1, each once."""
    ends = np.cumsum(weights)
    ranks = np.ceil(np.arange(1, bins) * ends[-1] / bins - 1e-9)
    return np.unique(points[np.minimum(np.searchsorted(ends, ranks), len(points) - 1)])


# The fit.


def _matrices(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for pdf in batches:
        for i in range(0, len(pdf), BLOCK_ROWS):
            part = pdf.iloc[i : i + BLOCK_ROWS]
            yield (
                np.stack(part["x"].to_numpy()).astype(np.float64),
                part["label"].to_numpy(np.int32), part["fold"].to_numpy(np.int32),
            )


def _values(data: DataFrame, features: str, label: str, fold: str | None) -> RDD:
    """Matrices (values, label, fold) of the rows, a few in each task."""
    rows = data.select(
        F.col(label).cast("int").alias("label"),
        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
        vector_to_array(features).alias("x"),
    )

    def pack(batches):
        import pickle

        for m in _matrices(batches):
            yield pd.DataFrame({"m": [pickle.dumps(m)]})

    def unpack(row):
        import pickle

        return pickle.loads(row["m"])

    return rows.mapInPandas(pack, "m binary").rdd.map(unpack)


@dataclass
class Fitted:
    classes: int
    start: list[float]
    trees: list[list[Tree]]  # by round and output


def fit_boosted(
    data: DataFrame, s: Settings, folds: int = 0, features: str = "features", label: str = "label",
    fold: str = "fold",
) -> list[Fitted]:
    """Boosted trees on all rows, then, with `folds`, on the rows outside each fold; one pass serves all.

    Classes are numbered from 0.  Two classes have one output, more have a softmax of one each.  The
    data should be stored or persisted.
    """
    sc = data.sparkSession.sparkContext
    counts = data.groupBy(label, *([fold] if folds else [])).count().collect()
    classes = max(2, int(max(r[label] for r in counts)) + 1)
    outputs = 1 if classes == 2 else classes
    fits = folds + 1
    start = np.zeros((fits, outputs))
    for fit in range(fits):
        n = np.zeros(classes)
        for r in counts:
            if not fit or r[fold] != fit - 1:
                n[int(r[label])] += r["count"]
        share = np.clip(n / max(1, n.sum()), 1e-6, 1 - 1e-6)
        start[fit] = np.log(share[1] / (1 - share[1])) if classes == 2 else np.log(share)

    values = _values(data, features, label, fold if folds else None)
    edges = _edges(values, s.bins)
    d = len(edges)

    def binned(m):
        x, y, f = m
        kind = np.uint8 if s.bins <= 256 else np.int32
        bins = np.stack([np.searchsorted(e, x[:, j]).astype(kind) for j, e in enumerate(edges)]).T
        return bins, y, f, _row_keys(x, y), np.repeat(start[:, None, :], len(y), axis=1)

    if sum(r["count"] for r in counts) * d <= LOCAL_CELLS:
        own = _local(values.map(binned), start, edges, s)
        return [Fitted(classes, start[f].tolist(), own[f]) for f in range(fits)]
    blocks = values.map(binned).persist(StorageLevel.MEMORY_AND_DISK)
    made: list[list[list[Tree]]] = [[] for _ in range(fits)]
    previous: RDD | None = None
    for turn in range(s.rounds):
        columns = chosen_columns(d, s, turn)
        growths = {(f, o): Growth(s, columns) for f in range(fits) for o in range(outputs)}
        while True:
            asked = {k: (g.tree, nodes) for k, g in growths.items() if (nodes := g.wanted())}
            if not asked:
                break
            found = _pass(sc, blocks, asked, columns, s, turn)
            for k, (_, nodes) in asked.items():
                whole = {n: found.get((*k, n), Split(0.0, -1, 0, (0, 0, 0), (0, 0, 0))) for n in nodes}
                growths[k].learn(whole, edges)
            if previous is not None:  # the rows' new state has been made by this pass
                previous.unpersist()
                previous = None
        trees = {k: g.finish() for k, g in growths.items()}
        for f in range(fits):
            made[f].append([trees[f, o] for o in range(outputs)])
        if turn + 1 < s.rounds:
            previous, blocks = blocks, _advanced(sc, blocks, trees)
            if turn % CUT_ROUNDS == CUT_ROUNDS - 1:
                if not sc.getCheckpointDir():
                    sc.setCheckpointDir(work_folder(data.sparkSession, "boosting"))
                blocks.checkpoint()
                blocks.count()
    for rdd in (blocks, previous):
        if rdd is not None:
            rdd.unpersist()
    return [Fitted(classes, start[f].tolist(), made[f]) for f in range(fits)]


def _local(blocks: RDD, start: np.ndarray, edges: list[np.ndarray], s: Settings) -> list[list[list[Tree]]]:
    """The trees of every fit, by round and output; each fit is one task, which has all its rows."""
    fits = len(start)

    def dealt(block: Block):
        bins, y, f, key, _ = block
        for fit in range(fits):
            kept = f != fit - 1 if fit else slice(None)
            yield fit, (bins[kept], y[kept], f[kept], key[kept])

    def grow(item):
        fit, parts = item
        bins, *others = zip(*parts)
        whole = np.concatenate([b.T for b in bins], 1).T
        return fit, _grown((whole, *map(np.concatenate, others), None), start[fit], edges, s)

    found = dict(blocks.flatMap(dealt).groupByKey(fits, lambda fit: fit).map(grow).collect())
    return [[[Tree(**t) for t in turn] for turn in found[fit]] for fit in range(fits)]


def _edges(values: RDD, bins: int) -> list[np.ndarray]:
    """Per feature its cut points: the values of the ranks ceil(i * n / bins), at most bins - 1.

    Summaries of the tasks say about where a rank is.  Where they left values out, exact counts
    between their points say in which interval it is, and only those intervals' values are counted one
    by one, so that the cuts are the same for any tasks.
    """

    def parts(m):
        for j, column in enumerate(m[0].T):
            yield j, _summary(column)

    def brief(found):  # cuts, or points near them if values were left out
        points, weights = found
        if (weights == 1).all():
            return True, _cuts(points, weights, bins)
        return False, np.unique(np.concatenate([points[:1], _cuts(points, weights, NEAR * bins), points[-1:]]))

    found = dict(values.flatMap(parts).reduceByKey(_merged).mapValues(brief).collect())
    if all(exact for exact, _ in found.values()):
        return [found[j][1] for j in sorted(found)]
    near = [found[j][1] for j in sorted(found)]

    def between(matrices):  # rows per feature and interval (points[i - 1], points[i]]
        total = {}
        for x, _, _ in matrices:
            for j, points in enumerate(near):
                own = np.bincount(np.searchsorted(points, x[:, j]), minlength=len(points) + 1)
                total[j] = total[j] + own if j in total else own
        return total.items()

    rows = dict(values.mapPartitions(between).reduceByKey(np.add).collect())
    wanted: dict[int, dict[int, list[int]]] = {}
    for j in range(len(near)):
        ends = np.cumsum(rows[j])
        for rank in np.ceil(np.arange(1, bins) * ends[-1] / bins - 1e-9).astype(np.int64).tolist():
            i = int(np.searchsorted(ends, rank))
            wanted.setdefault(j, {}).setdefault(i, []).append(rank - int(ends[i] - rows[j][i]))

    def inside(matrices):
        for x, _, _ in matrices:
            for j, intervals in wanted.items():
                at = np.searchsorted(near[j], x[:, j])
                hit = np.isin(at, list(intervals))
                own, column = at[hit], x[hit, j]
                order = np.lexsort((column, own))
                own, column = own[order], column[order]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                for a, b in zip(starts, [*starts[1:], len(own)]):
                    yield (j, int(own[a])), np.unique(column[a:b], return_counts=True)

    def counted(a, b):
        values = np.concatenate([a[0], b[0]])
        kept, at = np.unique(values, return_inverse=True)
        return kept, np.bincount(at, np.concatenate([a[1], b[1]]), len(kept)).astype(np.int64)

    def picked(item):
        (j, i), (points, counts) = item
        return j, points[np.searchsorted(np.cumsum(counts), wanted[j][i])].tolist()

    cuts: dict[int, set] = {j: set() for j in range(len(near))}
    for j, own in values.flatMap(lambda m: inside([m])).reduceByKey(counted).map(picked).collect():
        cuts[j].update(own)
    return [np.array(sorted(cuts[j])) for j in sorted(cuts)]


def _advanced(sc, blocks: RDD, trees: dict[tuple[int, int], Tree]) -> RDD:
    held = sc.broadcast({k: t.__dict__ for k, t in trees.items()})

    def add(block: Block) -> Block:
        bins, *others, margin = block
        margin = margin.copy()
        for (fit, output), content in held.value.items():
            tree = Tree(**content)
            margin[fit, :, output] += np.array(tree.value)[tree.leaves(bins, True)]
        return bins, *others, margin

    return blocks.map(add).persist(StorageLevel.MEMORY_AND_DISK)


def _pass(sc, blocks: RDD, asked: dict, columns: np.ndarray, s: Settings, turn: int) -> dict:
    """(fit, output, node) -> Split, from the sums of all rows."""
    held = sc.broadcast({k: (tree.__dict__, nodes) for k, (tree, nodes) in asked.items()})

    def sums(blocks):
        own: dict = {}
        for b in blocks:
            for (fit, output), (content, nodes) in held.value.items():
                tree = Tree(**content)
                for key, part in histograms(b, fit, output, tree, nodes, columns, s, turn):
                    at = (fit, output, *key)
                    own[at] = own[at] + part if at in own else part
        return own.items()

    def best(item):
        (fit, output, node, first), total = item
        split = best_split(total, columns[first : first + BLOCK_FEATURES], s)
        return (fit, output, node), tuple(split.__dict__.values())

    keys = sum(len(nodes) for _, nodes in asked.values()) * -(-len(columns) // BLOCK_FEATURES)
    reducers = max(1, min(keys, blocks.getNumPartitions()))
    found: dict = {}
    for key, made in blocks.mapPartitions(sums).reduceByKey(np.add, reducers).map(best).collect():
        split = Split(*made)
        held_split = found.get(key)
        if held_split is None or (split.gain, -split.feature) > (held_split.gain, -held_split.feature):
            found[key] = split
    held.unpersist()
    return found


# Spark ML.


class _Boosted(HasFeaturesCol, HasLabelCol, HasSeed):
    pass


class BoostedTrees(Estimator, _Boosted):
    """Boosted trees as an estimator; see `fit_boosted`.  `growth` is "leaf" or "level"."""

    rounds = Param(Params._dummy(), "rounds", "trees per output", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "what a tree's values are multiplied by", TypeConverters.toFloat)
    growth = Param(Params._dummy(), "growth", "leaf or level", TypeConverters.toString)
    leaves = Param(Params._dummy(), "leaves", "most leaves of a tree, by leaf", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "most levels, 0 for any", TypeConverters.toInt)
    rowShare = Param(Params._dummy(), "rowShare", "rows of a round", TypeConverters.toFloat)
    columnShare = Param(Params._dummy(), "columnShare", "features of a round", TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "bins of a feature", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "added to second order sums", TypeConverters.toFloat)
    minRows = Param(Params._dummy(), "minRows", "least rows of a leaf", TypeConverters.toInt)
    minHessian = Param(Params._dummy(), "minHessian", "least second order sum of a leaf", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", seed=42, rounds=300, rate=0.05, growth="leaf",
        leaves=31, depth=0, rowShare=0.8, columnShare=0.8, bins=255, l2=0.0, minRows=20, minHessian=1e-3,
    ):
        super().__init__()
        self._set(**{
            "featuresCol": "features", "labelCol": "label", "seed": 42, "rounds": 300, "rate": 0.05,
            "growth": "leaf", "leaves": 31, "depth": 0, "rowShare": 0.8, "columnShare": 0.8,
            "bins": 255, "l2": 0.0, "minRows": 20, "minHessian": 1e-3, **self._input_kwargs,
        })

    def getStepSize(self) -> float:
        return self.getOrDefault(self.rate)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.depth)

    def getMaxIter(self) -> int:
        return self.getOrDefault(self.rounds)

    def settings(self) -> Settings:
        def get(name):
            return self.getOrDefault(self.getParam(name))

        return Settings(
            get("rounds"), get("rate"), get("leaves"), get("depth"), get("growth") == "level",
            get("rowShare"), get("columnShare"), get("bins"), get("l2"), get("minRows"),
            get("minHessian"), get("seed"),
        )

    def _model(self, fitted: Fitted) -> BoostedTreesModel:
        trees = [[t.__dict__ for t in turn] for turn in fitted.trees]
        return BoostedTreesModel(
            featuresCol=self.getFeaturesCol(),
            content=json.dumps({"classes": fitted.classes, "start": fitted.start, "trees": trees}),
        )

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        return self._model(
            fit_boosted(dataset, self.settings(), 0, self.getFeaturesCol(), self.getLabelCol())[0]
        )

    def fit_folds(self, dataset: DataFrame, folds: int, fold: str = "fold") -> list[BoostedTreesModel]:
        """The model of all rows, then one per fold that has not seen its rows, from the same passes."""
        fitted = fit_boosted(
            dataset, self.settings(), folds, self.getFeaturesCol(), self.getLabelCol(), fold
        )
        return [self._model(f) for f in fitted]


class BoostedTreesModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `probability` (vector) and `prediction`; of equal probabilities the first class."""

    content = Param(Params._dummy(), "content", "trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", content=None):
        super().__init__()
        self._set(**{"featuresCol": featuresCol, **self._input_kwargs})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = dataset.sparkSession.sparkContext.broadcast(self.getOrDefault(self.content))

        @F.pandas_udf("array<double>")
        def probability(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            classes, start, turns = trees_of(held.value)
            for column in columns:
                if not len(column):
                    yield pd.Series([], dtype=object)
                    continue
                yield pd.Series(list(probabilities(np.stack(column.to_numpy()), classes, start, turns)))

        p = probability(vector_to_array(self.getFeaturesCol()))
        found = dataset.withColumn("_p", p)
        return found.withColumn("probability", array_to_vector("_p")).withColumn(
            "prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        ).drop("_p")


def trees_of(content: str) -> tuple[int, list[float], list[list[Tree]]]:
    """(classes, margins at the start, trees by round and output) of a model's content."""
    made = json.loads(content)
    return made["classes"], made["start"], [[Tree(**t) for t in turn] for turn in made["trees"]]


def probabilities(
    x: np.ndarray, classes: int, start: list[float], turns: list[list[Tree]]
) -> np.ndarray:
    margin = np.repeat(np.array([start]), len(x), axis=0)
    for trees in turns:
        for output, tree in enumerate(trees):
            margin[:, output] += np.array(tree.value)[tree.leaves(x, False)]
    if classes == 2:
        p = 1 / (1 + np.exp(-margin[:, 0]))
        return np.stack([1 - p, p], 1)
    p = np.exp(margin - margin.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


# A look at the first split.


def first_splits(data: DataFrame, s: Settings, features: str = "features", label: str = "label") -> DataFrame:
    """(dim, threshold, gain, n_left, n_right): of every feature the best split of all rows at the start.

    data must be stored.  Of two classes; rows and features are not sampled.
    """
    spark = data.sparkSession
    values = _values(data, features, label, None)
    edges = _edges(values, s.bins)
    share = data.agg(F.avg(label)).first()[0]
    start = np.log(share / (1 - share))

    def sums(matrices):
        own: dict = {}
        for x, y, f in matrices:
            bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
            block = (bins, y, f, np.zeros(len(y), np.uint64), np.full((1, len(y), 1), start))
            for (_, first), part in histograms(
                block, 0, 0, Tree(), [0], np.arange(len(edges)),
                Settings(bins=s.bins, row_share=1.0), 0,
            ):
                own[first] = own[first] + part if first in own else part
        return own.items()

    def best(item):
        first, total = item
        for i in range(len(total)):
            split = best_split(total[i : i + 1], np.array([first + i]), s)
            if split.feature >= 0:
                cut = float(edges[split.feature][split.bin])
                yield split.feature, cut, split.gain, split.left[2], split.right()[2]

    rows = values.mapPartitions(sums).reduceByKey(np.add).flatMap(best)
    return stored(
        spark.createDataFrame(rows, "dim int, threshold double, gain double, n_left long, n_right long"),
        "first-splits",
    )
