"""Forests and boosted trees for a binary target, grown from histograms that the tasks count with arrays.

Rows are binned once and written as blocks of rows. Each level of a tree is one pass over the blocks: every task sums what
it has by node and bin, sums meet by tree, and only splits reach the driver. A task holds one block and its sums; columns with
few bins share one key, so that a row is counted a few times instead of once for each column. Splits, weights, minimum rows
and depths follow the parameters of the Spark ML estimator, and the result is that estimator's own model: it is put together
in Spark's file format and loaded, so scoring, saving and reloading are Spark's.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.session import shared_folder, staged

#: Rows of a block, blocks that a forest counts together, and rows that boosting does, so that its arrays stay in the cache.
BLOCK, BLOCKS, SLICE = 131_072, 4, 16_384
#: Rows for which a task is planned, and bins of columns that share a key in a forest (for each node) and in boosting.
TASK_ROWS, FOREST_CELLS, BOOST_CELLS = 500_000, 512, 4096
#: Numbers are cut at quantiles told to this rank error, as coarse as the sample of 10,000 rows that Spark takes.
QUANTILES = 2000
#: A row of class 1 counts so much, and one of class 0 as one, where both are counted in one number: a task has fewer rows.
OTHER = float(1 << 26)
STATE = StorageLevel.MEMORY_AND_DISK
#: A row that is in no node any more, or never was.
GONE = 0xFFFF
#: Poisson(1) counts by 16 random bits.
DRAWN = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass(frozen=True)
class Binned:
    """A column in bins: a number cut at `edges`, a category's codes, or codes that are one feature each but for the last."""

    feature: int
    bins: int
    edges: np.ndarray | None = None
    hot: bool = False


@dataclass(frozen=True)
class Layout:
    """Columns and the keys that several of them share: for each column its key, the stride and the cells of that key."""

    columns: tuple[Binned, ...]
    key: tuple[int, ...]
    stride: tuple[int, ...]
    cells: tuple[int, ...]

    def marginal(self, sums: list[np.ndarray], k: int) -> np.ndarray:
        """(node, bin, ...) of column k from sums (node, cell, ...) by key."""
        whole, stride, bins = sums[self.key[k]], self.stride[k], self.columns[k].bins
        return whole.reshape(len(whole), -1, bins, stride, *whole.shape[2:]).sum(axis=(1, 3))

    def bin_of(self, k: int) -> np.ndarray:
        """The bin of column k in each cell of its key."""
        return np.arange(self.cells[self.key[k]]) // self.stride[k] % self.columns[k].bins


def laid_out(columns: Sequence[Binned], most: int) -> Layout:
    """Wide columns first, each with the others that still fit into `most` cells."""
    cells: list[int] = []
    key, stride = [0] * len(columns), [1] * len(columns)
    for k in sorted(range(len(columns)), key=lambda k: -columns[k].bins):
        at = next((p for p, n in enumerate(cells) if n * columns[k].bins <= most), len(cells))
        if at == len(cells):
            cells.append(1)
        key[k], stride[k] = at, cells[at]
        cells[at] *= columns[k].bins
    return Layout(tuple(columns), tuple(key), tuple(stride), tuple(cells))


def edges_of(values: Sequence[float], most: int) -> np.ndarray:
    """Up to `most` - 1 thresholds between values that stand for equal shares of rows, as Spark ML places them."""
    different, counts = np.unique(np.asarray(values, np.float64), return_counts=True)
    middle = (different[1:] + different[:-1]) / 2
    if len(middle) < most:
        return middle
    stride = counts.sum() / most
    found, target, upto = [], stride, np.cumsum(counts)
    for k in range(1, len(different)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            found.append(middle[k - 1])
            target += stride
    return np.array(found[: most - 1])


def binned(rows: DataFrame, numbers: dict[int, Column], codes: dict[int, tuple[Column, int, bool]], most: int, cells: int, total: float) -> tuple[RDD, Layout]:
    """Blocks (number, keys, target) of `rows`; `numbers` and `codes` (with their count, and whether each is a feature) by feature."""
    spark = rows.sparkSession
    names = {k: f"n{k}" for k in numbers}
    narrow = rows.select(*[c.cast("double").alias(names[k]) for k, c in numbers.items()], *[c.cast("double").alias(f"c{k}") for k, (c, _, _) in codes.items()], F.col("target").cast("int").alias("target"))
    told = narrow.approxQuantile(list(names.values()), [k / QUANTILES for k in range(QUANTILES + 1)], 0.5 / QUANTILES)
    cut = {k: edges_of(q, min(most, max(2, int(total)))) for k, q in zip(numbers, told, strict=True)}
    columns = [Binned(k, len(e) + 1, e) for k, e in cut.items()] + [Binned(k, n, hot=hot) for k, (_, n, hot) in codes.items()]
    layout = laid_out(columns, cells)
    kind = np.uint16 if max(layout.cells) <= 1 << 16 else np.int64

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, at = [], 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held], axis=1)
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([keys.tobytes()], pa.binary()), pa.array([b"".join(t.tobytes() for _, t in held)], pa.binary())], ["block", "keys", "target"])

        for batch in batches:
            if any(c.null_count for c in batch.columns):
                raise ValueError("features must not be missing")
            keys = np.zeros((len(layout.cells), batch.num_rows), np.int64)
            for k, c in enumerate(columns):
                values = batch.column(k).to_numpy(zero_copy_only=False)
                keys[layout.key[k]] += layout.stride[k] * (values.astype(np.int64) if c.edges is None else np.searchsorted(c.edges, values))
            held.append((keys.astype(kind), batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(np.uint8)))
            size += batch.num_rows
            if size >= BLOCK:
                yield block()
                held, size, at = [], 0, at + 1
        if held:
            yield block()

    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(total / TASK_ROWS))
    stored = staged(narrow.repartition(tasks).mapInArrow(job, "block long, keys binary, target binary"), "tree-blocks")
    width = len(layout.cells)

    def arrays(row) -> tuple:
        return row["block"], np.frombuffer(row["keys"], kind).reshape(width, -1), np.frombuffer(row["target"], np.uint8)

    return stored.rdd.map(arrays), layout


# --- splits ---------------------------------------------------------------------------------------


@dataclass
class Grown:
    """Splits of a level's nodes: gain, column, which bins go right, and statistics (node, child, ...) of both children.

    `gain` is 0 where a node isn't split.
    """

    stats: np.ndarray
    gain: np.ndarray
    column: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    cut: list
    children: np.ndarray


def _chosen(layout: Layout, stats: np.ndarray, options: list, allowed: np.ndarray | None) -> Grown:
    """The best option of each node. Options: for each column gains (node, option), left statistics, order of the bins or None."""
    n = len(stats)
    best = Grown(stats, np.zeros(n), np.zeros(n, np.int64), np.zeros((n, max(c.bins for c in layout.columns)), bool), np.zeros(n, np.int64), [None] * n, np.zeros((n, 2, *stats.shape[1:])))
    for k, (gains, left, order) in enumerate(options):
        c = layout.columns[k]
        if not gains.shape[1]:
            continue
        if allowed is not None:
            of = c.feature + np.arange(gains.shape[1]) if c.hot else np.full(gains.shape[1], c.feature)
            gains = np.where(allowed[:, of], gains, 0)
        at = gains.argmax(axis=1)
        for node in np.flatnonzero(gains[np.arange(n), at] > best.gain):
            j = int(at[node])
            best.gain[node], best.column[node], best.feature[node] = gains[node, j], k, c.feature + (j if c.hot else 0)
            best.children[node] = left[node, j], stats[node] - left[node, j]
            best.right[node] = False
            if c.hot:
                best.right[node, j] = True
                best.cut[node] = ([0.0], 2)
            elif order is None:
                best.right[node, j + 1 : c.bins] = True
                best.cut[node] = ([float(c.edges[j])], -1)
            else:
                best.right[node, order[node, j + 1 :]] = True
                best.cut[node] = (sorted(map(float, order[node, : j + 1])), c.bins)
    return best


def gini_splits(layout: Layout, sums: list[np.ndarray], weights: np.ndarray, least: int, allowed: np.ndarray) -> Grown:
    """From counts (node, bin, class) of each column. Statistics: the counts by class."""
    def impurity(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = counts * weights
        all_ = by.sum(axis=-1)
        return 1 - ((by / np.maximum(all_, 1e-300)[..., None]) ** 2).sum(axis=-1), all_

    stats = sums[0].sum(axis=1)
    whole, weight = impurity(stats)
    options = []
    for c, counts in zip(layout.columns, sums, strict=True):
        # a code that is a feature of its own: the others go left
        left = stats[:, None] - counts[:, : c.bins - 1] if c.hot else np.cumsum(counts, axis=1)[:, :-1]
        right = stats[:, None] - left
        (a, wa), (b, wb) = impurity(left), impurity(right)
        gains = whole[:, None] - (wa * a + wb * b) / np.maximum(weight, 1e-300)[:, None]
        fits = (left.sum(axis=-1) >= max(least, 1)) & (right.sum(axis=-1) >= max(least, 1))
        options.append((np.where(fits, gains, 0), left, None))
    return _chosen(layout, stats, options, allowed)


def variance_splits(layout: Layout, sums: list[np.ndarray], least: int) -> Grown:
    """From (rows, weight, weighted sum) by node and bin of each column, which are the statistics too. Categories are ordered by mean."""
    stats = sums[0].sum(axis=1)
    options = []
    for c, s in zip(layout.columns, sums, strict=True):
        order = None
        if c.edges is None:
            mean = np.where(s[..., 1] > 0, s[..., 2] / np.maximum(s[..., 1], 1e-300), np.inf)
            order = np.argsort(mean, axis=1, kind="stable")
            s = np.take_along_axis(s, order[..., None], axis=1)
        left = np.cumsum(s, axis=1)[:, :-1]
        right = stats[:, None] - left
        square = lambda x: x[..., 2] ** 2 / np.maximum(x[..., 1], 1e-300)
        gains = (square(left) + square(right) - square(stats)[:, None]) / np.maximum(stats[:, 1], 1e-300)[:, None]
        fits = (left[..., 0] >= max(least, 1)) & (right[..., 0] >= max(least, 1))
        options.append((np.where(fits & (gains > 1e-15), gains, 0), left, order))
    return _chosen(layout, stats, options, None)


class Steps:
    """Where the rows of a level's nodes go: to node 2 k or 2 k + 1 of the next level, or, if `leave`, away from leaves."""

    def __init__(self, layout: Layout, grown: Grown, leave: bool):
        self.key = np.array([layout.key[c] for c in grown.column])
        self.most = max(layout.cells)
        self.to = np.zeros((len(grown.gain), self.most), np.uint16)
        for node, c in enumerate(grown.column):
            cells = layout.cells[self.key[node]]
            go = grown.right[node][layout.bin_of(c)] if grown.gain[node] else False
            self.to[node, :cells] = GONE if leave and not grown.gain[node] else 2 * node + np.asarray(go, np.uint16)

    def __call__(self, keys: np.ndarray, node: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        if len(self.to) == 1:
            return self.to[0][keys[self.key[0]] if rows is None else keys[self.key[0]][rows]]
        rows = np.arange(keys.shape[1]) if rows is None else rows
        return self.to.ravel()[node.astype(np.int64) * self.most + keys.ravel()[self.key[node] * keys.shape[1] + rows]]


# --- models in Spark's format ---------------------------------------------------------------------


def _metadata(kind: str, estimator, **more) -> dict:
    told = {"class": kind, "timestamp": int(time.time() * 1000), "sparkVersion": more.pop("version"), "uid": more.pop("uid", estimator.uid)}
    only = more.pop("only", None)
    plain = lambda params: {p.name: v for p, v in params.items() if only is None or p.name in only}
    return told | {"paramMap": plain(estimator._paramMap), "defaultParamMap": plain(estimator._defaultParamMap)} | more


def flat(levels: list[Grown], told) -> list[tuple]:
    """A tree's nodes in depth-first order; `told` gives prediction, impurity, Spark's statistics and rows from the statistics.

    Two leaves with one prediction are one leaf, as in Spark.
    """
    def tree(depth: int, at: int, stats: np.ndarray):
        if depth < len(levels) and levels[depth].gain[at] > 0:
            g = levels[depth]
            left, right = tree(depth + 1, 2 * at, g.children[at, 0]), tree(depth + 1, 2 * at + 1, g.children[at, 1])
            if len(left) > 1 or len(right) > 1 or left[0][1][0] != right[0][1][0]:
                return [((float(g.gain[at]), int(g.feature[at]), *g.cut[at], len(left)), told(stats)), *left, *right]
        return [(None, told(stats))]

    out = []
    for k, (split, (prediction, impurity, stats, count)) in enumerate(tree(0, 0, levels[0].stats[0])):
        gain, feature, cut, arity, left = split or (-1.0, -1, [], -1, 0)
        out.append((k, prediction, impurity, stats, count, gain, k + 1 if split else -1, k + 1 + left if split else -1, (feature, cut, arity)))
    return out


def as_model(spark, estimator, trees: list[list[tuple]], tree_weights: Sequence[float], features: int):
    """The estimator's model of these trees."""
    forest = isinstance(estimator, RandomForestClassifier)
    model, tree_kind = (RandomForestClassificationModel, "classification.DecisionTreeClassificationModel") if forest else (GBTClassificationModel, "regression.DecisionTreeRegressionModel")
    path = f"{shared_folder(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    whole = _metadata(f"org.apache.spark.ml.classification.{model.__name__}", estimator, version=spark.version, numFeatures=features, numTrees=len(trees), **({"numClasses": 2} if forest else {}))
    only = {"featuresCol", "labelCol", "weightCol", "maxBins", "maxDepth", "minInfoGain", "minInstancesPerNode", "seed"}
    each = [json.dumps(_metadata(f"org.apache.spark.ml.{tree_kind}", estimator, version=spark.version, uid=f"{estimator.uid}_{k}", only=only)) for k in range(len(trees))]
    node = "struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(k, t, float(w)) for k, (t, w) in enumerate(zip(each, tree_weights, strict=True))], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(k, n) for k, t in enumerate(trees) for n in t], f"treeID int, nodeData {node}").coalesce(1).write.parquet(f"{path}/data")
    loaded = model.load(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return loaded


# --- forests --------------------------------------------------------------------------------------


def _weights_of(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    return DRAWN[np.random.default_rng([seed, tree, block]).integers(0, 1 << 16, n, np.uint16)]


def forest(blocks: RDD, layout: Layout, estimator: RandomForestClassifier, weights: Sequence[float], features: int, spark):
    """A forest with bootstrapped rows (Poisson weights) and a random subset of the features for each node."""
    count, depth, seed, least = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed(), estimator.getMinInstancesPerNode()
    by_class, some = np.asarray(weights, float), math.ceil(math.sqrt(features))
    kind = np.uint8 if 2**depth < 256 else np.uint16
    gone = np.iinfo(kind).max
    width = len(layout.cells)

    def begun(block: tuple) -> tuple:
        at, keys, target = block
        nodes = np.stack([np.where(_weights_of(seed, t, at, len(target)) > 0, 0, gone).astype(kind) for t in range(count)])
        return at, keys, target, nodes

    def counted(level: int):
        def job(part: Iterator[tuple]) -> Iterator[tuple]:
            told = None
            # one tree after another over a few blocks, so that its sums stay in the processor's cache
            while some_blocks := list(islice(part, BLOCKS)):
                wide = [[2 * k.astype(np.int32) + target for k in keys] for _, keys, target, _ in some_blocks]
                found = []
                for t in range(count):
                    sums = [np.zeros(2**level * n * 2) for n in layout.cells]
                    for (at, _, target, nodes), own in zip(some_blocks, wide, strict=True):
                        rows = np.flatnonzero(nodes[t] != gone)
                        if not len(rows):
                            continue
                        drawn = _weights_of(seed, t, at, len(target))[rows].astype(np.float64)
                        node = nodes[t][rows].astype(np.int64)
                        for p in range(width):
                            sums[p] += np.bincount(own[p][rows] + node * (2 * layout.cells[p]), drawn, 2**level * layout.cells[p] * 2)
                    parts = [x.reshape(2**level, n, 2) for x, n in zip(sums, layout.cells, strict=True)]
                    found.append([layout.marginal(parts, k) for k in range(len(layout.columns))])
                told = found if told is None else [[x + y for x, y in zip(a, b, strict=True)] for a, b in zip(told, found, strict=True)]
            yield from enumerate(told or ())

        return job

    def split(level: int):
        def job(found: tuple) -> tuple:
            t, sums = found
            order = np.random.default_rng([seed, t, level, 1]).random((2**level, features)).argsort(axis=1)
            allowed = np.zeros((2**level, features), bool)
            np.put_along_axis(allowed, order[:, :some], True, axis=1)
            return t, gini_splits(layout, sums, by_class, least, allowed)

        return job

    def moved(grown: dict[int, Grown]):
        def job(part: Iterator[tuple]) -> Iterator[tuple]:
            steps = {t: Steps(layout, g, True) for t, g in grown.items()}
            for at, keys, target, nodes in part:
                new = np.full_like(nodes, gone)
                for t, step in steps.items():
                    rows = np.flatnonzero(nodes[t] != gone)
                    if len(rows):
                        to = step(keys, nodes[t][rows], rows)
                        new[t][rows] = np.where(to == GONE, gone, to)
                yield at, keys, target, new

        return job

    def told(stats: np.ndarray) -> tuple:
        by = stats * by_class
        share = by / by.sum()
        return float(by.argmax()), float(1 - (share**2).sum()), by.tolist(), int(round(stats.sum()))

    levels: list[list[Grown]] = [[] for _ in range(count)]
    before, state = None, blocks.map(begun).persist(STATE)
    for level in range(depth):
        summed = state.mapPartitions(counted(level)).reduceByKey(lambda a, b: [x + y for x, y in zip(a, b, strict=True)], min(count, blocks.context.defaultParallelism))
        grown = dict(summed.map(split(level)).collect())
        if before:
            before.unpersist()
        for t, g in grown.items():
            levels[t].append(g)
        if level + 1 == depth or not any(g.gain.any() for g in grown.values()):
            break
        before, state = state, state.mapPartitions(moved({t: g for t, g in grown.items() if g.gain.any()}), preservesPartitioning=True).persist(STATE)
    state.unpersist()
    # a tree for which no row was drawn is a leaf that knows nothing but the weights
    trees = [flat(of, told) if of else [(0, 0.0, 0.0, [1.0, 1.0], 0, -1.0, -1, -1, (-1, [], -1))] for of in levels]
    return as_model(spark, estimator, trees, [1.0] * count, features)


# --- boosting -------------------------------------------------------------------------------------


def _summed(parts: RDD) -> np.ndarray:
    """The sum of one array for each task that has rows; many tasks are added up in between."""
    return reduce(np.add, parts.collect()) if parts.getNumPartitions() <= 256 else parts.treeReduce(np.add)


def boosted(blocks: RDD, layout: Layout, estimator: GBTClassifier, weights: Sequence[float], features: int, spark):
    """Regression trees on the gradient of the logistic loss; the first is fitted to the classes themselves."""
    depth, rate, least = estimator.getMaxDepth(), estimator.getStepSize(), estimator.getMinInstancesPerNode()
    by_class = np.asarray(weights, float)

    def gradient(target: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
        sign = 2.0 * target - 1
        return sign if margin is None else 4 * sign / (1 + np.exp(2 * sign * margin))

    def counted(above: list[Grown]):
        nodes = 2 ** len(above)

        def job(part: Iterator[tuple]) -> Iterator[np.ndarray]:
            steps, sums = [Steps(layout, g, False) for g in above], None
            for _, keys, target, margin in part:
                if sums is None:
                    sums, squares = [np.zeros((2, nodes * n)) for n in layout.cells], np.zeros(nodes)
                for lo in range(0, len(target), SLICE):
                    some, own = np.ascontiguousarray(keys[:, lo : lo + SLICE]), target[lo : lo + SLICE]
                    node = np.zeros(len(own), np.uint16)
                    for step in steps:
                        node = step(some, node)
                    g = gradient(own, None if margin is None else margin[lo : lo + SLICE])
                    wg = by_class[own] * g
                    squares += np.bincount(node, wg * g, nodes)
                    both = np.array([1.0, OTHER])[own]
                    for p, n in enumerate(layout.cells):
                        at = some[p] if nodes == 1 else node * np.int64(n) + some[p]
                        sums[p][0] += np.bincount(at, both, nodes * n)
                        sums[p][1] += np.bincount(at, wg, nodes * n)
            if sums:
                ones = [s[0] // OTHER for s in sums]
                parts = [np.stack([s[0] - (OTHER - 1) * n, (s[0] - OTHER * n) * by_class[0] + n * by_class[1], s[1]], axis=-1).reshape(nodes, -1, 3) for s, n in zip(sums, ones, strict=True)]
                yield np.concatenate([squares, *(layout.marginal(parts, k).ravel() for k in range(len(layout.columns)))])

        return job

    def added(levels: list[Grown], values: np.ndarray):
        def job(part: Iterator[tuple]) -> Iterator[tuple]:
            steps = [Steps(layout, g, False) for g in levels]
            for at, keys, target, margin in part:
                node = np.zeros(len(target), np.uint16)
                for step in steps:
                    node = step(keys, node)
                yield at, keys, target, values[node] if margin is None else margin + values[node]

        return job

    def predicted(levels: list[Grown]) -> np.ndarray:
        """The prediction of each node of the level below the last; rows of a leaf have all gone to its left."""
        now = np.array([levels[0].stats[0, 2] / levels[0].stats[0, 1]])
        for g in levels:
            below = g.children[..., 2] / np.where(g.children[..., 1] > 0, g.children[..., 1], 1)
            now = np.where(g.gain[:, None] > 0, below, now[:, None]).ravel()
        return now

    before, state = None, blocks.map(lambda b: (*b, None)).persist(STATE)
    trees, files = [], []
    for k in range(estimator.getMaxIter()):
        levels, squares = [], []
        for level in range(depth):
            found, nodes = _summed(state.mapPartitions(counted(levels))), 2**level
            if before:  # the first pass has written the state that follows
                before.unpersist()
                before = None
                files.append(state.getCheckpointFile())
                if files[-1]:
                    _forget(spark, files[:-1])
                    files = files[-1:]
            ends = nodes * np.cumsum([1, *(3 * c.bins for c in layout.columns)])
            sums = [found[a:b].reshape(nodes, -1, 3) for a, b in zip(ends, ends[1:], strict=False)]
            squares.append(found[:nodes])
            levels.append(variance_splits(layout, sums, least))
            if not levels[-1].gain.any():
                break

        def told(stats: np.ndarray, all_=squares[0][0], root=levels[0].stats[0]) -> tuple:
            # the sum of squares is known for the root; below it stands for the tree's mean, since no prediction needs it
            n, weight, total = map(float, stats)
            squared = float(all_) * weight / float(root[1])
            return total / weight, max(0.0, squared / weight - (total / weight) ** 2), [weight, total, squared], int(round(n))

        trees.append(flat(levels, told))
        if k + 1 == estimator.getMaxIter():
            break
        before, state = state, state.mapPartitions(added(levels, predicted(levels) * (rate if k else 1.0)), preservesPartitioning=True).persist(STATE)
        if estimator.getCheckpointInterval() > 0 and (k + 1) % estimator.getCheckpointInterval() == 0:
            state.checkpoint()
    state.unpersist()
    _forget(spark, files)
    return as_model(spark, estimator, trees, [1.0, *[rate] * (len(trees) - 1)], features)


def _forget(spark, files: Sequence[str | None]) -> None:
    for file in filter(None, files):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
