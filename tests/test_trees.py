"""Trees grown from histograms against Spark ML's own on rows whose every split both can see."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retailscope.operators import models, trees
from retailscope.operators.features import BINARY, CATEGORICAL, NUMERIC


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3000):
        ratio, count, revenue = rng.randrange(40) / 8, rng.randrange(6), rng.randrange(50) * 2.5
        words = [rng.choice("uvwxyz"[: 2 + c]) for c in range(len(CATEGORICAL))]
        chance = 0.1 + 0.1 * (ratio > 3) + 0.15 * (words[2] == "w") + 0.2 * (count == 2) * (revenue > 60)
        rows.append((k, ratio, *words, count, revenue, int(count > 0), int(rng.random() < chance)))
    names = ["order_id", "shipping_ratio", *CATEGORICAL, "customer_prior_order_count", "customer_prior_revenue", "is_repeat_customer_asof", "target"]
    return spark.createDataFrame(rows, names).repartition(5)


@pytest.mark.parametrize("family", ["hist_gradient_boosting", "regularized_boosting"])
def test_boosting_equals_spark(spark, train, family, monkeypatch):
    stages = models.estimator(family, 1.0).getStages()

    def short(*args):  # passes of ten trees that cross a checkpoint
        return Pipeline(stages=[*stages[:-1], stages[-1].copy({stages[-1].maxIter: 12})])

    monkeypatch.setattr(models, "estimator", short)
    monkeypatch.setattr(trees, "BLOCK", 200)
    fitted = models.fit(train, family)
    want = short().fit(models.weighted(train)[0])
    assert fitted.stages[-1].treeWeights == want.stages[-1].treeWeights and len(fitted.stages[-1].trees) == 12
    told = [m.transform(train).select("order_id", vector_to_array("probability")[1].alias("p")).toPandas().set_index("order_id")["p"] for m in (fitted, want)]
    assert np.abs(told[0] - told[1].loc[told[0].index]).max() < 1e-9
    assert fitted.stages[-1].totalNumNodes == want.stages[-1].totalNumNodes


def test_forest_learns_as_spark_does(spark, train):
    weighted, total, _ = models.weighted(train)
    ours, theirs = models.fit(train, "random_forest"), models.estimator("random_forest", total)
    theirs = Pipeline(stages=[s if not s.hasParam("numTrees") else s.setNumTrees(10) for s in theirs.getStages()]).fit(weighted)
    a, b = (m.transform(train).select("order_id", models.chance(m).alias("p"), "target").toPandas().sort_values("order_id") for m in (ours, theirs))
    assert np.corrcoef(a.p, b.p)[0, 1] > 0.95 and abs(a.p.mean() - b.p.mean()) < 0.02
    nodes = [s.totalNumNodes / s.getNumTrees for m in (ours, theirs) for s in m.stages if s.hasParam("numTrees")]
    assert 0.8 < np.mean(nodes[:6]) / np.mean(nodes[6:]) < 1.25
    assert {s.numFeatures for m in (ours, theirs) for s in m.stages if s.hasParam("numTrees")} == {len(NUMERIC) + sum(min(2 + c, 6) for c in range(len(CATEGORICAL))) + len(BINARY)}


def test_keys_give_back_every_column():
    rng = np.random.default_rng(5)
    columns = [trees.Binned(k, int(n), np.arange(n - 1.0)) for k, n in enumerate((32, 5, 8, 1, 700, 2, 31))]
    layout = trees.laid_out(columns, 512)
    bins = np.stack([rng.integers(0, c.bins, 1000) for c in columns])
    keys = np.zeros((len(layout.cells), 1000), int)
    for k, b in enumerate(bins):
        keys[layout.key[k]] += layout.stride[k] * b
    sums = [np.bincount(key, minlength=n).reshape(1, n, 1) for key, n in zip(keys, layout.cells, strict=True)]
    for k, c in enumerate(columns):
        assert (layout.marginal(sums, k)[0, :, 0] == np.bincount(bins[k], minlength=c.bins)).all()
        assert (layout.bin_of(k)[keys[layout.key[k]]] == bins[k]).all()


def test_edges():
    assert trees.edges_of([1, 1, 2, 5], 32).tolist() == [1.5, 3.5]
    assert trees.edges_of([3.0], 32).tolist() == [] and trees.edges_of([], 32).tolist() == []
    cut = trees.edges_of(np.arange(2001) ** 2, 32)
    assert len(cut) == 31 and (np.diff(np.searchsorted(cut, np.arange(2001) ** 2)) <= 1).all()
    shares = np.bincount(np.searchsorted(cut, np.arange(2001) ** 2))
    assert shares.max() - shares.min() <= 2


def test_missing_features_and_one_class_are_errors(spark, train):
    with pytest.raises(Exception, match="missing"):
        models.fit(train.withColumn("customer_prior_revenue", F.when(F.col("order_id") > 0, F.col("customer_prior_revenue"))), "regularized_boosting")
    with pytest.raises(ValueError):
        models.fit(train.where("target = 1"), "random_forest")
