"""The four return-risk model families as Spark ML models, their comparison, and scoring. `trees` grows the tree ensembles."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, RobustScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.operators import trees
from retailscope.operators.features import BINARY, CATEGORICAL, NUMERIC
from retailscope.operators.metrics import class_weights, classification_metrics
from retailscope.session import shared_folder, staged

SEED = 42
#: Trees of a random forest, and of each of its parts. A row needs one node for each tree of a part only.
TREES, TREES_AT_ONCE = 300, 50
MAX_ITERATIONS = 1000
FAMILIES = ("logistic_regression", "hist_gradient_boosting", "random_forest", "regularized_boosting")
CODES = [f"{c}_code" for c in CATEGORICAL]


def indexer() -> StringIndexer:
    """Codes in alphabetical order of the training values; unseen values get the code after the last."""
    return StringIndexer(inputCols=CATEGORICAL, outputCols=CODES, handleInvalid="keep", stringOrderType="alphabetAsc")


def linear_input() -> list:
    """Centred and range-scaled numbers, one-hot categories (unseen: all zeros), the flag as it is."""
    hot = [f"{c}_hot" for c in CATEGORICAL]
    return [
        VectorAssembler(inputCols=NUMERIC, outputCol="numbers"),
        RobustScaler(inputCol="numbers", outputCol="scaled", withCentering=True, withScaling=True),
        indexer(),
        OneHotEncoder(inputCols=CODES, outputCols=hot, handleInvalid="error", dropLast=True),
        VectorAssembler(inputCols=["scaled", *hot, *BINARY], outputCol="features"),
    ]


def tree_input() -> list:
    """Raw numbers and category codes, which the trees split as categories."""
    return [indexer(), VectorAssembler(inputCols=[*NUMERIC, *CODES, *BINARY], outputCol="features")]


def estimator(family: str, total_weight: float, checkpoint_every: int = 10) -> Pipeline:
    common = {"labelCol": "target", "weightCol": "weight", "featuresCol": "features"}
    if family == "logistic_regression":
        # the penalty of an inverse strength of 1, expressed for a mean loss
        model = LogisticRegression(maxIter=MAX_ITERATIONS, regParam=1.0 / total_weight, elasticNetParam=0.0, standardization=False, **common)
        return Pipeline(stages=[*linear_input(), model])
    if family == "random_forest":
        parts = [
            RandomForestClassifier(numTrees=TREES_AT_ONCE, maxDepth=8, seed=SEED + k, checkpointInterval=checkpoint_every, probabilityCol=f"probability_{k}", rawPredictionCol="", predictionCol="", **common)
            for k in range(TREES // TREES_AT_ONCE)
        ]
        return Pipeline(stages=[*linear_input(), *parts])
    boosted = {"seed": SEED, "checkpointInterval": checkpoint_every, **common}
    if family == "hist_gradient_boosting":
        return Pipeline(stages=[*tree_input(), GBTClassifier(maxIter=100, maxDepth=4, stepSize=0.1, maxBins=64, minInstancesPerNode=20, **boosted)])
    if family == "regularized_boosting":
        return Pipeline(stages=[*tree_input(), GBTClassifier(maxIter=150, maxDepth=2, stepSize=0.03, maxBins=64, minInstancesPerNode=150, **boosted)])
    raise ValueError(f"unknown model family {family!r}; expected one of {FAMILIES}")


def weighted(train: DataFrame) -> tuple[DataFrame, float, tuple[float, float]]:
    """Training rows with balanced class weights, the weight total (the row count), and the weights of both classes."""
    w = class_weights(train).first()
    if not w["pos"] or not w["neg"]:
        raise ValueError("training rows hold a single class")
    weight = F.when(F.col("target") == 1, w["weight_pos"]).otherwise(w["weight_neg"])
    return train.withColumn("weight", weight), float(w["n"]), (w["weight_neg"], w["weight_pos"])


def fit(train: DataFrame, family: str) -> PipelineModel:
    """Fit one family. Boosting cuts its lineage in the session's checkpoint folder.

    A logistic regression that has not converged is an error, not a model.
    """
    shared_folder(train.sparkSession)
    rows, total, weights = weighted(train)
    if family != "logistic_regression":
        return _grown(rows, family, total, weights)
    fitted = estimator(family, total).fit(rows)
    if fitted.stages[-1].summary.totalIterations >= MAX_ITERATIONS:
        raise RuntimeError(f"no convergence within {MAX_ITERATIONS} iterations")
    return fitted


def _grown(rows: DataFrame, family: str, total: float, weights: tuple[float, float]) -> PipelineModel:
    """Trees over features that are computed, binned and written once; a forest's parts one after another."""
    stages = estimator(family, total).getStages()
    ensembles = [s for s in stages if isinstance(s, RandomForestClassifier | GBTClassifier)]
    ready = Pipeline(stages=[s for s in stages if s not in ensembles]).fit(rows)
    forest = family == "random_forest"
    # each category's codes and one more for unseen values, which is none of a forest's one-hot features
    known = [len(labels) for labels in next(s for s in ready.stages if isinstance(s, StringIndexerModel)).labelsArray]
    numbers = {k: vector_to_array("scaled")[k] if forest else F.col(c) for k, c in enumerate(NUMERIC)}
    codes, at = {}, len(NUMERIC)
    for c, n in zip(CODES, known, strict=True):
        codes[at] = F.col(c), n + 1, forest
        at += n if forest else 1
    numbers |= {at + k: F.col(c) for k, c in enumerate(BINARY)}
    features, grow = at + len(BINARY), trees.forest if forest else trees.boosted
    blocks, layout = trees.binned(ready.transform(rows), numbers, codes, ensembles[0].getMaxBins(), trees.FOREST_CELLS if forest else trees.BOOST_CELLS, total)
    return PipelineModel(stages=[*ready.stages, *(grow(blocks, layout, e, weights, features, rows.sparkSession) for e in ensembles)])


def chance(model: PipelineModel) -> Column:
    """The probability of a return; that of a forest is the mean over its trees, and so over its equal parts."""
    found = [s.getProbabilityCol() for s in model.stages if s.hasParam("probabilityCol")]
    return reduce(Column.__add__, [vector_to_array(c)[1] for c in found]) / len(found)


def scored(model: PipelineModel, features: DataFrame) -> DataFrame:
    """`features` plus `return_probability` and `predicted_label` (returned at 0.5 or more)."""
    told = model.transform(features).withColumn("return_probability", chance(model))
    label = F.when(F.col("return_probability") >= 0.5, "Returned").otherwise("Not Returned")
    return told.select(*features.columns, "return_probability", label.alias("predicted_label"))


def compared(models: dict[str, PipelineModel], features: DataFrame) -> DataFrame:
    """Metrics of every model on both splits, computed together; each row is scored once."""
    parts = [
        scored(model, features).select(F.lit(name).alias("model"), "split", "target", "return_probability")
        for name, model in models.items()
    ]
    every = staged(reduce(DataFrame.unionByName, parts), "scores")
    return classification_metrics(every, "target", "return_probability", by=["model", "split"])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def same_scores(a: PipelineModel, b: PipelineModel, features: DataFrame, key: str = "order_id") -> DataFrame:
    """Rows scored by both models and how many differ, for the check after reloading."""
    left = scored(a, features).select(key, F.col("return_probability").alias("a"))
    right = scored(b, features).select(key, F.col("return_probability").alias("b"))
    return left.join(right, key).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("differing"))
