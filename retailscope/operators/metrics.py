"""Binary classification metrics over a scored table, optionally per model and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numeric import count_where, rows
from retailscope.functions.ordered import running_totals
from retailscope.session import staged


def _ratio(num: Column, den: Column) -> Column:
    """Double quotient, 0 for an empty denominator as in the usual metric libraries."""
    return F.coalesce(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def threshold_metrics(scored: DataFrame, label: str, score: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Confusion matrix, precision, recall and F1 at a threshold; one pass."""
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.groupBy(*by).agg(
        count_where(hit & real).alias("tp"),
        count_where(hit & ~real).alias("fp"),
        count_where(~hit & real).alias("fn"),
        count_where(~hit & ~real).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def curve(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, highest first: positives and negatives at it and down to it.

    Rows collapse to distinct scores before anything is ordered, and the order is summed in slices.
    """
    counted = staged(
        scored.groupBy(*by, (-F.col(score).cast("double")).alias("order_score")).agg(
            count_where(F.col(label) == 1).alias("pos"), count_where(F.col(label) != 1).alias("neg")
        ),
        "curve",
    )
    summed = running_totals(counted, {"tp": F.col("pos"), "fp": F.col("neg")}, ["order_score"], by)
    totals = counted.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    score_column = (-F.col("order_score")).alias("score")
    if not by:
        packed = totals.select(F.struct("all_pos", "all_neg")).scalar()
        return summed.withColumn("t", packed).select(score_column, "pos", "neg", "tp", "fp", "t.all_pos", "t.all_neg")
    return summed.join(totals, list(by)).select(*by, score_column, "pos", "neg", "tp", "fp", "all_pos", "all_neg")


def curve_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC (fpr, tpr) and precision-recall points."""
    return points.select(
        *by,
        "score",
        _ratio(F.col("fp"), F.col("all_neg")).alias("fpr"),
        _ratio(F.col("tp"), F.col("all_pos")).alias("tpr"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def ranking_metrics(points: DataFrame, by: Sequence[str] = (), digits: int = 8) -> DataFrame:
    """ROC-AUC with ties averaged, and average precision as the step sum over distinct scores."""
    pairs = F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / F.lit(2.0))
    step = F.col("pos").cast("double") * _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    sums = points.groupBy(*by).agg(
        F.sum(pairs).alias("pairs"),
        F.sum(step).alias("steps"),
        F.max("all_pos").alias("p"),
        F.max("all_neg").alias("n"),
    )
    positives, negatives = F.nullif("p", F.lit(0)).cast("double"), F.nullif("n", F.lit(0)).cast("double")
    return sums.select(
        *by,
        F.round(F.col("pairs") / (positives * negatives), digits).alias("roc_auc"),
        F.round(F.col("steps") / positives, digits).alias("pr_auc"),
    )


def classification_metrics(
    scored: DataFrame, label: str, score: str, by: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """Threshold and ranking metrics in one table."""
    fixed = threshold_metrics(scored, label, score, by, threshold)
    ranked = ranking_metrics(curve(scored, label, score, by), by)
    if by:
        return fixed.join(ranked, list(by))
    one = ranked.select(F.struct("roc_auc", "pr_auc")).scalar()
    return fixed.withColumn("r", one).select("*", "r.roc_auc", "r.pr_auc").drop("r")


def gaps(metrics: DataFrame) -> DataFrame:
    """Train minus test average precision per model, and the model with the best test value."""
    wide = metrics.groupBy("model").pivot("split", ["train", "test"]).agg(F.first("pr_auc"))
    best = wide.agg(F.max_by("model", F.struct(F.col("test"), F.col("model")))).scalar()
    return wide.withColumn("best", best).select(
        "model",
        F.col("train").alias("train_pr_auc"),
        F.col("test").alias("test_pr_auc"),
        F.round(F.col("train") - F.col("test"), 8).alias("gap"),
        (F.col("model") == F.col("best")).alias("selected"),
    )


def class_weights(features: DataFrame, label: str = "target") -> DataFrame:
    """Balanced weights n / (2 * n_class), and the negative-to-positive ratio."""
    counts = features.agg(
        rows().alias("n"), count_where(F.col(label) == 1).alias("pos"), count_where(F.col(label) == 0).alias("neg")
    )
    n = F.col("n").cast("double")
    return counts.select(
        "n",
        "pos",
        "neg",
        (n / (2 * F.nullif("pos", F.lit(0)))).alias("weight_pos"),
        (n / (2 * F.nullif("neg", F.lit(0)))).alias("weight_neg"),
        (F.col("neg").cast("double") / F.nullif("pos", F.lit(0))).alias("neg_to_pos"),
    )
