"""Recency / frequency / monetary scoring of customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numeric import money, rows
from retailscope.functions.ordered import running_totals
from retailscope.session import staged

QUANTILES = 5

# Segment names with their conditions on the scores, first match wins.
SEGMENT_RULES = (
    ("Champions", "r_score >= 4 AND f_score >= 4 AND m_score >= 4"),
    ("Loyal", "f_score >= 4"),
    ("At Risk", "r_score <= 2 AND (f_score >= 3 OR m_score >= 3)"),
    ("New", "f_score = 1 AND r_score >= 4"),
    ("Lost", "r_score <= 2 AND f_score <= 2 AND m_score <= 2"),
)
OTHER_SEGMENT = "Needs Attention"


def rfm_base(orders: DataFrame) -> DataFrame:
    """Per customer: last order, order count, revenue, and days from the last order of all to theirs."""
    as_of = orders.agg(F.max("order_date")).scalar()
    per_customer = orders.groupBy("customer_id").agg(
        F.max("order_date").alias("last_order_date"),
        F.count("order_date").alias("frequency"),
        F.sum("net_sales").alias("monetary"),
    )
    return per_customer.withColumn("recency_days", F.date_diff(as_of, F.col("last_order_date")))


def quantile_score(position: Column, size: Column, parts: int = QUANTILES) -> Column:
    """Equal-frequency bin 1..parts of a 1-based rank, edges interpolated between ranks.

    Whole-number ceiling of parts * (rank - 1) / (size - 1); `ntile` puts the remainder elsewhere.
    """
    last = F.greatest(size - 1, F.lit(1))
    ceiling = F.call_function("div", F.lit(parts) * (position - 1) + last - 1, last)
    return F.greatest(F.lit(1), ceiling).cast("int")


def rfm_scores(orders: DataFrame) -> DataFrame:
    """Quintile scores: recent, frequent and high-spending customers score 5. Ties go by customer id.

    The three measures are ranked together, as three groups of one narrow table.
    """
    base = staged(rfm_base(orders), "rfm")
    size = base.agg(rows()).scalar()
    measures = {"r_score": -F.col("recency_days"), "f_score": F.col("frequency"), "m_score": F.col("monetary")}
    cells = [F.struct(F.lit(score).alias("score"), value.cast("decimal(30,4)").alias("value")) for score, value in measures.items()]
    long = base.select("customer_id", F.explode(F.array(*cells)).alias("x")).select("customer_id", "x.score", "x.value")
    placed = running_totals(long, {"position": F.lit(1).cast("bigint")}, ["value", "customer_id"], ["score"])
    places = placed.groupBy("customer_id").agg(*[F.max(F.when(F.col("score") == score, F.col("position"))).alias(score) for score in measures])
    ranked = base.join(places, "customer_id")
    return ranked.select(*base.columns, *[quantile_score(F.col(score), size).alias(score) for score in measures])


def segment() -> Column:
    label = None
    for name, rule in SEGMENT_RULES:
        label = F.when(F.expr(rule), name) if label is None else label.when(F.expr(rule), name)
    return label.otherwise(OTHER_SEGMENT)


def rfm_segments(scores: DataFrame) -> DataFrame:
    return scores.withColumn("segment", segment())


def segment_summary(segments: DataFrame) -> DataFrame:
    """Size, revenue, mean recency (1 digit) and mean frequency (2 digits), half-even like the report."""
    return (
        segments.groupBy("segment")
        .agg(
            rows().alias("customer_count"),
            money(F.sum("monetary")).alias("total_monetary"),
            F.bround(F.avg("recency_days"), 1).alias("avg_recency_days"),
            F.bround(F.avg("frequency"), 2).alias("avg_frequency"),
        )
        .orderBy(F.desc("total_monetary"), "segment")
    )
