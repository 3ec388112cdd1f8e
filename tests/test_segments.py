import datetime as dt
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from retailscope.operators import reports, segments

SCHEMA = "order_id bigint, customer_id string, order_date date, net_sales decimal(12,2)"


def make_orders(spark, customers, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(customers):
        for _ in range(1 + rng.randrange(6)):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(300))
            rows.append((len(rows), f"C{c:04d}", day, Decimal(rng.randrange(100, 2000)) / 100))
    return spark.createDataFrame(rows, SCHEMA), pd.DataFrame(rows, columns=["order_id", "customer_id", "order_date", "net_sales"])


def pandas_scores(orders):
    orders = orders.assign(order_date=pd.to_datetime(orders["order_date"]), net_sales=orders["net_sales"].astype(float).round(2))
    g = orders.groupby("customer_id").agg(last=("order_date", "max"), f=("order_date", "count"), m=("net_sales", "sum"))
    g["m"] = g["m"].round(2)
    g["r"] = (orders["order_date"].max() - g["last"]).dt.days

    def score(series, ascending):
        return pd.qcut(series.rank(method="first", ascending=ascending), 5, labels=[1, 2, 3, 4, 5]).astype(int)

    return {
        c: t for c, *t in zip(g.index, score(g["r"], False), score(g["f"], True), score(g["m"], True), strict=True)
    }


@pytest.mark.parametrize("customers", [4, 7, 23, 250])
def test_scores_equal_rank_quintiles(spark, customers):
    df, frame = make_orders(spark, customers)
    got = {r["customer_id"]: [r["r_score"], r["f_score"], r["m_score"]] for r in segments.rfm_scores(df).collect()}
    assert got == pandas_scores(frame)


def test_single_customer_scores_one(spark):
    df, _ = make_orders(spark, 1)
    row = segments.rfm_scores(df).first()
    assert (row["r_score"], row["f_score"], row["m_score"]) == (1, 1, 1)


def test_segment_rules_in_order(spark):
    cases = [
        ((5, 5, 5), "Champions"),
        ((4, 4, 4), "Champions"),
        ((3, 4, 5), "Loyal"),
        ((1, 5, 1), "Loyal"),
        ((2, 3, 1), "At Risk"),
        ((1, 1, 3), "At Risk"),
        ((5, 1, 1), "New"),
        ((4, 1, 5), "New"),
        ((2, 2, 2), "Lost"),
        ((1, 1, 1), "Lost"),
        ((3, 3, 3), "Needs Attention"),
        ((5, 2, 1), "Needs Attention"),
    ]
    df = spark.createDataFrame([s for s, _ in cases], "r_score int, f_score int, m_score int")
    got = {(r[0], r[1], r[2]): r["segment"] for r in segments.rfm_segments(df).collect()}
    assert got == dict(cases)


def test_summary_adds_up(spark):
    df, frame = make_orders(spark, 60)
    summary = segments.segment_summary(segments.rfm_segments(segments.rfm_scores(df)))
    total = summary.agg(F.sum("customer_count"), F.sum("total_monetary")).first()
    assert total[0] == 60 and total[1] == pytest.approx(float(frame["net_sales"].sum()))
    order = [r["total_monetary"] for r in summary.collect()]
    assert order == sorted(order, reverse=True)


def test_report_of_an_empty_range(spark, star):
    stats = reports.orders_stats(star.orders(True), star.items(), star.products(), date_from="2050-01-01")
    row = stats.first()
    assert (row["order_count"], row["total_revenue"], row["avg_order_value"], row["return_rate_pct"]) == (0, 0.0, 0.0, 0.0)
    assert row["top_categories"] == [] and row["top_channel"] is None
    told = reports.orders_narrative(stats).first()
    assert told["key_insights"][0] == "'N/A' is the top-revenue category."
    assert told["key_insights"][2] == "No sales-channel data available for this period."
    assert "Top sales channel: None (N/A)" in reports.orders_prompt(stats).first()["prompt"]


def test_ratings_report_of_an_empty_range(spark, star):
    stats = reports.ratings_stats(star.orders(), star.items(), star.products(), star.ratings(), date_from="2050-01-01")
    row = stats.first()
    assert row["total_ratings"] == 0 and row["avg_rating"] == 0.0 and row["rating_distribution"] == {}
    told = reports.ratings_narrative(stats).first()
    assert told["key_insights"] == ["No category return-rate data available."] * 2


def test_narratives_and_prompts_read_like_the_numbers(spark):
    stats = spark.sql(
        """SELECT cast(null as date) AS date_from, date'2025-12-31' AS date_to, 1234L AS order_count, 56789.5D AS total_revenue, 46.02D AS avg_order_value,
        6.8D AS return_rate_pct, array(named_struct('product_category', 'Toys', 'total_revenue', 1000.0D, 'share_pct', 31.0D)) AS top_categories,
        array(named_struct('region', 'South', 'total_revenue', 2000.0D, 'share_pct', 35.25D)) AS top_regions, 'Website' AS top_channel, 9.5D AS top_channel_revenue"""
    )
    told = reports.orders_narrative(stats).first()
    assert told["summary"] == "1,234 orders generated $56,789.50 in revenue (AOV $46.02) with a 6.80% return rate."
    assert told["key_insights"][0] == "'Toys' is the top-revenue category at 31.0% of total revenue."
    prompt = reports.orders_prompt(stats).first()["prompt"]
    assert "Period: all time to 2025-12-31" in prompt
    assert "Top regions by revenue: [('South', '$2,000.00 (35.25%)')]" in prompt


def test_reply_parsing_and_fallback(spark):
    good = 'Sure!\n```json\n{"summary": "s", "key_insights": ["a", "b"], "recommendations": []}\n``` bye'
    replies = spark.createDataFrame(
        [
            ("good", good),
            ("no_json", "sorry"),
            ("missing", '{"summary": "s", "key_insights": ["a"]}'),
            ("wrong_type", '{"summary": 5, "key_insights": ["a"], "recommendations": ["r"]}'),
            ("numbers", '{"summary": "s", "key_insights": [1], "recommendations": ["r"]}'),
            ("broken", '{"summary": "s", '),
            ("null", None),
        ],
        "report string, reply string",
    )
    fallback = replies.select("report", F.lit("f").alias("summary"), F.array(F.lit("i")).alias("key_insights"), F.array(F.lit("r")).alias("recommendations"))
    fallback = fallback.unionByName(fallback.limit(1).withColumn("report", F.lit("absent")))
    got = {r["report"]: r for r in reports.parsed_replies(replies, fallback).collect()}
    assert got["good"]["generated_by"] == "model" and got["good"]["key_insights"] == ["a", "b"] and got["good"]["recommendations"] == []
    assert all(r["generated_by"] == "deterministic_fallback" and r["summary"] == "f" for k, r in got.items() if k != "good")
    assert len(got) == 8
