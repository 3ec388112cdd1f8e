"""Revenue, margin, fulfilment, rating, return and acquisition reports.

Revenue is `net_sales`. Product and category revenue exists only at the item grain. The order's own
region is used, never the customer's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailscope.functions.numeric import (
    cents,
    count_where,
    money,
    money_mean,
    money_percent,
    percent,
    rounded_ratio,
    rows,
)
from retailscope.operators.filters import Date, apply_filters, in_range, top

RETURNED = "return_status is not null"


def top_customers(
    customers: DataFrame,
    orders: DataFrame,
    region: str | None = None,
    customer_segment: str | None = None,
    limit: int = 10,
) -> DataFrame:
    """Customers with the most revenue. Orders are summed per customer before the customer join."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    kept = apply_filters(customers, region=region, customer_segment=customer_segment)
    per_customer = orders.groupBy("customer_id").agg(
        F.count("order_id").alias("order_count"), F.sum("net_sales").alias("revenue")
    )
    named = kept.select("customer_id", "customer_name", "customer_segment", "region").join(per_customer, "customer_id")
    shown = named.select(
        "customer_id",
        "customer_name",
        "customer_segment",
        "region",
        "order_count",
        money(F.col("revenue")).alias("total_revenue"),
        money_mean(F.col("revenue"), F.col("order_count")).alias("avg_order_value"),
        "revenue",
    )
    return top(shown, "revenue", "customer_id", limit).drop("revenue")


def items_in_range(items: DataFrame, orders: DataFrame | None, date_from: Date, date_to: Date) -> DataFrame:
    """Items of the orders in the range. Without a range every item qualifies and no join is made."""
    dates = in_range(date_from, date_to)
    if dates is None:
        return items
    return items.join(orders.where(dates).select("order_id"), "order_id", "left_semi")


def product_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(
        F.sum("quantity").alias("units"), F.sum("net_sales").alias("revenue"), F.sum("profit").alias("profit")
    )


def top_products(
    products: DataFrame,
    items: DataFrame,
    orders: DataFrame | None = None,
    product_category: str | None = None,
    date_from: Date = None,
    date_to: Date = None,
    limit: int = 10,
    by: str = "revenue",
) -> DataFrame:
    """Products with the most revenue (or `units`). Items are summed per product before the join."""
    totals = product_totals(items_in_range(items, orders, date_from, date_to))
    kept = apply_filters(products, product_category=product_category)
    named = kept.join(totals, "product_id")
    shown = named.select(
        "product_id",
        "product_name",
        "product_category",
        F.col("units").alias("units_sold"),
        money(F.col("revenue")).alias("total_revenue"),
        F.col(by).alias("_by"),
    )
    return top(shown, "_by", "product_id", limit).drop("_by")


def category_margin(
    products: DataFrame,
    items: DataFrame,
    orders: DataFrame | None = None,
    product_category: str | None = None,
    date_from: Date = None,
    date_to: Date = None,
) -> DataFrame:
    """Revenue, profit and margin per category, from per-product sums."""
    totals = product_totals(items_in_range(items, orders, date_from, date_to))
    kept = apply_filters(products, product_category=product_category).select("product_id", "product_category")
    sums = (
        totals.join(kept, "product_id")
        .groupBy("product_category")
        .agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"))
    )
    return sums.select(
        "product_category",
        money(F.col("revenue")).alias("total_revenue"),
        money(F.col("profit")).alias("total_profit"),
        money_percent(F.col("profit"), F.col("revenue")).alias("margin_pct"),
    ).orderBy(F.desc("total_revenue"), "product_category")


def monthly_revenue(orders: DataFrame, date_from: Date = None, date_to: Date = None, region: str | None = None) -> DataFrame:
    kept = apply_filters(orders, date_from, date_to, region=region)
    return (
        kept.groupBy(F.trunc("order_date", "month").alias("month"))
        .agg(rows().alias("order_count"), money(F.sum("net_sales")).alias("total_revenue"))
        .orderBy("month")
    )


def yearly_revenue(orders: DataFrame, date_from: Date = None, date_to: Date = None, region: str | None = None) -> DataFrame:
    """Revenue per year and growth over the previous year that has orders."""
    kept = apply_filters(orders, date_from, date_to, region=region)
    yearly = kept.groupBy(F.year("order_date").alias("year")).agg(F.sum("net_sales").alias("revenue"))
    by_year = Window.orderBy("year")  # one row per calendar year
    before = yearly.withColumn("previous", F.lag("revenue").over(by_year))
    return before.select(
        "year",
        money(F.col("revenue")).alias("total_revenue"),
        money_percent(F.col("revenue") - F.col("previous"), F.col("previous")).alias("yoy_growth_pct"),
    ).orderBy("year")


def region_fulfilment(orders: DataFrame, date_from: Date = None, date_to: Date = None) -> DataFrame:
    """Revenue and delivery outcome shares per order region; 'Cancelled' covers pending and returned orders."""
    kept = apply_filters(orders, date_from, date_to)
    outcomes = {
        "on_time_pct": "On Time",
        "delayed_pct": "Delayed",
        "early_pct": "Early",
        "cancelled_pending_or_returned_pct": "Cancelled",
    }
    counts = kept.groupBy("region").agg(
        rows().alias("order_count"),
        F.sum("net_sales").alias("revenue"),
        *[count_where(F.col("delivery_status") == status).alias(name) for name, status in outcomes.items()],
    )
    return counts.select(
        "region",
        "order_count",
        money(F.col("revenue")).alias("total_revenue"),
        *[percent(F.col(name), F.col("order_count")).alias(name) for name in outcomes],
    ).orderBy(F.desc("total_revenue"), "region")


def channel_aov(orders: DataFrame, date_from: Date = None, date_to: Date = None) -> DataFrame:
    kept = apply_filters(orders, date_from, date_to)
    sums = kept.groupBy("sales_channel").agg(rows().alias("order_count"), F.sum("net_sales").alias("revenue"))
    return sums.select(
        "sales_channel",
        "order_count",
        money_mean(F.col("revenue"), F.col("order_count")).alias("avg_order_value"),
        money(F.col("revenue")).alias("total_revenue"),
    ).orderBy(F.desc("total_revenue"), "sales_channel")


def return_rate(orders: DataFrame, date_from: Date = None, date_to: Date = None) -> DataFrame:
    """Returned orders, all orders and the rate; the rate is NULL for an empty range."""
    kept = apply_filters(orders, date_from, date_to)
    counts = kept.agg(count_where(F.expr(RETURNED)).alias("returned_orders"), rows().alias("total_orders"))
    return counts.withColumn("return_rate_pct", percent(F.col("returned_orders"), F.col("total_orders")))


def order_categories(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per (order, category) with the order's columns.

    The categories of an order are a set, bounded by the catalog's categories and combined map-side:
    an order with very many items shuffles as one short row. The set is hashed by order like the
    orders are, so the join needs no further shuffle of items.
    """
    named = items.select("order_id", "product_id").join(products.select("product_id", "product_category"), "product_id")
    sets = named.groupBy("order_id").agg(F.collect_set("product_category").alias("categories"))
    return sets.join(orders, "order_id").select(*orders.columns, F.explode("categories").alias("product_category"))


def return_rate_by_category(
    items: DataFrame,
    products: DataFrame,
    orders: DataFrame,
    product_category: str | None = None,
    date_from: Date = None,
    date_to: Date = None,
) -> DataFrame:
    """Orders that touch a category and how many of them came back; an order counts once per category."""
    kept_orders = apply_filters(orders, date_from, date_to).select("order_id", "return_status")
    kept_products = apply_filters(products, product_category=product_category)
    counts = (
        order_categories(items, kept_products, kept_orders)
        .groupBy("product_category")
        .agg(rows().alias("orders_with_category"), count_where(F.expr(RETURNED)).alias("returned_orders"))
    )
    rate = percent(F.col("returned_orders"), F.col("orders_with_category"))
    return counts.withColumn("return_rate_pct", rate).orderBy(F.desc("return_rate_pct"), "product_category")


def rated_orders(ratings: DataFrame, orders: DataFrame, date_from: Date = None, date_to: Date = None) -> DataFrame:
    kept = apply_filters(orders, date_from, date_to)
    return kept.join(ratings.select("order_id", "rating", "review_sentiment"), "order_id")


def rating_distribution(ratings: DataFrame, orders: DataFrame, date_from: Date = None, date_to: Date = None) -> DataFrame:
    rated = rated_orders(ratings, orders.select("order_id", "order_date"), date_from, date_to)
    return rated.groupBy(F.col("rating").cast("double").alias("rating")).agg(rows().alias("num_ratings")).orderBy("rating")


def mean_rating(total: Column, count: Column) -> Column:
    """Mean of one-decimal ratings, two decimals."""
    return rounded_ratio((total * 10), count * 10)


def rating_by_delivery(ratings: DataFrame, orders: DataFrame, date_from: Date = None, date_to: Date = None) -> DataFrame:
    rated = rated_orders(ratings, orders.select("order_id", "order_date", "delivery_status"), date_from, date_to)
    sums = rated.groupBy("delivery_status").agg(F.count("rating").alias("num_ratings"), F.sum("rating").alias("total"))
    return sums.select(
        "delivery_status", "num_ratings", mean_rating(F.col("total"), F.col("num_ratings")).alias("avg_rating")
    ).orderBy(F.desc("avg_rating"), "delivery_status")


def returned_with_rating(ratings: DataFrame, orders: DataFrame) -> DataFrame:
    """Returned orders, and those of them that carry a rating (0 when the two sets are disjoint)."""
    joined = orders.select("order_id", "return_status").join(ratings.select("order_id", "rating"), "order_id", "left")
    back = F.expr(RETURNED)
    return joined.agg(
        count_where(back).alias("returned_orders_total"),
        count_where(back & F.col("rating").isNotNull()).alias("returned_orders_with_a_rating"),
    )


# Upper bounds of the discount share and the label of each band.
DISCOUNT_BANDS = (("0.10", "1-10%"), ("0.20", "11-20%"), ("0.30", "21-30%"))
NO_DISCOUNT = "0% (no discount)"
DEEP_DISCOUNT = "30%+"


def discount_band(discount: Column, gross: Column) -> Column:
    """Band of discount / gross. Compared as discount <= bound * gross, so nothing is rounded."""
    known = gross != 0
    band = F.when(discount == 0, NO_DISCOUNT)
    for bound, label in DISCOUNT_BANDS:
        share = F.when(gross > 0, discount <= gross * F.lit(bound).cast("decimal(4,2)")).otherwise(
            discount >= gross * F.lit(bound).cast("decimal(4,2)")
        )
        band = band.when(known & share, label)
    return band.otherwise(DEEP_DISCOUNT)


def discount_profitability(orders: DataFrame) -> DataFrame:
    banded = orders.withColumn("discount_band", discount_band(F.col("discount_amount"), F.col("gross_sales")))
    sums = banded.groupBy("discount_band").agg(
        rows().alias("order_count"),
        F.count("profit_margin_percentage").alias("margins"),
        F.sum("profit_margin_percentage").alias("margin"),
        F.sum("net_sales").alias("revenue"),
        F.sum("profit").alias("profit"),
    )
    return sums.select(
        "discount_band",
        "order_count",
        money_mean(F.col("margin"), F.col("margins")).alias("avg_margin_pct"),
        money(F.col("revenue")).alias("total_revenue"),
        money(F.col("profit")).alias("total_profit"),
    ).orderBy("discount_band")


def customer_acquisition(orders: DataFrame, date_from: Date = None, date_to: Date = None) -> DataFrame:
    """Per customer: channel of the first order that names one, and revenue within the range.

    One pass: the first channel is a `min_by` (which combines map-side, so a hot customer is no
    problem) and ignores the range; customers without an order in the range are dropped.
    """
    dates = in_range(date_from, date_to)
    inside = F.lit(True) if dates is None else dates
    named = F.when(F.col("marketing_channel").isNotNull(), F.struct("order_date", "order_id"))
    per_customer = orders.groupBy("customer_id").agg(
        F.min_by("marketing_channel", named).alias("marketing_channel"),
        F.sum(F.when(inside, F.col("net_sales"))).alias("lifetime_revenue"),
        count_where(inside).alias("orders_in_range"),
    )
    return per_customer.where("marketing_channel is not null and orders_in_range > 0")


def channel_roi(orders: DataFrame, customers: DataFrame, date_from: Date = None, date_to: Date = None) -> DataFrame:
    """Lifetime revenue per acquisition dollar, by the channel that brought the customer in."""
    acquired = customer_acquisition(orders, date_from, date_to)
    sums = (
        acquired.join(customers.select("customer_id", "customer_acquisition_cost"), "customer_id")
        .groupBy("marketing_channel")
        .agg(
            rows().alias("customers_acquired"),
            F.sum("lifetime_revenue").alias("revenue"),
            F.sum("customer_acquisition_cost").alias("cost"),
        )
    )
    return sums.select(
        "marketing_channel",
        "customers_acquired",
        money(F.col("revenue")).alias("lifetime_revenue"),
        money(F.col("cost")).alias("total_acquisition_cost"),
        rounded_ratio(cents(F.col("revenue")), cents(F.col("cost"))).alias("revenue_per_acquisition_dollar"),
    ).orderBy(F.desc("lifetime_revenue"), "marketing_channel")
