"""Point-in-time order history and the return-risk feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numeric import count_where, rounded_ratio, rows
from retailscope.functions.ordered import running_totals

# The model features in their order.
NUMERIC = ["shipping_ratio", "customer_prior_order_count", "customer_prior_revenue"]
CATEGORICAL = ["sales_channel", "payment_method", "shipping_method", "region", "customer_segment", "primary_category"]
BINARY = ["is_repeat_customer_asof"]
FEATURES = ["shipping_ratio", *CATEGORICAL, "customer_prior_order_count", "customer_prior_revenue", "is_repeat_customer_asof"]


def order_history(orders: DataFrame) -> DataFrame:
    """Orders plus what the customer had before each: `prior_orders` and `prior_revenue`, by date and id."""
    return running_totals(
        orders,
        {"prior_orders": F.lit(1).cast("bigint"), "prior_revenue": F.col("net_sales")},
        ["order_date", "order_id"],
        ["customer_id"],
        include_current=False,
    )


def days_between_orders(orders: DataFrame) -> DataFrame:
    """Days from each order to the customer's previous one.

    The sum of the gaps of a customer is the day count from first to last order, and the smallest
    and largest gap need the order's neighbour, which the numbered history gives by an equi-join.
    """
    numbered = running_totals(
        orders.select("customer_id", "order_date", "order_id"),
        {"seq": F.lit(1).cast("bigint")},
        ["order_date", "order_id"],
        ["customer_id"],
    )
    later = numbered.select("customer_id", (F.col("seq") - 1).alias("seq"), F.col("order_date").alias("next_date"))
    gap = F.date_diff(F.col("next_date"), F.col("order_date"))
    gaps = numbered.join(later, ["customer_id", "seq"]).select(gap.alias("gap"))
    return gaps.agg(
        rows().alias("gaps"),
        rounded_ratio(F.sum("gap"), rows()).alias("avg_days"),
        F.min("gap").alias("min_days"),
        F.max("gap").alias("max_days"),
    )


def returned_flag() -> Column:
    return (F.col("order_status") == "Returned").cast("int")


def target_summary(orders: DataFrame) -> DataFrame:
    """Orders, returns and the return rate."""
    counts = orders.agg(rows().alias("orders"), F.coalesce(F.sum(returned_flag()), F.lit(0)).alias("returned"))
    return counts.withColumn("return_rate", rounded_ratio(F.col("returned"), F.col("orders"), 6))


def split_name(last_train_year: int) -> Column:
    """Split by time: training up to and including the year, testing after it."""
    return F.when(F.year("order_date") <= last_train_year, "train").otherwise("test")


def split_summary(orders: DataFrame, last_train_year: int) -> DataFrame:
    counts = orders.groupBy(split_name(last_train_year).alias("split")).agg(
        rows().alias("orders"),
        F.sum(returned_flag()).alias("returned"),
        F.min("order_date").alias("first_date"),
        F.max("order_date").alias("last_date"),
    )
    return counts.withColumn("return_rate", rounded_ratio(F.col("returned"), F.col("orders"), 6))


def discount_exclusion(orders: DataFrame) -> DataFrame:
    """Why no discount feature is built: how discounts and returns co-occur."""
    off, back = F.col("discount_amount") > 0, F.col("order_status") == "Returned"
    return orders.agg(
        count_where(off).alias("discounted_orders"),
        count_where(off & back).alias("discounted_returns"),
        count_where(back).alias("returns"),
        count_where(back & ~off).alias("returns_without_discount"),
        count_where(F.col("gross_sales") <= 0).alias("orders_without_gross"),
    )


def shipping_ratio() -> Column:
    """Shipping cost per gross dollar; NULL without gross sales."""
    return F.col("shipping_cost").cast("double") / F.nullif(F.col("gross_sales").cast("double"), F.lit(0.0))


def primary_category(items: DataFrame, products: DataFrame, item_order: list[str] | tuple[str, ...]) -> DataFrame:
    """Category of the order's item with most revenue, the earlier item on ties.

    One candidate per order survives each partial aggregation; only the winners meet the products.
    """
    best = items.groupBy("order_id").agg(
        F.min_by("product_id", F.struct((-F.col("net_sales")).alias("less"), *item_order)).alias("product_id")
    )
    named = products.select("product_id", F.col("product_category").alias("primary_category"))
    return best.join(named, "product_id").select("order_id", "primary_category")


def stored_history_check(orders: DataFrame) -> DataFrame:
    """Stored per-customer aggregates against the order rows: are they constant, and do they agree?"""
    per_customer = orders.groupBy("customer_id").agg(
        rows().alias("actual"),
        F.min("customer_order_count").alias("low"),
        F.max("customer_order_count").alias("high"),
        F.max(F.col("is_repeat_customer").cast("int")).alias("flag"),
    )
    return per_customer.agg(
        rows().alias("customers"),
        count_where(F.col("low") == F.col("high")).alias("constant_counts"),
        count_where(F.col("high") != F.col("actual")).alias("disagreeing_counts"),
        count_where((F.col("flag") == 1) != (F.col("actual") > 1)).alias("disagreeing_flags"),
    )


def feature_table(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    item_order: list[str] | tuple[str, ...],
    last_train_year: int,
) -> DataFrame:
    """order_id, the model features, target and split. History covers every order; rows without
    gross sales or items have no ratio or category and are left out (see `feature_rejects`)."""
    raw = _feature_rows(orders, items, products, customers, item_order, last_train_year)
    return raw.where("shipping_ratio is not null and primary_category is not null")


def feature_rejects(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders that cannot be a training row, with the reason."""
    has_items = items.select("order_id").distinct().withColumn("found", F.lit(True))
    reason = F.when(F.col("found").isNull(), "no items").when(F.col("gross_sales") <= 0, "no gross sales")
    joined = orders.select("order_id", "gross_sales").join(has_items, "order_id", "left")
    return joined.select("order_id", reason.alias("reason")).where("reason is not null")


def _feature_rows(orders, items, products, customers, item_order, last_train_year) -> DataFrame:
    narrow = orders.select(
        "order_id",
        "customer_id",
        "order_date",
        "net_sales",
        shipping_ratio().alias("shipping_ratio"),
        "sales_channel",
        "payment_method",
        "shipping_method",
        "region",
        returned_flag().alias("target"),
        split_name(last_train_year).alias("split"),
    )
    # everything keyed by order first, then everything keyed by customer: the wide rows move once
    by_order = narrow.join(primary_category(items, products, item_order), "order_id", "left")
    joined = order_history(by_order).join(customers.select("customer_id", "customer_segment"), "customer_id")
    return joined.select(
        "order_id",
        "shipping_ratio",
        *CATEGORICAL,
        F.col("prior_orders").alias("customer_prior_order_count"),
        F.col("prior_revenue").cast("double").alias("customer_prior_revenue"),
        (F.col("prior_orders") > 0).cast("int").alias("is_repeat_customer_asof"),
        "target",
        "split",
    )
