"""KPI breakdowns by report dimension: partial aggregation over the facts, then shares of the total.

Totals are scalar subqueries over the same grouped table. Spark runs its shuffle once and reuses it,
and no window has to bring every group into one task, however many values a dimension has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailscope.functions.bands import AGE_BANDS, DELAY_BANDS, DELIVERY_DAY_BANDS, RATING_BANDS, band
from retailscope.functions.numeric import (
    cents,
    count_where,
    money,
    money_mean,
    money_percent,
    percent,
    rounded_ratio,
    rows,
    sum_where,
)
from retailscope.functions.ordered import exact_quantiles
from retailscope.operators import sales
from retailscope.operators.sales import RETURNED, mean_rating
from retailscope.schemas import PAID_CHANNELS, RETURN_REASONS, SOCIAL_CHANNELS
from retailscope.session import staged

def with_totals(grouped: DataFrame, *columns: str) -> DataFrame:
    """`grouped` plus `_total`, the sums of the columns over all its rows."""
    total = grouped.agg(F.struct(*[F.sum(c).alias(c) for c in columns])).scalar()
    return grouped.withColumn("_total", total)


def share(part: str, name: str) -> Column:
    """Percentage of the `with_totals` sum."""
    return percent(F.col(part), F.col(f"_total.{part}")).alias(name)


def money_share(part: str, name: str) -> Column:
    return money_percent(F.col(part), F.col(f"_total.{part}")).alias(name)


def order_sums() -> list[Column]:
    return [
        rows().alias("orders"),
        F.sum("net_sales").alias("net"),
        F.sum("profit").alias("gain"),
        count_where(F.expr(RETURNED)).alias("returned_orders"),
    ]


def kpi_columns() -> list[Column]:
    return [
        F.col("orders"),
        share("orders", "order_share_pct"),
        money(F.col("net")).alias("revenue"),
        money_share("net", "revenue_share_pct"),
        money_mean(F.col("net"), F.col("orders")).alias("aov"),
        money(F.col("gain")).alias("profit"),
        money_percent(F.col("gain"), F.col("net")).alias("margin_pct"),
        F.col("returned_orders"),
        percent(F.col("returned_orders"), F.col("orders")).alias("return_rate_pct"),
    ]


def kpi_by(orders: DataFrame, *dims: str | Column, extra: Mapping[str, tuple[Sequence[Column], Column]] | None = None) -> DataFrame:
    """Orders, shares, revenue, AOV, profit, margin and return rate per value of the dimensions.

    `extra` adds measures: name -> (aggregates, expression over their aliases).
    """
    measures = extra or {}
    sums = order_sums() + [a for aggregates, _ in measures.values() for a in aggregates]
    grouped = orders.groupBy(*dims).agg(*sums)
    names = grouped.columns[: len(dims)]
    return with_totals(grouped, "orders", "net").select(*names, *kpi_columns(), *[value.alias(name) for name, (_, value) in measures.items()])


def decimal_mean(column: str, name: str) -> tuple[list[Column], Column]:
    """Mean of a two-decimal column, for `extra`."""
    total, count = f"_{name}_sum", f"_{name}_n"
    return [F.sum(column).alias(total), F.count(column).alias(count)], money_mean(F.col(total), F.col(count))


def distinct_customers() -> tuple[list[Column], Column]:
    return [F.count_distinct("customer_id").alias("_customers")], F.col("_customers")


# --- company-wide -------------------------------------------------------------------------------


def headline(orders: DataFrame, customers: DataFrame, ratings: DataFrame) -> DataFrame:
    """The company in one row."""
    totals = orders.agg(
        rows().alias("orders"),
        F.count_distinct("customer_id").alias("ordering_customers"),
        F.sum("net_sales").alias("net"),
        F.sum("gross_sales").alias("gross"),
        F.sum("discount_amount").alias("off"),
        F.sum("profit").alias("gain"),
        F.sum("quantity").alias("units"),
        count_where(F.expr(RETURNED)).alias("returned_orders"),
        count_where(F.col("order_status") == "Cancelled").alias("cancelled_orders"),
    )
    never = customers.join(orders.select("customer_id"), "customer_id", "left_anti").agg(rows()).scalar()
    rated = ratings.agg(F.struct(F.count("rating").alias("n"), F.sum("rating").alias("total"))).scalar()
    return totals.withColumns({"rated": rated, "never_ordered": never}).select(
        "orders",
        "ordering_customers",
        "never_ordered",
        money(F.col("net")).alias("revenue"),
        money(F.col("gross")).alias("gross_sales"),
        money_percent(F.col("gross") - F.col("net"), F.col("net")).alias("gross_over_net_pct"),
        money(F.col("off")).alias("discounts"),
        money_percent(F.col("off"), F.col("gross")).alias("discount_pct"),
        money(F.col("gain")).alias("profit"),
        money_percent(F.col("gain"), F.col("net")).alias("margin_pct"),
        money_mean(F.col("net"), F.col("orders")).alias("aov"),
        F.col("units"),
        "returned_orders",
        percent(F.col("returned_orders"), F.col("orders")).alias("return_rate_pct"),
        "cancelled_orders",
        percent(F.col("cancelled_orders"), F.col("orders")).alias("cancellation_rate_pct"),
        F.col("rated.n").alias("rated_orders"),
        mean_rating(F.col("rated.total"), F.col("rated.n")).alias("avg_rating"),
    )


def year_table(orders: DataFrame) -> DataFrame:
    """Orders, revenue, profit and growth over the previous present year."""
    yearly = orders.groupBy(F.year("order_date").alias("year")).agg(*order_sums())
    before = yearly.withColumn("previous", F.lag("net").over(Window.orderBy("year")))
    return before.select(
        "year",
        "orders",
        money(F.col("net")).alias("revenue"),
        money(F.col("gain")).alias("profit"),
        money_percent(F.col("net") - F.col("previous"), F.col("previous")).alias("yoy_growth_pct"),
    )


def peak_season(orders: DataFrame, months: Sequence[int] = (11, 12)) -> DataFrame:
    """Share of orders and revenue that falls in the peak months."""
    peak = F.month("order_date").isin(*months)
    sums = orders.agg(
        rows().alias("all_orders"),
        F.sum("net_sales").alias("net"),
        count_where(peak).alias("peak_orders"),
        sum_where(peak, F.col("net_sales")).alias("peak"),
    )
    return sums.select(
        "peak_orders",
        money(F.col("peak")).alias("peak_revenue"),
        percent(F.col("peak_orders"), F.col("all_orders")).alias("order_share_pct"),
        money_percent(F.col("peak"), F.col("net")).alias("revenue_share_pct"),
    )


def best_and_worst_month(orders: DataFrame) -> DataFrame:
    """Per year the months with most and least revenue; the earlier month wins a tie."""
    monthly = orders.groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month")).agg(
        F.sum("net_sales").alias("net")
    )
    return monthly.groupBy("year").agg(
        F.max_by("month", F.struct(F.col("net"), -F.col("month"))).alias("best_month"),
        money(F.max("net")).alias("best_revenue"),
        F.min_by("month", F.struct("net", "month")).alias("worst_month"),
        money(F.min("net")).alias("worst_revenue"),
    )


def delivery_table(orders: DataFrame) -> DataFrame:
    """Delivery outcomes with mean days, and shares among the delivered orders."""
    table = kpi_by(orders, "delivery_status", extra={"avg_delivery_days": decimal_mean("delivery_days", "days")})
    delivered = table.withColumn("delivered", F.when(F.col("delivery_status") != "Cancelled", F.col("orders")))
    return with_totals(delivered, "delivered").select(*table.columns, share("delivered", "delivered_share_pct"))


def shipping_table(orders: DataFrame) -> DataFrame:
    """Shipping methods with mean days, mean cost and margin after shipping."""
    extra = {
        "avg_delivery_days": decimal_mean("delivery_days", "days"),
        "avg_shipping_cost": decimal_mean("shipping_cost", "cost"),
        "shipping_pct_of_revenue": (
            [F.sum("shipping_cost").alias("_ship"), F.sum("net_sales").alias("_ship_net")],
            money_percent(F.col("_ship"), F.col("_ship_net")),
        ),
    }
    return kpi_by(orders, "shipping_method", extra=extra)


# --- customers ----------------------------------------------------------------------------------


def customer_base(customers: DataFrame) -> DataFrame:
    sums = customers.agg(
        rows().alias("customers"),
        F.min("customer_age").alias("min_age"),
        F.max("customer_age").alias("max_age"),
        F.sum("customer_age").alias("ages"),
        F.count("customer_age").alias("aged"),
        F.sum("customer_acquisition_cost").alias("cost"),
    )
    return sums.select(
        "customers",
        "min_age",
        "max_age",
        rounded_ratio(F.col("ages"), F.col("aged"), 1).alias("avg_age"),
        money(F.col("cost")).alias("total_acquisition_cost"),
        money_mean(F.col("cost"), F.col("customers")).alias("avg_acquisition_cost"),
    )


def customers_by(customers: DataFrame, dim: str) -> DataFrame:
    counts = customers.groupBy(dim).agg(rows().alias("customers"))
    return with_totals(counts, "customers").select(dim, "customers", share("customers", "share_pct"))


def customer_totals(orders: DataFrame) -> DataFrame:
    """One row per ordering customer."""
    return orders.groupBy("customer_id").agg(*order_sums())


def lifetime_value(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Order frequency and lifetime revenue per customer: mean, exact median, extremes, repeat share."""
    per_customer = staged(customer_totals(orders).select("customer_id", "orders", "net"), "customer-totals")
    medians = exact_quantiles(per_customer, ["orders", "net"], [0.5])
    cost = customers.agg(
        F.struct(F.sum("customer_acquisition_cost").alias("total"), rows().alias("n"))
    ).scalar()
    sums = per_customer.agg(
        rows().alias("customers"),
        F.sum("orders").alias("all_orders"),
        F.min("orders").alias("min_orders"),
        F.max("orders").alias("max_orders"),
        F.sum("net").alias("total"),
        F.max("net").alias("top"),
        count_where(F.col("orders") > 1).alias("repeat_customers"),
    )

    def median(feature: str) -> Column:
        return F.lit(medians[feature][0]).cast("double")

    revenue_per_dollar = rounded_ratio(
        cents(F.col("total")) * F.col("cost.n"), cents(F.col("cost.total")) * F.col("customers"), 2
    )
    return sums.withColumns({"cost": cost, "m_orders": median("orders"), "m_net": median("net")}).select(
        "customers",
        rounded_ratio(F.col("all_orders"), F.col("customers")).alias("avg_orders"),
        F.col("m_orders").alias("median_orders"),
        "min_orders",
        "max_orders",
        money_mean(F.col("total"), F.col("customers")).alias("avg_revenue"),
        F.round("m_net", 2).alias("median_revenue"),
        money(F.col("top")).alias("max_revenue"),
        "repeat_customers",
        percent(F.col("repeat_customers"), F.col("customers")).alias("repeat_share_pct"),
        revenue_per_dollar.alias("revenue_per_acquisition_dollar"),
    )


def customer_kpi(orders: DataFrame, customers: DataFrame, dim: str | Column) -> DataFrame:
    """KPIs by a customer attribute. Registered customers are counted even if they never ordered."""
    joined = customers.select("customer_id", dim if isinstance(dim, Column) else F.col(dim)).join(
        customer_totals(orders), "customer_id", "left"
    )
    name = joined.columns[1]
    sums = joined.groupBy(name).agg(
        rows().alias("customers"),
        F.count("orders").alias("active_customers"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("orders", "net", "gain", "returned_orders")],
    )
    return with_totals(sums, "customers", "orders", "net").select(
        name, "customers", "active_customers", share("customers", "customer_share_pct"), *kpi_columns()
    )


def age_band() -> Column:
    return band(F.col("customer_age"), AGE_BANDS).alias("age_band")


def loyalty(orders: DataFrame) -> DataFrame:
    sums = orders.agg(
        F.sum("loyalty_points_earned").alias("points_earned"),
        F.sum("loyalty_points_redeemed").alias("points_redeemed"),
        count_where(F.col("loyalty_points_redeemed") > 0).alias("redeeming_orders"),
        rows().alias("n"),
    )
    return sums.select(
        "points_earned",
        "points_redeemed",
        percent(F.col("points_redeemed"), F.col("points_earned")).alias("redeemed_pct"),
        "redeeming_orders",
        percent(F.col("redeeming_orders"), F.col("n")).alias("redeeming_share_pct"),
    )


# --- products -----------------------------------------------------------------------------------


def catalog(products: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Catalog size, price range and what of it was sold."""
    sold = items.agg(
        F.struct(rows().alias("lines"), F.sum("quantity").alias("units"), F.count_distinct("product_id").alias("sold"))
    ).scalar()
    placed = orders.agg(rows()).scalar()
    sums = products.agg(
        rows().alias("products"),
        F.count_distinct("product_category").alias("categories"),
        F.count_distinct("product_subcategory").alias("subcategories"),
        F.count_distinct("brand").alias("brands"),
        money(F.min("unit_price")).alias("min_price"),
        money(F.max("unit_price")).alias("max_price"),
        F.sum("unit_price").alias("prices"),
        rounded_ratio(F.sum("product_rating") * 100, rows() * 100).alias("avg_product_rating"),
    )
    return sums.withColumns({"sold": sold, "placed": placed}).select(
        "products",
        "categories",
        "subcategories",
        "brands",
        "min_price",
        "max_price",
        money_mean(F.col("prices"), F.col("products")).alias("avg_price"),
        "avg_product_rating",
        F.col("sold.sold").alias("products_sold"),
        F.col("sold.units").alias("units_sold"),
        rounded_ratio(F.col("sold.lines"), F.col("placed")).alias("lines_per_order"),
    )


def category_rank(products: DataFrame, items: DataFrame) -> DataFrame:
    """Categories by item revenue with share, margin and cumulative share."""
    per_product = sales.product_totals(items)
    sums = (
        per_product.join(products.select("product_id", "product_category"), "product_id")
        .groupBy("product_category")
        .agg(F.sum("revenue").alias("net"), F.sum("profit").alias("gain"))
    )
    ranked = Window.orderBy(F.desc("net"), "product_category")  # one row per category
    upto = F.sum("net").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    return with_totals(sums, "net").select(
        F.row_number().over(ranked).alias("rank"),
        "product_category",
        money(F.col("net")).alias("revenue"),
        money_share("net", "share_pct"),
        money_percent(upto, F.col("_total.net")).alias("cumulative_share_pct"),
        money(F.col("gain")).alias("profit"),
        money_percent(F.col("gain"), F.col("net")).alias("margin_pct"),
    )


def price_points(products: DataFrame) -> DataFrame:
    sums = products.groupBy("product_category").agg(
        rows().alias("products"),
        F.sum("unit_price").alias("prices"),
        money(F.min("unit_price")).alias("min_price"),
        money(F.max("unit_price")).alias("max_price"),
    )
    return sums.select(
        "product_category", "products", money_mean(F.col("prices"), F.col("products")).alias("avg_price"), "min_price", "max_price"
    )


def top_product_shares(products: DataFrame, items: DataFrame, limit: int = 10, by: str = "revenue") -> DataFrame:
    """Top products with brand and share of all item revenue."""
    totals = sales.product_totals(items)
    company = items.agg(F.sum("net_sales")).scalar()
    named = products.select("product_id", "product_name", "product_category", "brand").join(totals, "product_id")
    shown = named.withColumn("company", company).select(
        "product_id",
        "product_name",
        "product_category",
        "brand",
        F.col("units").alias("units_sold"),
        money(F.col("revenue")).alias("revenue"),
        money_percent(F.col("revenue"), F.col("company"), 4).alias("share_pct"),
        F.col(by).alias("_by"),
    )
    place = F.row_number().over(Window.orderBy(F.desc("_by"), "product_id"))  # over `limit` rows
    return sales.top(shown, "_by", "product_id", limit).withColumn("rank", place).drop("_by")


def top_brands(products: DataFrame, items: DataFrame, limit: int = 5) -> DataFrame:
    sums = (
        sales.product_totals(items)
        .join(products.select("product_id", "brand"), "product_id")
        .groupBy("brand")
        .agg(F.sum("revenue").alias("net"), F.sum("units").alias("units_sold"))
    )
    shared = with_totals(sums, "net").select("brand", money(F.col("net")).alias("revenue"), "units_sold", money_share("net", "share_pct"))
    return sales.top(shared, "revenue", "brand", limit)


def return_reasons(orders: DataFrame) -> DataFrame:
    """Returned orders per reason, with the reason's group and the group's share."""
    group = F.create_map(*[F.lit(v) for pair in RETURN_REASONS.items() for v in pair])
    counts = orders.where(F.expr(RETURNED)).groupBy("return_reason").agg(rows().alias("orders"))
    grouped = counts.withColumn("reason_group", group[F.col("return_reason")])
    of_group = F.sum("orders").over(Window.partitionBy("reason_group"))  # one row per reason
    return with_totals(grouped, "orders").select(
        "return_reason",
        "orders",
        share("orders", "share_pct"),
        "reason_group",
        percent(of_group, F.col("_total.orders")).alias("group_share_pct"),
    )


def returns_by_category_and_reason(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """Returned orders per (category, reason); an order counts once per category."""
    back = orders.where(F.expr(RETURNED)).select("order_id", "return_reason")
    pairs = sales.order_categories(items, products, back)
    return pairs.groupBy("product_category", "return_reason").agg(rows().alias("returned_orders"))


# --- marketing ----------------------------------------------------------------------------------


def channel_group() -> Column:
    channel = F.col("marketing_channel")
    return F.when(channel.isin(*PAID_CHANNELS), "paid").when(channel.isNotNull(), "owned").alias("channel_group")


def social_flag() -> Column:
    return F.coalesce(F.col("marketing_channel").isin(*SOCIAL_CHANNELS), F.lit(False)).alias("social")


def revenue_by_year(orders: DataFrame, dim: str, years: Sequence[int]) -> DataFrame:
    """`dim` x year revenue with one column per listed year and the change from first to last."""
    wide = orders.withColumn("year", F.year("order_date")).groupBy(dim).pivot("year", list(years)).agg(F.sum("net_sales"))
    first, last = F.col(str(years[0])), F.col(str(years[-1]))
    return wide.select(
        dim,
        *[money(F.coalesce(F.col(str(y)), F.lit(0))).alias(f"revenue_{y}") for y in years],
        money_percent(last - first, first, 1).alias("change_pct"),
    )


def roi_table(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Acquisition ROI with the mean acquisition cost per customer."""
    roi = sales.channel_roi(orders, customers)
    cost = F.col("total_acquisition_cost").cast("decimal(20,2)")
    return roi.withColumn("avg_acquisition_cost", money_mean(cost, F.col("customers_acquired")))


def campaigns(orders: DataFrame) -> DataFrame:
    """KPIs per campaign; orders without one are '(none)'."""
    named = orders.withColumn("campaign", F.coalesce("campaign_name", F.lit("(none)")))
    return kpi_by(named, "campaign", extra={"avg_discount": decimal_mean("discount_amount", "off")})


def campaign_coverage(orders: DataFrame) -> DataFrame:
    """Orders and revenue without a campaign, with the default one, and with a named one."""
    kind = (
        F.when(F.col("campaign_name").isNull(), "none")
        .when(F.col("campaign_name") == "Default_Campaign", "default")
        .otherwise("named")
        .alias("campaign_kind")
    )
    return kpi_by(orders, kind)


def coupon_use(orders: DataFrame) -> DataFrame:
    used = F.col("coupon_code").isNotNull().alias("coupon_used")
    return kpi_by(orders, used, extra={"avg_discount": decimal_mean("discount_amount", "off")})


def coupon_codes(orders: DataFrame) -> DataFrame:
    return kpi_by(
        orders.where(F.col("coupon_code").isNotNull()),
        "coupon_code",
        extra={"avg_discount": decimal_mean("discount_amount", "off")},
    )


def discount_totals(orders: DataFrame) -> DataFrame:
    sums = orders.agg(
        F.sum("discount_amount").alias("off"),
        F.sum("gross_sales").alias("gross"),
        count_where(F.col("discount_amount") > 0).alias("discounted_orders"),
        rows().alias("n"),
    )
    return sums.select(
        money(F.col("off")).alias("discounts"),
        money_percent(F.col("off"), F.col("gross")).alias("discount_pct_of_gross"),
        "discounted_orders",
        percent(F.col("discounted_orders"), F.col("n")).alias("discounted_share_pct"),
    )


def discount_bands(orders: DataFrame) -> DataFrame:
    banded = orders.withColumn("discount_band", sales.discount_band(F.col("discount_amount"), F.col("gross_sales")))
    return kpi_by(banded, "discount_band", extra={"avg_margin_pct": decimal_mean("profit_margin_percentage", "margin")})


# --- regions ------------------------------------------------------------------------------------


def region_volume(orders: DataFrame) -> DataFrame:
    return kpi_by(orders, "region", extra={"customers": distinct_customers()})


def fulfilment(orders: DataFrame, dim: str) -> DataFrame:
    """Delivery outcome shares and mean delivery days by region or warehouse."""
    outcomes = {"on_time_pct": "On Time", "delayed_pct": "Delayed", "early_pct": "Early", "cancelled_pct": "Cancelled"}
    counts = orders.groupBy(dim).agg(
        rows().alias("orders"),
        F.sum("delivery_days").alias("days"),
        F.count("delivery_days").alias("delivered"),
        *[count_where(F.col("delivery_status") == status).alias(name) for name, status in outcomes.items()],
    )
    return counts.select(
        dim,
        "orders",
        *[percent(F.col(name), F.col("orders")).alias(name) for name in outcomes],
        money_mean(F.col("days"), F.col("delivered")).alias("avg_delivery_days"),
    )


def return_rate_vs_company(orders: DataFrame, dim: str) -> DataFrame:
    counts = orders.groupBy(dim).agg(rows().alias("orders"), count_where(F.expr(RETURNED)).alias("returned_orders"))
    return with_totals(counts, "returned_orders", "orders").select(
        dim,
        percent(F.col("returned_orders"), F.col("orders")).alias("return_rate_pct"),
        percent(F.col("_total.returned_orders"), F.col("_total.orders")).alias("company_rate_pct"),
    )


def top_categories_per(items: DataFrame, products: DataFrame, orders: DataFrame, dim: str, n: int = 3) -> DataFrame:
    """The n categories with most item revenue within each value of an order dimension."""
    lines = items.select("order_id", "product_id", "net_sales").join(orders.select("order_id", dim), "order_id")
    by_product = lines.groupBy(dim, "product_id").agg(F.sum("net_sales").alias("net"))
    sums = by_product.join(products.select("product_id", "product_category"), "product_id").groupBy(dim, "product_category").agg(F.sum("net").alias("net"))
    place = F.row_number().over(Window.partitionBy(dim).orderBy(F.desc("net"), "product_category"))
    return (
        sums.withColumn("rank", place)
        .where(F.col("rank") <= n)
        .select(dim, "rank", "product_category", money(F.col("net")).alias("revenue"))
    )


# --- ratings ------------------------------------------------------------------------------------


def rating_headline(ratings: DataFrame, orders: DataFrame) -> DataFrame:
    """Mean, median, mode, range and threshold shares of the ratings, from one count per value."""
    counts = ratings.groupBy("rating").agg(rows().alias("n"))
    middle = F.lit(exact_quantiles(ratings, ["rating"], [0.5])["rating"][0]).cast("double")
    placed = orders.agg(rows()).scalar()
    sums = counts.agg(
        F.sum("n").alias("rated_orders"),
        F.sum(F.col("rating") * F.col("n")).alias("total"),
        F.max_by("rating", F.struct(F.col("n"), -F.col("rating"))).cast("double").alias("mode_rating"),
        F.min("rating").cast("double").alias("min_rating"),
        F.max("rating").cast("double").alias("max_rating"),
        *[
            F.coalesce(sum_where(condition, F.col("n")), F.lit(0)).alias(name)
            for name, condition in (
                ("four_or_more", F.col("rating") >= 4),
                ("two_or_less", F.col("rating") <= 2),
                ("perfect", F.col("rating") == 5),
            )
        ],
    )
    rated = F.col("rated_orders")
    return sums.withColumns({"median_rating": middle, "placed": placed}).select(
        "rated_orders",
        percent(rated, F.col("placed")).alias("rated_share_pct"),
        mean_rating(F.col("total"), rated).alias("avg_rating"),
        F.round("median_rating", 2).alias("median_rating"),
        "mode_rating",
        "min_rating",
        "max_rating",
        percent(F.col("four_or_more"), rated).alias("four_or_more_pct"),
        percent(F.col("two_or_less"), rated).alias("two_or_less_pct"),
        percent(F.col("perfect"), rated).alias("perfect_pct"),
    )


def rating_by(rated: DataFrame, dim: str | Column, extra: Mapping[str, tuple] | None = None) -> DataFrame:
    """Rated orders, their share and mean rating per value of a dimension."""
    measures = extra or {}
    grouped = rated.groupBy(dim).agg(
        F.count("rating").alias("rated_orders"),
        F.sum("rating").alias("total"),
        *[a for aggregates, _ in measures.values() for a in aggregates],
    )
    return with_totals(grouped, "rated_orders").select(
        grouped.columns[0],
        "rated_orders",
        share("rated_orders", "share_pct"),
        mean_rating(F.col("total"), F.col("rated_orders")).alias("avg_rating"),
        *[value.alias(name) for name, (_, value) in measures.items()],
    )


def rating_band() -> Column:
    return band(F.col("rating"), RATING_BANDS).alias("rating_band")


def delivery_day_band() -> Column:
    return band(F.col("delivery_days"), DELIVERY_DAY_BANDS).alias("delivery_band")


def delay_band() -> Column:
    return band(F.col("delivery_days") - F.col("estimated_delivery_days"), DELAY_BANDS).alias("delay_band")


def sentiment_check(ratings: DataFrame) -> DataFrame:
    """Negative reviews against ratings below 2.5: the two counts and the rows where they disagree."""
    low = F.col("rating") < F.lit("2.5").cast("decimal(3,1)")
    negative = F.col("review_sentiment") == "Negative"
    return ratings.agg(
        count_where(negative).alias("negative_reviews"),
        count_where(low).alias("ratings_below_2_5"),
        count_where(negative != low).alias("disagreeing"),
    )


def category_ratings(ratings: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Mean rating per category; a rated order counts once in every category it touches."""
    rated = ratings.select("order_id", "rating")
    return rating_by(sales.order_categories(items, products, rated), "product_category")


# --- repeat purchases -----------------------------------------------------------------------------


def first_and_repeat_orders(history: DataFrame) -> DataFrame:
    """KPIs of first orders against repeat orders; `history` has `prior_orders` per order."""
    kind = F.when(F.col("prior_orders") == 0, "first").otherwise("repeat").alias("order_kind")
    return kpi_by(history, kind)
