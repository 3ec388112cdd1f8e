"""The relational building blocks, each on whole tables, with their checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from retailscope.functions.numeric import count_where, money, money_mean, percent, rows, safe_divide, sum_where
from retailscope.functions.ordered import quantiles, running_totals
from retailscope.operators import chunking, filters, kpi, profile, quality, sales, segments
from retailscope.operators.filters import apply_filters, page
from retailscope.plans.checks import dollars, mean, pct, star
from retailscope.plans.kpi import TOP_SHARE
from retailscope.plans.quality import describe_sql
from retailscope.plans.registry import add
from retailscope.schemas import schema
from retailscope.session import shared_folder
from retailscope.sources import csv, publish, sample
from retailscope.sources.standin import ITEM_ORDER

# --- filters and projections ----------------------------------------------------------------------

add(
    "f1_optional_filters",
    lambda s: apply_filters(s.orders(True), "1996-01-01", None, region="ASIA", order_status=None, sales_channel="Website").select("order_id"),
    star("SELECT order_id FROM s_orders WHERE order_date >= DATE '1996-01-01' AND region = 'ASIA' AND sales_channel = 'Website'"),
)
add(
    "f2_date_range",
    lambda s: apply_filters(s.orders(), "1997-03-01", "1997-09-30").select("order_id", "order_date"),
    star("SELECT order_id, order_date FROM s_orders WHERE order_date >= DATE '1997-03-01' AND order_date <= DATE '1997-09-30'"),
)
add(
    "f3_vocabulary_filter",
    lambda s: apply_filters(s.orders(), **filters.checked(order_status="Pending", shipping_method="Express")).select("order_id"),
    star("SELECT order_id FROM s_orders WHERE order_status = 'Pending' AND shipping_method = 'Express'"),
)
add(
    "f4_null_filters",
    lambda s: s.orders().where(F.col("marketing_channel").isNull() & F.col("coupon_code").isNotNull()).select("order_id"),
    star("SELECT order_id FROM s_orders WHERE marketing_channel IS NULL AND coupon_code IS NOT NULL"),
)
add(
    "f5_discount_band",
    lambda s: s.orders().select("order_id", sales.discount_band(F.col("discount_amount"), F.col("gross_sales")).alias("band")),
    star(
        """SELECT order_id, CASE WHEN disc_c = 0 THEN '0% (no discount)' WHEN 10 * disc_c <= gross_c THEN '1-10%' WHEN 10 * disc_c <= 2 * gross_c THEN '11-20%'
  WHEN 10 * disc_c <= 3 * gross_c THEN '21-30%' ELSE '30%+' END AS band FROM s_orders"""
    ),
)
add(
    "f6_zero_safe_ratio",
    lambda s: s.orders().select("order_id", safe_divide(F.col("profit"), F.col("net_sales")).alias("margin")).where("margin is not null"),
    star("SELECT order_id, (profit_c::double / 100) / (net_c::double / 100) AS margin FROM s_orders WHERE net_c <> 0"),
)
add(
    "f7_project_and_rename",
    lambda s: s.items().select("order_id", F.col("product_id").alias("sku"), money(F.col("net_sales")).alias("paid")),
    star(f"SELECT order_id, product_id AS sku, {dollars('net_c')} AS paid FROM s_items"),
)
add(
    "f8_membership",
    lambda s: s.orders().where(F.col("order_status").isin("Returned", "Cancelled") & ~F.col("payment_method").isin("PayPal")).select("order_id"),
    star("SELECT order_id FROM s_orders WHERE order_status IN ('Returned', 'Cancelled') AND payment_method NOT IN ('PayPal')"),
)
add(
    "f9_numeric_columns",
    lambda s: s.products().select(*profile.numeric_columns(s.products())).select("product_id", *[money(F.col(c)).alias(c) for c in ("unit_price", "product_cost")]),
    star("SELECT product_id, unit_price::double AS unit_price, product_cost::double AS product_cost FROM s_products"),
)
add(
    "f10_coalesce",
    lambda s: s.orders().select("order_id", F.coalesce("coupon_code", F.lit("none")).alias("coupon")),
    star("SELECT order_id, coalesce(coupon_code, 'none') AS coupon FROM s_orders"),
)

# --- joins ----------------------------------------------------------------------------------------

add(
    "j1_customers_orders",
    lambda s: s.customers().join(s.orders(), "customer_id").groupBy("customer_country").agg(rows().alias("orders")),
    star("SELECT customer_country, count(*) AS orders FROM s_customers JOIN s_orders USING (customer_id) GROUP BY 1"),
)
add(
    "j2_products_items",
    lambda s: s.items().join(s.products(), "product_id").groupBy("brand").agg(rows().alias("items"), F.sum("quantity").alias("units")),
    star("SELECT brand, count(*) AS items, cast(sum(quantity) as bigint) AS units FROM s_items JOIN s_products USING (product_id) GROUP BY 1"),
)
add(
    "j3_items_products_orders",
    lambda s: s.items()
    .join(s.products(), "product_id")
    .join(s.orders().select("order_id", "order_status"), "order_id")
    .groupBy("product_category", "order_status")
    .agg(money(F.sum("net_sales")).alias("revenue")),
    star(f"SELECT product_category, order_status, {dollars('sum(i.net_c)')} AS revenue FROM s_items i JOIN s_products USING (product_id) JOIN s_orders USING (order_id) GROUP BY 1, 2"),
)
add(
    "j4_orders_left_ratings",
    lambda s: s.orders().join(s.ratings().select("order_id", "rating"), "order_id", "left").groupBy("order_status").agg(rows().alias("orders"), F.count("rating").alias("rated")),
    star("SELECT order_status, count(*) AS orders, count(rating) AS rated FROM s_orders LEFT JOIN (SELECT order_id, rating FROM s_ratings) USING (order_id) GROUP BY 1"),
)
add(
    "j5_orders_ratings",
    lambda s: sales.rated_orders(s.ratings(), s.orders()).groupBy("sales_channel").agg(F.sum("rating").cast("double").alias("stars")),
    star("SELECT sales_channel, sum(tenths)::double / 10 AS stars FROM s_orders JOIN s_ratings USING (order_id) GROUP BY 1"),
)
add(
    "j6_preaggregated_join",
    lambda s: kpi.customer_totals(s.orders())
    .join(s.customers(), "customer_id")
    .groupBy("customer_segment")
    .agg(money(F.sum("net")).alias("revenue"), money(F.sum("customer_acquisition_cost")).alias("cost")),
    star(
        f"""
, r AS (SELECT customer_id, sum(net_c) AS net FROM s_orders GROUP BY 1)
SELECT customer_segment, {dollars('sum(net)')} AS revenue, {dollars('sum(cac_c)')} AS cost FROM r JOIN s_customers USING (customer_id) GROUP BY 1"""
    ),
)
add(
    "j7_many_to_one",
    lambda s: quality.join_validated(s.items().select("order_id", "product_id"), s.products().select("product_id", "brand"), "product_id"),
    star("SELECT order_id, product_id, brand FROM s_items LEFT JOIN s_products USING (product_id)"),
)
add(
    "j8_one_to_one",
    lambda s: quality.join_validated(
        s.orders().select("order_id", "customer_id"), s.ratings().select("order_id", "review_sentiment"), "order_id", one_to_one=True, complete=False
    ),
    star("SELECT order_id, customer_id, review_sentiment FROM s_orders LEFT JOIN (SELECT order_id, review_sentiment FROM s_ratings) USING (order_id)"),
)
add(
    "j9_semi_join",
    lambda s: s.products().join(s.items(), "product_id", "left_semi").select("product_id"),
    star("SELECT product_id FROM s_products WHERE product_id IN (SELECT product_id FROM s_items)"),
)
add(
    "j9_anti_join",
    lambda s: s.orders().join(s.items(), "order_id", "left_anti").select("order_id"),
    star("SELECT order_id FROM s_orders WHERE order_id NOT IN (SELECT order_id FROM s_items)"),
)
add(
    "j10_lookup_with_default",
    lambda s: s.raw("supplier")
    .selectExpr("s_suppkey * 30 AS customer_id")
    .join(s.customers().select("customer_id", "customer_segment"), "customer_id", "left")
    .select("customer_id", F.coalesce("customer_segment", F.lit("Consumer")).alias("segment")),
    star("SELECT s_suppkey * 30 AS customer_id, coalesce(customer_segment, 'Consumer') AS segment FROM supplier LEFT JOIN s_customers ON customer_id = s_suppkey * 30"),
)
add(
    "j12_two_attributes_one_join",
    lambda s: s.items().join(s.products().select("product_id", "product_name", "product_category"), "product_id", "left").select("order_id", "product_name", "product_category"),
    star("SELECT order_id, product_name, product_category FROM s_items LEFT JOIN s_products USING (product_id)"),
)

# --- aggregates -----------------------------------------------------------------------------------

add(
    "g1_counts",
    lambda s: s.orders().groupBy("sales_channel").agg(rows().alias("orders"), F.count("coupon_code").alias("coupons")),
    star("SELECT sales_channel, count(*) AS orders, count(coupon_code) AS coupons FROM s_orders GROUP BY 1"),
)
add(
    "g2_decimal_sum",
    lambda s: s.items().groupBy("product_id").agg(money(F.sum("net_sales")).alias("revenue")),
    star(f"SELECT product_id, {dollars('sum(net_c)')} AS revenue FROM s_items GROUP BY 1"),
)
add(
    "g3_rounded_mean",
    lambda s: s.items().groupBy("product_id").agg(money_mean(F.sum("net_sales"), rows()).alias("mean_sale")),
    star(f"SELECT product_id, {mean('sum(net_c)', 'count(*)')} AS mean_sale FROM s_items GROUP BY 1"),
)
add(
    "g4_count_distinct",
    lambda s: s.orders().groupBy(F.trunc("order_date", "month").alias("month")).agg(F.count_distinct("customer_id").alias("customers")),
    star("SELECT cast(date_trunc('month', order_date) as date) AS month, count(DISTINCT customer_id) AS customers FROM s_orders GROUP BY 1"),
)
add(
    "g5_filtered_count",
    lambda s: s.orders().groupBy("warehouse").agg(count_where(F.col("delivery_status") == "Delayed").alias("delayed")),
    star("SELECT warehouse, count(*) FILTER (delivery_status = 'Delayed') AS delayed FROM s_orders GROUP BY 1"),
)
add(
    "g6_filtered_distinct",
    lambda s: s.orders().groupBy("warehouse").agg(F.count_distinct(F.when(F.col("return_status").isNotNull(), F.col("customer_id"))).alias("returning")),
    star("SELECT warehouse, count(DISTINCT customer_id) FILTER (return_status IS NOT NULL) AS returning FROM s_orders GROUP BY 1"),
)
add(
    "g7_global_aggregates",
    lambda s: s.orders().agg(rows().alias("orders"), money(F.sum("net_sales")).alias("revenue"), sum_where(F.col("quantity") > 100, F.lit(1)).alias("large")),
    star(f"SELECT count(*) AS orders, {dollars('sum(net_c)')} AS revenue, count(*) FILTER (quantity > 100) AS large FROM s_orders"),
)
add(
    "g8_min_max",
    lambda s: s.orders().groupBy("customer_id").agg(F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order")),
    star("SELECT customer_id, min(order_date) AS first_order, max(order_date) AS last_order FROM s_orders GROUP BY 1"),
)
add(
    "g9_arg_max",
    lambda s: s.orders().groupBy("customer_id").agg(F.max_by("order_id", F.struct(F.col("net_sales"), -F.col("order_id"))).alias("largest_order")),
    star("SELECT customer_id, arg_max(order_id, (net_c, -order_id)) AS largest_order FROM s_orders GROUP BY 1"),
)
add(
    "g10_rate",
    lambda s: s.orders().groupBy("sales_channel").agg(F.avg((F.col("order_status") == "Returned").cast("int")).alias("rate")),
    star("SELECT sales_channel, avg(cast(order_status = 'Returned' as int)) AS rate FROM s_orders GROUP BY 1"),
)
add(
    "g11_quantiles",
    lambda s: quantiles(s.orders(), ["net_sales", "quantity"], [0.1, 0.5, 0.9], by=["sales_channel"]).select(
        "sales_channel", "feature", "probability", F.round("quantile", 6).alias("quantile")
    ),
    star(
        "\nUNION ALL ".join(
            f"SELECT sales_channel, '{c}' AS feature, {p}::double AS probability, round(quantile_cont({c}::double, {p}), 6) AS quantile FROM s_orders GROUP BY 1"
            for c in ("net_sales", "quantity")
            for p in (0.1, 0.5, 0.9)
        )
    ),
)
add(
    "g12_correlation",
    lambda s: s.orders().groupBy("sales_channel").agg(F.round(F.corr(F.col("net_sales").cast("double"), F.col("quantity").cast("double")), 6).alias("r")),
    star("SELECT sales_channel, round(corr(net_sales::double, quantity::double), 6) AS r FROM s_orders GROUP BY 1"),
)
add("g13_describe", lambda s: profile.describe(s.products(), ["unit_price", "product_cost"]), describe_sql(["unit_price", "product_cost"], "s_products"))
add("g14_value_counts", lambda s: profile.value_counts(s.orders(), "marketing_channel"), star("SELECT marketing_channel, count(*) AS n FROM s_orders GROUP BY 1"))


def median_and_mode(s):
    middle = quantiles(s.items(), ["quantity"], [0.5]).select("quantile").scalar()
    counts = s.items().groupBy("quantity").agg(rows().alias("n"))
    return counts.agg(F.max_by("quantity", F.struct(F.col("n"), -F.col("quantity"))).alias("mode")).withColumn("median", middle)


add(
    "g15_median_and_mode",
    median_and_mode,
    star("SELECT (SELECT quantity FROM s_items GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, quantile_cont(quantity::double, 0.5) AS median FROM s_items"),
)
add(
    "g16_share_of_total",
    lambda s: kpi.with_totals(s.orders().groupBy("payment_method").agg(rows().alias("orders")), "orders").select(
        "payment_method", kpi.share("orders", "share_pct")
    ),
    star(f", g AS (SELECT payment_method, count(*) AS n FROM s_orders GROUP BY 1) SELECT payment_method, {pct('n', 'sum(n) OVER ()')} AS share_pct FROM g"),
)

# --- windows --------------------------------------------------------------------------------------

add(
    "w1_lag",
    lambda s: s.orders()
    .groupBy(F.trunc("order_date", "month").alias("month"))
    .agg(rows().alias("orders"))
    .withColumn("previous", F.coalesce(F.lag("orders").over(Window.orderBy("month")), F.lit(0))),
    star(", m AS (SELECT cast(date_trunc('month', order_date) as date) AS month, count(*) AS orders FROM s_orders GROUP BY 1) SELECT *, coalesce(lag(orders) OVER (ORDER BY month), 0) AS previous FROM m"),
)
add(
    "w2_first_row_per_key",
    lambda s: sales.customer_acquisition(s.orders()).select("customer_id", "marketing_channel"),
    star("SELECT DISTINCT ON (customer_id) customer_id, marketing_channel FROM s_orders WHERE marketing_channel IS NOT NULL ORDER BY customer_id, order_date, order_id"),
)


def numbered(s):
    return running_totals(
        s.orders().select("customer_id", "order_id", "order_date", "net_sales"),
        {"count_before": F.lit(1).cast("bigint"), "revenue_before": F.col("net_sales")},
        ["order_date", "order_id"],
        ["customer_id"],
        include_current=False,
    )


BEFORE = """, b AS (SELECT order_id, row_number() OVER w - 1 AS count_before, coalesce(sum(net_c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM s_orders WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id))"""
add("w3_running_count", lambda s: numbered(s).select("order_id", "count_before"), star(BEFORE + " SELECT order_id, count_before FROM b"))
add(
    "w4_running_sum",
    lambda s: numbered(s).select("order_id", money(F.col("revenue_before")).alias("revenue_before")),
    star(BEFORE + " SELECT order_id, c::double / 100 AS revenue_before FROM b"),
)
add(
    "w4_running_sum_in_slices",
    lambda s: running_totals(
        s.orders().select("sales_channel", "order_id", "net_sales"), {"upto": F.col("net_sales")}, ["order_id"], ["sales_channel"]
    ).select("order_id", money(F.col("upto")).alias("upto")),
    star("SELECT order_id, (sum(net_c) OVER (PARTITION BY sales_channel ORDER BY order_id))::double / 100 AS upto FROM s_orders"),
)
add(
    "w5_global_rank",
    lambda s: running_totals(
        kpi.customer_totals(s.orders()).select("customer_id", "net"), {"rank": F.lit(1).cast("bigint")}, ["net", "customer_id"]
    ).select("customer_id", "rank"),
    star("SELECT customer_id, row_number() OVER (ORDER BY sum(net_c), customer_id) AS rank FROM s_orders GROUP BY customer_id"),
)
add(
    "w6_quintiles_in_slices",
    lambda s: segments.rfm_scores(s.orders()).groupBy("m_score").agg(rows().alias("customers"), money(F.min("monetary")).alias("least")),
    star(
        """
, p AS (SELECT customer_id, sum(net_c) AS net, row_number() OVER (ORDER BY sum(net_c), customer_id) AS k, count(*) OVER () AS n FROM s_orders GROUP BY 1),
q AS (SELECT *, cast(greatest(1, ceil(5e0 * (k - 1) / (n - 1))) as int) AS m_score FROM p)
SELECT m_score, count(*) AS customers, min(net)::double / 100 AS least FROM q GROUP BY 1"""
    ),
)
add(
    "w8_top_n_per_group",
    lambda s: kpi.top_categories_per(s.items(), s.products(), s.orders(), "sales_channel", 2),
    star(
        f"""
, g AS (SELECT sales_channel, product_category, sum(i.net_c) AS net FROM s_items i JOIN s_products USING (product_id) JOIN s_orders USING (order_id) GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY sales_channel ORDER BY net DESC, product_category) AS rank FROM g)
SELECT sales_channel, rank, product_category, {dollars('net')} AS revenue FROM w WHERE rank <= 2"""
    ),
)
add(
    "w9_first_item_per_order",
    lambda s: profile.first_item_category(s.items(*ITEM_ORDER), s.products(), ITEM_ORDER),
    star(f", f AS (SELECT order_id, arg_min(product_id, ({', '.join(ITEM_ORDER)})) AS product_id FROM s_items GROUP BY 1) SELECT order_id, product_category FROM f JOIN s_products USING (product_id)"),
)
add("w10_result_rank", lambda s: kpi.top_product_shares(s.products(), s.items(), 20), star(TOP_SHARE.format(by="net", n=20)))

# --- sorting and pages ----------------------------------------------------------------------------

add(
    "l1_top_orders",
    lambda s: filters.top(s.orders().select("order_id", money(F.col("net_sales")).alias("net")), "net", "order_id", 100),
    star(f"SELECT order_id, {dollars('net_c')} AS net FROM s_orders ORDER BY net_c DESC, order_id LIMIT 100"),
)
add(
    "l2_multi_key_sort",
    lambda s: s.orders().orderBy("customer_id", "order_date", "order_id").select("customer_id", "order_date", "order_id"),
    star("SELECT customer_id, order_date, order_id FROM s_orders ORDER BY 1, 2, 3"),
)


def page_sql(columns: str, source: str, where: str, order: str, size: int, skip: int) -> str:
    return star(
        f""", p AS (SELECT {columns} FROM {source} {where}), t AS (SELECT count(*) AS total FROM p)
SELECT p.*, total, (total + {size - 1}) // {size} AS pages FROM p, t ORDER BY {order} LIMIT {size} OFFSET {skip}"""
    )


add(
    "l3_customer_page",
    lambda s: page(
        s.customers().select("customer_id", "customer_name", "region", "customer_segment"),
        "customer_id",
        "customer_name",
        "asc",
        page_number=2,
        page_size=25,
        sortable=("customer_name", "customer_id"),
        region="EUROPE",
    ),
    page_sql("customer_id, customer_name, region, customer_segment", "s_customers", "WHERE region = 'EUROPE'", "customer_name, customer_id", 25, 25),
)
add(
    "l4_product_page",
    lambda s: page(
        s.products().select("product_id", "brand", "product_category", money(F.col("unit_price")).alias("unit_price")),
        "product_id",
        "unit_price",
        "desc",
        page_number=3,
        page_size=10,
        product_category="PROMO",
    ),
    page_sql("product_id, brand, product_category, unit_price::double AS unit_price", "s_products", "WHERE product_category = 'PROMO'", "unit_price DESC, product_id", 10, 20),
)
add(
    "l5_deep_page",
    lambda s: page(s.orders().select("order_id", "order_date", "order_status"), "order_id", "order_date", "desc", page_number=500, page_size=25),
    page_sql("order_id, order_date, order_status", "s_orders", "", "order_date DESC, order_id", 25, 12_475),
)
add(
    "l5_order_page",
    lambda s: page(
        s.orders().select("order_id", "order_date", "order_status", money(F.col("net_sales")).alias("net_sales")),
        "order_id",
        "order_date",
        "desc",
        page_number=5,
        page_size=20,
        order_status="Completed",
        date_from="1996-01-01",
        date_to="2000-12-31",
    ),
    page_sql(
        f"order_id, order_date, order_status, {dollars('net_c')} AS net_sales",
        "s_orders",
        "WHERE order_status = 'Completed' AND order_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
        "order_date DESC, order_id",
        20,
        80,
    ),
)
BY_CATEGORY = ", g AS (SELECT product_category, sum(net_c) AS net FROM s_items JOIN s_products USING (product_id) GROUP BY 1)"


def ends(s):
    ranked = sales.category_margin(s.products(), s.items()).select("product_category", "total_revenue")
    first = ranked.orderBy(F.desc("total_revenue"), "product_category").limit(3).withColumn("side", F.lit("top"))
    last = ranked.orderBy("total_revenue", F.desc("product_category")).limit(3).withColumn("side", F.lit("bottom"))
    return first.unionByName(last)


add(
    "l6_top_and_bottom",
    ends,
    star(
        BY_CATEGORY
        + f""" SELECT * FROM (SELECT product_category, {dollars('net')} AS total_revenue, 'top' AS side FROM g ORDER BY net DESC, 1 LIMIT 3)
UNION ALL SELECT * FROM (SELECT product_category, {dollars('net')} AS total_revenue, 'bottom' AS side FROM g ORDER BY net, 1 DESC LIMIT 3)"""
    ),
)

# --- sets -----------------------------------------------------------------------------------------

add(
    "u1_union_all",
    lambda s: s.orders().select("customer_id").unionByName(s.customers().select("customer_id")).groupBy("customer_id").agg(rows().alias("n")),
    star("SELECT customer_id, count(*) AS n FROM (SELECT customer_id FROM s_orders UNION ALL SELECT customer_id FROM s_customers) GROUP BY 1"),
)


def disjoint(s):
    rated = s.ratings().select("order_id")
    back = s.orders().where("return_status is not null").select("order_id")
    both = back.join(rated, "order_id", "left_semi").agg(rows()).scalar()
    neither = s.orders().join(rated, "order_id", "left_anti").join(back, "order_id", "left_anti").agg(rows()).scalar()
    return back.agg(rows().alias("returned")).select("returned", both.alias("returned_and_rated"), neither.alias("neither"))


add(
    "u2_disjoint_and_coverage",
    disjoint,
    star(
        """SELECT count(return_status) AS returned, count(*) FILTER (return_status IS NOT NULL AND rated) AS returned_and_rated,
  count(*) FILTER (return_status IS NULL AND rated IS NULL) AS neither FROM s_orders LEFT JOIN (SELECT order_id, true AS rated FROM s_ratings) USING (order_id)"""
    ),
)

# --- scalar functions -----------------------------------------------------------------------------

add(
    "x1_date_parts",
    lambda s: s.orders().select(
        "order_id",
        F.trunc("order_date", "month").alias("month_start"),
        F.year("order_date").alias("year"),
        F.month("order_date").alias("month"),
        F.date_format("order_date", "yyyy-MM").alias("period"),
    ),
    star(
        "SELECT order_id, cast(date_trunc('month', order_date) as date) AS month_start, cast(year(order_date) as int) AS year, cast(month(order_date) as int) AS month, strftime(order_date, '%Y-%m') AS period FROM s_orders"
    ),
)
add(
    "x2_days_between",
    lambda s: s.orders().select("order_id", F.date_diff(F.lit("2001-12-31").cast("date"), F.col("order_date")).alias("days")),
    star("SELECT order_id, cast(date_diff('day', order_date, DATE '2001-12-31') as int) AS days FROM s_orders"),
)
add(
    "x3_round_half_up",
    lambda s: s.orders().select("order_id", F.round(F.col("net_sales"), 1).cast("double").alias("net")),
    star("SELECT order_id, round(net_sales, 1)::double AS net FROM s_orders"),
)
add(
    "x4_round_half_even",
    lambda s: s.orders().select("order_id", F.bround(F.col("order_id") / F.lit(8.0), 2).alias("eighths")),
    star("SELECT order_id, round_even(order_id / 8e0, 2) AS eighths FROM s_orders"),
)
add(
    "x5_casts",
    lambda s: s.raw("orders").select("o_orderkey", F.to_date(F.col("o_orderdate").cast("string").substr(1, 10)).alias("day"), F.col("o_totalprice").cast("bigint").alias("dollars")),
    "SELECT o_orderkey, cast(o_orderdate as date) AS day, cast(trunc(o_totalprice) as bigint) AS dollars FROM orders",
)
add(
    "x6_currency_text",
    lambda s: s.orders().select("order_id", csv.number(F.concat(F.lit("$"), F.format_number("net_sales", 2))).alias("net")),
    star(f"SELECT order_id, {dollars('net_c')} AS net FROM s_orders"),
)
add(
    "x7_number_formats",
    lambda s: s.orders().select("order_id", F.format_number("net_sales", 2).alias("money"), F.format_string("%.2f%%", percent(F.lit(1), F.col("order_id") + 1)).alias("share")),
    star(f"SELECT order_id, format('{{:,.2f}}', {dollars('net_c')}) AS money, format('{{:.2f}}', {pct('1', 'order_id + 1')}) || '%' AS share FROM s_orders"),
)
add(
    "x8_json_extract",
    lambda s: s.spark.read.parquet(f"{s.folder}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")),
    "SELECT event_id, cast(props->>'k' as int) AS k FROM events",
)
add(
    "x9_json_build",
    lambda s: s.raw("documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("metadata")),
    """SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' AS metadata FROM documents""",
)
add(
    "x10_json_block",
    lambda s: s.spark.read.parquet(f"{s.folder}/events.parquet").select(
        "event_id",
        F.from_json(F.regexp_extract(F.concat(F.lit("Sure:\n"), F.col("props"), F.lit("\nDone.")), r"(?s)\{.*\}", 0), "k int")["k"].alias("k"),
    ),
    "SELECT event_id, cast(props->>'k' as int) AS k FROM events",
)
add(
    "x14_pattern_match",
    lambda s: s.orders().select("order_id", F.col("warehouse").rlike(r"^WH-\d{3}$").alias("valid"), F.col("warehouse").rlike(r"^WH-00\d$").alias("single")),
    star(r"SELECT order_id, regexp_matches(warehouse, '^WH-\d{3}$') AS valid, regexp_matches(warehouse, '^WH-00\d$') AS single FROM s_orders"),
)
# --- sources and sinks ----------------------------------------------------------------------------


def target(s) -> str:
    return f"{shared_folder(s.spark)}/published-{uuid.uuid4().hex}"


def star_tables(s) -> dict:
    return {"customers": s.customers(), "products": s.products(), "orders": s.orders(True), "order_items": s.items(), "ratings": s.ratings()}


def counts(*names: str) -> str:
    views = {"customers": "customers", "products": "products", "orders": "orders", "order_items": "items", "ratings": "ratings"}
    return "\nUNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM s_{views[n]}" for n in names)


add(
    "s4_item_ids",
    lambda s: csv.with_item_ids(s.items(*ITEM_ORDER), ITEM_ORDER).select("order_item_id", "order_id", "product_id"),
    star(f"SELECT row_number() OVER (ORDER BY order_id, {', '.join(ITEM_ORDER)}) AS order_item_id, order_id, product_id FROM s_items"),
)


def order_export(s):
    """Orders with the rating columns still on them, as the order system exports them."""
    rated = s.ratings().select("order_id", F.col("rating").alias("customer_rating"), "review_sentiment")
    return s.orders().select("order_id", "customer_id").join(rated, "order_id", "left")


add(
    "s5_ratings_split",
    lambda s: csv.split_ratings(order_export(s)).withColumn("rating", F.col("rating").cast("double")),
    star("SELECT order_id, customer_id, rating::double AS rating, review_sentiment FROM s_ratings"),
)


def ranges(tables):
    """The tables' rules but for the vocabularies and the least quantity: the stand-in has other values, and orders without items."""
    kept = {n: quality.table_rules(n, df.columns) for n, df in tables.items()}
    return {n: {name: rule for name, rule in own.items() if not name.endswith("is known") and (n, name) != ("orders", "quantity > 0")} for n, own in kept.items()}


def atomic_load(s):
    tables = star_tables(s)
    return publish.publish(tables, target(s), ranges(tables)).select("table", "rows")


add("s7_atomic_load", atomic_load, star(counts("customers", "products", "orders", "order_items", "ratings")))


def exported(df, s, **more):
    """`df` as a CSV export with the awkward cells that text columns may hold."""
    path = f"{target(s)}/export"
    df.withColumns(more).write.option("header", True).option("escape", '"').csv(path)
    return path


def awkward(key: str):
    """Commas, quotes and line ends inside a text."""
    k = F.col(key) % 4
    return F.when(k == 0, F.concat(F.lit('say "'), F.col(key).cast("string"), F.lit('", again'))).when(k == 1, F.concat(F.lit("two\nlines, "), F.col(key).cast("string"))).when(k == 2, F.lit("nan"))


def awkward_sql(key: str) -> str:
    return f"""CASE {key} % 4 WHEN 0 THEN 'say "' || {key} || '", again' WHEN 1 THEN 'two' || chr(10) || 'lines, ' || {key} END"""


def customer_file(s):
    blank = {c: F.lit(None).cast("string") for c in ("customer_city", "customer_state", "customer_postal_code")}
    df = s.customers().select("customer_id", "customer_age", "gender", "customer_segment", "customer_country", "region", "customer_acquisition_cost")
    return exported(df, s, **blank, customer_name=awkward("customer_id"), junk=F.lit("x,y"))


add(
    "s1_customer_file",
    lambda s: csv.load_customers(s.spark, customer_file(s)).select(
        "customer_id", "customer_name", "customer_age", "gender", "region", "customer_city", F.col("customer_acquisition_cost").cast("double").alias("cost")
    ),
    star(f"SELECT customer_id::varchar AS customer_id, {awkward_sql('customer_id')} AS customer_name, customer_age, gender, region, NULL::varchar AS customer_city, cac_c::double / 100 AS cost FROM s_customers"),
)


def product_file(s):
    blank = {c: F.lit("N/A") for c in ("product_subcategory", "supplier", "product_rating")}
    return exported(s.products().select("product_id", "product_category", "brand", "unit_price"), s, **blank, product_name=awkward("product_id"), product_cost=F.lit("1.50"))


add(
    "s2_product_file",
    lambda s: csv.load_products(s.spark, product_file(s)).select(
        "product_id", "product_name", "product_category", "brand", F.col("unit_price").cast("double").alias("unit_price"), F.col("product_cost").cast("double").alias("product_cost"), "supplier"
    ),
    star(f"SELECT product_id::varchar AS product_id, {awkward_sql('product_id')} AS product_name, product_category, brand, price_c::double / 100 AS unit_price, 1.5::double AS product_cost, NULL::varchar AS supplier FROM s_products"),
)


def order_file(s):
    """The order export with its reviews, which hold commas, quotes and line ends."""
    have = s.orders(True)
    blank = {c: F.lit(None).cast("string") for c in schema("orders").fieldNames() if c not in have.columns}
    rated = s.ratings().select("order_id", F.col("rating").alias("customer_rating"), "review_sentiment")
    return exported(have.join(rated, "order_id", "left"), s, **blank, customer_review=awkward("order_id"))


add(
    "s3_order_file",
    lambda s: csv.load_orders(s.spark, order_file(s)).select("order_id", "customer_id", "order_date", "order_status", "sales_channel", "coupon_code", F.col("net_sales").cast("double").alias("net_sales")),
    star(f"SELECT order_id::varchar AS order_id, customer_id::varchar AS customer_id, order_date, order_status, sales_channel, coupon_code, {dollars('net_c')} AS net_sales FROM s_orders"),
)
add(
    "s3_rating_file",
    lambda s: csv.load_ratings(s.spark, order_file(s)).select("order_id", "customer_id", F.col("rating").cast("double").alias("rating"), "review_sentiment", "customer_review"),
    star(f"SELECT order_id::varchar AS order_id, customer_id::varchar AS customer_id, rating::double AS rating, review_sentiment, {awkward_sql('order_id')} AS customer_review FROM s_ratings"),
)


def item_file(s):
    return exported(s.items(), s, unit_price=F.lit("9.99"), discount_percentage=F.lit("0.1000"), tax_amount=F.lit(""), shipping_cost=F.lit("NULL"))


add(
    "s6_missing_cells",
    lambda s: csv.load_order_items(s.spark, item_file(s)).agg(
        rows().alias("items"), F.count("tax_amount").alias("taxes"), F.count("shipping_cost").alias("shipping_costs"), F.count("unit_price").alias("prices"), F.sum("net_sales").cast("double").alias("net_sales")
    ),
    star(f"SELECT count(*) AS items, 0::bigint AS taxes, 0::bigint AS shipping_costs, count(*) AS prices, {dollars('sum(net_c)')} AS net_sales FROM s_items"),
)


def statistics_file(s):
    """The published totals as texts with signs and separators."""
    one = s.orders().agg(rows().alias("n"), F.count_distinct("customer_id").alias("c"), F.sum("net_sales").alias("net"), F.sum("profit").alias("profit"))
    dollar = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    texts = {"Total Transactions": F.col("n"), "Total Customers": F.col("c"), "Total Revenue": dollar("net"), "Total Profit": dollar("profit"), "Average Order Value": F.lit("$1,282.50"), "Average Rating": F.lit("3.68"), "Return Rate": F.lit("6.85%"), "Cancellation Rate": F.lit("6.08%")}
    return exported(one.select(*[t.alias(name) for name, t in texts.items()]), s)


add(
    "s8_published_statistics",
    lambda s: csv.load_statistics(s.spark, statistics_file(s)),
    star(
        f"""SELECT count(*)::double AS total_transactions, count(DISTINCT customer_id)::double AS total_customers, {dollars('sum(net_c)')} AS total_revenue,
  {dollars('sum(profit_c)')} AS total_profit, 1282.5::double AS avg_order_value, 3.68::double AS avg_rating, 6.85::double AS return_rate, 6.08::double AS cancellation_rate FROM s_orders"""
    ),
)
add(
    "s10_chunk_store",
    lambda s: publish.replace_chunks(
        chunking.with_metadata(chunking.chunk_documents(s.raw("documents").selectExpr("concat('doc-', cast(doc_id as string), '.md') AS source_file", "text")), "supplied", 64),
        target(s),
    ).select("table", "rows"),
    "SELECT 'chunks' AS \"table\", count(*) AS rows FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0",
)
add(
    "s11_pruned_scan",
    lambda s: s.orders().select("customer_id", "order_date", money(F.col("net_sales")).alias("net_sales")),
    star(f"SELECT customer_id, order_date, {dollars('net_c')} AS net_sales FROM s_orders"),
)


def metadata_sink(s):
    folder = target(s)
    publish.write_metadata({"status": kpi.kpi_by(s.orders(), "order_status").select("order_status", "orders", "revenue")}, folder)
    return s.spark.read.schema("order_status string, orders bigint, revenue double").json(f"{folder}/status")


add("s12_metadata_sink", metadata_sink, star(f"SELECT order_status, count(*) AS orders, {dollars('sum(net_c)')} AS revenue FROM s_orders GROUP BY 1"))
add(
    "s14_consistent_sample",
    lambda s: profile.table_shapes(sample.sample_star(star_tables(s))).select("table", "rows"),
    star(
        """
, o AS (SELECT * FROM s_orders ORDER BY md5('42-' || order_id), order_id LIMIT 300), i AS (SELECT * FROM s_items WHERE order_id IN (SELECT order_id FROM o)),
c AS (SELECT count(*) FILTER (customer_id IN (SELECT customer_id FROM o)) AS a, count(*) FILTER (customer_id NOT IN (SELECT customer_id FROM o)) AS b FROM s_customers),
p AS (SELECT count(*) FILTER (product_id IN (SELECT product_id FROM i)) AS a, count(*) FILTER (product_id NOT IN (SELECT product_id FROM i)) AS b FROM s_products)
SELECT 'orders' AS "table", count(*) AS rows FROM o UNION ALL SELECT 'order_items', count(*) FROM i
UNION ALL SELECT 'ratings', count(*) FROM s_ratings WHERE order_id IN (SELECT order_id FROM o)
UNION ALL SELECT 'customers', a + least(b, 20) FROM c UNION ALL SELECT 'products', a + least(b, 20) FROM p"""
    ),
)
