"""Profiling, data-quality and maintenance jobs with their checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from retailscope.functions.numeric import rows
from retailscope.operators import maintenance, profile, quality, sales
from retailscope.plans.checks import dollars, mean, pct, ratio, star
from retailscope.plans.registry import CHECKS, add
from retailscope.schemas import VOCABULARIES
from retailscope.session import shared_folder
from retailscope.sources import buckets
from retailscope.sources.standin import ITEM_ORDER

MONEY = ["gross_sales", "discount_amount", "net_sales", "profit", "quantity", "delivery_days"]
DIMS = ["order_status", "sales_channel", "payment_method", "shipping_method", "marketing_channel", "coupon_code", "warehouse"]


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def tables(s):
    return {"customers": s.customers(), "products": s.products(), "orders": s.orders(True), "order_items": s.items(), "ratings": s.ratings()}


add(
    "e1_table_shapes",
    lambda s: profile.table_shapes(tables(s)),
    star(
        ", n AS ("
        + union(
            f"SELECT '{t}' AS \"table\", count(*) AS rows FROM s_{v}"
            for t, v in (("customers", "customers"), ("products", "products"), ("orders", "orders"), ("order_items", "items"), ("ratings", "ratings"))
        )
        + ") SELECT \"table\", rows, cast(CASE \"table\" WHEN 'customers' THEN 9 WHEN 'products' THEN 8 WHEN 'orders' THEN 30"
        " WHEN 'order_items' THEN 8 ELSE 4 END as int) AS columns FROM n"
    ),
)


def describe_sql(columns, source="s_orders") -> str:
    return star(
        union(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}::double), 6) AS mean, round(stddev_samp({c}::double), 6) AS std,"
            f" min({c})::double AS min, max({c})::double AS max, round(quantile_cont({c}::double, 0.25), 6) AS p25,"
            f" round(quantile_cont({c}::double, 0.5), 6) AS p50, round(quantile_cont({c}::double, 0.75), 6) AS p75 FROM {source}"
            for c in columns
        )
    )


add("e2_describe", lambda s: profile.describe(s.orders(), MONEY), describe_sql(MONEY))
add(
    "e3_cardinality",
    lambda s: profile.cardinality(s.orders(), DIMS),
    star(union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM s_orders" for c in DIMS)),
)
NULLABLE = ["delivery_days", "return_status", "marketing_channel", "coupon_code", "campaign_name", "net_sales"]
add(
    "e4_null_fractions",
    lambda s: profile.null_fractions(s.orders(), NULLABLE),
    star(
        "SELECT * FROM ("
        + union(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, {ratio(f'count(*) - count({c})', 'count(*)', 3)} AS null_fraction FROM s_orders"
            for c in NULLABLE
        )
        + ") WHERE nulls > 0"
    ),
)
add(
    "e5_null_together",
    lambda s: profile.null_together(s.orders().join(s.ratings().select("order_id", "rating"), "order_id", "left"), "delivery_days", "rating"),
    star(
        """SELECT bool_and((delivery_days IS NULL) = (rating IS NULL)) AS same_rows,
  count(*) FILTER ((delivery_days IS NULL) <> (rating IS NULL)) AS differing FROM s_orders LEFT JOIN s_ratings USING (order_id)"""
    ),
)
add("e6_value_counts", lambda s: profile.value_counts(s.orders(), "return_status"), star("SELECT return_status, count(*) AS n FROM s_orders GROUP BY 1"))
add(
    "e6_unrated_delivery_status",
    lambda s: profile.value_counts(s.orders().join(s.ratings().select("order_id"), "order_id", "left_anti"), "delivery_status"),
    star("SELECT delivery_status, count(*) AS n FROM s_orders WHERE order_id NOT IN (SELECT order_id FROM s_ratings) GROUP BY 1"),
)
add(
    "e7_flag_agreement",
    lambda s: profile.flag_agreement(s.orders()),
    star(
        """SELECT count(*) FILTER (order_status = 'Returned') AS by_status, count(return_status) AS by_flag,
  count(*) FILTER ((order_status = 'Returned') <> (return_status IS NOT NULL)) AS disagreeing FROM s_orders"""
    ),
)
add(
    "e8_duplicate_rows",
    lambda s: profile.duplicate_rows(s.raw("lineitem"), ["l_orderkey", "l_linenumber"]),
    """WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT cast(sum(n) as bigint) AS rows, count(*) AS keys, cast(sum(n - 1) as bigint) AS duplicates FROM k""",
)
add(
    "e9_date_range",
    lambda s: profile.date_range(s.orders(), "order_date"),
    star("SELECT min(order_date) AS first_date, max(order_date) AS last_date, count(*) AS rows FROM s_orders"),
)
add(
    "e10_orders_per_year",
    lambda s: profile.orders_per_year(s.orders()),
    star("SELECT cast(year(order_date) as int) AS year, count(*) AS orders FROM s_orders GROUP BY 1"),
)
add(
    "e11_outliers",
    lambda s: profile.outliers(s.orders()),
    star(
        """SELECT count(*) FILTER (profit_margin_percentage < 0) AS negative_margins, count(*) FILTER (delivery_days < 0) AS negative_delivery_days,
  count(*) FILTER (delivery_days - estimated_delivery_days > 10) AS more_than_10_days_late FROM s_orders"""
    ),
)
add(
    "e11_box_plot",
    lambda s: profile.box_plot(s.orders(), "net_sales"),
    star(
        """
, v AS (SELECT net_sales::double AS v FROM s_orders), q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM v)
SELECT round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS q2, round(any_value(q3), 6) AS q3, round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS lower_fence,
  round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS upper_fence, count(*) FILTER (v < q1 - 1.5 * (q3 - q1)) AS below,
  count(*) FILTER (v > q3 + 1.5 * (q3 - q1)) AS above FROM v, q"""
    ),
)
add(
    "e12_core_kpis",
    lambda s: profile.core_kpis(s.orders(), s.ratings()),
    star(
        f"""
, r AS (SELECT sum(tenths) AS t, count(*) AS k FROM s_ratings),
o AS (SELECT count(*) AS n, sum(net_c) AS net, sum(profit_c) AS gain, sum(quantity) AS q, avg(disc_c::double / nullif(gross_c, 0)) AS d,
  count(*) FILTER (order_status = 'Returned') AS b, count(*) FILTER (order_status = 'Cancelled') AS g FROM s_orders)
SELECT {dollars('net')} AS total_revenue, n AS total_orders, cast(q as bigint) AS total_quantity, {mean('net', 'n')} AS avg_order_value,
  round(d * 100, 6) AS avg_discount_pct, {dollars('gain')} AS total_profit, {pct('gain', 'net')} AS profit_margin_pct,
  {pct('b', 'n')} AS return_rate_pct, {pct('g', 'n')} AS cancellation_rate_pct, {ratio('t', '10 * k')} AS avg_rating FROM o, r"""
    ),
)


def published(s):
    """The totals as another route computes them: straight from the line items and orders."""
    items = s.raw("lineitem").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 0).alias("total_revenue"))
    orders = s.raw("orders").agg(rows().alias("total_transactions"), F.count_distinct("o_custkey").alias("total_customers"))
    return orders.withColumn("total_revenue", items.scalar())


def reported(s):
    sums = s.orders().agg(rows().alias("total_transactions"), F.count_distinct("customer_id").alias("total_customers"), F.sum("net_sales").alias("net"))
    return sums.select("total_transactions", "total_customers", F.round("net", 0).alias("total_revenue"))


RECONCILED = star(
    """
, e AS (SELECT count(*)::double AS t, count(DISTINCT o_custkey)::double AS c, (SELECT round(sum(l_extendedprice * (1 - l_discount)), 0) FROM lineitem) AS r FROM orders),
a AS (SELECT count(*)::double AS t, count(DISTINCT customer_id)::double AS c, round(sum(net_c)::double / 100, 0) AS r FROM s_orders),
m AS (SELECT 'total_transactions' AS metric, e.t AS expected, a.t AS actual FROM e, a UNION ALL SELECT 'total_customers', e.c, a.c FROM e, a
  UNION ALL SELECT 'total_revenue', e.r, a.r FROM e, a)
SELECT metric, expected, actual, CASE WHEN round(abs(expected - actual), 6) <= 0.01 THEN 'OK' ELSE 'FAIL' END AS status FROM m"""
)
add("e13_computed_vs_published", lambda s: quality.reconcile(published(s), reported(s)), RECONCILED)
add("q11_reconciliation", lambda s: quality.reconcile(published(s), reported(s)), RECONCILED)
CORR = ["gross_sales", "discount_amount", "net_sales", "profit", "quantity", "delivery_days", "rating"]
add(
    "e14_correlations",
    lambda s: profile.correlations(s.orders().join(s.ratings().select("order_id", "rating"), "order_id", "left"), CORR),
    star(
        ", j AS (SELECT * FROM s_orders LEFT JOIN (SELECT order_id, rating FROM s_ratings) USING (order_id))"
        + union(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::double, {b}::double), 6) AS correlation FROM j" for a in CORR for b in CORR)
    ),
)
add(
    "e15_revenue_by_category",
    lambda s: profile.revenue_by(s.items().join(s.products().select("product_id", "product_category"), "product_id"), "product_category"),
    star(f"SELECT product_category, {dollars('sum(net_c)')} AS revenue FROM s_items JOIN s_products USING (product_id) GROUP BY 1"),
)
for dim in ("region", "marketing_channel"):
    add(
        f"e15_revenue_by_{dim}",
        lambda s, dim=dim: profile.revenue_by(s.orders(True), dim),
        star(f"SELECT {dim}, {dollars('sum(net_c)')} AS revenue FROM s_orders GROUP BY 1"),
    )
add(
    "e15_revenue_by_month",
    lambda s: profile.revenue_by(s.orders(), F.date_format("order_date", "yyyy-MM").alias("month")),
    star(f"SELECT strftime(order_date, '%Y-%m') AS month, {dollars('sum(net_c)')} AS revenue FROM s_orders GROUP BY 1"),
)
add(
    "e16_top_products",
    lambda s: sales.top_products(s.products(), s.items()).select("product_id", "product_name", "units_sold", "total_revenue"),
    star(
        f"""SELECT product_id, product_name, cast(sum(quantity) as bigint) AS units_sold, {dollars('sum(net_c)')} AS total_revenue
FROM s_items JOIN s_products USING (product_id) GROUP BY 1, 2 ORDER BY sum(net_c) DESC, 1 LIMIT 10"""
    ),
)
add(
    "e16_top_customers",
    lambda s: sales.top_customers(s.customers(), s.orders()).select("customer_id", "customer_name", "order_count", "total_revenue"),
    star(
        f"""SELECT customer_id, customer_name, count(*) AS order_count, {dollars('sum(net_c)')} AS total_revenue
FROM s_orders JOIN s_customers USING (customer_id) GROUP BY 1, 2 ORDER BY sum(net_c) DESC, 1 LIMIT 10"""
    ),
)
add(
    "e17_concentration",
    lambda s: profile.concentration(s.orders(), s.items()),
    star(
        f"""
, p AS (SELECT sum(net_c) AS net, row_number() OVER (ORDER BY sum(net_c) DESC, product_id) AS k FROM s_items GROUP BY product_id),
c AS (SELECT sum(net_c) AS net, row_number() OVER (ORDER BY sum(net_c) DESC, customer_id) AS k FROM s_orders GROUP BY customer_id)
SELECT 'products' AS of, count(*) AS members, {pct('sum(net) FILTER (k <= 10)', 'sum(net)', 4)} AS top_share_pct FROM p
UNION ALL SELECT 'customers', count(*), {pct('sum(net) FILTER (k <= 10)', 'sum(net)', 4)} FROM c"""
    ),
)
FIRST_ITEM = f"""
, f AS (SELECT order_id, arg_min(product_id, ({', '.join(ITEM_ORDER)})) AS product_id FROM s_items GROUP BY 1),
j AS (SELECT o.order_id, order_status, product_category, tenths FROM s_orders o JOIN f USING (order_id) JOIN s_products USING (product_id)
  LEFT JOIN (SELECT order_id, tenths FROM s_ratings) USING (order_id)),
g AS (SELECT product_category, count(*) AS orders, {ratio('sum(tenths)', '10 * count(tenths)', 6)} AS avg_rating,
  {pct("count(*) FILTER (order_status = 'Returned')", 'count(*)', 6)} AS return_rate_pct FROM j GROUP BY 1)"""


def first_rates(s):
    return profile.first_item_rates(s.items(*ITEM_ORDER), s.products(), s.orders(), s.ratings(), ITEM_ORDER)


add("e18_first_item_rates", first_rates, star(FIRST_ITEM + " SELECT * FROM g"))
add(
    "e19_rating_return_correlation",
    lambda s: first_rates(s).agg(F.round(F.corr("avg_rating", "return_rate_pct"), 6).alias("correlation")),
    star(FIRST_ITEM + " SELECT round(corr(avg_rating, return_rate_pct), 6) AS correlation FROM g"),
)
BAD = "order_status IN ('Returned', 'Cancelled')"
add(
    "e20_value_at_risk",
    lambda s: profile.value_at_risk(s.orders()),
    star(
        f"""
, t AS (SELECT count(*) AS n, sum(net_c) AS net, count(*) FILTER ({BAD}) AS bn, sum(net_c) FILTER ({BAD}) AS bad,
  sum(net_c) FILTER (order_status = 'Returned') AS r, sum(net_c) FILTER (order_status = 'Cancelled') AS c,
  sum(profit_c) FILTER (order_status = 'Returned') AS u FROM s_orders)
SELECT bn AS bad_orders, {pct('bn', 'n')} AS bad_order_pct, {dollars('bad')} AS bad_revenue, {pct('bad', 'net')} AS bad_revenue_pct,
  {dollars('r')} AS returned_revenue, {dollars('c')} AS cancelled_revenue, {dollars('u')} AS unreversed_profit FROM t"""
    ),
)
add(
    "e21_gross_vs_net",
    lambda s: profile.gross_vs_net(s.orders()),
    star(
        f"""SELECT {dollars('sum(gross_c)')} AS gross_sales, {dollars('sum(net_c)')} AS net_sales, {pct('sum(gross_c) - sum(net_c)', 'sum(net_c)')} AS overstated_pct
FROM s_orders"""
    ),
)
add(
    "e22_catalog_checks",
    lambda s: profile.catalog_checks(s.products(), ["PROMO", "Clothing"]),
    star(
        """
, g AS (SELECT product_category, count(*) AS products FROM s_products GROUP BY 1), w AS (SELECT unnest(['PROMO', 'Clothing']) AS product_category)
SELECT coalesce(g.product_category, w.product_category) AS product_category, coalesce(products, 0) AS products, w.product_category IS NOT NULL AS wanted
FROM g FULL JOIN w ON g.product_category = w.product_category"""
    ),
)


# --- quality ------------------------------------------------------------------------------------


def rule_sql(table: str, rules: dict[str, str]) -> str:
    return star(union(f"SELECT '{name}' AS rule, count(*) FILTER (NOT ({cond})) AS broken FROM {table}" for name, cond in rules.items()))


def broken(df, *groups):
    return quality.violation_counts(df, {k: v for g in groups for k, v in g.items()})


add(
    "q1_range_checks",
    lambda s: broken(
        s.orders(),
        quality.positive("quantity"),
        quality.within("delivery_days", 0, 10),
        quality.within("discount_amount", 0),
        quality.within("shipping_cost", 0, 40),
    ),
    rule_sql(
        "s_orders",
        {
            "quantity > 0": "quantity > 0",
            "delivery_days >= 0": "delivery_days >= 0",
            "delivery_days <= 10": "delivery_days <= 10",
            "discount_amount >= 0": "discount_amount >= 0",
            "shipping_cost >= 0": "shipping_cost >= 0",
            "shipping_cost <= 40": "shipping_cost <= 40",
        },
    ),
)
add(
    "q2_not_null_checks",
    lambda s: broken(s.orders(), quality.required("order_id", "order_date", "delivery_days", "marketing_channel")),
    rule_sql("s_orders", {f"{c} is present": f"{c} IS NOT NULL" for c in ("order_id", "order_date", "delivery_days", "marketing_channel")}),
)


def known(column: str) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in VOCABULARIES[column])})"


VOCAB = ("order_status", "delivery_status", "payment_method", "region", "marketing_channel")
add(
    "q3_allowed_values",
    lambda s: broken(s.orders(True), quality.allowed(*VOCAB)),
    rule_sql("s_orders", {f"{c} is known": known(c) for c in VOCAB}),
)
add(
    "q4_lengths_and_patterns",
    lambda s: broken(
        s.orders(),
        quality.max_length(campaign_name=11, coupon_code=6),
        quality.matches("warehouse", r"^WH-\d{3}$"),
        quality.matches("coupon_code", r"^SAVE[12]\d$"),
    ),
    rule_sql(
        "s_orders",
        {
            "campaign_name has at most 11 characters": "length(campaign_name) <= 11",
            "coupon_code has at most 6 characters": "length(coupon_code) <= 6",
            r"warehouse matches ^WH-\d{3}$": r"regexp_matches(warehouse, '^WH-\d{3}$')",
            r"coupon_code matches ^SAVE[12]\d$": r"regexp_matches(coupon_code, '^SAVE[12]\d$')",
        },
    ),
)
add(
    "q1_q4_rejected_orders",
    lambda s: quality.rejected(
        quality.violations(s.orders(True), quality.table_rules("orders", ["quantity", "region", "net_sales", "warehouse", "delivery_days"]))
    ).select("order_id", F.array_join("violations", "; ").alias("reasons")),
    star(
        f"""SELECT order_id, concat_ws('; ', CASE WHEN quantity <= 0 THEN 'quantity > 0' END, CASE WHEN NOT {known('region')} THEN 'region is known' END) AS reasons
FROM s_orders WHERE quantity <= 0 OR NOT {known('region')}"""
    ),
)
add(
    "q5_duplicate_keys",
    lambda s: quality.duplicate_keys(s.raw("lineitem"), ["l_orderkey", "l_linenumber"]),
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
add(
    "q6_orders_without_items",
    lambda s: quality.orphans(s.orders().select("order_id", "customer_id"), s.items(), "order_id"),
    star("SELECT order_id, customer_id FROM s_orders WHERE order_id NOT IN (SELECT order_id FROM s_items)"),
)
add(
    "q6_join_cardinality",
    lambda s: quality.join_report(s.orders(), s.items(), "order_id"),
    star(
        """
, l AS (SELECT order_id, count(*) AS ln FROM s_orders GROUP BY 1), r AS (SELECT order_id, count(*) AS rn FROM s_items GROUP BY 1)
SELECT cast(sum(ln) as bigint) AS left_rows, cast(sum(ln) FILTER (rn IS NULL) as bigint) AS unmatched_left_rows, count(*) FILTER (rn > 1) AS duplicate_right_keys,
  count(*) FILTER (ln > 1) AS repeated_left_keys FROM l FULL JOIN r USING (order_id)"""
    ),
)


def new_orders(s):
    """Orders out of the event stream: an event is an order of its user; ids continue or collide with the table."""
    events = s.spark.read.parquet(f"{s.folder}/events.parquet")
    key = "CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN -1 ELSE event_id * 3 END"  # some have no key, some share one
    return events.selectExpr(f"{key} AS order_id", "user_id * 7 AS customer_id", "cast(ts as date) AS order_date", "cast(null as string) AS currency")


def inserted(s):
    existing = s.orders().select("order_id", "customer_id", "order_date")
    return maintenance.insert_batch(existing, new_orders(s), "order_id", {"customer_id": s.customers()}, {"currency": "USD"})


BATCH = """
, b AS (SELECT CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN -1 ELSE event_id * 3 END AS order_id, user_id * 7 AS customer_id,
  cast(ts as date) AS order_date FROM events),
m AS (SELECT b.*, CASE WHEN order_id IS NULL THEN 'key is missing' WHEN order_id = -1 THEN 'duplicate key' WHEN order_id IN (SELECT order_id FROM s_orders) THEN 'duplicate key'
  WHEN customer_id NOT IN (SELECT customer_id FROM s_customers) THEN 'no such customer_id' END AS reason FROM b)"""
add(
    "q7_insert_batch",
    lambda s: inserted(s).table,
    star(
        BATCH
        + """ SELECT order_id, customer_id, order_date, NULL AS currency FROM s_orders
UNION ALL SELECT order_id, customer_id, order_date, 'USD' FROM m WHERE reason IS NULL"""
    ),
)
add(
    "q7_insert_refused",
    lambda s: inserted(s).refused.select("order_id", "customer_id", "reason"),
    star(BATCH + " SELECT order_id, customer_id, reason FROM m WHERE reason IS NOT NULL"),
)


def patch_rows(s):
    """Supplier rows as customer patches: every one renames, half of them also clear the age."""
    return s.raw("supplier").selectExpr(
        "CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 1 THEN 1 ELSE s_suppkey * 20 END AS customer_id",  # some have no key, some share one
        "if(s_acctbal < 0, array('customer_name', 'customer_age'), array('customer_name')) AS set_fields",
        "s_name AS customer_name",
        "cast(null as int) AS customer_age",
    )


def patched(s):
    kept = s.customers().select("customer_id", "customer_name", "customer_age")
    return maintenance.patch_batch(kept, patch_rows(s), "customer_id", ["customer_name", "customer_age"])


add(
    "q8_patch_batch",
    lambda s: patched(s).table.withColumn("customer_age", F.coalesce("customer_age", F.lit(-1))),
    star(
        """SELECT customer_id, coalesce(s_name, customer_name) AS customer_name, CASE WHEN s_acctbal < 0 THEN -1 ELSE customer_age END AS customer_age
FROM s_customers LEFT JOIN supplier ON s_suppkey * 20 = customer_id AND s_suppkey % 10 > 1
  OR customer_id = 1 AND s_suppkey % 10 = 1 AND (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 1) = 1"""
    ),
)


def patched_buckets(s):
    """The same patches on a table in buckets; the result is read from the version that they made."""
    target = f"{shared_folder(s.spark)}/buckets-{uuid.uuid4().hex}"
    buckets.create(s.customers().select("customer_id", "customer_name", "customer_age"), target, "customer_id", 16)
    buckets.patch(s.spark, target, patch_rows(s), ["customer_name", "customer_age"])
    return buckets.read(s.spark, target)


add(
    "q8_patch_buckets",
    lambda s: patched_buckets(s).withColumn("customer_age", F.coalesce("customer_age", F.lit(-1))),
    CHECKS["q8_patch_batch"],
)
add(
    "q8_patch_not_found",
    lambda s: patched(s).refused.select("customer_id", "reason"),
    star(
        """, p AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 1 THEN 1 ELSE s_suppkey * 20 END AS customer_id FROM supplier),
n AS (SELECT customer_id, count(*) AS times FROM p GROUP BY 1)
SELECT customer_id, CASE WHEN customer_id IS NULL THEN 'key is missing' WHEN customer_id NOT IN (SELECT customer_id FROM s_customers) THEN 'not found' ELSE 'key repeats' END AS reason
FROM p LEFT JOIN n USING (customer_id) WHERE customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM s_customers) OR times > 1"""
    ),
)


def deleted(s):
    requests = s.raw("supplier").selectExpr("s_suppkey * 11 AS product_id")
    return maintenance.delete_restrict(s.products().select("product_id", "brand"), requests, "product_id", {"order_items": s.items()})


add(
    "q9_delete_restrict",
    lambda s: deleted(s).refused,
    star(
        """SELECT r.product_id, CASE WHEN p.product_id IS NULL THEN 'not found' ELSE 'referenced by order_items' END AS reason
FROM (SELECT s_suppkey * 11 AS product_id FROM supplier) r LEFT JOIN s_products p ON p.product_id = r.product_id
WHERE p.product_id IS NULL OR r.product_id IN (SELECT product_id FROM s_items)"""
    ),
)
add(
    "q9_delete_kept",
    lambda s: deleted(s).table,
    star(
        """SELECT product_id, brand FROM s_products WHERE product_id IN (SELECT product_id FROM s_items)
  OR product_id NOT IN (SELECT s_suppkey * 11 FROM supplier)"""
    ),
)


def cascaded(s):
    returned = s.orders().where("return_status is not null")
    left = maintenance.delete_cascade(s.orders(), returned, "order_id", {"order_items": s.items(), "ratings": s.ratings()})
    return profile.table_shapes({name: df.select("order_id") for name, df in left.items()}).drop("columns")


add(
    "q10_delete_cascade",
    cascaded,
    star(
        """
, k AS (SELECT order_id FROM s_orders WHERE return_status IS NOT NULL)
SELECT 'table' AS "table", count(*) AS rows FROM s_orders WHERE order_id NOT IN (SELECT order_id FROM k)
UNION ALL SELECT 'order_items', count(*) FROM s_items WHERE order_id NOT IN (SELECT order_id FROM k)
UNION ALL SELECT 'ratings', count(*) FROM s_ratings WHERE order_id NOT IN (SELECT order_id FROM k)"""
    ),
)
add(
    "q12_assertions",
    lambda s: quality.check_table(
        s.orders(),
        duplicate_orders=(rows() - F.count_distinct("order_id"), 0),
        negative_revenue=(F.count_if(F.col("net_sales") < 0), 0),
        returned_and_rated=(F.count_if((F.col("return_status") == "Returned") & (F.col("order_status") == "Completed")), 0),
        orders_without_revenue=(F.count_if(F.col("net_sales") == 0), 0),
    ),
    star(
        """
, t AS (SELECT 'duplicate_orders' AS name, count(*) - count(DISTINCT order_id) AS a FROM s_orders
  UNION ALL SELECT 'negative_revenue', count(*) FILTER (net_c < 0) FROM s_orders
  UNION ALL SELECT 'returned_and_rated', count(*) FILTER (return_status = 'Returned' AND order_status = 'Completed') FROM s_orders
  UNION ALL SELECT 'orders_without_revenue', count(*) FILTER (net_c = 0) FROM s_orders)
SELECT name, 0::double AS expected, a::double AS actual, a = 0 AS ok FROM t"""
    ),
)
add(
    "q13_null_audit",
    lambda s: profile.null_counts(s.orders(), [*DIMS, "net_sales"]),
    star(union(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM s_orders" for c in [*DIMS, "net_sales"])),
)
add(
    "q16_items_above_orders",
    lambda s: quality.item_order_gap(
        s.raw("orders").selectExpr("o_orderkey AS order_id", "cast(o_totalprice as decimal(12,2)) AS total"), s.items(), "total"
    ),
    star(
        f"""
, i AS (SELECT order_id, sum(net_c) AS net FROM s_items GROUP BY 1),
j AS (SELECT net, cast(cast(o_totalprice as decimal(12,2)) * 100 as bigint) AS total FROM i JOIN orders ON o_orderkey = order_id)
SELECT count(*) AS orders_with_items, count(*) FILTER (net > total) AS items_above_order, {dollars('sum(net)')} AS item_revenue,
  {dollars('sum(total)')} AS order_revenue FROM j"""
    ),
)
