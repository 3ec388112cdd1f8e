"""Analytical reports and their checks."""

from __future__ import annotations

from retailscope.operators import sales
from retailscope.plans.checks import dollars, mean, pct, ratio, star
from retailscope.plans.registry import add

TOP_CUSTOMERS = f"""
SELECT c.customer_id, c.customer_name, c.customer_segment, c.region, count(o.order_id) AS order_count,
  {dollars('sum(o.net_c)')} AS total_revenue, {mean('sum(o.net_c)', 'count(*)')} AS avg_order_value
FROM s_orders o JOIN s_customers c USING (customer_id) {{where}}
GROUP BY ALL ORDER BY sum(o.net_c) DESC, c.customer_id LIMIT {{n}}"""

add("a1_top_customers", lambda s: sales.top_customers(s.customers(), s.orders()), star(TOP_CUSTOMERS.format(where="", n=10)))
add(
    "a1_top_customers_filtered",
    lambda s: sales.top_customers(s.customers(), s.orders(), region="ASIA", customer_segment="BUILDING", limit=25),
    star(TOP_CUSTOMERS.format(where="WHERE c.region = 'ASIA' AND c.customer_segment = 'BUILDING'", n=25)),
)

TOP_PRODUCTS = f"""
SELECT p.product_id, p.product_name, p.product_category, cast(sum(i.quantity) as bigint) AS units_sold,
  {dollars('sum(i.net_c)')} AS total_revenue
FROM s_products p JOIN s_items i USING (product_id) JOIN s_orders o USING (order_id) {{where}}
GROUP BY ALL ORDER BY {{by}} DESC, p.product_id LIMIT {{n}}"""

add(
    "a2_top_products",
    lambda s: sales.top_products(s.products(), s.items()),
    star(TOP_PRODUCTS.format(where="", by="sum(i.net_c)", n=10)),
)
add(
    "a2_top_products_filtered",
    lambda s: sales.top_products(
        s.products(), s.items(), s.orders(), product_category="PROMO", date_from="1996-01-01", date_to="1998-12-31", limit=15
    ),
    star(
        TOP_PRODUCTS.format(
            where="WHERE p.product_category = 'PROMO' AND o.order_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
            by="sum(i.net_c)",
            n=15,
        )
    ),
)
MONTHLY = f"""
SELECT cast(date_trunc('month', order_date) as date) AS month, count(*) AS order_count, {dollars('sum(net_c)')} AS total_revenue
FROM s_orders {{where}} GROUP BY 1"""
add("a3_monthly_revenue", lambda s: sales.monthly_revenue(s.orders()), star(MONTHLY.format(where="")))
add(
    "a3_monthly_revenue_filtered",
    lambda s: sales.monthly_revenue(s.orders(True), "1996-02-15", "1999-07-01", region="EUROPE"),
    star(MONTHLY.format(where="WHERE order_date BETWEEN DATE '1996-02-15' AND DATE '1999-07-01' AND region = 'EUROPE'")),
)
YEARLY = f"""
, y AS (SELECT cast(year(order_date) as int) AS year, sum(net_c) AS r FROM s_orders {{where}} GROUP BY 1),
g AS (SELECT year, r, lag(r) OVER (ORDER BY year) AS p FROM y)
SELECT year, {dollars('r')} AS total_revenue, {pct('r - p', 'p')} AS yoy_growth_pct FROM g"""
add("a4_yearly_revenue", lambda s: sales.yearly_revenue(s.orders()), star(YEARLY.format(where="")))
add(
    "a4_yearly_revenue_filtered",
    lambda s: sales.yearly_revenue(s.orders(True), date_from="1997-01-01", region="AFRICA"),
    star(YEARLY.format(where="WHERE order_date >= DATE '1997-01-01' AND region = 'AFRICA'")),
)
MARGIN = f"""
SELECT product_category, {dollars('sum(i.net_c)')} AS total_revenue, {dollars('sum(i.profit_c)')} AS total_profit,
  {pct('sum(i.profit_c)', 'sum(i.net_c)')} AS margin_pct
FROM s_items i JOIN s_products USING (product_id) JOIN s_orders o USING (order_id) {{where}} GROUP BY 1"""
add("a5_category_margin", lambda s: sales.category_margin(s.products(), s.items()), star(MARGIN.format(where="")))
add(
    "a5_category_margin_in_range",
    lambda s: sales.category_margin(s.products(), s.items(), s.orders(), date_from="1997-05-01", date_to="1997-10-31"),
    star(MARGIN.format(where="WHERE o.order_date BETWEEN DATE '1997-05-01' AND DATE '1997-10-31'")),
)
add(
    "a6_region_fulfilment",
    lambda s: sales.region_fulfilment(s.orders(True)),
    star(
        f"""
SELECT region, count(*) AS order_count, {dollars('sum(net_c)')} AS total_revenue,
  {pct("count(*) FILTER (delivery_status = 'On Time')", 'count(*)')} AS on_time_pct,
  {pct("count(*) FILTER (delivery_status = 'Delayed')", 'count(*)')} AS delayed_pct,
  {pct("count(*) FILTER (delivery_status = 'Early')", 'count(*)')} AS early_pct,
  {pct("count(*) FILTER (delivery_status = 'Cancelled')", 'count(*)')} AS cancelled_pending_or_returned_pct
FROM s_orders GROUP BY region"""
    ),
)
add(
    "a7_channel_aov",
    lambda s: sales.channel_aov(s.orders()),
    star(
        f"""
SELECT sales_channel, count(*) AS order_count, {mean('sum(net_c)', 'count(*)')} AS avg_order_value,
  {dollars('sum(net_c)')} AS total_revenue FROM s_orders GROUP BY 1"""
    ),
)
add(
    "a8_return_rate",
    lambda s: sales.return_rate(s.orders()),
    star(
        f"""
SELECT count(return_status) AS returned_orders, count(*) AS total_orders,
  {pct('count(return_status)', 'count(*)')} AS return_rate_pct FROM s_orders"""
    ),
)
RETURN_BY_CATEGORY = f"""
SELECT product_category, count(DISTINCT i.order_id) AS orders_with_category,
  count(DISTINCT i.order_id) FILTER (o.return_status IS NOT NULL) AS returned_orders,
  {pct('count(DISTINCT i.order_id) FILTER (o.return_status IS NOT NULL)', 'count(DISTINCT i.order_id)')} AS return_rate_pct
FROM s_items i JOIN s_products USING (product_id) JOIN s_orders o USING (order_id) {{where}} GROUP BY 1"""
add(
    "a9_return_rate_by_category",
    lambda s: sales.return_rate_by_category(s.items(), s.products(), s.orders()),
    star(RETURN_BY_CATEGORY.format(where="")),
)
add(
    "a9_return_rate_one_category",
    lambda s: sales.return_rate_by_category(
        s.items(), s.products(), s.orders(), product_category="ECONOMY", date_from="1998-01-01"
    ),
    star(RETURN_BY_CATEGORY.format(where="WHERE product_category = 'ECONOMY' AND o.order_date >= DATE '1998-01-01'")),
)
add(
    "a10_rating_distribution",
    lambda s: sales.rating_distribution(s.ratings(), s.orders(), "1996-01-01", "1999-12-31"),
    star(
        """
SELECT rating::double AS rating, count(*) AS num_ratings FROM s_ratings r JOIN s_orders o USING (order_id)
WHERE o.order_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1"""
    ),
)
add(
    "a11_returned_with_rating",
    lambda s: sales.returned_with_rating(s.ratings(), s.orders()),
    star(
        """
SELECT count(o.return_status) AS returned_orders_total,
  count(*) FILTER (o.return_status IS NOT NULL AND r.rating IS NOT NULL) AS returned_orders_with_a_rating
FROM s_orders o LEFT JOIN s_ratings r ON r.order_id = o.order_id"""
    ),
)
add(
    "a12_rating_by_delivery",
    lambda s: sales.rating_by_delivery(s.ratings(), s.orders()),
    star(
        f"""
SELECT o.delivery_status, count(rating) AS num_ratings, {ratio('sum(r.tenths)', '10 * count(rating)')} AS avg_rating
FROM s_orders o JOIN s_ratings r ON r.order_id = o.order_id GROUP BY 1"""
    ),
)
add(
    "a13_discount_profitability",
    lambda s: sales.discount_profitability(s.orders()),
    star(
        f"""
SELECT CASE WHEN disc_c = 0 THEN '0% (no discount)' WHEN gross_c <> 0 AND 10 * disc_c <= gross_c THEN '1-10%'
    WHEN gross_c <> 0 AND 10 * disc_c <= 2 * gross_c THEN '11-20%'
    WHEN gross_c <> 0 AND 10 * disc_c <= 3 * gross_c THEN '21-30%' ELSE '30%+' END AS discount_band,
  count(*) AS order_count,
  {mean('sum(cast(profit_margin_percentage * 100 as bigint))', 'count(profit_margin_percentage)')} AS avg_margin_pct,
  {dollars('sum(net_c)')} AS total_revenue, {dollars('sum(profit_c)')} AS total_profit
FROM s_orders GROUP BY 1"""
    ),
)
ROI = f"""
, f AS (SELECT customer_id, marketing_channel FROM (SELECT customer_id, marketing_channel,
    row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS n
    FROM s_orders WHERE marketing_channel IS NOT NULL) WHERE n = 1),
r AS (SELECT customer_id, sum(net_c) AS v FROM s_orders {{where}} GROUP BY 1)
SELECT f.marketing_channel, count(*) AS customers_acquired, {dollars('sum(r.v)')} AS lifetime_revenue,
  {dollars('sum(c.cac_c)')} AS total_acquisition_cost, {ratio('sum(r.v)', 'sum(c.cac_c)')} AS revenue_per_acquisition_dollar
FROM f JOIN r USING (customer_id) JOIN s_customers c USING (customer_id) GROUP BY 1"""
add("a14_channel_roi", lambda s: sales.channel_roi(s.orders(), s.customers()), star(ROI.format(where="")))
add(
    "a14_channel_roi_in_range",
    lambda s: sales.channel_roi(s.orders(), s.customers(), "1999-01-01", "1999-06-30"),
    star(ROI.format(where="WHERE order_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'")),
)
