"""KPI breakdowns and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailscope.operators import baskets, features, kpi, sales
from retailscope.plans.checks import dollars, mean, pct, ratio, star
from retailscope.plans.registry import add
from retailscope.schemas import PAID_CHANNELS, RETURN_REASONS, SOCIAL_CHANNELS

SUMS = """count(*) AS orders, sum(net_c) AS net, sum(profit_c) AS gain, count(return_status) AS returned_orders"""
SHOWN = f"""cast(orders as bigint) AS orders, {pct('orders', 'sum(orders) OVER ()')} AS order_share_pct, {dollars('net')} AS revenue,
  {pct('net', 'sum(net) OVER ()')} AS revenue_share_pct, {mean('net', 'orders')} AS aov, {dollars('gain')} AS profit,
  {pct('gain', 'net')} AS margin_pct, cast(returned_orders as bigint) AS returned_orders, {pct('returned_orders', 'orders')} AS return_rate_pct"""


def kpi_sql(dim: str, name: str, sums: str = "", shown: str = "", source: str = "s_orders", extra: str = "") -> str:
    lead = f", {extra}" if extra else ""
    return star(
        f"""{lead}, g AS (SELECT {dim} AS {name}, {SUMS} {', ' + sums if sums else ''} FROM {source} GROUP BY 1)
SELECT {name}, {SHOWN} {', ' + shown if shown else ''} FROM g"""
    )


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


add(
    "k1_headline",
    lambda s: kpi.headline(s.orders(), s.customers(), s.ratings()),
    star(
        f"""
, o AS (SELECT count(*) AS n, count(DISTINCT customer_id) AS buyers, sum(net_c) AS net, sum(gross_c) AS gross, sum(disc_c) AS off,
  sum(profit_c) AS gain, sum(quantity) AS units, count(return_status) AS back,
  count(*) FILTER (order_status = 'Cancelled') AS gone FROM s_orders),
r AS (SELECT count(*) AS rated, sum(tenths) AS tenths FROM s_ratings),
v AS (SELECT count(*) AS never FROM s_customers WHERE customer_id NOT IN (SELECT customer_id FROM s_orders))
SELECT n AS orders, buyers AS ordering_customers, never AS never_ordered, {dollars('net')} AS revenue, {dollars('gross')} AS gross_sales,
  {pct('gross - net', 'net')} AS gross_over_net_pct, {dollars('off')} AS discounts, {pct('off', 'gross')} AS discount_pct,
  {dollars('gain')} AS profit, {pct('gain', 'net')} AS margin_pct, {mean('net', 'n')} AS aov, cast(units as bigint) AS units,
  back AS returned_orders, {pct('back', 'n')} AS return_rate_pct, gone AS cancelled_orders, {pct('gone', 'n')} AS cancellation_rate_pct,
  rated AS rated_orders, {ratio('tenths', '10 * rated')} AS avg_rating FROM o, r, v"""
    ),
)
add(
    "k2_year_table",
    lambda s: kpi.year_table(s.orders()),
    star(
        f"""
, y AS (SELECT cast(year(order_date) as int) AS year, count(*) AS n, sum(net_c) AS net, sum(profit_c) AS gain FROM s_orders GROUP BY 1),
z AS (SELECT *, lag(net) OVER (ORDER BY year) AS p FROM y)
SELECT year, n AS orders, {dollars('net')} AS revenue, {dollars('gain')} AS profit, {pct('net - p', 'p')} AS yoy_growth_pct FROM z"""
    ),
)
add("k3_month_seasonality", lambda s: kpi.kpi_by(s.orders(), F.month("order_date").alias("month")), kpi_sql("cast(month(order_date) as int)", "month"))
add(
    "k4_peak_season_share",
    lambda s: kpi.peak_season(s.orders()),
    star(
        f"""
, t AS (SELECT count(*) AS n, sum(net_c) AS net, count(*) FILTER (month(order_date) >= 11) AS pn,
  sum(net_c) FILTER (month(order_date) >= 11) AS pv FROM s_orders)
SELECT pn AS peak_orders, {dollars('pv')} AS peak_revenue, {pct('pn', 'n')} AS order_share_pct, {pct('pv', 'net')} AS revenue_share_pct FROM t"""
    ),
)
add(
    "k4_best_and_worst_month",
    lambda s: kpi.best_and_worst_month(s.orders()),
    star(
        f"""
, m AS (SELECT cast(year(order_date) as int) AS year, cast(month(order_date) as int) AS month, sum(net_c) AS net FROM s_orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY net DESC, month) AS hi, row_number() OVER (PARTITION BY year ORDER BY net, month) AS lo FROM m)
SELECT year, max(month) FILTER (hi = 1) AS best_month, {dollars('max(net)')} AS best_revenue, max(month) FILTER (lo = 1) AS worst_month,
  {dollars('min(net)')} AS worst_revenue FROM r GROUP BY year"""
    ),
)
add("k5_order_status", lambda s: kpi.kpi_by(s.orders(), "order_status"), kpi_sql("order_status", "order_status"))
DAYS = "sum(cast(delivery_days * 100 as bigint)) AS days, count(delivery_days) AS dn"
add(
    "k6_delivery_status",
    lambda s: kpi.delivery_table(s.orders()),
    kpi_sql(
        "delivery_status",
        "delivery_status",
        DAYS,
        f"{mean('days', 'dn')} AS avg_delivery_days, CASE WHEN delivery_status <> 'Cancelled' THEN"
        f" {pct('orders', '''(sum(orders) FILTER (delivery_status <> 'Cancelled') OVER ())''')} END AS delivered_share_pct",
    ),
)
SHIPPING = (
    DAYS + ", sum(ship_c) AS ship",
    f"{mean('days', 'dn')} AS avg_delivery_days, {mean('ship', 'orders')} AS avg_shipping_cost, {pct('ship', 'net')} AS shipping_pct_of_revenue",
)
add("k7_shipping_method", lambda s: kpi.shipping_table(s.orders()), kpi_sql("shipping_method", "shipping_method", *SHIPPING))
add("k8_payment_method", lambda s: kpi.kpi_by(s.orders(), "payment_method"), kpi_sql("payment_method", "payment_method"))
add("k9_sales_channel", lambda s: kpi.kpi_by(s.orders(), "sales_channel"), kpi_sql("sales_channel", "sales_channel"))
add(
    "k10_return_rate_by_year",
    lambda s: kpi.kpi_by(s.orders(), F.year("order_date").alias("year")),
    kpi_sql("cast(year(order_date) as int)", "year"),
)
add(
    "k11_customer_base",
    lambda s: kpi.customer_base(s.customers()),
    star(
        f"""
SELECT count(*) AS customers, min(customer_age) AS min_age, max(customer_age) AS max_age,
  {ratio('sum(customer_age)', 'count(customer_age)', 1)} AS avg_age, {dollars('sum(cac_c)')} AS total_acquisition_cost,
  {mean('sum(cac_c)', 'count(*)')} AS avg_acquisition_cost FROM s_customers"""
    ),
)
for dim in ("gender", "customer_country", "region"):
    add(
        f"k11_customers_by_{dim.removeprefix('customer_')}",
        lambda s, dim=dim: kpi.customers_by(s.customers(), dim),
        star(
            f"""
, g AS (SELECT {dim}, count(*) AS customers FROM s_customers GROUP BY 1)
SELECT {dim}, customers, {pct('customers', 'sum(customers) OVER ()')} AS share_pct FROM g"""
        ),
    )
add(
    "k12_lifetime_value",
    lambda s: kpi.lifetime_value(s.orders(), s.customers()),
    star(
        f"""
, p AS (SELECT customer_id, count(*) AS n, sum(net_c) AS net FROM s_orders GROUP BY 1),
c AS (SELECT count(*) AS cn, sum(cac_c) AS cost FROM s_customers),
t AS (SELECT count(*) AS k, sum(n) AS orders, min(n) AS lo, max(n) AS hi, sum(net) AS net, max(net) AS top,
  count(*) FILTER (n > 1) AS again, quantile_cont(n, 0.5) AS mo, quantile_cont(cast(net as double) / 100, 0.5) AS mn FROM p)
SELECT k AS customers, {ratio('orders', 'k')} AS avg_orders, cast(mo as double) AS median_orders, lo AS min_orders, hi AS max_orders,
  {mean('net', 'k')} AS avg_revenue, round(mn, 2) AS median_revenue, {dollars('top')} AS max_revenue, again AS repeat_customers,
  {pct('again', 'k')} AS repeat_share_pct, {ratio('net * cn', 'cost * k')} AS revenue_per_acquisition_dollar FROM t, c"""
    ),
)
CUSTOMER_KPI = """
, t AS (SELECT customer_id, count(*) AS orders, sum(net_c) AS net, sum(profit_c) AS gain, count(return_status) AS returned_orders
  FROM s_orders GROUP BY 1),
g AS (SELECT {dim} AS {name}, count(*) AS customers, count(orders) AS active_customers, sum(orders) AS orders, sum(net) AS net,
  sum(gain) AS gain, sum(returned_orders) AS returned_orders FROM s_customers LEFT JOIN t USING (customer_id) GROUP BY 1)
SELECT {name}, customers, active_customers, {share} AS customer_share_pct, {shown} FROM g"""
# the limits once more, written out
AGE_SQL = """CASE WHEN customer_age < 18 THEN 'under 18' WHEN customer_age < 25 THEN '18-24' WHEN customer_age < 35 THEN '25-34' WHEN customer_age < 45 THEN '35-44'
  WHEN customer_age < 55 THEN '45-54' WHEN customer_age < 65 THEN '55-64' WHEN customer_age >= 65 THEN '65+' END"""
RATING_SQL = """CASE WHEN rating >= 4.5 THEN 'excellent (4.5-5.0)' WHEN rating >= 4.0 THEN '4.0-4.4' WHEN rating >= 3.5 THEN '3.5-3.9' WHEN rating >= 3.0 THEN '3.0-3.4'
  WHEN rating >= 2.5 THEN '2.5-2.9' WHEN rating < 2.5 THEN 'poor (up to 2.4)' END"""
DAYS_SQL = """CASE WHEN delivery_days > 8 THEN '9+ days' WHEN delivery_days > 5 THEN '6-8 days' WHEN delivery_days > 2 THEN '3-5 days' WHEN delivery_days >= 0 THEN '0-2 days'
  WHEN delivery_days < 0 THEN 'negative' END"""
DELAY_SQL = """CASE WHEN delivery_days - estimated_delivery_days > 5 THEN '6+ days late' WHEN delivery_days - estimated_delivery_days > 2 THEN '3-5 days late'
  WHEN delivery_days - estimated_delivery_days > 0 THEN '1-2 days late' WHEN delivery_days - estimated_delivery_days > -1 THEN 'on the day'
  WHEN delivery_days - estimated_delivery_days <= -1 THEN 'early' END"""
for key, name, dim, sql in (
    ("k13_segments", "customer_segment", "customer_segment", "customer_segment"),
    ("k15_age_bands", "age_band", None, AGE_SQL),
    ("k15_gender", "gender", "gender", "gender"),
    ("k38_countries", "customer_country", "customer_country", "customer_country"),
):
    add(
        key,
        lambda s, dim=dim: kpi.customer_kpi(s.orders(), s.customers(), dim or kpi.age_band()),
        star(CUSTOMER_KPI.format(dim=sql, name=name, share=pct("customers", "sum(customers) OVER ()"), shown=SHOWN)),
    )
add(
    "k38_top_states",
    lambda s: sales.top(
        kpi.customer_kpi(s.orders(), s.customers(), "customer_state").select("customer_state", "orders", "revenue"),
        "revenue",
        "customer_state",
        10,
    ),
    star(
        f"""
SELECT customer_state, count(*) AS orders, {dollars('sum(net_c)')} AS revenue FROM s_orders JOIN s_customers USING (customer_id)
GROUP BY 1 ORDER BY sum(net_c) DESC, 1 LIMIT 10"""
    ),
)
add(
    "k16_loyalty",
    lambda s: kpi.loyalty(s.orders()),
    star(
        f"""
, t AS (SELECT sum(loyalty_points_earned) AS e, sum(loyalty_points_redeemed) AS r, count(*) FILTER (loyalty_points_redeemed > 0) AS k, count(*) AS n FROM s_orders)
SELECT cast(e as bigint) AS points_earned, cast(r as bigint) AS points_redeemed, {pct('r', 'e')} AS redeemed_pct, k AS redeeming_orders,
  {pct('k', 'n')} AS redeeming_share_pct FROM t"""
    ),
)
add("k17_customer_type", lambda s: kpi.kpi_by(s.orders(), "customer_type"), kpi_sql("customer_type", "customer_type"))
add(
    "k18_catalog",
    lambda s: kpi.catalog(s.products(), s.items(), s.orders()),
    star(
        f"""
, i AS (SELECT count(*) AS lines, sum(quantity) AS units, count(DISTINCT product_id) AS sold FROM s_items),
o AS (SELECT count(*) AS placed FROM s_orders),
p AS (SELECT count(*) AS products, count(DISTINCT product_category) AS categories, count(DISTINCT product_subcategory) AS subcategories,
  count(DISTINCT brand) AS brands, min(price_c) AS lo, max(price_c) AS hi, sum(price_c) AS prices,
  sum(25 + product_id % 25) AS tenths FROM s_products)
SELECT products, categories, subcategories, brands, {dollars('lo')} AS min_price, {dollars('hi')} AS max_price, {mean('prices', 'products')} AS avg_price,
  {ratio('tenths', '10 * products')} AS avg_product_rating, sold AS products_sold, cast(units as bigint) AS units_sold,
  {ratio('lines', 'placed')} AS lines_per_order FROM p, i, o"""
    ),
)
add(
    "k18_products_per_category",
    lambda s: kpi.customers_by(s.products(), "product_category").withColumnRenamed("customers", "products"),
    star(
        f"""
, g AS (SELECT product_category, count(*) AS products FROM s_products GROUP BY 1)
SELECT product_category, products, {pct('products', 'sum(products) OVER ()')} AS share_pct FROM g"""
    ),
)
add(
    "k19_category_rank",
    lambda s: kpi.category_rank(s.products(), s.items()),
    star(
        f"""
, g AS (SELECT product_category, sum(net_c) AS net, sum(profit_c) AS gain FROM s_items JOIN s_products USING (product_id) GROUP BY 1),
w AS (SELECT *, sum(net) OVER () AS t, sum(net) OVER (ORDER BY net DESC, product_category) AS u,
  row_number() OVER (ORDER BY net DESC, product_category) AS rank FROM g)
SELECT rank, product_category, {dollars('net')} AS revenue, {pct('net', 't')} AS share_pct, {pct('u', 't')} AS cumulative_share_pct,
  {dollars('gain')} AS profit, {pct('gain', 'net')} AS margin_pct FROM w"""
    ),
)
add(
    "k20_price_points",
    lambda s: kpi.price_points(s.products()),
    star(
        f"""
SELECT product_category, count(*) AS products, {mean('sum(price_c)', 'count(*)')} AS avg_price, {dollars('min(price_c)')} AS min_price,
  {dollars('max(price_c)')} AS max_price FROM s_products GROUP BY 1"""
    ),
)
TOP_SHARE = f"""
, g AS (SELECT product_id, product_name, product_category, brand, sum(i.quantity) AS units, sum(net_c) AS net
  FROM s_items i JOIN s_products USING (product_id) GROUP BY ALL),
w AS (SELECT *, row_number() OVER (ORDER BY {{by}} DESC, product_id) AS rank, (SELECT sum(net_c) FROM s_items) AS t FROM g)
SELECT rank, product_id, product_name, product_category, brand, cast(units as bigint) AS units_sold, {dollars('net')} AS revenue,
  {pct('net', 't', 4)} AS share_pct FROM w WHERE rank <= {{n}}"""
add("k21_top_products", lambda s: kpi.top_product_shares(s.products(), s.items()), star(TOP_SHARE.format(by="net", n=10)))
add(
    "k22_top_products_by_units",
    lambda s: kpi.top_product_shares(s.products(), s.items(), limit=5, by="units"),
    star(TOP_SHARE.format(by="units", n=5)),
)
add(
    "k23_top_brands",
    lambda s: kpi.top_brands(s.products(), s.items()),
    star(
        f"""
, g AS (SELECT brand, sum(net_c) AS net, sum(i.quantity) AS units FROM s_items i JOIN s_products USING (product_id) GROUP BY 1)
SELECT brand, {dollars('net')} AS revenue, cast(units as bigint) AS units_sold, {pct('net', 'sum(net) OVER ()')} AS share_pct
FROM g ORDER BY net DESC, brand LIMIT 5"""
    ),
)
GROUP_SQL = "CASE return_reason " + " ".join(f"WHEN '{r}' THEN '{g}'" for r, g in RETURN_REASONS.items()) + " END"
add(
    "k24_return_reasons",
    lambda s: kpi.return_reasons(s.orders()),
    star(
        f"""
, g AS (SELECT return_reason, {GROUP_SQL} AS reason_group, count(*) AS orders FROM s_orders WHERE return_status IS NOT NULL GROUP BY 1, 2)
SELECT return_reason, orders, {pct('orders', 'sum(orders) OVER ()')} AS share_pct, reason_group,
  {pct('sum(orders) OVER (PARTITION BY reason_group)', 'sum(orders) OVER ()')} AS group_share_pct FROM g"""
    ),
)
add("k25_marketing_channel", lambda s: kpi.kpi_by(s.orders(), "marketing_channel"), kpi_sql("marketing_channel", "marketing_channel"))
add(
    "k26_paid_vs_owned",
    lambda s: kpi.kpi_by(s.orders(), kpi.channel_group()),
    kpi_sql(
        f"CASE WHEN marketing_channel IN ({names(PAID_CHANNELS)}) THEN 'paid' WHEN marketing_channel IS NOT NULL THEN 'owned' END",
        "channel_group",
    ),
)
add(
    "k26_social_channels",
    lambda s: kpi.kpi_by(s.orders(), kpi.social_flag()),
    kpi_sql(f"coalesce(marketing_channel IN ({names(SOCIAL_CHANNELS)}), false)", "social"),
)
YEARS = list(range(1995, 2002))


def by_year_sql(dim: str) -> str:
    shown = ", ".join(f"{dollars(f'coalesce(sum(net_c) FILTER (year(order_date) = {y}), 0)')} AS revenue_{y}" for y in YEARS)
    first, last = (f"sum(net_c) FILTER (year(order_date) = {y})" for y in (YEARS[0], YEARS[-1]))
    return star(f"SELECT {dim}, {shown}, {pct(f'{last} - {first}', first, 1)} AS change_pct FROM s_orders GROUP BY 1")


add("k27_channel_by_year", lambda s: kpi.revenue_by_year(s.orders(), "marketing_channel", YEARS), by_year_sql("marketing_channel"))
add(
    "k28_roi_table",
    lambda s: kpi.roi_table(s.orders(), s.customers()),
    star(
        f"""
, f AS (SELECT customer_id, arg_min(marketing_channel, (order_date, order_id)) AS ch FROM s_orders WHERE marketing_channel IS NOT NULL GROUP BY 1),
r AS (SELECT customer_id, sum(net_c) AS v FROM s_orders GROUP BY 1)
SELECT ch AS marketing_channel, count(*) AS customers_acquired, {dollars('sum(v)')} AS lifetime_revenue, {dollars('sum(cac_c)')} AS total_acquisition_cost,
  {ratio('sum(v)', 'sum(cac_c)')} AS revenue_per_acquisition_dollar, {mean('sum(cac_c)', 'count(*)')} AS avg_acquisition_cost
FROM f JOIN r USING (customer_id) JOIN s_customers USING (customer_id) GROUP BY 1"""
    ),
)
OFF = ("sum(disc_c) AS off", f"{mean('off', 'orders')} AS avg_discount")
add("k29_campaigns", lambda s: kpi.campaigns(s.orders()), kpi_sql("coalesce(campaign_name, '(none)')", "campaign", *OFF))
add(
    "k29_campaign_coverage",
    lambda s: kpi.campaign_coverage(s.orders()),
    kpi_sql(
        "CASE WHEN campaign_name IS NULL THEN 'none' WHEN campaign_name = 'Default_Campaign' THEN 'default' ELSE 'named' END",
        "campaign_kind",
    ),
)
add("k30_coupon_use", lambda s: kpi.coupon_use(s.orders()), kpi_sql("coupon_code IS NOT NULL", "coupon_used", *OFF))
add(
    "k30_coupon_codes",
    lambda s: kpi.coupon_codes(s.orders()),
    kpi_sql("coupon_code", "coupon_code", *OFF, source="q", extra="q AS (SELECT * FROM s_orders WHERE coupon_code IS NOT NULL)"),
)
add(
    "k31_discount_totals",
    lambda s: kpi.discount_totals(s.orders()),
    star(
        f"""
SELECT {dollars('sum(disc_c)')} AS discounts, {pct('sum(disc_c)', 'sum(gross_c)')} AS discount_pct_of_gross,
  count(*) FILTER (disc_c > 0) AS discounted_orders, {pct('count(*) FILTER (disc_c > 0)', 'count(*)')} AS discounted_share_pct FROM s_orders"""
    ),
)
BAND_SQL = """CASE WHEN disc_c = 0 THEN '0% (no discount)' WHEN gross_c <> 0 AND 10 * disc_c <= gross_c THEN '1-10%'
  WHEN gross_c <> 0 AND 10 * disc_c <= 2 * gross_c THEN '11-20%' WHEN gross_c <> 0 AND 10 * disc_c <= 3 * gross_c THEN '21-30%' ELSE '30%+' END"""
add(
    "k31_discount_bands",
    lambda s: kpi.discount_bands(s.orders()),
    kpi_sql(
        BAND_SQL,
        "discount_band",
        "sum(cast(profit_margin_percentage * 100 as bigint)) AS mg, count(profit_margin_percentage) AS mn",
        f"{mean('mg', 'mn')} AS avg_margin_pct",
    ),
)
add(
    "k32_region_volume",
    lambda s: kpi.region_volume(s.orders(True)),
    kpi_sql("region", "region", "count(DISTINCT customer_id) AS customers", "customers"),
)
add("k33_region_profitability", lambda s: kpi.kpi_by(s.orders(True), "region"), kpi_sql("region", "region"))
add("k34_region_by_year", lambda s: kpi.revenue_by_year(s.orders(True), "region", YEARS), by_year_sql("region"))


def fulfilment_sql(dim: str) -> str:
    outcomes = {"on_time_pct": "On Time", "delayed_pct": "Delayed", "early_pct": "Early", "cancelled_pct": "Cancelled"}
    shown = ", ".join(
        pct(f"count(*) FILTER (delivery_status = '{v}')", "count(*)") + f" AS {name}" for name, v in outcomes.items()
    )
    days = mean("sum(cast(delivery_days * 100 as bigint))", "count(delivery_days)")
    return star(f"SELECT {dim}, count(*) AS orders, {shown}, {days} AS avg_delivery_days FROM s_orders GROUP BY 1")


add("k35_region_fulfilment", lambda s: kpi.fulfilment(s.orders(True), "region"), fulfilment_sql("region"))
add("k35_warehouse_fulfilment", lambda s: kpi.fulfilment(s.orders(), "warehouse"), fulfilment_sql("warehouse"))
add(
    "k36_region_returns_vs_company",
    lambda s: kpi.return_rate_vs_company(s.orders(True), "region"),
    star(
        f"""
, g AS (SELECT region, count(*) AS n, count(return_status) AS b FROM s_orders GROUP BY 1)
SELECT region, {pct('b', 'n')} AS return_rate_pct, {pct('sum(b) OVER ()', 'sum(n) OVER ()')} AS company_rate_pct FROM g"""
    ),
)
add(
    "k37_top_categories_per_region",
    lambda s: kpi.top_categories_per(s.items(), s.products(), s.orders(True), "region"),
    star(
        f"""
, g AS (SELECT region, product_category, sum(i.net_c) AS net FROM s_items i JOIN s_products USING (product_id) JOIN s_orders o USING (order_id) GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY net DESC, product_category) AS rank FROM g)
SELECT region, rank, product_category, {dollars('net')} AS revenue FROM w WHERE rank <= 3"""
    ),
)
add(
    "k39_rating_headline",
    lambda s: kpi.rating_headline(s.ratings(), s.orders()),
    star(
        f"""
, v AS (SELECT rating, count(*) AS n FROM s_ratings GROUP BY 1),
m AS (SELECT rating FROM v ORDER BY n DESC, rating LIMIT 1),
t AS (SELECT count(*) AS k, sum(tenths) AS tenths, min(rating) AS lo, max(rating) AS hi, quantile_cont(rating::double, 0.5) AS mid,
  count(*) FILTER (tenths >= 40) AS a, count(*) FILTER (tenths <= 20) AS b, count(*) FILTER (tenths = 50) AS c FROM s_ratings),
o AS (SELECT count(*) AS n FROM s_orders)
SELECT k AS rated_orders, {pct('k', 'n')} AS rated_share_pct, {ratio('tenths', '10 * k')} AS avg_rating, round(mid, 2) AS median_rating,
  m.rating::double AS mode_rating, lo::double AS min_rating, hi::double AS max_rating, {pct('a', 'k')} AS four_or_more_pct,
  {pct('b', 'k')} AS two_or_less_pct, {pct('c', 'k')} AS perfect_pct FROM t, o, m"""
    ),
)


def rating_sql(dim: str, name: str, source: str = "s_ratings", sums: str = "", shown: str = "") -> str:
    return star(
        f"""
, g AS (SELECT {dim} AS {name}, count(*) AS rated_orders, sum(tenths) AS tenths {', ' + sums if sums else ''} FROM {source} GROUP BY 1)
SELECT {name}, rated_orders, {pct('rated_orders', 'sum(rated_orders) OVER ()')} AS share_pct,
  {ratio('tenths', '10 * rated_orders')} AS avg_rating {', ' + shown if shown else ''} FROM g"""
    )


JOINED = "s_ratings JOIN s_orders USING (order_id)"
add("k40_rating_bands", lambda s: kpi.rating_by(s.ratings(), kpi.rating_band()), rating_sql(RATING_SQL, "rating_band"))
add("k41_sentiment", lambda s: kpi.rating_by(s.ratings(), "review_sentiment"), rating_sql("review_sentiment", "review_sentiment"))
add(
    "k41_sentiment_check",
    lambda s: kpi.sentiment_check(s.ratings()),
    star(
        """
SELECT count(*) FILTER (review_sentiment = 'Negative') AS negative_reviews, count(*) FILTER (tenths < 25) AS ratings_below_2_5,
  count(*) FILTER ((review_sentiment = 'Negative') <> (tenths < 25)) AS disagreeing FROM s_ratings"""
    ),
)
add(
    "k42_rating_by_delivery",
    lambda s: kpi.rating_by(
        sales.rated_orders(s.ratings(), s.orders()), "delivery_status", {"avg_delivery_days": kpi.decimal_mean("delivery_days", "days")}
    ),
    rating_sql("delivery_status", "delivery_status", JOINED, DAYS, f"{mean('days', 'dn')} AS avg_delivery_days"),
)
add(
    "k43_rating_by_delivery_days",
    lambda s: kpi.rating_by(sales.rated_orders(s.ratings(), s.orders()), kpi.delivery_day_band()),
    rating_sql(DAYS_SQL, "delivery_band", JOINED),
)
add(
    "k44_rating_by_segment",
    lambda s: kpi.rating_by(s.ratings().join(s.customers().select("customer_id", "customer_segment"), "customer_id"), "customer_segment"),
    rating_sql("customer_segment", "customer_segment", "s_ratings JOIN s_customers USING (customer_id)"),
)
add(
    "k44_rating_by_category",
    lambda s: kpi.category_ratings(s.ratings(), s.items(), s.products()),
    rating_sql(
        "product_category",
        "product_category",
        "(SELECT DISTINCT order_id, product_category FROM s_items JOIN s_products USING (product_id)) JOIN s_ratings USING (order_id)",
    ),
)
add("k44_rating_by_channel", lambda s: kpi.rating_by(sales.rated_orders(s.ratings(), s.orders()), "sales_channel"), rating_sql("sales_channel", "sales_channel", JOINED))
add("k44_rating_by_region", lambda s: kpi.rating_by(sales.rated_orders(s.ratings(), s.orders(True)), "region"), rating_sql("region", "region", JOINED))
add(
    "z1_cross_sell_pairs",
    lambda s: baskets.cross_sell_pairs(s.items(), s.orders()),
    star(
        f"""
, l AS (SELECT DISTINCT order_id, product_id FROM s_items), o AS (SELECT count(*) AS n FROM s_orders),
p AS (SELECT a.product_id AS product_a, b.product_id AS product_b, count(*) AS orders_together FROM l a JOIN l b ON a.order_id = b.order_id
  AND a.product_id < b.product_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT p.*, {pct('orders_together', 'n', 4)} AS support_pct FROM p, o ORDER BY orders_together DESC, product_a, product_b LIMIT 20"""
    ),
)
add(
    "z2_first_and_repeat_orders",
    lambda s: kpi.first_and_repeat_orders(features.order_history(s.orders())),
    kpi_sql(
        "CASE WHEN seq = 1 THEN 'first' ELSE 'repeat' END",
        "order_kind",
        source="q",
        extra="q AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS seq FROM s_orders)",
    ),
)
add(
    "z2_days_between_orders",
    lambda s: features.days_between_orders(s.orders()),
    star(
        f"""
, q AS (SELECT date_diff('day', lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id), order_date) AS gap FROM s_orders)
SELECT count(gap) AS gaps, {ratio('sum(gap)', 'count(gap)')} AS avg_days, min(gap) AS min_days, max(gap) AS max_days FROM q"""
    ),
)
add("z3_shipping_cost_vs_margin", lambda s: kpi.shipping_table(s.orders()), kpi_sql("shipping_method", "shipping_method", *SHIPPING))
add("z4_payment_return_rate", lambda s: kpi.kpi_by(s.orders(), "payment_method"), kpi_sql("payment_method", "payment_method"))
add(
    "z5_returns_by_category_and_reason",
    lambda s: kpi.returns_by_category_and_reason(s.items(), s.products(), s.orders()),
    star(
        """
SELECT product_category, return_reason, count(DISTINCT order_id) AS returned_orders FROM s_items JOIN s_products USING (product_id)
JOIN s_orders o USING (order_id) WHERE return_status IS NOT NULL GROUP BY 1, 2"""
    ),
)
add(
    "z6_delay_vs_rating",
    lambda s: kpi.rating_by(sales.rated_orders(s.ratings(), s.orders()), kpi.delay_band()),
    rating_sql(DELAY_SQL, "delay_band", JOINED),
)
