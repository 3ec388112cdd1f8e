"""Customer segmentation and report statistics, with their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailscope.functions.numeric import money
from retailscope.operators import kpi, reports, segments
from retailscope.plans.checks import dollars, mean, pct, ratio, star
from retailscope.plans.registry import add

RFM = """
, b AS (SELECT customer_id, max(order_date) AS last_order_date, count(*) AS frequency, sum(net_c) AS net FROM s_orders GROUP BY 1),
p AS (SELECT *, date_diff('day', last_order_date, (SELECT max(order_date) FROM s_orders)) AS recency_days FROM b),
k AS (SELECT *, row_number() OVER (ORDER BY recency_days DESC, customer_id) AS rr, row_number() OVER (ORDER BY frequency, customer_id) AS fr,
  row_number() OVER (ORDER BY net, customer_id) AS mr, count(*) OVER () AS n FROM p),
q AS (SELECT *, cast(greatest(1, ceil(5e0 * (rr - 1) / (n - 1))) as int) AS r_score, cast(greatest(1, ceil(5e0 * (fr - 1) / (n - 1))) as int) AS f_score,
  cast(greatest(1, ceil(5e0 * (mr - 1) / (n - 1))) as int) AS m_score FROM k),
x AS (SELECT *, CASE WHEN least(r_score, f_score, m_score) >= 4 THEN 'Champions' WHEN f_score >= 4 THEN 'Loyal'
  WHEN r_score <= 2 AND greatest(f_score, m_score) >= 3 THEN 'At Risk' WHEN f_score = 1 AND r_score >= 4 THEN 'New'
  WHEN greatest(r_score, f_score, m_score) <= 2 THEN 'Lost' ELSE 'Needs Attention' END AS segment FROM q)"""


def base(s):
    return segments.rfm_base(s.orders()).withColumn("monetary", money(F.col("monetary")))


add(
    "p1_rfm_base",
    base,
    star(RFM + f" SELECT customer_id, last_order_date, frequency, {dollars('net')} AS monetary, cast(recency_days as int) AS recency_days FROM p"),
)
add(
    "p2_rfm_scores",
    lambda s: segments.rfm_scores(s.orders()).select("customer_id", "r_score", "f_score", "m_score"),
    star(RFM + " SELECT customer_id, r_score, f_score, m_score FROM x"),
)
add(
    "p3_rfm_segments",
    lambda s: segments.rfm_segments(segments.rfm_scores(s.orders())).select("customer_id", "segment"),
    star(RFM + " SELECT customer_id, segment FROM x"),
)
SUMMARY = f"""count(*) AS customer_count, {dollars('sum(net)')} AS total_monetary, round_even(avg(recency_days), 1) AS avg_recency_days,
  round_even(avg(frequency), 2) AS avg_frequency"""
add(
    "p4_segment_summary",
    lambda s: segments.segment_summary(segments.rfm_segments(segments.rfm_scores(s.orders()))),
    star(RFM + f" SELECT segment, {SUMMARY} FROM x GROUP BY 1"),
)


def rfm_table(s):
    summary = segments.segment_summary(segments.rfm_segments(segments.rfm_scores(s.orders())))
    revenue = F.col("total_monetary").cast("decimal(20,2)")
    return kpi.with_totals(summary.withColumn("_r", revenue), "customer_count", "_r").select(
        "segment",
        "customer_count",
        kpi.share("customer_count", "customer_share_pct"),
        "total_monetary",
        kpi.money_share("_r", "revenue_share_pct"),
        "avg_recency_days",
        "avg_frequency",
    )


add(
    "k14_rfm_table",
    rfm_table,
    star(
        RFM
        + f""", g AS (SELECT segment, {SUMMARY}, sum(net) AS net FROM x GROUP BY 1)
SELECT segment, customer_count, {pct('customer_count', 'sum(customer_count) OVER ()')} AS customer_share_pct, total_monetary,
  {pct('net', 'sum(net) OVER ()')} AS revenue_share_pct, avg_recency_days, avg_frequency FROM g"""
    ),
)


def flat_orders(s, **dates):
    stats = reports.orders_stats(s.orders(True), s.items(), s.products(), **dates)
    return stats.select(
        "order_count",
        "total_revenue",
        "avg_order_value",
        "return_rate_pct",
        "top_channel",
        "top_channel_revenue",
        *[
            c.alias(f"{name}_{i + 1}")
            for i in range(3)
            for name, c in (
                ("category", F.get("top_categories", F.lit(i))["product_category"]),
                ("category_revenue", F.get("top_categories", F.lit(i))["total_revenue"]),
                ("category_share_pct", F.get("top_categories", F.lit(i))["share_pct"]),
                ("region", F.get("top_regions", F.lit(i))["region"]),
                ("region_share_pct", F.get("top_regions", F.lit(i))["share_pct"]),
            )
        ],
    )


def orders_stats_sql(where: str) -> str:
    picks = ", ".join(
        f"(SELECT product_category FROM c WHERE k = {i}) AS category_{i}, (SELECT {dollars('net')} FROM c WHERE k = {i}) AS category_revenue_{i},"
        f" (SELECT round_even(100 * {dollars('net')} / {dollars('t.net')}, 2) FROM c WHERE k = {i}) AS category_share_pct_{i},"
        f" (SELECT region FROM r WHERE k = {i}) AS region_{i},"
        f" (SELECT round_even(100 * {dollars('net')} / {dollars('t.net')}, 2) FROM r WHERE k = {i}) AS region_share_pct_{i}"
        for i in (1, 2, 3)
    )
    return star(
        f"""
, o AS (SELECT * FROM s_orders {where}),
t AS (SELECT count(*) AS n, sum(net_c) AS net, count(return_status) AS b FROM o),
c AS (SELECT product_category, sum(i.net_c) AS net, row_number() OVER (ORDER BY sum(i.net_c) DESC, product_category) AS k
  FROM s_items i JOIN s_products USING (product_id) JOIN o USING (order_id) GROUP BY 1),
r AS (SELECT region, sum(net_c) AS net, row_number() OVER (ORDER BY sum(net_c) DESC, region) AS k FROM o GROUP BY 1),
h AS (SELECT sales_channel, sum(net_c) AS net, row_number() OVER (ORDER BY sum(net_c) DESC, sales_channel) AS k FROM o GROUP BY 1)
SELECT n AS order_count, {dollars('t.net')} AS total_revenue, {mean('t.net', 'n')} AS avg_order_value, {pct('b', 'n')} AS return_rate_pct,
  (SELECT sales_channel FROM h WHERE k = 1) AS top_channel, (SELECT {dollars('net')} FROM h WHERE k = 1) AS top_channel_revenue, {picks} FROM t"""
    )


add("p5_orders_report_stats", lambda s: flat_orders(s), orders_stats_sql(""))
add(
    "p5_orders_report_stats_in_range",
    lambda s: flat_orders(s, date_from="1997-01-01", date_to="1997-12-31"),
    orders_stats_sql("WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"),
)


def flat_ratings(s):
    stats = reports.ratings_stats(s.orders(), s.items(), s.products(), s.ratings())
    return stats.select(
        "total_ratings",
        "avg_rating",
        "overall_return_rate_pct",
        F.element_at("rating_distribution", "3.0").alias("rated_3_0"),
        F.size("rating_distribution").alias("rating_values"),
        *[
            F.get(cells, F.lit(i))[field].alias(f"{name}_{field}_{i + 1}")
            for i in range(3)
            for name, cells in (("highest", "highest_return_rate_categories"), ("lowest", "lowest_return_rate_categories"))
            for field in ("product_category", "return_rate_pct")
        ],
    )


LADDER = ", ".join(
    f"(SELECT {field} FROM c WHERE {side} = {i}) AS {name}_{field}_{i}"
    for i in (1, 2, 3)
    for name, side in (("highest", "hi"), ("lowest", "lo"))
    for field in ("product_category", "return_rate_pct")
)
add(
    "p6_ratings_report_stats",
    flat_ratings,
    star(
        f"""
, g AS (SELECT product_category, count(*) AS n, count(return_status) AS b FROM (SELECT DISTINCT order_id, product_category FROM s_items
  JOIN s_products USING (product_id)) JOIN s_orders USING (order_id) GROUP BY 1),
d AS (SELECT product_category, {pct('b', 'n')} AS return_rate_pct FROM g),
c AS (SELECT *, row_number() OVER (ORDER BY return_rate_pct DESC, product_category) AS hi,
  row_number() OVER (ORDER BY return_rate_pct, product_category DESC) AS lo FROM d),
r AS (SELECT count(*) AS n, sum(tenths) AS tenths, count(*) FILTER (tenths = 30) AS three, count(DISTINCT tenths) AS k FROM s_ratings),
o AS (SELECT count(*) AS n, count(return_status) AS b FROM s_orders)
SELECT r.n AS total_ratings, {ratio('r.tenths', '10 * r.n')} AS avg_rating, {pct('o.b', 'o.n')} AS overall_return_rate_pct, three AS rated_3_0,
  cast(k as int) AS rating_values, {LADDER} FROM r, o"""
    ),
)


def narrative(s):
    stats = reports.orders_stats(s.orders(True), s.items(), s.products())
    told = reports.orders_narrative(stats)
    return told.select("summary", F.explode(F.concat("key_insights", "recommendations")).alias("insight"))


add(
    "p7_orders_narrative",
    narrative,
    star(
        f"""
, t AS (SELECT count(*) AS n, sum(net_c) AS net, count(return_status) AS b FROM s_orders),
c AS (SELECT product_category AS k, sum(net_c) AS v FROM s_items JOIN s_products USING (product_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
r AS (SELECT region AS k, sum(net_c) AS v FROM s_orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
h AS (SELECT sales_channel AS k, sum(net_c) AS v FROM s_orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
w AS (SELECT format('{{:,}}', n) || ' orders generated $' || format('{{:,.2f}}', {dollars('net')}) || ' in revenue (AOV $'
  || format('{{:,.2f}}', {mean('net', 'n')}) || ') with a ' || format('{{:.2f}}', {pct('b', 'n')}) || '% return rate.' AS summary FROM t)
SELECT summary, '''' || c.k || ''' is the top-revenue category at ' || cast(round_even(100 * {dollars('c.v')} / {dollars('t.net')}, 2) as varchar)
  || '% of total revenue.' AS insight FROM w, t, c
UNION ALL SELECT summary, '''' || r.k || ''' is the top-revenue region at ' || cast(round_even(100 * {dollars('r.v')} / {dollars('t.net')}, 2) as varchar)
  || '% of total revenue.' FROM w, t, r
UNION ALL SELECT summary, '''' || h.k || ''' is the leading sales channel by revenue.' FROM w, h
UNION ALL SELECT summary, 'Investigate the ' || format('{{:.2f}}', {pct('b', 'n')}) || '% return rate for cost-reduction opportunities.' FROM w, t
UNION ALL SELECT summary, 'Consider concentrating marketing spend toward ''' || r.k || ''' and ''' || c.k || ''', the current top performers.' FROM w, r, c"""
    ),
)
def filled(template: str, **parts: str) -> str:
    """A text template as a SQL concatenation."""
    sql, rest = [], template
    while rest:
        head, found, tail = rest.partition("{")
        sql.append("'" + head.replace("'", "''") + "'")
        if not found:
            break
        name, _, rest = tail.partition("}")
        sql.append(parts[name])
    return " || ".join(sql)


def money_text(cents: str) -> str:
    return f"'$' || format('{{:,.2f}}', {dollars(cents)})"


def two(number: str) -> str:
    return "format('{:.2f}', " + number + ")"


def cells(table: str, order: str, *texts: str) -> str:
    """Rows as `[('a', 'b'), …]`."""
    inner = " || ''', ''' || ".join(texts)
    return f"(SELECT '[' || string_agg('(''' || {inner} || ''')', ', ' ORDER BY {order}) || ']' FROM {table})"


def share_cells(table: str) -> str:
    share = f"cast(round_even(100 * {dollars('v')} / {dollars('t.net')}, 2) as varchar)"
    return cells(table, "v DESC, k", "k", f"{money_text('v')} || ' (' || {share} || '%)'")


PERIOD = {"since": "'all time'", "until": "'all time'"}
ORDER_NUMBERS = {
    **PERIOD,
    "orders": "format('{:,}', n)",
    "revenue": money_text("t.net"),
    "aov": "'$' || format('{:,.2f}', " + mean("t.net", "n") + ")",
    "rate": two(pct("b", "n")),
    "categories": share_cells("c"),
    "regions": share_cells("r"),
    "channel": "h.k",
    "channel_revenue": money_text("h.v"),
}
add(
    "p8_orders_prompt",
    lambda s: reports.orders_prompt(reports.orders_stats(s.orders(True), s.items(), s.products())),
    star(
        f"""
, t AS (SELECT count(*) AS n, sum(net_c) AS net, count(return_status) AS b FROM s_orders),
c AS (SELECT product_category AS k, sum(net_c) AS v FROM s_items JOIN s_products USING (product_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3),
r AS (SELECT region AS k, sum(net_c) AS v FROM s_orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3),
h AS (SELECT sales_channel AS k, sum(net_c) AS v FROM s_orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT {filled(reports.ORDERS_PROMPT, **ORDER_NUMBERS)} AS prompt FROM t, h"""
    ),
)


def rate_cells(order: str) -> str:
    ranked = f"(SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM d) WHERE k <= 3"
    return cells(ranked, "k", "product_category", two("p") + " || '%'")


RATING_NUMBERS = {
    **PERIOD,
    "ratings": "format('{:,}', r.n)",
    "mean": two(ratio("r.tenths", "10 * r.n")),
    "histogram": "(SELECT '{' || string_agg('''' || rating || ''': ' || n, ', ' ORDER BY rating) || '}' FROM v)",
    "rate": two(pct("o.b", "o.n")),
    "highest": rate_cells("p DESC, product_category"),
    "lowest": rate_cells("p, product_category DESC"),
}
add(
    "p7_ratings_narrative",
    lambda s: reports.ratings_narrative(reports.ratings_stats(s.orders(), s.items(), s.products(), s.ratings())).select(
        "summary", F.explode(F.concat("key_insights", "recommendations")).alias("insight")
    ),
    star(
        f"""
, g AS (SELECT product_category, count(*) AS n, count(return_status) AS b FROM (SELECT DISTINCT order_id, product_category FROM s_items
  JOIN s_products USING (product_id)) JOIN s_orders USING (order_id) GROUP BY 1),
d AS (SELECT product_category, {pct('b', 'n')} AS p FROM g), r AS (SELECT count(*) AS n, sum(tenths) AS tenths FROM s_ratings),
o AS (SELECT count(*) AS n, count(return_status) AS b FROM s_orders),
hi AS (SELECT * FROM d ORDER BY p DESC, product_category LIMIT 1), lo AS (SELECT * FROM d ORDER BY p, product_category DESC LIMIT 1),
w AS (SELECT format('{{:,}}', r.n) || ' ratings collected, averaging ' || {two(ratio('r.tenths', '10 * r.n'))} || '/5, against an overall return rate of '
  || {two(pct('o.b', 'o.n'))} || '%.' AS summary FROM r, o)
SELECT summary, '''' || product_category || ''' has the highest return rate at ' || {two('p')} || '%.' AS insight FROM w, hi
UNION ALL SELECT summary, '''' || product_category || ''' has the lowest return rate at ' || {two('p')} || '%.' FROM w, lo
UNION ALL SELECT summary, 'Review product quality/listing accuracy for ''' || product_category || '''.' FROM w, hi"""
    ),
)
add(
    "p8_ratings_prompt",
    lambda s: reports.ratings_prompt(reports.ratings_stats(s.orders(), s.items(), s.products(), s.ratings())),
    star(
        f"""
, g AS (SELECT product_category, count(*) AS n, count(return_status) AS b FROM (SELECT DISTINCT order_id, product_category FROM s_items
  JOIN s_products USING (product_id)) JOIN s_orders USING (order_id) GROUP BY 1),
d AS (SELECT product_category, {pct('b', 'n')} AS p FROM g), r AS (SELECT count(*) AS n, sum(tenths) AS tenths FROM s_ratings),
v AS (SELECT rating, count(*) AS n FROM s_ratings GROUP BY 1), o AS (SELECT count(*) AS n, count(return_status) AS b FROM s_orders)
SELECT {filled(reports.RATINGS_PROMPT, **RATING_NUMBERS)} AS prompt FROM r, o"""
    ),
)


def segment_stats(s):
    scored = segments.rfm_segments(segments.rfm_scores(s.orders()))
    return reports.segments_stats(scored, segments.segment_summary(scored))


SEGMENTS = (
    RFM
    + f""", g AS (SELECT segment, {SUMMARY}, row_number() OVER (ORDER BY sum(net) DESC, segment) AS k FROM x GROUP BY 1),
t AS (SELECT count(*) AS n, max(last_order_date) AS as_of, count(DISTINCT segment) AS parts FROM x)"""
)
SPEND = "'$' || format('{:,.2f}', total_monetary)"
ABOUT = {"name": "segment", "count": "customer_count", "spend": SPEND, "recency": "avg_recency_days", "frequency": "avg_frequency"}
SCORED = {"customers": "format('{:,}', n)", "as_of": "as_of", "count": "parts"}
add(
    "p7_segments_narrative",
    lambda s: reports.segments_narrative(segment_stats(s)).select("summary", F.explode(F.concat("key_insights", "recommendations")).alias("insight")),
    star(
        SEGMENTS
        + f""" SELECT {filled(reports.SEGMENTS_SUMMARY, **SCORED)} AS summary, CASE WHEN k = 1 THEN {filled(reports.TOP_SEGMENT, **ABOUT)}
  ELSE {filled(reports.OTHER_SEGMENTS, **ABOUT)} END AS insight FROM g, t WHERE k <= 4
UNION ALL SELECT {filled(reports.SEGMENTS_SUMMARY, **SCORED)}, unnest(['Prioritize retention offers for the ''At Risk'' segment before they lapse into ''Lost''.',
  'Target the ''New'' segment with onboarding/second-purchase incentives.']) FROM t"""
    ),
)
SEGMENT_CELLS = cells(
    "g",
    "k",
    "segment",
    "customer_count || ' customers'",
    SPEND + " || ' total spend'",
    "'avg recency ' || avg_recency_days || 'd'",
    "'avg frequency ' || avg_frequency",
)
add(
    "p8_segments_prompt",
    lambda s: reports.segments_prompt(segment_stats(s)),
    star(SEGMENTS + f" SELECT {filled(reports.SEGMENTS_PROMPT, segments=SEGMENT_CELLS, **SCORED)} AS prompt FROM t"),
)


def replies(s):
    """One reply per conversation turn: assistants answer in JSON, users in plain text."""
    turns = s.raw("conversations").withColumn("report", F.concat_ws("-", "conv_id", "turn", "role"))
    told = F.to_json(F.struct(F.col("text").alias("summary"), F.array("role").alias("key_insights"), F.array(F.lit("act")).alias("recommendations")))
    return turns.select("report", F.when(F.col("role") == "assistant", F.concat(F.lit("Here you are:\n"), told, F.lit("\nDone."))).otherwise(F.col("text")).alias("reply"))


def fallbacks(s):
    insight, advice = F.array(F.lit("none")).alias("key_insights"), F.array(F.lit("wait")).alias("recommendations")
    return replies(s).select("report", F.lit("deterministic").alias("summary"), insight, advice).distinct()


add(
    "p9_parsed_replies",
    lambda s: reports.parsed_replies(replies(s).distinct(), fallbacks(s)).select(
        "report", F.md5("summary").alias("summary_md5"), F.col("key_insights")[0].alias("insight"), "generated_by"
    ),
    """SELECT DISTINCT concat_ws('-', conv_id, turn, role) AS report, md5(CASE WHEN role = 'assistant' THEN text ELSE 'deterministic' END) AS summary_md5,
  CASE WHEN role = 'assistant' THEN role ELSE 'none' END AS insight, CASE WHEN role = 'assistant' THEN 'model' ELSE 'deterministic_fallback' END AS generated_by
FROM conversations""",
)
