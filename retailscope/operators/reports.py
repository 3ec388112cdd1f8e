"""Statistics, prompts and deterministic narratives of the business reports, one row per report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailscope.functions.numeric import count_where, money, money_mean, percent, rows
from retailscope.operators import sales
from retailscope.operators.filters import Date, apply_filters
from retailscope.operators.sales import RETURNED, mean_rating
from retailscope.operators.segments import SEGMENT_RULES
from retailscope.session import staged


def _ranked(df: DataFrame, by: str, key: str, n: int, fields: Sequence[str | Column], descending: bool = True) -> Column:
    """The first n rows of a report table as one array of structs (a scalar subquery)."""
    lead = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    cut = df.orderBy(lead, key if descending else F.desc(key)).limit(n)
    place = F.row_number().over(Window.orderBy(lead, key if descending else F.desc(key)))  # n rows
    packed = cut.select(F.struct(place.alias("place"), F.struct(*fields).alias("row")).alias("cell"))
    cells = F.array_sort(F.collect_list("cell"))
    return packed.agg(F.transform(cells, lambda c: c["row"])).scalar()


def orders_stats(
    orders: DataFrame, items: DataFrame, products: DataFrame, date_from: Date = None, date_to: Date = None
) -> DataFrame:
    """Totals, top three categories and regions with their share of order revenue, and the top channel.

    One pass over the orders fills a region x channel table; totals, regions and channels come from it.
    """
    kept = apply_filters(orders, date_from, date_to)
    cube = staged(
        kept.groupBy("region", "sales_channel").agg(
            rows().alias("orders"), F.sum("net_sales").alias("net"), count_where(F.expr(RETURNED)).alias("returned")
        ),
        "orders-report",
    )
    lines = sales.items_in_range(items, orders, date_from, date_to)
    categories = (
        sales.product_totals(lines)
        .join(products.select("product_id", "product_category"), "product_id")
        .groupBy("product_category")
        .agg(F.sum("revenue").alias("net"))
    )
    regions = cube.groupBy("region").agg(F.sum("net").alias("net"))
    channels = cube.groupBy("sales_channel").agg(F.sum("net").alias("net"))
    total = cube.agg(F.sum("net")).scalar()

    def shares(df: DataFrame, name: str) -> Column:
        ratio = F.coalesce(F.bround(100 * F.col("net").cast("double") / F.nullif(F.col("total").cast("double"), F.lit(0.0)), 2), F.lit(0.0))
        fields = [name, money(F.col("net")).alias("total_revenue"), ratio.alias("share_pct")]
        return _ranked(df.withColumn("total", total), "net", name, 3, fields)

    top_channel = _ranked(channels, "net", "sales_channel", 1, ["sales_channel", money(F.col("net")).alias("revenue")])
    sums = cube.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("order_count"),
        F.sum("net").alias("net"),
        F.coalesce(F.sum("returned"), F.lit(0)).alias("returned"),
    )
    zero = F.lit(0.0)
    return sums.withColumns(
        {"categories": shares(categories, "product_category"), "regions": shares(regions, "region"), "channel": top_channel}
    ).select(
        F.lit(date_from).cast("date").alias("date_from"),
        F.lit(date_to).cast("date").alias("date_to"),
        "order_count",
        F.coalesce(money(F.col("net")), zero).alias("total_revenue"),
        F.coalesce(money_mean(F.col("net"), F.col("order_count")), zero).alias("avg_order_value"),
        F.coalesce(percent(F.col("returned"), F.col("order_count")), zero).alias("return_rate_pct"),
        F.col("categories").alias("top_categories"),
        F.col("regions").alias("top_regions"),
        F.get("channel", F.lit(0))["sales_channel"].alias("top_channel"),
        F.get("channel", F.lit(0))["revenue"].alias("top_channel_revenue"),
    )


def ratings_stats(
    orders: DataFrame, items: DataFrame, products: DataFrame, ratings: DataFrame, date_from: Date = None, date_to: Date = None
) -> DataFrame:
    """Rating count, mean and histogram, the return rate, and the categories that come back most and least."""
    histogram = staged(
        sales.rated_orders(ratings, orders.select("order_id", "order_date"), date_from, date_to)
        .groupBy("rating")
        .agg(rows().alias("n")),
        "ratings-report",
    )
    cells = F.array_sort(F.collect_list(F.struct("rating", "n")))
    pairs = F.transform(cells, lambda c: F.struct(c["rating"].cast("string").alias("key"), c["n"].alias("value")))
    categories = staged(
        sales.return_rate_by_category(items, products, orders, date_from=date_from, date_to=date_to), "category-returns"
    )
    fields = ["product_category", "return_rate_pct"]
    overall = sales.return_rate(orders, date_from, date_to).select("return_rate_pct").scalar()
    sums = histogram.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_ratings"),
        F.sum(F.col("rating") * F.col("n")).alias("total"),
        F.map_from_entries(pairs).alias("rating_distribution"),
    )
    extremes = {
        "overall": overall,
        "highest": _ranked(categories, "return_rate_pct", "product_category", 3, fields),
        "lowest": _ranked(categories, "return_rate_pct", "product_category", 3, fields, descending=False),
    }
    return sums.withColumns(extremes).select(
        F.lit(date_from).cast("date").alias("date_from"),
        F.lit(date_to).cast("date").alias("date_to"),
        "total_ratings",
        F.coalesce(mean_rating(F.col("total"), F.col("total_ratings")), F.lit(0.0)).alias("avg_rating"),
        "rating_distribution",
        F.coalesce("overall", F.lit(0.0)).alias("overall_return_rate_pct"),
        F.col("highest").alias("highest_return_rate_categories"),
        F.col("lowest").alias("lowest_return_rate_categories"),
    )


def segments_stats(segments: DataFrame, summary: DataFrame) -> DataFrame:
    """As-of date, scored customers and the segment rows, most valuable first."""
    fields = ["segment", "customer_count", "total_monetary", "avg_recency_days", "avg_frequency"]
    packed = _ranked(summary, "total_monetary", "segment", len(SEGMENT_RULES) + 1, fields)
    newest = segments.agg(
        F.max("last_order_date").alias("as_of_date"), rows().alias("total_customers_scored")
    )
    return newest.withColumn("segments", packed)


# --- text ---------------------------------------------------------------------------------------


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def two_digits(value: Column) -> Column:
    return F.format_string("%.2f", value)


def plain(value: Column) -> Column:
    """Shortest decimal text of a double, as `21.39` or `31.0`."""
    return value.cast("string")


def text(template: str, **values: Column) -> Column:
    """`template` with each {name} replaced by a column."""
    parts, rest = [], template
    while rest:
        head, found, tail = rest.partition("{")
        parts.append(F.lit(head))
        if not found:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def pairs(cells: Column, *fields) -> Column:
    """An array of structs as `[('a', 'b'), …]`."""
    quoted = F.transform(
        cells, lambda c: F.concat(F.lit("("), F.concat_ws(", ", *[F.concat(F.lit("'"), f(c), F.lit("'")) for f in fields]), F.lit(")"))
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def first(cells: str, field: str) -> Column:
    return F.get(F.col(cells), F.lit(0))[field]


def _period() -> dict[str, Column]:
    return {
        "since": F.coalesce(F.col("date_from").cast("string"), F.lit("all time")),
        "until": F.coalesce(F.col("date_to").cast("string"), F.lit("all time")),
    }


# Text of the prompts and narratives.
ONLY_NUMBERS = "Use ONLY the numbers below - do not invent or estimate any figure not given here."
ORDERS_PROMPT = (
    "You are a retail analytics assistant. Write a business narrative for this e-commerce orders report. "
    + ONLY_NUMBERS
    + "\n\nPeriod: {since} to {until}\nTotal orders: {orders}\nTotal revenue: {revenue}\nAverage order value: {aov}\n"
    "Return rate: {rate}%\nTop categories by revenue: {categories}\nTop regions by revenue: {regions}\n"
    "Top sales channel: {channel} ({channel_revenue})"
)
RATINGS_PROMPT = (
    "You are a retail analytics assistant. Write a business narrative for this customer ratings & returns report. "
    + ONLY_NUMBERS
    + "\n\nPeriod: {since} to {until}\nTotal ratings collected: {ratings}\nAverage rating: {mean}/5\n"
    "Rating distribution: {histogram}\nOverall return rate: {rate}%\nHighest-return-rate categories: {highest}\n"
    "Lowest-return-rate categories: {lowest}"
)
SEGMENTS_PROMPT = (
    "You are a retail analytics assistant. Write a business narrative for this RFM (Recency/Frequency/Monetary) "
    "customer segmentation report. "
    + ONLY_NUMBERS
    + "\n\nAnalysis date: {as_of} (the most recent order date in the dataset)\nTotal customers scored: {customers}\n"
    "Segments: {segments}"
)
ORDERS_SUMMARY = "{orders} orders generated {revenue} in revenue (AOV {aov}) with a {rate}% return rate."
TOP_CATEGORY = "'{name}' is the top-revenue category"
TOP_REGION = "'{name}' is the top-revenue region"
OF_REVENUE = " at {share}% of total revenue."
TOP_CHANNEL = "'{name}' is the leading sales channel by revenue."
NO_CHANNEL = "No sales-channel data available for this period."
ORDERS_ADVICE = (
    "Investigate the {rate}% return rate for cost-reduction opportunities.",
    "Consider concentrating marketing spend toward '{region}' and '{category}', the current top performers.",
)
RATINGS_SUMMARY = "{ratings} ratings collected, averaging {mean}/5, against an overall return rate of {rate}%."
HIGHEST_RETURN = "'{name}' has the highest return rate at {rate}%."
LOWEST_RETURN = "'{name}' has the lowest return rate at {rate}%."
NO_RETURN_DATA = "No category return-rate data available."
RATINGS_ADVICE = "Review product quality/listing accuracy for '{name}'."
NO_RATINGS_ADVICE = "Collect more rating data before drawing category-level conclusions."
SEGMENTS_SUMMARY = "{customers} customers scored via RFM as of {as_of}, split across {count} segments."
TOP_SEGMENT = "'{name}' is the highest-value segment by total spend ({spend} across {count} customers)."
OTHER_SEGMENTS = "'{name}': {count} customers, avg recency {recency} days, avg frequency {frequency} orders."
NO_SEGMENTS = "No segment data available."
SEGMENTS_ADVICE = (
    "Prioritize retention offers for the 'At Risk' segment before they lapse into 'Lost'.",
    "Target the 'New' segment with onboarding/second-purchase incentives.",
)


def _share_text(c: Column) -> Column:
    return F.concat(dollars(c["total_revenue"]), F.lit(" ("), plain(c["share_pct"]), F.lit("%)"))


def orders_prompt(stats: DataFrame) -> DataFrame:
    """The numbers-only prompt. Without a channel its revenue reads N/A."""
    prompt = text(
        ORDERS_PROMPT,
        **_period(),
        orders=thousands(F.col("order_count")),
        revenue=dollars(F.col("total_revenue")),
        aov=dollars(F.col("avg_order_value")),
        rate=two_digits(F.col("return_rate_pct")),
        categories=pairs(F.col("top_categories"), lambda c: c["product_category"], _share_text),
        regions=pairs(F.col("top_regions"), lambda c: c["region"], _share_text),
        channel=F.coalesce("top_channel", F.lit("None")),
        channel_revenue=F.coalesce(dollars(F.col("top_channel_revenue")), F.lit("N/A")),
    )
    return stats.select(prompt.alias("prompt"))


def orders_narrative(stats: DataFrame) -> DataFrame:
    category = F.coalesce(first("top_categories", "product_category"), F.lit("N/A"))
    region = F.coalesce(first("top_regions", "region"), F.lit("N/A"))
    rate = two_digits(F.col("return_rate_pct"))

    def leader(template: str, name: Column, cells: str) -> Column:
        share = text(OF_REVENUE, share=plain(first(cells, "share_pct")))
        return F.concat(text(template, name=name), F.coalesce(share, F.lit(".")))

    return stats.select(
        text(
            ORDERS_SUMMARY,
            orders=thousands(F.col("order_count")),
            revenue=dollars(F.col("total_revenue")),
            aov=dollars(F.col("avg_order_value")),
            rate=rate,
        ).alias("summary"),
        F.array(
            leader(TOP_CATEGORY, category, "top_categories"),
            leader(TOP_REGION, region, "top_regions"),
            F.coalesce(text(TOP_CHANNEL, name=F.col("top_channel")), F.lit(NO_CHANNEL)),
        ).alias("key_insights"),
        F.array(text(ORDERS_ADVICE[0], rate=rate), text(ORDERS_ADVICE[1], region=region, category=category)).alias(
            "recommendations"
        ),
    )


def ratings_prompt(stats: DataFrame) -> DataFrame:
    counts = F.transform(
        F.map_entries("rating_distribution"), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string"))
    )

    def rates(cells: str) -> Column:
        return pairs(F.col(cells), lambda c: c["product_category"], lambda c: F.concat(two_digits(c["return_rate_pct"]), F.lit("%")))

    prompt = text(
        RATINGS_PROMPT,
        **_period(),
        ratings=thousands(F.col("total_ratings")),
        mean=two_digits(F.col("avg_rating")),
        histogram=F.concat(F.lit("{"), F.array_join(counts, ", "), F.lit("}")),
        rate=two_digits(F.col("overall_return_rate_pct")),
        highest=rates("highest_return_rate_categories"),
        lowest=rates("lowest_return_rate_categories"),
    )
    return stats.select(prompt.alias("prompt"))


def ratings_narrative(stats: DataFrame) -> DataFrame:
    def line(template: str, cells: str) -> Column:
        built = text(template, name=first(cells, "product_category"), rate=two_digits(first(cells, "return_rate_pct")))
        return F.coalesce(built, F.lit(NO_RETURN_DATA))

    high, low = "highest_return_rate_categories", "lowest_return_rate_categories"
    return stats.select(
        text(
            RATINGS_SUMMARY,
            ratings=thousands(F.col("total_ratings")),
            mean=two_digits(F.col("avg_rating")),
            rate=two_digits(F.col("overall_return_rate_pct")),
        ).alias("summary"),
        F.array(line(HIGHEST_RETURN, high), line(LOWEST_RETURN, low)).alias("key_insights"),
        F.array(F.coalesce(text(RATINGS_ADVICE, name=first(high, "product_category")), F.lit(NO_RATINGS_ADVICE))).alias(
            "recommendations"
        ),
    )


def segments_prompt(stats: DataFrame) -> DataFrame:
    cells = pairs(
        F.col("segments"),
        lambda c: c["segment"],
        lambda c: F.concat(c["customer_count"].cast("string"), F.lit(" customers")),
        lambda c: F.concat(dollars(c["total_monetary"]), F.lit(" total spend")),
        lambda c: F.concat(F.lit("avg recency "), plain(c["avg_recency_days"]), F.lit("d")),
        lambda c: F.concat(F.lit("avg frequency "), plain(c["avg_frequency"])),
    )
    prompt = text(
        SEGMENTS_PROMPT,
        as_of=F.col("as_of_date").cast("string"),
        customers=thousands(F.col("total_customers_scored")),
        segments=cells,
    )
    return stats.select(prompt.alias("prompt"))


def segments_narrative(stats: DataFrame) -> DataFrame:
    lead = F.coalesce(
        text(
            TOP_SEGMENT,
            name=first("segments", "segment"),
            spend=dollars(first("segments", "total_monetary")),
            count=first("segments", "customer_count").cast("string"),
        ),
        F.lit(NO_SEGMENTS),
    )
    others = F.transform(
        F.slice("segments", 2, 3),
        lambda c: text(
            OTHER_SEGMENTS,
            name=c["segment"],
            count=c["customer_count"].cast("string"),
            recency=plain(c["avg_recency_days"]),
            frequency=plain(c["avg_frequency"]),
        ),
    )
    return stats.select(
        text(
            SEGMENTS_SUMMARY,
            customers=thousands(F.col("total_customers_scored")),
            as_of=F.col("as_of_date").cast("string"),
            count=F.size("segments").cast("string"),
        ).alias("summary"),
        F.concat(F.array(lead), F.coalesce(others, F.array().cast("array<string>"))).alias("key_insights"),
        F.array(*[F.lit(a) for a in SEGMENTS_ADVICE]).alias("recommendations"),
    )


# --- model replies --------------------------------------------------------------------------------


def parsed_replies(replies: DataFrame, fallback: DataFrame, key: str = "report") -> DataFrame:
    """Narratives from raw model replies: the outermost {...} block if it has the three fields with
    the right types, else the report's deterministic narrative. A missing reply falls back too."""
    block = F.try_parse_json(F.nullif(F.regexp_extract("reply", r"(?s)\{.*\}", 0), F.lit("")))
    read = replies.select(key, block.alias("v"))

    def typed(path: str, allowed: Sequence[str], as_type: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("v", f"$.{path}", "variant"))
        return F.when(kind.isin(*allowed), F.try_variant_get("v", f"$.{path}", as_type))

    lists = ("ARRAY<STRING>", "ARRAY<VOID>")
    fields = {
        "summary": typed("summary", ("STRING",), "string"),
        "key_insights": typed("key_insights", lists, "array<string>"),
        "recommendations": typed("recommendations", lists, "array<string>"),
    }
    model = read.select(key, *[c.alias(f"model_{n}") for n, c in fields.items()])
    usable = F.col("model_summary").isNotNull() & F.col("model_key_insights").isNotNull() & F.col("model_recommendations").isNotNull()
    joined = fallback.join(model, key, "left")
    return joined.select(
        key,
        *[F.when(usable, F.col(f"model_{n}")).otherwise(F.col(n)).alias(n) for n in fields],
        F.when(usable, "model").otherwise("deterministic_fallback").alias("generated_by"),
    )
