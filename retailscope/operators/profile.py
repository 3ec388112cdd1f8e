"""Data profiling: one aggregation pass per question, results in long form."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailscope.functions.numeric import count_where, money, money_mean, money_percent, percent, rows, rounded_ratio, sum_where
from retailscope.functions.ordered import exact_quantiles
from retailscope.operators import sales
from retailscope.operators.sales import mean_rating


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def table_shapes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    counts = [
        df.agg(rows().alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
        for name, df in tables.items()
    ]
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    return whole


def column_types(tables: Mapping[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    listed = [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(listed, "table string, column string, type string")


def melted(df: DataFrame, measures: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Aggregates of many columns in one pass, one output row per column: {column: {measure: aggregate}}."""
    flat = {f"{i}_{m}": agg for i, per in enumerate(measures.values()) for m, agg in per.items()}
    one = df.agg(*[agg.alias(name) for name, agg in flat.items()])
    cells = [
        F.struct(F.lit(column).alias("column"), *[F.col(f"{i}_{m}").alias(m) for m in per])
        for i, (column, per) in enumerate(measures.items())
    ]
    return one.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def describe(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """count, mean, standard deviation, minimum, exact quartiles and maximum per column."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    moments = melted(
        doubles,
        {
            c: {
                "count": F.count(c),
                "mean": F.round(F.avg(c), digits),
                "std": F.round(F.stddev_samp(c), digits),
                "min": F.min(c),
                "max": F.max(c),
            }
            for c in columns
        },
    )
    told = exact_quantiles(doubles, columns, [0.25, 0.5, 0.75])
    named = df.sparkSession.createDataFrame([(c, *q) for c, q in told.items()], "column string, p25 double, p50 double, p75 double")
    return moments.join(F.broadcast(named.select("column", *[F.round(n, digits).alias(n) for n in ("p25", "p50", "p75")])), "column", "left")  # one row per described column


def box_plot(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, fences at 1.5 interquartile ranges, and the rows outside them."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    q = exact_quantiles(values, ["v"], [0.25, 0.5, 0.75])["v"]
    low, high = (None, None) if q[0] is None else (q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0]))
    told = {"q1": q[0], "q2": q[1], "q3": q[2], "lower_fence": low, "upper_fence": high}
    return values.agg(
        *[F.round(F.lit(v).cast("double"), 6).alias(n) for n, v in told.items()],
        count_where(F.col("v") < F.lit(low)).alias("below"),
        count_where(F.col("v") > F.lit(high)).alias("above"),
    )


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column. Values are made distinct per column before they are counted."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    distinct = df.select(F.explode(cells).alias("cell")).select("cell.*").groupBy("column", "value").agg(rows().alias("n"))
    return distinct.groupBy("column").agg(F.count("value").alias("distinct_values"))


def null_fractions(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Share of NULLs for the columns that have any."""
    names = list(columns or df.columns)
    audit = melted(df, {c: {"nulls": count_where(F.col(c).isNull()), "rows": rows()} for c in names})
    fraction = rounded_ratio(F.col("nulls"), F.col("rows"), digits)
    return audit.where("nulls > 0").select("column", "nulls", fraction.alias("null_fraction"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return melted(df, {c: {"nulls": count_where(F.col(c).isNull())} for c in columns})


def null_together(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether two columns are NULL in exactly the same rows."""
    same = F.col(a).isNull() == F.col(b).isNull()
    return df.agg(F.bool_and(same).alias("same_rows"), count_where(~same).alias("differing"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, NULL included."""
    return df.groupBy(column).agg(rows().alias("n"))


def flag_agreement(orders: DataFrame) -> DataFrame:
    """Returned by status against returned by flag."""
    by_status, by_flag = F.col("order_status") == "Returned", F.col("return_status").isNotNull()
    return orders.agg(
        count_where(by_status).alias("by_status"),
        count_where(by_flag).alias("by_flag"),
        count_where(by_status != by_flag).alias("disagreeing"),
    )


def duplicate_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key value."""
    per_key = df.groupBy(*key).agg(rows().alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        rows().alias("keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def date_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"), rows().alias("rows"))


def orders_per_year(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.year("order_date").alias("year")).agg(rows().alias("orders"))


def outliers(orders: DataFrame) -> DataFrame:
    late = F.col("delivery_days") - F.col("estimated_delivery_days")
    return orders.agg(
        count_where(F.col("profit_margin_percentage") < 0).alias("negative_margins"),
        count_where(F.col("delivery_days") < 0).alias("negative_delivery_days"),
        count_where(late > 10).alias("more_than_10_days_late"),
    )


def core_kpis(orders: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ten company metrics. The discount percentage is the mean of the orders' own ratios."""
    share = F.col("discount_amount").cast("double") / F.nullif(F.col("gross_sales").cast("double"), F.lit(0.0))
    rated = ratings.agg(F.struct(F.sum("rating").alias("total"), F.count("rating").alias("n"))).scalar()
    sums = orders.agg(
        rows().alias("total_orders"),
        F.sum("net_sales").alias("net"),
        F.sum("profit").alias("gain"),
        F.sum("quantity").alias("total_quantity"),
        F.round(F.avg(share) * 100, 6).alias("avg_discount_pct"),
        count_where(F.col("order_status") == "Returned").alias("back"),
        count_where(F.col("order_status") == "Cancelled").alias("gone"),
    ).withColumn("rated", rated)
    return sums.select(
        money(F.col("net")).alias("total_revenue"),
        "total_orders",
        "total_quantity",
        money_mean(F.col("net"), F.col("total_orders")).alias("avg_order_value"),
        "avg_discount_pct",
        money(F.col("gain")).alias("total_profit"),
        money_percent(F.col("gain"), F.col("net")).alias("profit_margin_pct"),
        percent(F.col("back"), F.col("total_orders")).alias("return_rate_pct"),
        percent(F.col("gone"), F.col("total_orders")).alias("cancellation_rate_pct"),
        mean_rating(F.col("rated.total"), F.col("rated.n")).alias("avg_rating"),
    )


def correlations(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson matrix in one pass, in long form; a pair uses the rows where both are present."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    measured = melted(doubles, {f"{a}|{b}": {"r": F.corr(a, b)} for a, b in pairs})
    parts = F.split("column", r"\|")
    long = measured.select(parts[0].alias("a"), parts[1].alias("b"), F.round("r", digits).alias("correlation"))
    mirrored = long.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "correlation")
    return long.unionByName(mirrored)


def revenue_by(df: DataFrame, *dims: str | Column) -> DataFrame:
    return df.groupBy(*dims).agg(money(F.sum("net_sales")).alias("revenue"))


def concentration(orders: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """How much of item revenue the top products and of order revenue the top customers hold."""

    def measure(df: DataFrame, key: str, label: str) -> DataFrame:
        per_key = df.groupBy(key).agg(F.sum("net_sales").alias("net"))
        top = sales.top(per_key, "net", key, n).agg(F.sum("net")).scalar()
        whole = per_key.agg(rows().alias("members"), F.sum("net").alias("net")).withColumn("top", top)
        return whole.select(F.lit(label).alias("of"), "members", money_percent(F.col("top"), F.col("net"), 4).alias("top_share_pct"))

    return measure(items, "product_id", "products").unionByName(measure(orders, "customer_id", "customers"))


def first_item_category(items: DataFrame, products: DataFrame, item_order: Sequence[str]) -> DataFrame:
    """Category of the first item of each order. `min_by` keeps one candidate per order and task."""
    first = items.groupBy("order_id").agg(F.min_by("product_id", F.struct(*item_order)).alias("product_id"))
    return first.join(products.select("product_id", "product_category"), "product_id").select("order_id", "product_category")


def first_item_rates(
    items: DataFrame, products: DataFrame, orders: DataFrame, ratings: DataFrame, item_order: Sequence[str]
) -> DataFrame:
    """Return rate and mean rating by the category of the order's first item."""
    first = first_item_category(items, products, item_order)
    joined = (
        orders.select("order_id", "order_status")
        .join(first, "order_id")
        .join(ratings.select("order_id", "rating"), "order_id", "left")
    )
    sums = joined.groupBy("product_category").agg(
        rows().alias("orders"),
        count_where(F.col("order_status") == "Returned").alias("back"),
        F.sum("rating").alias("total"),
        F.count("rating").alias("rated"),
    )
    return sums.select(
        "product_category",
        "orders",
        rounded_ratio(F.col("total") * 10, F.col("rated") * 10, 6).alias("avg_rating"),
        percent(F.col("back"), F.col("orders"), 6).alias("return_rate_pct"),
    )


def value_at_risk(orders: DataFrame) -> DataFrame:
    """Revenue in returned and cancelled orders, and profit booked on returns that nobody reversed."""
    back, gone = F.col("order_status") == "Returned", F.col("order_status") == "Cancelled"
    sums = orders.agg(
        rows().alias("n"),
        F.sum("net_sales").alias("net"),
        count_where(back | gone).alias("bad_orders"),
        sum_where(back | gone, F.col("net_sales")).alias("bad"),
        sum_where(back, F.col("net_sales")).alias("returned"),
        sum_where(gone, F.col("net_sales")).alias("cancelled"),
        sum_where(back, F.col("profit")).alias("unreversed"),
    )
    return sums.select(
        "bad_orders",
        percent(F.col("bad_orders"), F.col("n")).alias("bad_order_pct"),
        money(F.col("bad")).alias("bad_revenue"),
        money_percent(F.col("bad"), F.col("net")).alias("bad_revenue_pct"),
        money(F.col("returned")).alias("returned_revenue"),
        money(F.col("cancelled")).alias("cancelled_revenue"),
        money(F.col("unreversed")).alias("unreversed_profit"),
    )


def gross_vs_net(orders: DataFrame) -> DataFrame:
    sums = orders.agg(F.sum("gross_sales").alias("gross"), F.sum("net_sales").alias("net"))
    return sums.select(
        money(F.col("gross")).alias("gross_sales"),
        money(F.col("net")).alias("net_sales"),
        money_percent(F.col("gross") - F.col("net"), F.col("net")).alias("overstated_pct"),
    )


def catalog_checks(products: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Products per category, and whether each wanted category exists."""
    counted = products.groupBy("product_category").agg(rows().alias("products"))
    asked = products.sparkSession.createDataFrame([(w,) for w in wanted], "product_category string")
    return counted.join(asked.withColumn("wanted", F.lit(True)), "product_category", "full").select(
        "product_category", F.coalesce("products", F.lit(0)).cast("bigint").alias("products"), F.coalesce("wanted", F.lit(False)).alias("wanted")
    )
