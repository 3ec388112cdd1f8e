"""Row rules, key checks, reconciliation and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numeric import count_where, rows
from retailscope.schemas import VOCABULARIES, schema

Rules = Mapping[str, Column]  # rule name -> condition that a good row meets; NULL passes


def within(column: str, low=None, high=None) -> dict[str, Column]:
    value, rules = F.col(column), {}
    if low is not None:
        rules[f"{column} >= {low}"] = value >= F.lit(str(low)).cast("decimal(12,2)")
    if high is not None:
        rules[f"{column} <= {high}"] = value <= F.lit(str(high)).cast("decimal(12,2)")
    return rules


def positive(column: str) -> dict[str, Column]:
    return {f"{column} > 0": F.col(column) > 0}


def required(*columns: str) -> dict[str, Column]:
    return {f"{c} is present": F.col(c).isNotNull() for c in columns}


def allowed(*columns: str) -> dict[str, Column]:
    return {f"{c} is known": F.col(c).isin(*VOCABULARIES[c]) for c in columns}


def max_length(**limits: int) -> dict[str, Column]:
    return {f"{c} has at most {n} characters": F.length(c) <= n for c, n in limits.items()}


def not_empty(*columns: str) -> dict[str, Column]:
    return {f"{c} is not empty": F.length(c) >= 1 for c in columns}


def matches(column: str, pattern: str) -> dict[str, Column]:
    return {f"{column} matches {pattern}": F.col(column).rlike(pattern)}


def fits(column: str, precision: int, scale: int) -> dict[str, Column]:
    """A number (or its text) that the decimal type holds without rounding or overflow."""
    wide = F.expr(f"try_cast({column} as decimal(38,10))")
    narrow = F.expr(f"try_cast({column} as decimal({precision},{scale}))")
    return {f"{column} fits decimal({precision},{scale})": F.col(column).isNull() | F.coalesce(wide == narrow, F.lit(False))}


# Limits, lengths and patterns of the tables.
WAREHOUSE_PATTERN = r"^WH-\d{3}$"


def table_rules(table: str, columns: Sequence[str]) -> dict[str, Column]:
    """The rules of a star-schema table that apply to the columns at hand."""
    by_table: dict[str, list[dict[str, Column]]] = {
        "customers": [
            required("customer_id", "customer_name", "region"),
            not_empty("customer_id", "customer_name"),
            within("customer_age", 0, 120),
            within("customer_acquisition_cost", 0),
            allowed("gender", "customer_segment", "region"),
            max_length(customer_name=255, customer_city=128, customer_state=128, customer_country=128, customer_postal_code=32),
            fits("customer_acquisition_cost", 10, 2),
        ],
        "products": [
            required("product_id", "product_name", "product_category", "unit_price", "product_cost"),
            not_empty("product_name"),
            within("unit_price", 0),
            within("product_cost", 0),
            within("product_rating", 0, 5),
            allowed("product_category"),
            max_length(product_name=255, product_subcategory=128, brand=128, supplier=128),
        ],
        "orders": [
            required("order_id", "customer_id", "order_date", "order_status", "delivery_status", "quantity", "net_sales"),
            positive("quantity"),
            within("delivery_days", 0),
            within("estimated_delivery_days", 0),
            within("discount_amount", 0),
            within("tax_amount", 0),
            within("shipping_cost", 0),
            within("customer_lifetime_value", 0),
            within("loyalty_points_earned", 0),
            within("loyalty_points_redeemed", 0),
            within("customer_order_count", 1),
            allowed(
                "order_status",
                "delivery_status",
                "sales_channel",
                "customer_type",
                "region",
                "payment_method",
                "payment_status",
                "currency",
                "shipping_method",
                "marketing_channel",
            ),
            {"return_status is Returned": F.col("return_status") == "Returned"},
            matches("warehouse", WAREHOUSE_PATTERN),
            max_length(return_reason=255, campaign_name=128, coupon_code=64),
        ],
        "order_items": [
            required("order_id", "product_id", "quantity"),
            positive("quantity"),
            within("unit_price", 0),
        ],
        "ratings": [required("order_id", "customer_id", "rating"), within("rating", 1, 5), allowed("review_sentiment")],
        "score_requests": [
            required("customer_id", "gross_sales", "shipping_cost", "sales_channel", "payment_method", "shipping_method", "region"),
            positive("gross_sales"),
            within("shipping_cost", 0),
            allowed("sales_channel", "payment_method", "shipping_method", "region"),
        ],
    }
    have = set(columns)
    return {
        name: rule
        for group in by_table[table]
        for name, rule in group.items()
        if name.split()[0] in have
    }


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """`df` plus `violations`, the names of the rules each row breaks."""
    broken = [F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)


def violation_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows that break each rule, all rules in one pass."""
    one = df.agg(*[count_where(~F.coalesce(rule, F.lit(True))).alias(f"r{i}") for i, rule in enumerate(rules.values())])
    cells = [F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("broken")) for i, name in enumerate(rules)]
    return one.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*key).agg(rows().alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Child rows whose key has no parent."""
    return child.join(parent.select(on), on, "left_anti")


def join_report(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """What a validated many-to-one (or one-to-one) left join checks, in one row."""
    counts = right.groupBy(on).agg(rows().alias("right_rows"))
    sizes = left.groupBy(on).agg(rows().alias("left_rows"))
    both = sizes.join(counts, on, "full")
    return both.agg(
        F.coalesce(F.sum("left_rows"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum(F.when(F.col("right_rows").isNull(), F.col("left_rows"))), F.lit(0)).alias("unmatched_left_rows"),
        count_where(F.col("right_rows") > 1).alias("duplicate_right_keys"),
        count_where(F.col("left_rows") > 1).alias("repeated_left_keys"),
    )


def join_validated(left: DataFrame, right: DataFrame, on: str, one_to_one: bool = False, complete: bool = True) -> DataFrame:
    """Left join that raises when the right key repeats (or either does), or a left row has no match."""
    found = join_report(left, right, on).first()
    if found["duplicate_right_keys"] or (one_to_one and found["repeated_left_keys"]):
        raise ValueError(f"join on {on} is not {'one-to-one' if one_to_one else 'many-to-one'}: {found.asDict()}")
    if complete and found["unmatched_left_rows"]:
        raise ValueError(f"join on {on} leaves rows unmatched: {found.asDict()}")
    return left.join(right, on, "left")


def long_metrics(one_row: DataFrame, value: str) -> DataFrame:
    """A one-row table as (metric, value) rows."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(value)) for c in one_row.columns]
    return one_row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def reconcile(expected: DataFrame, actual: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Two one-row tables of the same metrics, side by side; OK within the tolerance."""
    paired = long_metrics(expected, "expected").join(F.broadcast(long_metrics(actual, "actual")), "metric", "left")
    # the difference is rounded well below the tolerance so that binary noise cannot fail a metric
    close = F.round(F.abs(F.col("expected") - F.col("actual")), 6) <= tolerance
    return paired.withColumn("status", F.when(close, "OK").otherwise("FAIL"))


def assertions(**checks: tuple[Column, object]) -> list[Column]:
    """Structs (name, expected, actual, ok) for `check_table`: name=(aggregate, expected value)."""
    return [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(expected).cast("double").alias("expected"),
            actual.cast("double").alias("actual"),
        ).alias(name)
        for name, (actual, expected) in checks.items()
    ]


def check_table(df: DataFrame, **checks: tuple[Column, object]) -> DataFrame:
    """Assertion rows over one aggregation of `df`."""
    cells = df.agg(*assertions(**checks)).select(F.explode(F.array(*checks)).alias("cell")).select("cell.*")
    return cells.withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def item_order_gap(orders: DataFrame, items: DataFrame, order_total: str = "net_sales") -> DataFrame:
    """Orders whose items sum to more than the order itself."""
    sums = items.groupBy("order_id").agg(F.sum("net_sales").alias("item_net"))
    joined = orders.select("order_id", F.col(order_total).alias("order_net")).join(sums, "order_id")
    return joined.agg(
        rows().alias("orders_with_items"),
        count_where(F.col("item_net") > F.col("order_net")).alias("items_above_order"),
        F.sum("item_net").cast("double").alias("item_revenue"),
        F.sum("order_net").cast("double").alias("order_revenue"),
    )


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table in schema order and type; absent ones become NULL."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields]
    )

