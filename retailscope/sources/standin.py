"""The star schema derived from a folder of order-system parquet tables.

Columns the folder lacks are integer arithmetic on keys, so any SQL engine derives the same values.
Every derived column is one SQL expression below; the tables are joins and groupings of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailscope.schemas import RETURN_REASONS, VOCABULARIES


def pick(key: str, values: Sequence[str]) -> str:
    """SQL that maps `key` 0, 1, 2 … to the values."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} {arms} END"


_MONEY = "decimal(12,2)"

# given on read, so that no job runs to infer them
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

CUSTOMER_COLUMNS = {
    "customer_id": "c_custkey",
    "customer_name": "c_name",
    "customer_segment": "c_mktsegment",
    "customer_country": "n_name",
    "customer_state": "concat(n_name, ' ', cast(c_custkey % 3 as varchar(3)))",
    "region": "r_name",
    "customer_acquisition_cost": "abs(cast(c_acctbal as decimal(12,2)))",
    "customer_age": "cast(18 + c_custkey % 57 as int)",
    "gender": pick("c_custkey % 3", ("Male", "Female", "Non-Binary")),
}

PRODUCT_COLUMNS = {
    "product_id": "p_partkey",
    "product_name": "p_name",
    "product_category": "p_type",
    "product_subcategory": "concat(p_type, ' ', cast(p_size % 8 as varchar(3)))",
    "brand": "p_brand",
    "unit_price": "cast(p_retailprice as decimal(12,2))",
    "product_cost": "cast(round(cast(p_retailprice as decimal(12,2)) * cast(0.55 as decimal(4,2)), 2) as decimal(12,2))",
    "product_rating": "cast((25 + p_partkey % 25) * 0.1 as decimal(3,2))",
}

# whole cents: integer arithmetic is exact and much cheaper than double -> decimal casts per row
ITEM_CENTS = {
    "order_id": "l_orderkey",
    "product_id": "l_partkey",
    "quantity": "cast(l_quantity as int)",
    "gross_c": "cast(floor(l_extendedprice * 100 + 0.5) as bigint)",
    "discount_c": "cast(floor((gross_c * cast(floor(l_discount * 100 + 0.5) as bigint) + 50) / 100) as bigint)",
    "cost_c": "cast(floor((gross_c * 55 + 50) / 100) as bigint)",
    "net_c": "gross_c - discount_c",
    "profit_c": "gross_c - discount_c - cost_c",
}
MONEY_FROM_CENTS = {
    "gross_sales": "gross_c",
    "discount_amount": "discount_c",
    "net_sales": "net_c",
    "product_cost": "cost_c",
    "profit": "profit_c",
}


def from_cents(cents: str) -> str:
    return f"cast(cast({cents} as decimal(12,0)) * cast(0.01 as decimal(2,2)) as {_MONEY})"


# order of the items of one order; with order_id it is unique
ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")

ORDER_COLUMNS = {
    "order_id": "o_orderkey",
    "customer_id": "o_custkey",
    "order_date": "cast(o_orderdate as date)",
    "sales_channel": pick("o_orderkey % 4", VOCABULARIES["sales_channel"]),
    "payment_method": pick("o_orderkey % 7", VOCABULARIES["payment_method"]),
    "shipping_method": pick("(o_orderkey + o_custkey) % 4", VOCABULARIES["shipping_method"]),
    "shipping_cost": f"cast(5 + o_orderkey % 37 as {_MONEY})",
    "marketing_channel": f"CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {pick('o_orderkey % 11 - 1', VOCABULARIES['marketing_channel'])} END",
    "coupon_code": "CASE WHEN o_orderkey % 5 = 0 THEN concat('SAVE', cast(12 + o_orderkey % 30 as varchar(3))) END",
    "campaign_name": "CASE WHEN o_orderkey % 5 < 3 THEN NULL WHEN o_orderkey % 5 = 3 THEN 'Default_Campaign'"
    " ELSE concat('Campaign_', cast(o_orderkey % 16 as varchar(3))) END",
    "customer_type": "CASE WHEN o_orderkey % 16 = 0 THEN 'New' WHEN o_orderkey % 16 = 1 THEN 'Returning' ELSE 'Loyal' END",
    "warehouse": "concat('WH-0', CASE WHEN o_orderkey % 19 < 9 THEN '0' ELSE '' END, cast(1 + o_orderkey % 19 as varchar(3)))",
    "loyalty_points_earned": "cast(o_orderkey % 200 as int)",
    "loyalty_points_redeemed": "cast(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 97 END as int)",
    "customer_order_count": "cast(1 + o_custkey % 19 as int)",
    "is_repeat_customer": "o_custkey % 19 > 0",
}
ORDER_SUMS = ("quantity", *MONEY_FROM_CENTS.values())
# in dependency order; `all_returned` says that every item of the order came back
ORDER_DERIVED = {
    "return_status": "CASE WHEN all_returned THEN 'Returned' END",
    "order_status": "CASE WHEN all_returned THEN 'Returned' WHEN o_orderstatus IN ('F', 'O') THEN 'Completed'"
    " WHEN order_id % 2 = 0 THEN 'Pending' ELSE 'Cancelled' END",
    "delivery_status": "CASE WHEN order_status <> 'Completed' THEN 'Cancelled' WHEN order_id % 10 = 0 THEN 'Early'"
    " WHEN order_id % 10 IN (1, 2) THEN 'Delayed' ELSE 'On Time' END",
    "delivery_days": "CASE WHEN order_status = 'Completed' THEN cast(1 + order_id % 11 as decimal(6,2)) END",
    "estimated_delivery_days": "CASE WHEN order_status = 'Completed' THEN cast(3 + order_id % 7 as decimal(6,2)) END",
    "return_reason": f"CASE WHEN return_status = 'Returned' THEN {pick('order_id % 8', tuple(RETURN_REASONS))} END",
    "profit_margin_percentage": "CASE WHEN net_sales <> 0 THEN cast(round(100 * profit / net_sales, 2) as decimal(6,2)) END",
}
RATING_COLUMNS = {
    "order_id": "order_id",
    "customer_id": "customer_id",
    "rating": "cast((10 + (order_id * 13) % 41) * 0.1 as decimal(3,1))",
    "review_sentiment": "CASE WHEN 10 + (order_id * 13) % 41 < 25 THEN 'Negative'"
    " WHEN 10 + (order_id * 13) % 41 < 35 THEN 'Neutral' ELSE 'Positive' END",
}


def columns(spec: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in spec.items()]


ITEM_MONEY = {name: from_cents(cents) for name, cents in MONEY_FROM_CENTS.items()}
ORDER_MONEY = {name: from_cents(f"coalesce({cents}, 0)") for name, cents in MONEY_FROM_CENTS.items()}
ORDER_MONEY = {"quantity": "cast(coalesce(items, 0) as bigint)", **ORDER_MONEY}


class Star:
    """Lazy star-schema tables over one folder. Unused columns and joins drop out of the plan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.schema(RAW[table]).parquet(f"{self.folder}/{table}.parquet")

    def customers(self) -> DataFrame:
        nations = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        joined = self.raw("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.selectExpr(*columns(CUSTOMER_COLUMNS))

    def products(self) -> DataFrame:
        return self.raw("part").selectExpr(*columns(PRODUCT_COLUMNS))

    def items(self, *extra: str) -> DataFrame:
        """Order items; `extra` names source columns to keep, such as those of ITEM_ORDER."""
        cents = self.raw("lineitem").selectExpr(*columns(ITEM_CENTS), *extra)
        return cents.selectExpr("order_id", "product_id", "quantity", *columns(ITEM_MONEY), *extra)

    def orders(self, with_region: bool = False) -> DataFrame:
        """Orders with their item sums (0 without items). The region comes from a join, so it is optional."""
        cents = self.raw("lineitem").selectExpr(*columns(ITEM_CENTS), "l_returnflag = 'R' AS returned")
        per_order = cents.groupBy("order_id").agg(
            F.expr("sum(quantity) AS items"),
            *[F.expr(f"sum({c}) AS {c}") for c in MONEY_FROM_CENTS.values()],
            F.expr("bool_and(returned) AS returned"),
        )
        # what is derived from an order's own columns comes after the joins, so that narrow rows are shuffled
        base = self.raw("orders")
        if with_region:
            base = base.join(self.customers().select(F.col("customer_id").alias("o_custkey"), "region"), "o_custkey")
        region = ["region"] if with_region else []
        orders = base.join(per_order.withColumnRenamed("order_id", "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left").selectExpr(
            *columns(ORDER_COLUMNS),
            *columns(ORDER_MONEY),
            "o_orderstatus",
            "coalesce(returned, false) AS all_returned",
            *region,
        )
        orders = orders.selectExpr(*ORDER_COLUMNS, *ORDER_MONEY, *columns(ORDER_DERIVED), *region)
        return orders.select("customer_id", *[c for c in orders.columns if c != "customer_id"]) if with_region else orders

    def ratings(self) -> DataFrame:
        return self.orders().where("order_status = 'Completed'").selectExpr(*columns(RATING_COLUMNS))
