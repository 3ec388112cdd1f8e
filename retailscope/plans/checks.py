"""SQL text shared by the check queries: the star schema as CTEs, and exact rounding."""

from __future__ import annotations

from retailscope.sources import standin as s


def _cols(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


_ITEMS = f"""
s_cents AS (SELECT {_cols(s.ITEM_CENTS)}, l_returnflag, {', '.join(s.ITEM_ORDER)} FROM lineitem),
s_items AS (SELECT *, {_cols(s.ITEM_MONEY)} FROM s_cents)"""

_CUSTOMERS = f"""
s_customers AS (SELECT {_cols(s.CUSTOMER_COLUMNS)},
  cast(abs(cast(c_acctbal as decimal(12,2))) * 100 as bigint) AS cac_c
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_PRODUCTS = f"""
s_products AS (SELECT {_cols(s.PRODUCT_COLUMNS)}, cast(cast(p_retailprice as decimal(12,2)) * 100 as bigint) AS price_c FROM part)"""


def _orders() -> str:
    sums = ", ".join(f"cast(sum({c}) as bigint) AS {c}" for c in s.MONEY_FROM_CENTS.values())
    text = f"""
s_sums AS (SELECT order_id, sum(quantity) AS items, {sums}, bool_and(l_returnflag = 'R') AS all_returned
  FROM s_cents GROUP BY order_id),
s_orders0 AS (SELECT {_cols(s.ORDER_COLUMNS)}, o_orderstatus FROM orders),
s_orders1 AS (SELECT o.*, {_cols(s.ORDER_MONEY)}, coalesce(i.all_returned, false) AS all_returned
  FROM s_orders0 o LEFT JOIN s_sums i ON i.order_id = o.order_id)"""
    level = 1
    for name, sql in s.ORDER_DERIVED.items():
        if name == "profit_margin_percentage":  # exact, DuckDB divides decimals in double
            sql = (
                "CASE WHEN net_sales <> 0 THEN cast(sign(profit) * ((2 * 10000 * abs(cast(profit * 100 as hugeint))"
                " + abs(cast(net_sales * 100 as hugeint))) // (2 * abs(cast(net_sales * 100 as hugeint)))) * 0.01 as decimal(6,2)) END"
            )
        text += f",\ns_orders{level + 1} AS (SELECT *, {sql} AS {name} FROM s_orders{level})"
        level += 1
    text += f""",
s_orders AS (SELECT o.*, c.region, cast(net_sales * 100 as bigint) AS net_c, cast(profit * 100 as bigint) AS profit_c,
  cast(gross_sales * 100 as bigint) AS gross_c, cast(discount_amount * 100 as bigint) AS disc_c,
  cast(shipping_cost * 100 as bigint) AS ship_c
  FROM s_orders{level} o JOIN s_customers c ON c.customer_id = o.customer_id)"""
    return text


_RATINGS = f"""
s_ratings AS (SELECT {_cols(s.RATING_COLUMNS)}, 10 + (order_id * 13) % 41 AS tenths FROM s_orders WHERE order_status = 'Completed')"""


def star(body: str, extra: str = "") -> str:
    """`body` with the star tables (and `extra` CTEs) in front of it."""
    ctes = [_ITEMS, _CUSTOMERS, _PRODUCTS, _orders(), _RATINGS] + ([extra] if extra else [])
    return "WITH " + ",".join(ctes) + "\n" + body


def ratio(num: str, den: str, digits: int = 2) -> str:
    """round(num / den, digits) of whole numbers, half away from zero, NULL when den is 0."""
    k = 10**digits
    return (
        f"(sign({num}) * ((2 * {k} * abs(cast({num} as hugeint)) + cast({den} as hugeint))"
        f" // nullif(2 * cast({den} as hugeint), 0)))::double / {k}e0"
    )


def pct(num: str, den: str, digits: int = 2) -> str:
    return ratio(f"(100 * ({num}))", f"({den})", digits)


def mean(sum_cents: str, count: str, digits: int = 2) -> str:
    return ratio(f"({sum_cents})", f"(100 * ({count}))", digits)


def dollars(cents: str) -> str:
    return f"(({cents})::double / 100e0)"
