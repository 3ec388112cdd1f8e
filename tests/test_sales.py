import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retailscope.operators import baskets, filters, kpi, sales
from retailscope.operators.filters import page


def orders_of(spark, rows):
    """rows: (order_id, customer, date, net)"""
    return spark.createDataFrame(
        [(o, c, dt.date.fromisoformat(d), Decimal(n)) for o, c, d, n in rows],
        "order_id bigint, customer_id string, order_date date, net_sales decimal(12,2)",
    )


def test_growth_skips_years_without_orders(spark):
    df = orders_of(spark, [(1, "a", "2020-05-01", "100.00"), (2, "a", "2022-05-01", "150.00"), (3, "b", "2023-01-01", "75.00")])
    got = [(r["year"], r["yoy_growth_pct"]) for r in sales.yearly_revenue(df).collect()]
    assert got == [(2020, None), (2022, 50.0), (2023, -50.0)]


def test_growth_over_a_year_without_revenue_is_null(spark):
    df = orders_of(spark, [(1, "a", "2020-05-01", "0.00"), (2, "a", "2021-05-01", "150.00")])
    assert sales.yearly_revenue(df).collect()[1]["yoy_growth_pct"] is None


def test_every_month_listed_has_orders(star):
    assert all(r["order_count"] > 0 for r in sales.monthly_revenue(star.orders(True), region="ASIA").collect())


def test_return_rate_of_nothing_is_null(star):
    row = sales.return_rate(star.orders(), date_from="2050-01-01").first()
    assert tuple(row) == (0, 0, None)


def test_values_outside_a_vocabulary_are_refused():
    with pytest.raises(ValueError):
        filters.checked(region="Narnia")
    assert filters.checked(region=None, order_status="Pending") == {"region": None, "order_status": "Pending"}


def test_discount_bands_and_their_edges(spark):
    cases = [
        ("0.00", "100.00", "0% (no discount)"),
        ("0.00", "0.00", "0% (no discount)"),
        ("5.00", "0.00", "30%+"),
        ("10.00", "100.00", "1-10%"),
        ("10.01", "100.00", "11-20%"),
        ("20.00", "100.00", "11-20%"),
        ("30.00", "100.00", "21-30%"),
        ("30.01", "100.00", "30%+"),
        (None, "100.00", "30%+"),
        ("1.00", None, "30%+"),
    ]
    df = spark.createDataFrame([(d, g) for d, g, _ in cases], "d string, g string").selectExpr("cast(d as decimal(12,2)) d", "cast(g as decimal(12,2)) g")
    got = [r[0] for r in df.select(sales.discount_band(F.col("d"), F.col("g"))).collect()]
    assert got == [label for _, _, label in cases]


def acquisition(spark):
    rows = [
        (1, "a", "2021-01-01", None, "10.00"),
        (2, "a", "2021-02-01", "Direct", "20.00"),
        (3, "a", "2021-02-01", "Referral", "30.00"),
        (4, "b", "2022-01-01", "Referral", "40.00"),
        (5, "c", "2022-01-01", None, "50.00"),
    ]
    return spark.createDataFrame(
        [(o, c, dt.date.fromisoformat(d), m, Decimal(n)) for o, c, d, m, n in rows],
        "order_id bigint, customer_id string, order_date date, marketing_channel string, net_sales decimal(12,2)",
    )


def test_acquisition_uses_the_first_order_with_a_channel(spark):
    customers = spark.sql("SELECT * FROM VALUES ('a', 5.00), ('b', 0.00), ('c', 9.00) AS t(customer_id, customer_acquisition_cost)")
    got = {r["marketing_channel"]: r for r in sales.channel_roi(acquisition(spark), customers).collect()}
    assert got["Direct"]["lifetime_revenue"] == 60.0 and got["Direct"]["revenue_per_acquisition_dollar"] == 12.0
    assert got["Referral"]["customers_acquired"] == 1 and got["Referral"]["revenue_per_acquisition_dollar"] is None
    assert set(got) == {"Direct", "Referral"}


def test_acquisition_range_limits_revenue_not_attribution(spark):
    customers = spark.sql("SELECT * FROM VALUES ('a', 5.00), ('b', 2.00), ('c', 9.00) AS t(customer_id, customer_acquisition_cost)")
    got = [tuple(r) for r in sales.channel_roi(acquisition(spark), customers, date_from="2021-02-01", date_to="2021-12-31").collect()]
    assert got == [("Direct", 1, 50.0, 5.0, 10.0)]


def test_order_without_items_counts_nowhere(spark):
    items = spark.sql("SELECT 1L AS order_id, 7L AS product_id UNION ALL SELECT 1L, 7L UNION ALL SELECT 2L, 8L")
    products = spark.sql("SELECT 7L AS product_id, 'A' AS product_category UNION ALL SELECT 8L, 'A'")
    orders = spark.sql("SELECT * FROM VALUES (1L, 'Returned'), (2L, NULL), (3L, 'Returned') AS t(order_id, return_status)")
    row = sales.return_rate_by_category(items, products, orders).first()
    assert tuple(row) == ("A", 2, 1, 50.0)


def test_top_rows_break_ties_by_key(spark):
    df = spark.sql("SELECT id AS k, 1.0D AS v FROM range(100)").repartition(9)
    assert [r["k"] for r in filters.top(df, "v", "k", 3).collect()] == [0, 1, 2]


def paged(spark):
    return spark.sql("SELECT id AS k, if(id % 7 = 0, null, id % 5) AS v FROM range(53)").repartition(6)


def expected_order(descending):
    data = [(k, None if k % 7 == 0 else k % 5) for k in range(53)]
    if descending:
        return sorted(data, key=lambda t: (t[1] is not None, -(t[1] or 0), t[0]))
    return sorted(data, key=lambda t: (t[1] is None, t[1] or 0, t[0]))


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("threshold", ["1000", "1"])
def test_pages_partition_the_rows(spark, direction, threshold):
    spark.conf.set("spark.sql.execution.topKSortFallbackThreshold", threshold)
    seen = []
    for number in (1, 2, 3, 4):
        got = page(paged(spark), "k", "v", direction, number, 15).collect()
        assert all((r["total"], r["pages"]) == (53, 4) for r in got)
        seen += [(r["k"], r["v"]) for r in got]
    spark.conf.unset("spark.sql.execution.topKSortFallbackThreshold")
    assert seen == expected_order(direction == "desc")


def test_page_arguments_are_checked(spark):
    for bad in ({"page_number": 0}, {"page_size": 101}, {"sort_dir": "up"}, {"sortable": ("k",)}):
        with pytest.raises(ValueError):
            page(paged(spark), "k", "v", **bad)


def test_shares_add_up(star):
    got = kpi.kpi_by(star.orders(), "payment_method").agg(F.sum("order_share_pct"), F.sum("revenue_share_pct")).first()
    assert abs(got[0] - 100) < 0.05 and abs(got[1] - 100) < 0.05


def brute_pairs(baskets_by_order, min_support, limit):
    counts = {}
    for products in baskets_by_order.values():
        ordered = sorted(set(products))
        for i, a in enumerate(ordered):
            for b in ordered[i + 1 :]:
                counts[a, b] = counts.get((a, b), 0) + 1
    kept = sorted(((-n, a, b) for (a, b), n in counts.items() if n >= min_support))[:limit]
    return [(a, b, -n) for n, a, b in kept]


@pytest.mark.parametrize("limit", [3, 40])
@pytest.mark.parametrize("block", [5, 1000])
def test_pairs_with_large_baskets(spark, limit, block):
    import random

    rng = random.Random(5)
    contents = {o: [rng.randrange(12) for _ in range(rng.randrange(1, 4))] for o in range(40)}
    contents.update({o: [rng.randrange(40) for _ in range(30)] for o in range(40, 43)})
    items = spark.createDataFrame([(o, p) for o, ps in contents.items() for p in ps], "order_id bigint, product_id bigint")
    orders = items.select("order_id").distinct()
    got = baskets.cross_sell_pairs(items, orders, 2, limit, block=block).collect()
    assert [(r[0], r[1], r[2]) for r in got] == brute_pairs(contents, 2, limit)


def test_tasks_of_pairs_grow_in_number(spark, monkeypatch):
    """More pairs than a task holds make more tasks; products in very many orders are counted apart, with the same result."""
    bought = [(o, p) for o in range(60) for p in {0, 1, o % 7 + 2, o % 5 + 9}] + [(None, 0), (None, 1), (3, None), (3, 0)]
    items = spark.createDataFrame(bought, "order_id long, product_id long")
    orders = spark.range(60).withColumnRenamed("id", "order_id")
    plain = [tuple(r) for r in baskets.cross_sell_pairs(items, orders).collect()]
    assert plain[0][:3] == (0, 1, 60)
    monkeypatch.setattr(baskets, "ROWS", 20)
    monkeypatch.setattr(baskets, "HOT", 12)
    assert [tuple(r) for r in baskets.cross_sell_pairs(items, orders).collect()] == plain
    rows = items.where("order_id is not null and product_id is not null").distinct().withColumns({"size": F.lit(4), "hot": F.lit(False)})
    assert baskets._tasks(rows.agg(F.sum((F.col("size") - 1) / 2))) >= 18
