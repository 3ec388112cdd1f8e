import pytest

from retailscope.operators import maintenance, profile, quality
from retailscope.sources import csv, documents, publish, sample


def customers(spark):
    return spark.sql("SELECT * FROM VALUES ('C1', 'Ann', 30), ('C2', 'Bob', 40), ('C3', 'Cid', 50) AS t(customer_id, customer_name, customer_age)")


def test_rules_name_what_is_broken(spark):
    df = spark.sql(
        """SELECT * FROM VALUES ('C1', 'Ann', 'South', 30, 'Male'), (NULL, 'Bob', 'South', 30, 'Male'), ('C3', '', NULL, 130, 'Robot'), ('C4', 'Dee', 'Mars', -1, NULL)
        AS t(customer_id, customer_name, region, customer_age, gender)"""
    )
    checked = quality.violations(df, quality.table_rules("customers", df.columns))
    got = {r["customer_name"]: r["violations"] for r in checked.collect()}
    assert got["Ann"] == []
    assert got["Bob"] == ["customer_id is present"]
    assert set(got[""]) == {"region is present", "customer_name is not empty", "customer_age <= 120", "gender is known"}
    assert set(got["Dee"]) == {"region is known", "customer_age >= 0"}
    assert quality.accepted(checked).count() == 1 and quality.rejected(checked).count() == 3


def test_decimal_fit_and_patterns(spark):
    df = spark.createDataFrame([("1.25", "WH-001"), ("1.255", "WH-1"), ("99999999999", None), ("abc", "WH-0011"), (None, "WH-999")], "x string, warehouse string")
    rules = {**quality.fits("x", 6, 2), **quality.matches("warehouse", quality.WAREHOUSE_PATTERN)}
    got = [(r["x"], len(r["violations"])) for r in quality.violations(df, rules).collect()]
    assert got == [("1.25", 0), ("1.255", 2), ("99999999999", 1), ("abc", 2), (None, 0)]


def test_insert_refuses_duplicates_and_missing_parents(spark):
    table = spark.sql("SELECT 'O1' AS order_id, 'C1' AS customer_id, 'EUR' AS currency")
    batch = spark.sql(
        """SELECT * FROM VALUES ('O1', 'C1', 'USD'), ('O2', 'C1', NULL), ('O3', 'C9', NULL), ('O4', 'C2', 'GBP'), ('O5', 'C1', NULL), ('O5', 'C1', NULL)
        AS t(order_id, customer_id, currency)"""
    )
    change = maintenance.insert_batch(table, batch, "order_id", {"customer_id": customers(spark)}, maintenance.DEFAULTS["orders"])
    assert sorted(tuple(r) for r in change.table.collect()) == [("O1", "C1", "EUR"), ("O2", "C1", "USD"), ("O4", "C2", "GBP")]
    assert sorted((r["order_id"], r["reason"]) for r in change.refused.collect()) == [
        ("O1", "duplicate key"),
        ("O3", "no such customer_id"),
        ("O5", "duplicate key"),
        ("O5", "duplicate key"),
    ]


def test_patch_tells_null_from_unset(spark):
    patches = spark.sql(
        """SELECT * FROM VALUES ('C1', array('customer_age'), 'ignored', NULL), ('C2', array('customer_name'), 'Rob', 99), ('C9', array('customer_name'), 'Zed', 1)
        AS t(customer_id, set_fields, customer_name, customer_age)"""
    )
    change = maintenance.patch_batch(customers(spark), patches, "customer_id", ["customer_name", "customer_age"])
    assert sorted((tuple(r) for r in change.table.collect()), key=str) == [("C1", "Ann", None), ("C2", "Rob", 40), ("C3", "Cid", 50)]
    assert [(r["customer_id"], r["reason"]) for r in change.refused.collect()] == [("C9", "not found")]
    with pytest.raises(ValueError):
        maintenance.patch_batch(customers(spark), patches, "customer_id", ["customer_id"])


def test_delete_is_restricted_by_children(spark):
    orders = spark.sql("SELECT 'O1' AS order_id, 'C1' AS customer_id")
    asked = spark.sql("SELECT * FROM VALUES ('C1'), ('C2'), ('C7') AS t(customer_id)")
    change = maintenance.delete_restrict(customers(spark), asked, "customer_id", {"orders": orders})
    assert sorted(r["customer_id"] for r in change.table.collect()) == ["C1", "C3"]
    assert sorted(tuple(r) for r in change.refused.collect()) == [("C1", "referenced by orders"), ("C7", "not found")]


def test_delete_cascades(spark):
    orders = spark.sql("SELECT * FROM VALUES (1), (2) AS t(order_id)")
    items = spark.sql("SELECT * FROM VALUES (1, 'x'), (1, 'y'), (2, 'z') AS t(order_id, p)")
    left = maintenance.delete_cascade(orders, spark.sql("SELECT 1 AS order_id"), "order_id", {"items": items, "ratings": orders})
    assert {k: v.count() for k, v in left.items()} == {"table": 1, "items": 1, "ratings": 1}


def test_validated_joins(spark):
    left = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'a'), (3, 'b') AS t(id, k)")
    right = spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 2) AS t(k, v)")
    assert quality.join_validated(left, right, "k").count() == 3
    with pytest.raises(ValueError, match="many-to-one"):
        quality.join_validated(left, right.unionByName(right), "k")
    with pytest.raises(ValueError, match="one-to-one"):
        quality.join_validated(left, right, "k", one_to_one=True)
    with pytest.raises(ValueError, match="unmatched"):
        quality.join_validated(left, right.where("k = 'a'"), "k")


def test_reconciliation_tolerance(spark):
    expected = spark.sql("SELECT 10.00D AS a, 5.0D AS b, 7.0D AS c")
    actual = spark.sql("SELECT 10.01D AS a, 5.02D AS b, cast(null as double) AS c")
    got = {r["metric"]: r["status"] for r in quality.reconcile(expected, actual).collect()}
    assert got == {"a": "OK", "b": "FAIL", "c": "FAIL"}


def test_typed_columns_and_shapes(spark):
    df = spark.sql("SELECT 1 AS i, 2.5D AS d, cast(1 as decimal(5,2)) AS m, 'x' AS s, true AS b")
    assert profile.numeric_columns(df) == ["i", "d", "m"] and profile.string_columns(df) == ["s"]
    assert [tuple(r) for r in profile.table_shapes({"t": df}).collect()] == [("t", 1, 5)]
    assert ("t", "m", "decimal(5,2)") in [tuple(r) for r in profile.column_types({"t": df}).collect()]


def test_correlation_ignores_rows_with_a_missing_side(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 2D), (2D, 4D), (3D, 6D), (NULL, 9D) AS t(x, y)")
    got = {(r["a"], r["b"]): r["correlation"] for r in profile.correlations(df, ["x", "y"]).collect()}
    assert got == {("x", "x"): 1.0, ("x", "y"): 1.0, ("y", "x"): 1.0, ("y", "y"): 1.0}


HEADER = "customer_id,junk,customer_name,customer_age,gender,customer_segment,customer_city,customer_state,customer_country,region,customer_postal_code,customer_acquisition_cost\n"


def test_csv_columns_by_name_and_missing_values(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text(HEADER + 'C1,zzz,"Smith, Ann",31,Female,VIP,,nan,USA,South,01234,24.50\nC2,zzz,Bob,NaN,,None,x,y,UK,East,,\n')
    got = csv.load_customers(spark, str(path)).orderBy("customer_id").collect()
    assert got[0]["customer_name"] == "Smith, Ann" and got[0]["customer_postal_code"] == "01234"
    assert str(got[0]["customer_acquisition_cost"]) == "24.50" and got[0]["customer_state"] is None
    assert got[1]["customer_age"] is None and got[1]["customer_segment"] is None and got[1]["customer_acquisition_cost"] is None
    with pytest.raises(ValueError, match="lacks"):
        csv.load_products(spark, str(path))


def test_order_export_feeds_orders_and_ratings(spark, tmp_path):
    from retailscope.schemas import schema

    columns = [*schema("orders").fieldNames(), "customer_rating", "review_sentiment", "customer_review"]
    values = {"order_id": "O1", "customer_id": "C1", "order_date": "2024-02-29", "net_sales": "10.50", "is_repeat_customer": "True", "quantity": "2"}
    rated = {**values, "customer_rating": "4.5", "review_sentiment": "Positive", "customer_review": "ok"}
    unrated = {**values, "order_id": "O2", "customer_rating": ""}
    path = tmp_path / "orders.csv"
    path.write_text("\n".join(",".join(r.get(c, "") for c in columns) for r in ({c: c for c in columns}, rated, unrated)) + "\n")
    orders = csv.load_orders(spark, str(path))
    assert orders.columns == schema("orders").fieldNames() and orders.count() == 2
    first = orders.where("order_id = 'O1'").first()
    assert str(first["order_date"]) == "2024-02-29" and first["is_repeat_customer"] is True and first["coupon_code"] is None
    got = csv.load_ratings(spark, str(path)).collect()
    assert [(r["order_id"], str(r["rating"]), r["review_sentiment"]) for r in got] == [("O1", "4.5", "Positive")]


def test_products_items_and_statistics_files(spark, tmp_path):
    products = tmp_path / "p.csv"
    products.write_text("product_id,product_name,product_category,product_subcategory,brand,supplier,unit_price,product_cost,product_rating,extra\nP1,Pan,Toys,,B,S,9.99,5.00,4.50,q\n")
    assert str(csv.load_products(spark, str(products)).first()["unit_price"]) == "9.99"
    items = tmp_path / "i.csv"
    items.write_text(
        "order_id,product_id,quantity,unit_price,discount_percentage,discount_amount,gross_sales,tax_amount,shipping_cost,net_sales,product_cost,profit\n"
        "O2,P1,1,9.99,0.1000,1.00,9.99,0,0,8.99,5.00,3.99\nO1,P1,2,9.99,0,0,19.98,0,0,19.98,10,9.98\n"
    )
    loaded = csv.with_item_ids(csv.load_order_items(spark, str(items)), ["product_id", "net_sales"])
    assert sorted((r["order_item_id"], r["order_id"]) for r in loaded.collect()) == [(1, "O1"), (2, "O2")]
    stats = tmp_path / "s.csv"
    stats.write_text(",".join(csv.STATISTICS) + '\n138116,24911,"$177,134,263.74","$76,146,395.76","$1,282.50",3.68,6.85%,6.08%\n')
    row = csv.load_statistics(spark, str(stats)).first()
    assert (row["total_transactions"], row["total_revenue"], row["avg_order_value"], row["return_rate"]) == (138116.0, 177134263.74, 1282.5, 6.85)


def test_quoted_line_ends_and_broken_records(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text('order_id,customer_id,customer_rating,review_sentiment,customer_review\nO1,C1,4.0,Positive,"fine, but\nthe ""other"" thing"\nO2,C1,,,\n')
    got = csv.load_ratings(spark, str(path)).collect()
    assert [(r["order_id"], r["customer_review"]) for r in got] == [("O1", 'fine, but\nthe "other" thing')]
    path.write_text("order_id,customer_id,customer_rating\nO1,C1,4.0,9,9\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        csv.load_ratings(spark, str(path)).collect()


def test_missing_and_repeated_keys_are_refused(spark):
    table = spark.sql("SELECT * FROM VALUES ('A', 1), ('B', 2) AS t(k, v)")
    batch = spark.sql("SELECT * FROM VALUES ('C', 3), (cast(null as string), 4), ('D', 5), ('D', 6), ('A', 7), ('E', -1) AS t(k, v)")
    change = maintenance.insert_batch(table, batch, "k", rules=quality.within("v", 0))
    assert sorted(tuple(r) for r in change.table.collect()) == [("A", 1), ("B", 2), ("C", 3)]
    assert sorted((r["v"], r["reason"]) for r in change.refused.collect()) == [(-1, "v >= 0"), (4, "key is missing"), (5, "duplicate key"), (6, "duplicate key"), (7, "duplicate key")]
    patches = spark.sql("SELECT *, array('v') AS set_fields FROM VALUES ('A', 9), ('B', 8), ('B', 7), (cast(null as string), 6), ('Z', 5) AS t(k, v)")
    change = maintenance.patch_batch(table, patches, "k", ["v"], quality.within("v", 0))
    assert sorted(tuple(r) for r in change.table.collect()) == [("A", 9), ("B", 2)]
    assert sorted((r["v"], r["reason"]) for r in change.refused.collect()) == [(5, "not found"), (6, "key is missing"), (7, "key repeats"), (8, "key repeats")]
    bad = spark.sql("SELECT 'A' AS k, -3 AS v, array('v') AS set_fields")
    change = maintenance.patch_batch(table, bad, "k", ["v"], quality.within("v", 0))
    assert sorted(tuple(r) for r in change.table.collect()) == [("A", 1), ("B", 2)] and change.refused.first()["reason"] == "v >= 0"


def test_new_rows_are_stamped(spark):
    table = spark.sql("SELECT 'A' AS k, timestamp'2020-01-01 00:00:00' AS created_at")
    change = maintenance.insert_batch(table, spark.sql("SELECT 'B' AS k"), "k")
    assert change.table.where("created_at is null").count() == 0 and change.table.schema["created_at"].dataType.typeName() == "timestamp"
    told = maintenance.insert_batch(table, spark.sql("SELECT 'B' AS k, timestamp'2021-01-01 00:00:00' AS created_at"), "k").table
    assert told.where("year(created_at) = 2021").count() == 1


def test_rating_ids_follow_the_orders(spark):
    ratings = spark.sql("SELECT * FROM VALUES ('O3', 4.0), ('O1', 5.0), ('O2', 1.0) AS t(order_id, rating)")
    assert sorted((r["rating_id"], r["order_id"]) for r in csv.with_rating_ids(ratings).collect()) == [(1, "O1"), (2, "O2"), (3, "O3")]


def test_rules_hold_before_publishing(spark, tmp_path):
    target = str(tmp_path / "star")
    with pytest.raises(publish.LoadRefused, match="customers.customer_id is missing"):
        publish.publish({"customers": spark.sql("SELECT cast(null as string) AS customer_id, 30 AS customer_age")}, target)
    with pytest.raises(publish.LoadRefused, match="customer_age <= 120"):
        publish.publish({"customers": spark.sql("SELECT 'C1' AS customer_id, 999 AS customer_age")}, target)
    orders = spark.sql("SELECT 'O1' AS order_id, date'2024-01-05' AS order_date")
    publish.publish({"orders": orders}, target)
    assert publish.published(spark, target)["orders"].columns == orders.columns


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "b.md").write_text("# B\ntext")
    (tmp_path / "a.md").write_text("only")
    (tmp_path / "c.txt").write_text("no")
    got = documents.read_markdown(spark, str(tmp_path)).orderBy("source_file").collect()
    assert [tuple(r) for r in got] == [("a.md", "only"), ("b.md", "# B\ntext")]
    with pytest.raises(FileNotFoundError):
        documents.read_markdown(spark, str(tmp_path / "none"))


def test_nan_becomes_null(spark):
    df = spark.sql("SELECT cast('NaN' as double) AS d, 'nan' AS s, 1 AS i")
    assert tuple(csv.missing_to_null(df).first()) == (None, None, 1)


def test_a_refused_load_leaves_the_last_one_in_place(spark, tmp_path):
    target = str(tmp_path / "star")
    good = {"customers": customers(spark), "orders": spark.sql("SELECT 'O1' AS order_id, 'C1' AS customer_id, date'2024-01-05' AS order_date")}
    publish.publish(good, target)
    bad = {**good, "orders": spark.sql("SELECT 'O1' AS order_id, 'C9' AS customer_id, date'2024-01-05' AS order_date")}
    with pytest.raises(publish.LoadRefused, match="orders.customer_id has no customers"):
        publish.publish(bad, target)
    with pytest.raises(publish.LoadRefused, match="customers.customer_id repeats"):
        publish.publish({"customers": customers(spark).unionByName(customers(spark))}, target)
    assert publish.published(spark, target)["orders"].first()["customer_id"] == "C1"
    publish.publish({"customers": customers(spark).limit(1)}, target)
    assert publish.published(spark, target)["customers"].count() == 1


def test_sample_keys_resolve(star):
    tables = {"customers": star.customers(), "products": star.products(), "orders": star.orders(), "order_items": star.items(), "ratings": star.ratings()}
    got = sample.sample_star(tables, orders=50, extra=5)
    assert got["orders"].count() == 50
    assert publish.key_problems(got).count() == 0
    used = got["orders"].select("customer_id").distinct().count()
    assert got["customers"].count() == used + 5
