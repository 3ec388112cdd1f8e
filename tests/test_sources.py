import csv as plain_csv
import io
import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from retailscope.operators import quality
from retailscope.sources import csv, publish


@pytest.fixture
def small_blocks(spark):
    """Files are read in byte ranges of 48 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(rows, end="\n"):
    out = io.StringIO()
    plain_csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_byte_ranges(small_blocks, tmp_path, end):
    """Cells with line ends, commas and quotes, also longer than several ranges, equal a plain reader's."""
    rng = random.Random(7)
    cells = ["a", "", "x,y", 'say ""hi""', "two\nlines", "\n", "win\r\nend", '"', '\n"\n', "long " * 40, "line\n" * 50, "é\U0001f600", " pad "]
    rows = [[str(k), rng.choice(cells), rng.choice(cells), rng.choice(cells)] for k in range(120)]
    path = tmp_path / "one.csv"
    path.write_bytes(written([["id", "a", "b", "c"], *rows], end).encode())
    df = csv.read_cells(small_blocks, str(path))
    assert df.columns == ["id", "a", "b", "c"]
    got = sorted((tuple(v or "" for v in r) for r in df.collect()), key=lambda r: int(r[0]))
    assert got == [tuple(r) for r in rows]


def test_one_file_is_read_in_many_tasks(small_blocks, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text(written([["id", "v"], *[[str(k), "value"] for k in range(2_000)]]))
    df = csv.read_cells(small_blocks, str(path))
    assert df.count() == 2_000
    assert df.rdd.getNumPartitions() > 50


def test_many_files_have_a_header_each(small_blocks, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.csv").write_text(written([["id", "v"], [str(k), "two\nlines"], [str(k + 10), "z"]]))
    got = csv.read_cells(small_blocks, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted([(str(k), "two\nlines") for k in range(4)] + [(str(k + 10), "z") for k in range(4)])
    (tmp_path / "5.csv").write_text(written([["v", "id"], ["q", "1"]]))
    with pytest.raises(ValueError, match="different headers"):
        csv.read_cells(small_blocks, str(tmp_path))


def test_headers_with_line_ends_and_odd_names(small_blocks, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("﻿" + written([["first name that is\nlonger than a byte range of forty-eight bytes", "v", "V", ""], ["1", "2", "3", "4"], []]))
    df = csv.read_cells(small_blocks, str(path))
    assert df.columns == ["first name that is\nlonger than a byte range of forty-eight bytes", "v1", "V2", "_c3"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3", "4")]


def test_files_that_fail(small_blocks, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text('id,v\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="within a quoted cell"):
        csv.read_cells(small_blocks, str(path))
    path.write_text("id,v\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        csv.read_cells(small_blocks, str(path)).collect()
    path.write_text("id,v\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        csv.read_cells(small_blocks, str(path)).select("id").collect()


def test_files_without_rows(small_blocks, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("id,v\n")
    df = csv.read_cells(small_blocks, str(path))
    assert df.columns == ["id", "v"] and df.count() == 0
    path.write_text("")
    assert csv.read_cells(small_blocks, str(path)).columns == []


def customers(spark, *ids):
    return spark.createDataFrame([(k, 30) for k in ids], "customer_id string, customer_age int")


def test_versions_are_numbered(spark, tmp_path):
    target = str(tmp_path)
    for k in range(3):
        got = publish.publish({"customers": customers(spark, f"C{k}")}, target).collect()
        assert [(r["table"], r["rows"]) for r in got] == [("customers", 1)]
    assert publish.versions(spark, target) == [1, 2, 3]
    assert publish.published(spark, target)["customers"].first()["customer_id"] == "C2"
    assert publish.published(spark, target, 1)["customers"].first()["customer_id"] == "C0"


def test_two_publishers_at_once(spark, tmp_path):
    target = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(publish.publish, {"customers": customers(spark, f"C{k}")}, target) for k in range(6)]
        paths = {job.result().first()["path"] for job in jobs}
    assert len(paths) == 6 and publish.versions(spark, target) == [1, 2, 3, 4, 5, 6]
    assert {publish.published(spark, target, v)["customers"].first()["customer_id"] for v in range(1, 7)} == {f"C{k}" for k in range(6)}


def test_a_number_that_is_taken_stays(spark, tmp_path):
    assert publish._put_if_absent(spark, f"{tmp_path}/log/1.json", "first") and not publish._put_if_absent(spark, f"{tmp_path}/log/1.json", "second")
    assert (tmp_path / "log" / "1.json").read_text() == "first"


def test_an_unfinished_entry_is_passed_over(spark, tmp_path):
    target = str(tmp_path)
    publish.publish({"customers": customers(spark, "C1")}, target)
    (tmp_path / "log" / f"{2:020d}.json").write_text('{"tables": {"cust')
    assert publish.published(spark, target)["customers"].first()["customer_id"] == "C1"
    publish.publish({"customers": customers(spark, "C3")}, target)
    assert publish.versions(spark, target) == [1, 3]


def test_refused_loads_leave_nothing(spark, tmp_path):
    target = str(tmp_path)
    publish.publish({"customers": customers(spark, "C1")}, target)
    with pytest.raises(publish.LoadRefused, match=r"customers.customer_id repeats \(1\)"):
        publish.publish({"customers": customers(spark, "C2", "C2")}, target)
    broken = {"customers": customers(spark, "C2"), "orders": spark.sql("SELECT 'O1' AS order_id, 'C2' AS customer_id, assert_true(false) AS x, date'2024-01-05' AS order_date")}
    with pytest.raises(Exception, match="assert|is not true"):
        publish.publish(broken, target)
    assert len(os.listdir(tmp_path / "versions")) == 1
    (tmp_path / "versions" / "lost").mkdir()
    assert publish.remove_leftovers(spark, target) == 0 and publish.remove_leftovers(spark, target, 0) == 1
    assert publish.published(spark, target)["customers"].count() == 1


def test_problems_are_counted(spark):
    tables = {
        "customers": spark.sql("SELECT * FROM VALUES ('C1'), ('C1'), ('C2'), (cast(null as string)) AS t(customer_id)"),
        "orders": spark.sql("SELECT * FROM VALUES ('O1', 'C1'), ('O2', 'C9'), ('O3', 'C9'), ('O4', cast(null as string)) AS t(order_id, customer_id)"),
        "order_items": spark.sql("SELECT * FROM VALUES ('O1'), ('O8'), ('O8') AS t(order_id)").selectExpr("order_id", "'P1' AS product_id"),
        "ratings": spark.sql("SELECT 'O1' AS order_id"),
    }
    got = {tuple(r) for r in publish.key_problems(tables).collect()}
    assert got == {("customers.customer_id repeats", 1), ("customers.customer_id is missing", 1), ("orders.customer_id has no customers", 3), ("order_items.order_id has no orders", 2)}


def test_rules_are_counted(spark, tmp_path):
    rows = spark.createDataFrame([("C1", 10), ("C2", 300), ("C3", -1), ("C4", None)], "customer_id string, customer_age int")
    with pytest.raises(publish.LoadRefused, match=r"customers: customer_age >= 0 \(1\); customers: customer_age <= 120 \(1\)"):
        publish.publish({"customers": rows}, str(tmp_path), {"customers": quality.within("customer_age", 0, 120)})
    empty = publish.publish({"customers": rows.where("false")}, str(tmp_path))
    assert empty.first()["rows"] == 0 and publish.published(spark, str(tmp_path))["customers"].columns == rows.columns


def test_log_entries_are_plain(spark, tmp_path):
    publish.publish({"customers": customers(spark, "C1")}, str(tmp_path))
    entry = json.loads((tmp_path / "log" / f"{1:020d}.json").read_text())
    assert entry["tables"]["customers"]["rows"] == 1
