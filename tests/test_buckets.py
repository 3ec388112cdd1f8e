import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from retailscope.operators import quality
from retailscope.sources import buckets

SCHEMA = "k string, v int"


@pytest.fixture
def target(spark, tmp_path):
    path = str(tmp_path / "table")
    buckets.create(spark.createDataFrame([(f"K{i}", i) for i in range(200)], SCHEMA), path, "k", 8)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_small_batches_leave_other_buckets_alone(spark, target):
    before, first = files(target), buckets.state_of(spark, target)
    refused = buckets.patch(spark, target, spark.sql("SELECT 'K7' AS k, -7 AS v, array('v') AS set_fields UNION ALL SELECT 'none', 1, array('v')"), ["v"])
    assert [(r["k"], r["reason"]) for r in refused.collect()] == [("none", "not found")]
    after, second = files(target), buckets.state_of(spark, target)
    assert all(after[f] == before[f] for f in before)
    changed = {b for b in first.paths if second.paths[b] != first.paths[b]}
    assert 1 <= len(changed) <= 2 and len(first.paths) == 8
    assert rows(buckets.read(spark, target)) == rows(spark.createDataFrame([(f"K{i}", -7 if i == 7 else i) for i in range(200)], SCHEMA))
    assert dict(rows(buckets.read(spark, target, 1)))["K7"] == 7


def test_insert_and_delete(spark, target):
    batch = spark.createDataFrame([("new", 5), ("K1", 9), (None, 3), ("bad", -4)], SCHEMA)
    refused = buckets.insert(spark, target, batch, rules=quality.within("v", 0))
    assert sorted((r["v"], r["reason"]) for r in refused.collect()) == [(-4, "v >= 0"), (3, "key is missing"), (9, "duplicate key")]
    assert buckets.read(spark, target).count() == 201
    children = {"items": spark.sql("SELECT 'K2' AS k")}
    refused = buckets.delete(spark, target, spark.sql("SELECT * FROM VALUES ('K2'), ('K3'), ('new'), ('gone') AS t(k)"), children)
    assert sorted(tuple(r) for r in refused.collect()) == [("K2", "referenced by items"), ("gone", "not found")]
    left = {k for k, _ in rows(buckets.read(spark, target))}
    assert "K2" in left and not {"K3", "new"} & left and len(left) == 199


def test_cascade_over_two_tables(spark, target, tmp_path):
    child = str(tmp_path / "child")
    buckets.create(spark.createDataFrame([("K1", 1), ("K1", 2), ("K5", 3)], SCHEMA), child, "k", 4)
    refused = buckets.delete_with(spark, target, spark.sql("SELECT * FROM VALUES ('K1'), ('K9'), ('gone') AS t(k)"), {"child": child})
    assert [tuple(r) for r in refused.collect()] == [("gone", "not found")]
    assert rows(buckets.read(spark, child)) == [("K5", 3)] and buckets.read(spark, target).count() == 198


def test_batches_at_once_all_take_effect(spark, target):
    def one(i):
        return buckets.insert(spark, target, spark.createDataFrame([(f"N{i}", i)], SCHEMA)).count()

    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(one, range(4))) == [0] * 4
    got = dict(rows(buckets.read(spark, target)))
    assert len(got) == 204 and all(got[f"N{i}"] == i for i in range(4))
    assert buckets.state_of(spark, target).version == 5


def test_empty_tables_and_batches(spark, tmp_path):
    path = str(tmp_path / "empty")
    buckets.create(spark.createDataFrame([], SCHEMA), path, "k", 4)
    assert buckets.read(spark, path).collect() == [] and buckets.read(spark, path).columns == ["k", "v"]
    assert buckets.insert(spark, path, spark.createDataFrame([], SCHEMA)).collect() == []
    assert buckets.state_of(spark, path).version == 1
    buckets.insert(spark, path, spark.createDataFrame([("a", 1)], SCHEMA))
    assert rows(buckets.read(spark, path)) == [("a", 1)]
    buckets.delete(spark, path, spark.sql("SELECT 'a' AS k"))
    assert buckets.read(spark, path).collect() == []
    with pytest.raises(ValueError, match="holds a table"):
        buckets.create(spark.createDataFrame([], SCHEMA), path, "k", 4)
    with pytest.raises(LookupError):
        buckets.read(spark, str(tmp_path / "none"))
