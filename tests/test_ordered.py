"""Sliced totals and bracketed quantiles against pandas, hot groups and NULL groups included."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retailscope.functions import ordered
from retailscope.functions.ordered import positions, quantiles, running_totals


def hot_rows(n=3000, seed=1):
    rng = random.Random(seed)
    groups = ["hot"] * (n // 3) + [None] * 40 + [f"g{rng.randrange(400)}" for _ in range(n - n // 3 - 40)]
    rng.shuffle(groups)
    return pd.DataFrame({"g": groups, "k": list(range(n)), "v": [rng.randrange(-50, 100) for _ in range(n)]})


@pytest.mark.parametrize("current", [True, False])
def test_grouped_totals_in_slices(spark, current):
    data = hot_rows()
    df = spark.createDataFrame(data, "g string, k bigint, v bigint").repartition(7)
    totals = {"c": F.lit(1).cast("bigint"), "s": F.col("v")}
    got = running_totals(df, totals, ["k"], ["g"], current).toPandas()
    expected = data.sort_values("k").copy()
    by = expected.groupby("g", dropna=False)
    expected["c"] = by.cumcount() + (1 if current else 0)
    expected["s"] = by["v"].cumsum() - (0 if current else expected["v"])
    got = got.sort_values("k").reset_index(drop=True)
    assert got[["k", "c", "s"]].values.tolist() == expected[["k", "c", "s"]].values.tolist()


def test_global_positions_and_sums(spark):
    data = hot_rows(1000)
    df = spark.createDataFrame(data, "g string, k bigint, v bigint").repartition(5)
    got = running_totals(df, {"p": F.lit(1).cast("bigint"), "s": F.col("v")}, ["v", "k"]).orderBy("p").toPandas()
    expected = data.sort_values(["v", "k"])
    assert got["k"].tolist() == expected["k"].tolist()
    assert got["s"].tolist() == expected["v"].cumsum().tolist()
    assert got["p"].tolist() == list(range(1, 1001))


def test_decimal_sums_keep_their_type(spark):
    df = spark.sql("SELECT id AS k, cast(id as decimal(12,2)) AS v FROM range(10)")
    got = running_totals(df, {"s": F.col("v")}, ["k"], include_current=False)
    assert got.schema["s"].dataType.simpleString() == "decimal(22,2)"
    assert float(got.where("k = 9").first()["s"]) == 36.0


def test_positions_of_one_row_and_of_none(spark):
    df = spark.sql("SELECT 5L AS k")
    assert positions(df, ["k"]).first()["position"] == 1
    assert positions(df.where("false"), ["k"]).count() == 0


def test_many_slices_of_one_group(spark, monkeypatch):
    monkeypatch.setattr(ordered, "slice_count", lambda spark: 60)
    got = positions(spark.range(500).toDF("k").repartition(7), ["k"]).where("position <> k + 1")
    assert got.count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_brackets_hold_the_quantiles(spark, monkeypatch, by):
    """More rows than the sketch tells apart, with heavy ties."""
    monkeypatch.setattr(ordered, "ACCURACY", 100)
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 6000), "x": rng.normal(size=6000), "y": rng.integers(0, 4, 6000).astype(float)})
    df = spark.createDataFrame(frame).repartition(6)
    ps = [0.0, 0.1, 0.5, 0.75, 0.999, 1.0]
    got = {(*[r[b] for b in by], r["feature"], r["probability"]): r["quantile"] for r in quantiles(df, ["x", "y"], ps, by).collect()}
    for key, part in frame.groupby("g") if by else [((), frame)]:
        for c in ("x", "y"):
            for p in ps:
                assert got[(key, c, p) if by else (c, p)] == pytest.approx(np.quantile(part[c], p), abs=1e-9)


@pytest.mark.parametrize("size", [1, 2, 5, 100, 1001])
def test_quantiles_interpolate(spark, size):
    rng = np.random.default_rng(size)
    values = np.round(rng.normal(size=size), 1)  # many ties
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": values[::-1] * 3}))
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["feature"], r["probability"]): r["quantile"] for r in quantiles(df, ["x", "y"], ps).collect()}
    for p in ps:
        assert got["x", p] == pytest.approx(np.quantile(values, p), abs=1e-9)
        assert got["y", p] == pytest.approx(np.quantile(values * 3, p), abs=1e-9)


def test_quantiles_skip_missing_values_and_split_by_key(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1.0D), ('a', cast('NaN' as double)), ('a', NULL), ('a', 3.0D), ('b', 7.0D), ('c', NULL) AS t(k, x)")
    got = {r["k"]: r["quantile"] for r in quantiles(df, ["x"], [0.5], by=["k"]).collect()}
    assert got == {"a": 2.0, "b": 7.0}


def test_staged_tables_can_be_dropped(spark):
    from retailscope import session

    kept = list(session._STAGED)
    session._STAGED.clear()
    table = session.staged(spark.range(5).toDF("k"), "drop-test")
    assert table.count() == 5
    assert session.drop_staged(spark) == 1 and session._STAGED == []
    session._STAGED.extend(kept)


@pytest.mark.parametrize("kind", ["normal", "ties", "steps", "tiny", "infinite"])
def test_exact_quantiles_over_several_rounds(spark, monkeypatch, kind):
    """With a coarse sketch: brackets are narrowed again and again, and ties end the search."""
    monkeypatch.setattr(ordered, "ACCURACY", 200)
    rng = np.random.default_rng(9)
    values = {
        "normal": rng.normal(size=30_000),
        "ties": np.where(rng.random(20_000) < 0.4, 1.0, rng.integers(0, 5, 20_000)),
        "steps": np.sort(np.concatenate([np.zeros(5_000), rng.random(5_000) * 1e-300, 1e300 * rng.random(5_000), -np.ones(5_000)])),
        "tiny": np.array([3.0, 1.0]),
        "infinite": np.concatenate([rng.normal(size=3_000), [np.inf] * 200, [-np.inf] * 100]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": -values})).repartition(7)
    ps = [0.0, 0.013, 0.25, 0.5, 0.8, 0.999, 1.0]
    got = ordered.exact_quantiles(df, ["x", "y"], ps)
    ranked = np.sort(values)
    for p, q, r in zip(ps, got["x"], got["y"], strict=True):
        for v, told in ((ranked, q), (np.sort(-values), r)):
            place = p * (len(v) - 1)
            low, high = v[int(place)], v[min(len(v) - 1, int(place) + 1)]
            if np.isfinite(low) and np.isfinite(high):
                assert told == low + (high - low) * (place - int(place))


def test_exact_quantiles_take_few_rounds(spark, monkeypatch):
    calls = []
    plain = ordered.F.percentile_approx
    df = spark.range(200_000).selectExpr("cast(id as double) AS x", "cast(id % 5 as double) AS y")
    monkeypatch.setattr(type(df), "first", lambda self, f=type(df).first: calls.append(1) or f(self))
    assert ordered.exact_quantiles(df, ["x", "y"], [0.5, 0.9]) == {"x": [99_999.5, 179_999.1], "y": [2.0, 4.0]}
    assert len(calls) <= 3 and plain is ordered.F.percentile_approx


def test_no_values_have_no_quantiles(spark):
    df = spark.sql("SELECT cast(null as double) AS x, cast('NaN' as double) AS y, 4 AS z")
    assert ordered.exact_quantiles(df, ["x", "y", "z"], [0.0, 0.5]) == {"x": [None, None], "y": [None, None], "z": [4.0, 4.0]}
    assert ordered.exact_quantiles(df.where("false"), ["z"], [0.5]) == {"z": [None]}
