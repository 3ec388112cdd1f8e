import numpy as np
import pytest

from retailscope.operators import filters


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("kind", ["spread", "ties", "missing"])
def test_pages_far_in_equal_a_sort(spark, monkeypatch, direction, kind):
    monkeypatch.setattr(filters, "DEEP", 60)
    monkeypatch.setattr(filters, "SLICES", 7)
    monkeypatch.setattr(filters, "SAMPLED", 50)
    rng = np.random.default_rng(2)
    values = {
        "spread": rng.permutation(3_000).tolist(),
        "ties": np.where(rng.random(3_000) < 0.7, 5, rng.integers(0, 9, 3_000)).tolist(),
        "missing": [None if x < 0.5 else int(9 * x) for x in rng.random(3_000)],
    }[kind]
    rows = [(f"k{i:05d}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    if direction == "asc":
        order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    else:
        order = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    for number in (1, 4, 60, 150, 151):
        got = filters.page(df, "k", "v", direction, number, 20).collect()
        assert [(r.k, r.v) for r in got] == order[20 * (number - 1) : 20 * number]
        assert all((r.total, r.pages) == (3_000, 150) for r in got)


def test_deep_pages_sort_a_short_slice(spark, monkeypatch):
    monkeypatch.setattr(filters, "DEEP", 100)
    df = spark.range(50_000).selectExpr("cast(id as string) AS k", "id % 1000 AS v")
    slice_, skip = filters.narrowed(df, "k", "v", "asc", 30_000, 20, 50_000)
    assert slice_.count() <= 2_000 and skip + 20 <= 2_000
