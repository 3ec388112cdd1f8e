import numpy as np
import pytest

from retailscope.operators import vector_index

SCHEMA = "id bigint, embedding array<double>"


def frame(spark, vectors, name, ids=None):
    rows = [(int(k), None if v is None else [float(x) for x in v]) for k, v in zip(range(len(vectors)) if ids is None else ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("id", name).repartition(3)


def by_hand(queries, chunks, k):
    out = []
    for i, q in enumerate(queries):
        sims = {j: round(float(np.dot(q, c) / np.linalg.norm(q) / np.linalg.norm(c)), 12) for j, c in enumerate(chunks) if len(c) == len(q) and np.linalg.norm(c) > 0}
        out += [(i, j, n) for n, j in enumerate(sorted(sims, key=lambda j: (-sims[j], j))[:k], 1)]
    return sorted(out)


def clustered(rng, n, d, groups, spread=0.05):
    centres = rng.normal(size=(groups, d))
    return centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize("search", [vector_index.search, vector_index.search_by_codes])
@pytest.mark.parametrize("kind", ["random", "clustered", "ties"])
def test_searches_are_exact(spark, monkeypatch, search, kind):
    """Also with tiny blocks, many parts of questions and a first wave that finds less than k."""
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    monkeypatch.setattr(vector_index, "FIRST", 1)
    rng = np.random.default_rng(3)
    if kind == "random":
        chunks = rng.normal(size=(400, 12))
    elif kind == "clustered":
        chunks = clustered(rng, 400, 12, 9)
    else:
        chunks = np.round(rng.normal(size=(300, 3)))
        chunks[50:170] = chunks[5]  # a third of all vectors are equal
    queries = np.concatenate([chunks[:4] + 0.01, rng.normal(size=(6, chunks.shape[1]))])
    index = vector_index.build(frame(spark, chunks, "chunk_id"), cells=10)
    got = search(index, frame(spark, queries, "query_id"), 5, question_bytes=300).collect()
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == by_hand(queries, chunks, 5)
    assert index.vectors == sum(np.linalg.norm(c) > 0 for c in chunks)


def test_clusters_are_skipped_and_few_vectors_read(spark):
    rng = np.random.default_rng(4)
    chunks = clustered(rng, 3_000, 16, 30, 0.01)
    queries = chunks[::300]
    index = vector_index.build(frame(spark, chunks, "chunk_id"), cells=30)
    asked = vector_index._questions(frame(spark, queries, "query_id"))
    first = vector_index.search(index, frame(spark, queries, "query_id"), 3)
    limits = vector_index._limits(asked, first, "similarity", 3)
    assert vector_index._requests(index, limits, 3).count() < 10 * 30 / 4  # requests of the second wave
    got = vector_index.search_by_codes(index, frame(spark, queries, "query_id"), 3).where("rank = 1").collect()
    assert sum(r.candidates for r in got) <= 0.1 * 10 * 3_000


def test_more_widths_than_have_cells(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "WIDTHS", 2)
    rng = np.random.default_rng(5)
    chunks = [rng.normal(size=w) for w in [4] * 30 + [5] * 20 + [6] * 3 + [7] * 2] + [np.zeros(4), np.full(5, np.nan), np.full(4, np.inf), [], None]
    queries = [rng.normal(size=w) for w in (4, 5, 6, 7, 8)]
    index = vector_index.build(frame(spark, chunks, "chunk_id"))
    assert set(index.centres) == {4, 5} and index.sizes[vector_index.OTHERS] == 5
    usable = [c if c is not None and len(c) and np.isfinite(c).all() else np.zeros(1) for c in chunks]
    for search in (vector_index.search, vector_index.search_by_codes):
        got = search(index, frame(spark, queries, "query_id"), 4).collect()
        assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == by_hand(queries, usable, 4)


@pytest.mark.parametrize("empty", ["chunks", "questions"])
def test_nothing_to_search(spark, empty):
    some, none = [[1.0, 0.0]], []
    index = vector_index.build(frame(spark, none if empty == "chunks" else some, "chunk_id"))
    for search in (vector_index.search, vector_index.search_by_codes):
        assert search(index, frame(spark, none if empty == "questions" else some, "query_id"), 2).collect() == []


def test_codes_bound_similarities():
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(200, 24))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    scales = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scales[:, None]).astype(np.int8)
    errors = np.linalg.norm(unit - codes * scales[:, None], axis=1)
    true, about = unit @ unit.T, unit @ (codes * scales[:, None]).T
    assert (np.abs(true - about) <= errors + 1e-12).all() and errors.max() < 0.05
