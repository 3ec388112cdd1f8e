"""The pipeline stage by stage against plain versions of each decision."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retailscope.llm import neardup, pii
from retailscope.session import staged
from tests.conftest import SMALL
from tests.llm.test_similar import smallest_of_similar
from tests.llm.test_rules import plain_base, plain_statistics
from tests.llm.test_tokens import check_packing, plain_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL), "test")
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_stages_against_plain_versions(stages):
    every = {r["doc_id"]: r for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    first, second, third, fourth, fifth = stages
    assert all(list(r) == COLUMNS for rows in stages[:4] for r in rows)
    # language: nothing with letters of one language goes
    assert all(r == every[r["doc_id"]] for r in first)
    assert len(first) >= 0.98 * len(every) and all(any(c.isalpha() for c in r["text"]) for r in first)
    # quality: the base rule holds for all that stay, and good documents stay
    passed = {r["doc_id"] for r in second}
    assert all(r == every[r["doc_id"]] for r in second)
    assert not any(plain_statistics(r["text"])[-1] for r in second)
    good = [r["doc_id"] for r in first if labels.get(r["doc_id"]) == 1 and not plain_statistics(r["text"])[-1]]
    assert sum(d in passed for d in good) >= 0.97 * len(good)
    # near copies: exactly the smallest document of each group
    assert sorted(r["doc_id"] for r in third) == smallest_of_similar({r["doc_id"]: r["text"] for r in second})
    assert all(r == every[r["doc_id"]] for r in third)
    # personal data
    by_id = {r["doc_id"]: r for r in third}
    assert sorted(r["doc_id"] for r in fourth) == sorted(by_id)
    for r in fourth:
        before = by_id[r["doc_id"]]
        assert r["text"] == pii.masked(before["text"]) and r["n_chars"] == len(r["text"]) and not plain_base(r["text"])
        assert (r["lang"], r["source"]) == (before["lang"], before["source"])
    # packing
    want = {r["doc_id"]: [*ids, 2] for r, ids in zip(fourth, plain_ids([r["text"] for r in fourth]), strict=True)}

    class Row(dict):
        __getattr__ = dict.__getitem__

    assert check_packing([Row(r) for r in fifth], want, 1024) <= 1.02 * -(-sum(map(len, want.values())) // 1024) + 1


def test_run_is_the_stages_one_after_another(spark, stages):
    got = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in stages[-1])


def test_odd_rows(spark):
    plain = "some words that are not the same as others in this short text {} which ends here"
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "12 34", None, None, 5), (None, plain.format("alpha beta"), "en", None, 70), (None, plain.format("alpha beta"), "en", None, 70), (4, plain.format("gamma delta") + " a@b.co", "en", "b", 70), (4, plain.format("gamma delta") + " a@b.co", "en", "b", 70), (5, plain.format("one two " + " ".join(f"w{i}" for i in range(9000))), None, "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("language", F.lit("x")).withColumn("kept", F.lit(False)).withColumn("bytes", F.lit(2))
    docs = df
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = staged(stage(spark, docs, SMALL), "odd")
        assert docs.columns == df.columns
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["4", "5", "None"]
    assert docs.filter("doc_id = 4").first().text.endswith("<email>")
    assert corpus_pipeline.STAGES[4][1](spark, docs, SMALL).select("doc_id").distinct().count() == 3
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, SMALL), "empty")
        assert empty.count() == 0


def test_one_of_each_keeps_the_smallest(spark):
    rows = [(9, "a b c d"), (3, "A B C D"), (None, "a b c d"), (7, "x y z"), (None, "only here it stands"), (None, "only here it stands")]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("3", "A B C D"), ("7", "x y z"), ("None", "only here it stands")]
