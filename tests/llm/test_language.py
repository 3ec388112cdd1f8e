"""The field's forward-backward against enumeration, and held-out accuracy on the given documents."""

from itertools import product

import numpy as np
import pyarrow as pa

from retailscope.llm import language
from retailscope.llm.queries import QUERIES


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    for sizes in ([1], [5], [2, 1, 6, 3], [4, 4]):
        labels = 3
        scores = rng.normal(size=(sum(sizes), labels)) * 2
        moves, begin = rng.normal(size=(labels, labels)), rng.normal(size=labels)
        starts = np.cumsum([0, *sizes[:-1]])
        want = np.zeros_like(scores)
        for s, n in zip(starts, sizes, strict=True):
            for path in product(range(labels), repeat=n):
                w = np.exp(begin[path[0]] + sum(scores[s + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
                for t, y in enumerate(path):
                    want[s + t, y] += w
        want /= want.sum(axis=1, keepdims=True)
        for columns in (1, 2, 3, 128):
            assert np.allclose(language.marginals(scores, starts, moves, begin, columns), want, atol=1e-9)


def test_pair_counts_are_those_of_all_labellings():
    rng = np.random.default_rng(2)
    scores, moves, begin = rng.normal(size=(7, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    starts = np.array([0, 4])
    want = np.zeros((2, 2))
    for s, n in ((0, 4), (4, 3)):
        part, total = np.zeros((2, 2)), 0
        for path in product(range(2), repeat=n):
            w = np.exp(begin[path[0]] + sum(scores[s + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            for a, b in zip(path, path[1:]):
                part[a, b] += w
        want += part / total
    assert np.allclose(language.pair_counts(scores, starts, np.array([1, 2, 3, 5, 6]), moves, begin), want)


def made_up():
    rng = np.random.default_rng(3)
    syllables = {"aa": ["ko", "ri", "tan", "mu"], "bb": ["sch", "ein", "ung", "der"]}
    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(n))
    return text


def test_code_switched_words_get_their_own_language():
    text = made_up()
    field = language.fit([(lang, text(lang, 12)) for _ in range(60) for lang in ("aa", "bb")])
    assert field.transitions[0, 0] > field.transitions[0, 1] and field.transitions[1, 1] > field.transitions[1, 0]
    labelled, ends = field.label(pa.array([f"{text('aa', 10)}, {text('bb', 7)}! 123 {text('aa', 5)}."]))
    assert ends.tolist() == [0, 22]
    assert np.argmax(labelled, axis=1).tolist() == [0] * 10 + [1] * 7 + [0] * 5
    langs, scores = field.predict(pa.array(["", None, "12 -- !", "Ein", "KORITAN rimu", text("bb", 30_000)]))
    assert langs == ["und", "und", "und", "bb", "aa", "bb"]
    assert scores[:3].tolist() == [0, 0, 0] and (scores[3:] > 0.5).all() and (scores <= 1).all()


def test_odd_rows(spark):
    text = made_up()
    rows = [(1, text("aa", 50), "x", 1.0), (1, text("aa", 50), "x", 1.0), (None, None, None, None), (2, "", None, 2.0), (3, "x" * 100_000, "y", 3.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, language string, score double")
    field = language.fit([(lang, text(lang, 12)) for _ in range(40) for lang in ("aa", "bb")])
    out = language.identify(df, field)
    assert out.columns == df.columns
    assert [r.language.lang for r in out.collect() if r.doc_id in (1, 2, None)].count("aa") == 2
    assert language.identify(df.limit(0), field).count() == 0
    from pyspark.sql import functions as F

    assert language.passages_of(df.limit(0), F.col("language"), F.col("doc_id"), F.col("text")) == []
    nothing = language.fit([])
    assert {r.language.lang for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.fit([("aa", "12 34"), ("bb", "")]).languages == []


def test_op1_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op1_language_field"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(found) == len(docs)
    import zlib

    held = [(found[d.doc_id].lang_pred, d.lang) for d in docs if found[d.doc_id].held_out and d.lang is not None]
    assert all(found[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    assert sum(a == b for a, b in held) >= 0.98 * len(held) and len(held) > 100
