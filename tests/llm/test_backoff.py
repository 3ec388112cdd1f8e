"""Exact base scores, a distribution that sums to one, and better scores than the base on held-out texts."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from retailscope.llm import backoff
from retailscope.llm.queries import QUERIES
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(rows):
    """rows: (key, text, held_out) -> key, n_tokens, n_known, N, base"""
    counts = Counter()
    for _, text, held in rows:
        if not held:
            counts.update(plain_words(text))
            counts["\nend"] += 1
    total, different = sum(counts.values()), len(counts)
    out = []
    for key, text, held in rows:
        tokens = [*plain_words(text), "\nend"]
        out.append((key, held, len(tokens), sum(counts[t] > 0 for t in tokens), total, sum(math.log10((counts[t] + 1) / (total + different + 1)) for t in tokens)))
    return out


def same(found, rows):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found)
    want = sorted((k is not None, k or 0, h, n, m, t, round(b, 5)) for k, h, n, m, t, b in plain_base(rows))
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=1e-9, atol=1e-4)


def test_op7_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(backoff, "HEAD", 2_000)
    t = pq.read_table(f"{SMALL}/documents.parquet")
    rows = [(d, x, zlib.crc32(str(d).encode()) % 7 == 2) for d, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True)]
    found = QUERIES["op7_backoff_scores"](spark, SMALL).collect()
    same(found, rows)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score <= 0 for r in found)


def test_odd_rows(spark):
    rows = [(1, "a b a B\x0bb", False), (1, "a b a B\x0bb", False), (2, None, False), (3, "", True), (None, "É a É", False), (4, "new words a", True), (5, "w " * 30_000 + "x" * 100_000, False), (6, " a\tb\n", True)]
    df = spark.createDataFrame([(d, x, h, "clash") for d, x, h in rows], "doc_id long, text string, held boolean, word string").repartition(3)
    same(backoff.score_texts(df, F.col("held")).collect(), rows)
    assert backoff.score_texts(df.limit(0), F.col("held")).count() == 0
    same(backoff.score_texts(df, F.lit(True)).collect(), [(d, x, True) for d, x, _ in rows])


def test_every_state_sums_to_one(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(60)
    model, _ = backoff.fit(texts)
    automaton = backoff.Automaton(model)
    states = len(model.failures)
    assert states > 1 + model.symbols
    for state in [0, 1, 5, automaton.begin, model.symbols + 1, states - 1]:
        automaton.begin = state
        total = sum(10 ** automaton.score([s]) for s in range(model.symbols - 1))
        assert abs(total - 1) < 1e-6, state


def test_scores_follow_the_counts_by_hand(spark, monkeypatch):
    """A small corpus, with every n-gram kept, against the recursion written out."""
    monkeypatch.setattr(backoff, "LEAST", 1)
    texts = ["the cat sat", "the cat ran", "the dog sat down", "a cat sat"]
    model, _ = backoff.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    lines = [["<s>", *t.split(), "</s>"] for t in texts]
    size = len({w for x in lines for w in x} - {"<s>"}) + backoff.CLASSES
    one, two, three = Counter(), Counter(), Counter()
    for x in lines:
        one.update(x[1:])
        two.update(zip(x, x[1:]))
        three.update((a, b, c) for a, b, c in zip(x, x[1:], x[2:]) if a != "<s>")
    def p1(w):
        return (one[w] + 1) / (sum(one.values()) + size)
    def mix(counts, h, w, lower):
        own = {k: n for k, n in counts.items() if k[:-1] == h}
        if not own:
            return lower
        bottom = sum(own.values()) + len(own)
        return own.get((*h, w), 0) / bottom + len(own) / bottom * lower
    text = ["the", "cat", "sat", "down", "</s>"]
    want, history = 0.0, ["<s>"]
    for w in text:
        p = mix(two, (history[-1],), w, p1(w))
        if len(history) > 1 and history[-2] != "<s>":
            p = mix(three, (history[-2], history[-1]), w, p)
        want += math.log10(p)
        history.append(w)
    order = [model.head[w][0] for w in text[:-1]] + [model.end]
    assert abs(backoff.Automaton(model).score(order) - want) < 1e-9


def test_pair_hashes_are_those_of_the_plan(spark):
    a, b = np.array([0, 1, -5, 2**62], np.int64), np.array([7, -1, 2**40, -(2**63)], np.int64)
    found = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()
    assert [r.h for r in found] == backoff.joint(a, b).tolist()


def test_no_word_or_history_is_left_out(spark):
    """More words than any limit on words, each in a pair and a triple that occur twice, against the recursion."""
    texts = [" ".join(f"w{i + k}" for k in range(3)) for i in range(0, 9_000, 3)] * 2 + ["w3 w4 w5 w0 w1 w9 w4 w5", "w8997 w8998 w8999 new"]
    rows = [(i, t, i == len(texts) - 1) for i, t in enumerate(texts)]
    one, two, three = Counter(), Counter(), Counter()
    for _, t, held in rows:
        if not held:
            x = ["<s>", *t.split(), "</s>"]
            one.update(x[1:])
            two.update(zip(x, x[1:]))
            three.update(zip(x[1:], x[2:], x[3:]))
    bottoms = {}
    for counts in (two, three):
        for k, n in counts.items():
            total, arcs = bottoms.get(k[:-1], (0, 0))
            bottoms[k[:-1]] = total + n + 1, arcs + n * (n >= backoff.LEAST)

    def mix(counts, gram, lower):
        bottom, arcs = bottoms.get(gram[:-1], (1, 0))
        n = counts[gram] if counts[gram] >= backoff.LEAST else 0
        return n / bottom + (1 - arcs / bottom) * lower

    found = {r.doc_id: r.score for r in backoff.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), F.col("held")).collect()}
    for key in (0, 2_999, len(texts) - 2, len(texts) - 1):
        x, want = ["<s>", *texts[key].split(), "</s>"], 0.0
        for at in range(1, len(x)):
            p = mix(two, (x[at - 1], x[at]), (one[x[at]] + 1) / (sum(one.values()) + len(one) + 1))
            want += math.log10(mix(three, tuple(x[at - 2 : at + 1]), p) if at > 2 else p)
        assert abs(found[key] - want) < 1e-9, key


def test_shuffle_files_go_as_soon_as_tables_are_written(spark):
    """While the result is read, only the shuffles of its own plan are on the disks, not those of counting."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name for i in range(local.getAllFiles().size()) if (name := local.getAllFiles().apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    df = spark.range(2_000).selectExpr("id doc_id", "concat('word', id % 50, ' after word', id % 7) text", "id % 7 = 2 held")
    found = backoff.score_texts(df, F.col("held"))
    until = time.time() + 20  # files go a little after they are released
    while (left := {x for x in shuffles() - before if x.endswith(".data")}) and time.time() < until:
        time.sleep(0.2)
    assert not left, left
    assert found.count() == 2_000


def test_packed_numbers_come_back():
    for kind in (np.uint16, np.int32, np.float64):
        for size in (0, 1, 1_000):
            values = (np.arange(size) * 37 % 60_000).astype(kind)
            back = backoff.unpack(backoff.packed(values), kind, size)
            assert back.dtype == kind and (back == values).all()


def test_batches_of_many_words_and_buckets(spark, monkeypatch):
    """Places among more than 65,536 words, and more buckets than batches, by the plain counts."""
    rows = [(i, " ".join(f"w{(i * 1_000 + k) % 90_000}" for k in range(1_000)), i % 7 == 2) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").coalesce(1)
    lines = backoff.sequences(df.select("doc_id", "text", F.col("held").alias("held_out"))).collect()
    assert max(len(r.words) // 8 for r in lines) > 65_536
    same(backoff.score_texts(df, F.col("held")).collect(), rows)
    monkeypatch.setattr(backoff, "BATCHES", 1)
    same(backoff.score_texts(df.repartition(9), F.col("held")).collect(), rows)


def test_ngrams_travel_packed(spark, monkeypatch):
    """No table has a row for each n-gram: a batch has a row for each level and bucket."""
    rows, keep = [], backoff.kept

    def noted(df, *more):
        out = keep(df, *more)
        rows.append(out.count())
        return out

    monkeypatch.setattr(backoff, "kept", noted)
    texts = [(i, " ".join(f"w{(i * 7 + k) % 5_000}" for k in range(200)), i % 7 == 2) for i in range(1_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string, held boolean").coalesce(2)
    same(backoff.score_texts(df, F.col("held")).collect(), texts)
    assert max(rows) <= 4 * 2 * 8, rows  # lines by levels by buckets; there are 5,000 words and pairs


def test_sums_have_one_owner():
    """Two batches with keys in common, more keys than a row takes, and one batch of held-out texts."""
    keys = [np.arange(a, a + 5_000, dtype=np.uint64) * np.uint64(2**50 + 12_345) for a in (0, 3_000, 4_000)]
    asked = [backoff.asked_rows(b, [(backoff.PAIR, k, [np.full(5_000, b < 2)])], 3, 700) for b, k in enumerate(keys)]
    asked = backoff.pa.Table.from_batches(asked)
    assert max(asked.column("size").to_pylist()) <= 700
    found = {}
    for bucket in range(3):
        for r in backoff.added(asked.filter(backoff.pc.equal(asked.column("bucket"), bucket)), 2).to_pylist():
            found.setdefault(r["batch"], []).append(r | {"level": backoff.PAIR})
    found = {b: backoff.Slice.held(r)[backoff.PAIR][0] for b, r in found.items()}
    want = [np.where((k >= keys[1][0]) & (k <= keys[0][-1]), 2, 0) for k in keys]
    assert all((found[b] >> 1 == want[b]).all() for b in range(3))
    assert ((found[0][3_000:] & 1) + (found[1][:2_000] & 1) == 1).all() and not (found[2] & 1).any()
    assert not (found[0][:3_000] & 1).any()


def test_held_out_texts_fill_batches(spark):
    """One held-out text in seven makes as few batches as its size needs, not one beside each batch of training texts."""
    df = spark.range(2_000).selectExpr("id doc_id", "repeat('some words ', 2000) text", "id % 7 = 2 held_out").coalesce(1)
    held = backoff.sequences(df).select("held_out").collect()
    assert sum(r.held_out for r in held) * 4 < len(held)
