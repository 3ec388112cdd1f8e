"""Huffman files and packing against plain versions of the same contracts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from retailscope.llm import huffman, packing
from retailscope.llm.common import TokenCache
from retailscope.llm.queries import QUERIES
from tests.conftest import SMALL

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", " a b ", "x\n y\n\nz", "naïve 'll it's  ", "a  b 　c d", "<|endoftext|> x <|endoftext|>", "\x1c a \x1f b", "é" * 3000, "12 34+5  6", "\t\tq w", "日本語 テキスト 。", "a b\n", "\U0001f600 \U0001f600 ok"]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def documents():
    t = pq.read_table(f"{SMALL}/documents.parquet")
    return t.column("doc_id").to_pylist(), t.column("text").to_pylist()


def test_cached_ids_are_those_of_whole_texts(documents):
    texts = documents[1] + ODD
    texts += ["a\n\nb c", "don't 'tis x'll", "l’été d'a", "ab12cd 3e4 .5f", "a.\nB c", "naïve,x Ünd? ß! ab\u00a0cd ª", "ĀĂ ab", "  ", "\n a b"]
    cache = TokenCache(VOCABULARY, most=500)
    got = [x for at in range(0, len(texts), 50) for x in cache.encode(texts[at : at + 50], 7)]
    assert [x.tolist() for x in got] == [[*x, 7] for x in plain_ids(texts)]


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 300):
        counts = (rng.pareto(0.4, n) * 10 + 1).astype(np.int64)
        lengths = huffman.code_lengths(counts, 12)
        assert lengths.max() <= 12
        assert n == 1 or sum(2.0 ** -lengths.astype(float)) == 1
    # against the plain tree, where no limit binds
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13])
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost, extra = 0, len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        extra += 1
        heapq.heappush(heap, (a[0] + b[0], extra))
    assert (huffman.code_lengths(counts) * counts).sum() == cost


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.pareto(0.5, 5000) * 3, 49_999).astype(np.uint32)
    counts = np.bincount(ids)
    lengths = huffman.code_lengths(counts)
    codes = huffman.codes_of(lengths)
    parts = [ids[:1], ids[1:1000], ids[1000:1256], ids[1256:]]
    packed = [huffman.pack(p, lengths, codes) for p in parts]
    back = huffman.Decoder(lengths).blocks([p for p, _ in packed], [m for _, m in packed], [len(p) for p in parts])
    assert all((a == b).all() for a, b in zip(parts, back, strict=True))
    assert (huffman.widen(huffman.narrow(ids)) == ids).all()
    wide = np.array([1, 70_000, 3], "<u4")
    assert (huffman.widen(huffman.narrow(wide)) == wide).all()


def test_op2_on_the_table(spark, documents):
    found = {r.doc_id: r for r in QUERIES["op2_huffman_ids"](spark, SMALL).collect()}
    start = 0
    for doc, ids in sorted(zip(documents[0], plain_ids(documents[1]), strict=True)):
        ids = [*ids, 0]
        assert (found[doc].start, found[doc].n_tokens, found[doc].ids_crc32) == (start, len(ids), digest(ids))
        start += len(ids)
    assert len(found) == len(documents[0])


def odd_rows(spark):
    rows = [(i, x, "clash") for i, x in enumerate(ODD)] + [(3, ODD[3], "again"), (None, "no id", None), (99, None, None), (98, "w " * 4000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3), rows


def test_files_with_odd_rows(spark):
    df, rows = odd_rows(spark)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32, r.ids) for r in huffman.read(spark, huffman.encode_documents(df, VOCABULARY), with_ids=True).collect())
    want = sorted((d is not None, d or 0, len(i) + 1, digest([*i, 0]), [*i, 0]) for (d, _, _), i in zip(rows, plain_ids([r[1] for r in rows]), strict=True))
    assert got == want
    empty = huffman.encode_documents(df.limit(0), VOCABULARY)
    assert huffman.read(spark, empty).count() == 0


def check_packing(rows, want, capacity):
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, ids in want.items():
        at = 0
        for n, r in enumerate(sorted(by_doc.pop(doc), key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, digest(ids[at : at + r.length]))
            assert n == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_op3_on_the_table(spark, documents):
    want = {d: [*i, 2] for d, i in zip(*[documents[0], plain_ids(documents[1])], strict=True)}
    used = check_packing(QUERIES["op3_best_fit_packing"](spark, SMALL).collect(), want, 1024)
    assert used <= 1.02 * -(-sum(map(len, want.values())) // 1024) + 1


def test_packing_with_odd_rows(spark):
    df, rows = odd_rows(spark)
    df = df.filter(F.coalesce(F.col("start"), F.lit("")) != "again")
    rows = [r for r in rows if r[2] != "again"]
    want = {d: [*i, 2] for (d, _, _), i in zip(rows, plain_ids([r[1] for r in rows]), strict=True)}
    check_packing(packing.pack(df, VOCABULARY, capacity=64).collect(), want, 64)
    twice = packing.pack(df.union(df), VOCABULARY, capacity=64)
    assert twice.count() == 2 * packing.pack(df, VOCABULARY, capacity=64).count()
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


def test_fullest_is_the_best_sum():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(60):
        items = rng.integers(1, 30, rng.integers(0, 10)).tolist()
        space = int(rng.integers(0, 60))
        counts = np.bincount(items, minlength=61)
        chosen = packing.fullest(counts, space)
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= space)
        assert sum(chosen) == best
        assert (np.bincount(chosen, minlength=61) <= counts).all()


def test_few_bins_for_uneven_counts():
    counts = np.zeros(1025, np.int64)
    rng = np.random.default_rng(4)
    for length in np.minimum(rng.lognormal(5.5, 1.0, 20_000).astype(int) + 1, 1024):
        counts[length] += 1
    plan = packing.plan_bins(counts, 1024)
    assert sum(t * np.bincount(c, minlength=1025) for t, c in plan).tolist() == counts.tolist()
    assert sum(t for t, _ in plan) <= 1.01 * -(-int((counts * np.arange(1025)).sum()) // 1024)


def test_a_full_cache_keeps_the_words_at_hand():
    """Words that come again are not encoded again, and what the texts at hand don't hold goes."""
    cache = TokenCache(VOCABULARY, most=8)
    first = ["the cat, the dog.\nThen nine more, seven birds and some rather long words"] * 3
    asked, raw = [], cache.raw
    cache.raw = lambda texts: asked.extend(t for t in texts if t.startswith(" ")) or raw(texts)
    once = cache.encode(first, 7)
    assert asked
    asked.clear()
    again = cache.encode(first, 7)
    assert asked == [] and all(np.array_equal(a, b) for a, b in zip(once, again, strict=True))
    cache.encode(["wholly other things"], 7)
    assert "cat," not in cache.words and len(cache.words) < 8
    assert [x.tolist() for x in cache.encode(["a b1, é.\nÉt 'tis it's %%% x\ty"], 7)] == [cache.tokenizer.encode("a b1, é.\nÉt 'tis it's %%% x\ty", add_special_tokens=False).ids + [7]]


def test_parts_of_any_size_give_the_same_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k} of a text, " * (k % 7)) for k in range(40)] + [(None, None)], "doc_id long, text string")
    found = []
    for part in (1, 100, 10_000_000):
        monkeypatch.setattr(huffman, "PART", part)
        blocks = huffman.token_blocks(docs, VOCABULARY, 0).collect()
        found.append(sorted((d if d is not None else -1, n) for b in blocks for d, n in zip(b.doc_ids, b.lengths, strict=True)))
    assert found[0] == found[1] == found[2] and len(found[0]) == 41


def test_words_encoded_as_one_text_have_their_own_ids(monkeypatch):
    """Unseen words share texts: fewer texts than words, and the ids of each word alone."""
    cache = TokenCache(VOCABULARY)
    words = ["a", "it's", "'", "x\ny", "a\n\nb", "Ġodd", "<|endoftext|>", "naïve", "日本語", "\U0001f600", "1234.5", "...", " x ", "x​y", "Word" * 40] + [f"w{i}-{i * i}" for i in range(1_500)]
    alone = cache.raw([" " + w for w in words])
    texts, encode = [], cache.tokenizer.encode_batch_fast

    class Counting:
        def encode_batch_fast(self, some, **kind):
            texts.extend(some)
            return encode(some, **kind)

    cache.tokenizer = Counting()
    assert cache.spaced(words) == alone
    assert len(texts) < len(words)
    assert cache.spaced([]) == []
    monkeypatch.setattr(cache, "opens", ~cache.opens)  # where cuts aren't certain, each word is encoded alone
    assert cache.spaced(words) == alone


def test_words_with_marks_are_kept_in_parts():
    """A word is encoded and kept once, whatever marks follow it; all kinds of neighbours give the ids of whole texts."""
    cache = TokenCache(VOCABULARY)
    cache.encode(["cat, (cat) cat.\nDog cat; cat7"], 0)
    assert set(cache.words) == {"cat", ",", " (", ")", " cat", ".\n", "Dog", ";", "7"}
    rng = np.random.default_rng(5)
    signs = ["a", "B", "é", "ß", "×", "÷", "'", "\n", " ", " ", "  ", "\t", ".", "1", "日", "ª", "\x1c", " ", "Ā", "-", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 12, 5_000)] + ["", " ", "\n", ".\nA", ".\n A", "A.\n", "(\nA b"]
    for at in range(0, len(texts), 500):
        got = cache.encode(texts[at : at + 500], 7)
        assert [x.tolist() for x in got] == [[*x, 7] for x in plain_ids(texts[at : at + 500])]
