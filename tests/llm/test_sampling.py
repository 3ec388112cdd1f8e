"""Sampled segmentations against enumeration of all of them, and exact round trips."""

import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from retailscope.llm import sampling
from retailscope.llm.queries import QUERIES
from tests.conftest import SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return sampling.Vocabulary(PATH)


def every(vocabulary, text):
    """ids -> probability, by listing all segmentations."""
    text = vocabulary.normal(text)
    piece = {vocabulary.processor.id_to_piece(i): i for own in vocabulary.lengths.values() for i in own.ids[:-1].tolist()}
    out = {}

    def go(at, ids, weight):
        if at == len(text):
            out[tuple(ids)] = weight
        for n in range(1, vocabulary.longest + 1):
            i = piece.get(text[at : at + n]) if at + n <= len(text) else None
            if i is not None:
                go(at + n, [*ids, i], weight + vocabulary.weight[i])
        if at < len(text) and text[at] not in piece:
            raw = text[at].encode()
            go(at + 1, [*ids, *vocabulary.bytes_id[list(raw)].tolist()], weight + vocabulary.byte_weight * len(raw))

    go(0, [], 0.0)
    bottom = np.logaddexp.reduce(list(out.values()))
    return {k: math.exp(v - bottom) for k, v in out.items()}


def drawn(vocabulary, text, rows, k):
    keys = sampling.mixed(np.arange(rows, dtype=np.uint64))
    return [x for at in range(0, rows, 2000) for x in sampling.sample_texts(vocabulary, [text] * len(keys[at : at + 2000]), keys[at : at + 2000], k)]


def test_probabilities_and_shares_are_those_of_all_segmentations(vocabulary):
    want = every(vocabulary, "then a\u0001 it")
    assert len(want) > 20
    rows = 6000
    found = drawn(vocabulary, "then a\u0001 it", rows, 3)
    first, included = {}, {}
    for own in found:
        keys = [tuple(ids.tolist()) for ids, *_ in own]
        assert len(set(keys)) == 3
        values = [v for _, _, v, _ in own]
        assert values == sorted(values, reverse=True)
        first[keys[0]] = first.get(keys[0], 0) + 1
        for key, (_, log, _, inclusion) in zip(keys, own, strict=True):
            assert abs(math.exp(log) - want[key]) < 1e-9
            included[key] = included.get(key, 0) + 1 / inclusion
    for key, p in want.items():
        assert abs(first.get(key, 0) / rows - p) < 5 * math.sqrt(p * (1 - p) / rows) + 1e-3
    # 1 / inclusion estimates a count of one for every segmentation, so its sum over a likely one is near the rows
    best = max(want, key=want.get)
    assert abs(included[best] / rows - 1) < 0.1
    # without replacement: the second is drawn from what the first left
    second = {}
    for own in found:
        key = tuple(own[1][0].tolist())
        second[key] = second.get(key, 0) + 1
    for key in sorted(want, key=want.get)[-5:]:
        p = sum(q * want[key] / (1 - q) for other, q in want.items() if other != key)
        assert abs(second.get(key, 0) / rows - p) < 5 * math.sqrt(p * (1 - p) / rows) + 1e-3


def test_all_segmentations_if_there_are_few(vocabulary):
    want = every(vocabulary, "of")
    own = drawn(vocabulary, "of", 1, 60)[0]
    assert {tuple(ids.tolist()) for ids, *_ in own} == set(want)
    assert all(i == 1 for *_, i in own)
    assert [len(ids) for ids, *_ in drawn(vocabulary, "", 1, 5)[0]] == [0]


def test_round_trip_and_seeds(vocabulary):
    texts = ["", "a", "  two  spaces  ", "naïve \U0001f600 日本語 \x01", "x" * 3000, "w1 w2\n\nw3\t", "▁ mark"]
    keys = sampling.mixed(np.arange(len(texts), dtype=np.uint64))
    found = sampling.sample_texts(vocabulary, texts, keys, 2)
    for text, own in zip(texts, found, strict=True):
        for ids, *_ in own:
            assert vocabulary.decode(ids.tolist()) == vocabulary.processor.decode(ids.tolist())
            assert vocabulary.decode(ids.tolist()) == text.replace("▁", " ")
    alone = [sampling.sample_texts(vocabulary, [t], keys[n : n + 1], 2)[0] for n, t in enumerate(texts)]
    assert [[x[0].tolist() for x in own] for own in found] == [[x[0].tolist() for x in own] for own in alone]


def test_op8_on_the_table(spark):
    rows = QUERIES["op8_sampled_pieces"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    by_doc = {}
    for r in rows:
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for own in by_doc.values():
        assert len({(r.n_pieces, r.ids_crc32) for r in own}) == len(own)
        assert all(0 < r.inclusion <= 1 for r in own) or max(r.log_prob for r in own) < -500


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "no key", "y"), (3, "same text", "z"), (3, "same text", "z"), (4, "long " * 20_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sample string").repartition(3)
    found = sampling.sample(df, PATH, k=3, with_ids=True)
    held = found.collect()
    assert [r.n_pieces for r in held if r.doc_id in (1, 2)] == [0, 0]
    same = sorted(tuple(r.ids) for r in held if r.doc_id == 3)
    assert len(same) == 6 and same[::2] == same[1::2]
    texts = {r.text for r in sampling.decode(found, PATH).collect()}
    assert texts == {"", "no key", "same text", "long " * 20_000}
    assert sampling.sample(df.limit(0), PATH).count() == 0


def test_texts_are_searched_together(vocabulary, monkeypatch):
    """As many rounds for many texts as for the longest, and the samples are those of each text alone."""
    texts = ["many words to leave a path at " * n for n in range(1, 60)]
    keys = sampling.mixed(np.arange(len(texts), dtype=np.uint64))
    rounds, leaves = [], sampling.leaves
    monkeypatch.setattr(sampling, "leaves", lambda *a: rounds.append(1) or leaves(*a))
    found = sampling.sample_texts(vocabulary, texts, keys, 3)
    together = len(rounds)
    alone = [sampling.sample_texts(vocabulary, [t], keys[n : n + 1], 3)[0] for n, t in enumerate(texts)]
    assert together < (len(rounds) - together) / 10
    assert [[(x[0].tolist(), x[1:]) for x in own] for own in found] == [[(x[0].tolist(), x[1:]) for x in own] for own in alone]


def test_lattices_have_every_piece(vocabulary):
    """Pieces of all lengths as words of their own, also where no shorter piece begins them."""
    pieces = [vocabulary.processor.id_to_piece(int(i)) for own in vocabulary.lengths.values() for i in own.ids[:-1][::50]]
    lattice = sampling.Lattice(vocabulary, pieces)
    known = {vocabulary.processor.id_to_piece(int(i)): int(i) for own in vocabulary.lengths.values() for i in own.ids[:-1]}
    edges = set(zip(lattice.source.tolist(), lattice.target.tolist(), lattice.kind.tolist(), strict=True))
    want = {(first + a, first + b, known[p[a:b]]) for first, p in zip(lattice.entry.tolist(), pieces, strict=True) for a in range(len(p)) for b in range(a + 1, len(p) + 1) if p[a:b] in known}
    assert {e for e in edges if e[2] >= 0} == want
    assert max(map(len, pieces)) == vocabulary.longest or len(pieces) > 500
