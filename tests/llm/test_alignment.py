"""Token groups against a plain walk over whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retailscope.llm import alignment, queries
from tests.conftest import SMALL

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    alphabet = alignment.byte_alphabet()

    def walk(text):
        """Groups [(ids of A, ids of B)] of a whole text by walking over its bytes."""
        if not text:
            return []
        a = first.encode(" " + text, add_special_tokens=False)
        b = second.encode(text)
        bytes_a = [bytes(alphabet[c] for c in t) for t in a.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, second.encode(text, out_type=str))]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return []
        groups, i, j = [], 0, 0
        while i < len(bytes_a):
            own, other, x, y = [a.ids[i]], [b[j]], len(bytes_a[i]), len(bytes_b[j])
            i, j = i + 1, j + 1
            while x != y:
                if x < y:
                    own.append(a.ids[i])
                    x += len(bytes_a[i])
                    i += 1
                else:
                    other.append(b[j])
                    y += len(bytes_b[j])
                    j += 1
            groups.append((own, other))
        return groups

    return walk


def expected(rows, walk):
    found = [(k, walk(t)) for k, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, groups in found for g in groups)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for k, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        line = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if groups else ""
        out.append((k, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def test_op12_on_the_table(spark, plain):
    found = queries.QUERIES["op12_token_groups"](spark, SMALL)
    assert found.columns == COLUMNS
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows, plain)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "\n", "\t\ta", "it's 'quoted'", "don't  stop", "▁", "a▁b", "x ▁",
    "<|endoftext|> <s> </s> <unk> <0x41>", "café naïve", "ﬁ ①", "\U0001f600 \U0001f468‍\U0001f469", "é", "  a", "a　b", "\x00", "a\x1c b", "1,234.50 $%&", "word " * 5_000, "x" * 30_000,
]


def test_odd_rows(spark, plain, tmp_path):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(7, "a  b"), (None, "a b"), (None, None)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("groups", F.lit(1)).withColumn("links", F.lit("x")).write.parquet(f"{path}/documents.parquet")
    found = queries.QUERIES["op12_token_groups"](spark, path)
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows, plain)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op12_token_groups"](spark, str(tmp_path)).collect() == []


def test_other_columns_and_the_groups_themselves(spark, plain):
    docs = spark.createDataFrame([(1, "Tokens of a text")], "key long, body string")
    row = alignment.align(docs, *PATHS, "key", "body").first()
    assert row.groups == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain("Tokens of a text"))


def test_forgetting_changes_nothing(plain):
    own = alignment.Aligner(*PATHS, most=3)
    texts = ["one two three four", "two three five", "one  two", "six seven eight nine ten"] * 2
    for text in texts:
        (found,) = own.align([text])
        assert found[3] == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain(text))


@pytest.fixture(scope="module")
def own():
    return alignment.Aligner(*PATHS)


@given(st.text(alphabet="ab \n'1.é▁ 一", max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text(plain, own, text):
    (found,) = own.align([text])
    assert found[3] == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain(text))


@given(st.lists(st.integers(1, 6), min_size=1, max_size=60), st.randoms())
@settings(max_examples=200, deadline=None)
def test_doubling_reaches_each_terminal(steps, random):
    """Long chains of overlapping tokens take several doublings."""
    ends_a = np.cumsum(steps)
    total = int(ends_a[-1])
    ends_b = np.unique([*random.sample(range(1, total + 1), random.randint(1, total)), total])
    common = np.intersect1d(ends_a, ends_b)
    label = alignment.jumped(ends_a, ends_b)
    assert list(ends_b[label]) == [common[np.searchsorted(common, e)] for e in [*ends_a, *ends_b]]


def test_linkable_pairs_are_bounded_by_the_vocabularies(own):
    assert len(own.pairs) <= 2 * (own.length_a.sum() + own.length_b.sum())
    assert (np.diff(own.pairs) > 0).all()
    for k in range(0, len(own.pairs), 997):
        a, b = own.a.tokens[own.pair_a[k]], own.b.tokens[own.pair_b[k]]
        assert a.endswith(b) or b.endswith(a)
