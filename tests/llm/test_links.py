"""SimHash groups and exact top-k search against brute force."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from retailscope.llm import neardup, topk
from retailscope.llm.queries import CHECKS, QUERIES
from tests.compare import compare, connect
from tests.conftest import SMALL


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = list(nodes)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def check(rows, found):
    prints = {}
    for doc, text in rows:
        prints.setdefault(plain_print(text), []).append(doc)
    roots = plain_components(prints)
    least = {}
    for p, docs in prints.items():
        for d in docs:
            if d is not None:
                least[roots[p]] = min(d, least.get(roots[p], d))
    want = sorted((str(d), f"{p:016x}", str(least.get(roots[p]))) for p, docs in prints.items() for d in docs)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want
    return len(set(roots.values()))


def test_op9_on_the_table(spark):
    t = pq.read_table(f"{SMALL}/documents.parquet")
    rows = list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))
    assert check(rows, QUERIES["op9_simhash_groups"](spark, SMALL).collect()) < len(rows)


def test_odd_rows_of_simhash(spark):
    rows = [(5, None, "p"), (3, "", "p"), (8, " \n", None), (9, "One two", "q"), (4, "one TWO", "q"), (7, "é " * 30_000, "q"), (7, "é " * 30_000, "q"), (None, "one two", "q"), (None, "alone here it is", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    check([r[:2] for r in rows], neardup.near_duplicates(df).collect())
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def nodes_of(spark, values):
    return spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")


def linked_like_brute_force(spark, values):
    roots = plain_components(values)
    got = {int(np.int64(r.a).view(np.uint64)): int(np.int64(r.b).view(np.uint64)) for r in neardup.stars(neardup.links(nodes_of(spark, values))).collect()}
    groups, want = {}, {}
    for v in values:
        groups.setdefault(got.get(v, v), set()).add(v)
        want.setdefault(roots[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_links_at_the_limit_of_three_bits(spark):
    random.seed(7)
    values = set()
    for _ in range(250):
        v = random.getrandbits(64)
        values.add(v)
        for bits in (2, 3, 4):
            values.add(v ^ sum(1 << b for b in random.sample(range(64), bits)))
    linked_like_brute_force(spark, sorted(values))


def test_long_posting_lists(spark, monkeypatch):
    """A large group of near copies and a crowd that shares three bytes without being linked."""
    random.seed(8)
    base = random.getrandbits(64)
    values = {base ^ sum(1 << b for b in random.sample(range(20), random.randint(0, 6))) for _ in range(300)}
    values |= {(base & 0xFFFFFF) | random.getrandbits(40) << 24 for _ in range(300)}
    values |= {(base & 0xFFFFFFFFFF) | random.getrandbits(24) << 40 for _ in range(200)}
    linked_like_brute_force(spark, sorted(values))


def test_both_searches_within_a_list_agree():
    rng = np.random.default_rng(9)
    free = sum(255 << 8 * p for p in (0, 3, 6))
    bits = [b for b in range(64) if free >> b & 1]
    values = {sum(1 << b for b in rng.choice(bits, rng.integers(0, 9), replace=False).tolist()) for _ in range(6000)}
    values = np.array(sorted(values), np.uint64)
    assert len(values) > 4000
    a, b = neardup.linked(values.view(np.int64), free)
    assert (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= 3).all()
    few = values[:1500]
    roots = plain_components(few.tolist())
    a, b = neardup.linked(few.view(np.int64), free)
    assert len(a) == len(few) - len(set(roots.values()))


def test_stars_on_a_chain_and_a_hub(spark):
    edges = [(i + 1, i) for i in range(60)] + [(1000 + i, 500) for i in range(50)] + [(2000, 1049)]
    got = {r.a: r.b for r in neardup.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 500 for i in range(50)} | {2000: 500}


# ---- search


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        own = min(v for i, v in ok if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(own))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return out


def test_op10_against_sql(spark):
    ok, text = compare(spark, connect(SMALL), "op10", QUERIES["op10_block_top_k"], CHECKS["op10_block_top_k"], SMALL)
    assert ok, text


def test_odd_vectors(spark):
    random.seed(10)
    rows = [(i, [random.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(230)]
    rows += [(300 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(60)] + [(0, [0.5] * 4), (50, rows[50][1]), (7, rows[7][1])]
    rows += [(400, None), (450, [None, 1.0, 1.0, 1.0]), (451, [float("nan")] * 4), (452, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (500, [1.0, 2.0]), (501, [3.0, -1.0]), (550, []), (600, [0.1] * 3)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 50 == 0).collect())
    assert got == brute(rows)
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_bounds_skip_blocks():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16)) * 1000
    blocks, at = [], 0
    for c in centres:
        own = np.floor(c + rng.normal(size=(topk.BLOCK, 16)))
        blocks.append((np.arange(at, at + topk.BLOCK).tobytes(), own.tobytes(), own.max(axis=0).tobytes(), own.min(axis=0).tobytes()))
        at += topk.BLOCK
    queries = np.floor(centres)
    best = topk.Best(40, 5)
    scored = topk.search_part(best, np.arange(40), np.full(40, -1), queries, blocks)
    assert scored < 40 * 40 / 4
    every = np.concatenate([np.frombuffer(b[1]).reshape(-1, 16) for b in blocks])
    want = np.sort(queries @ every.T, axis=1)[:, ::-1][:, :5]
    assert (best.scores == want).all()


def test_one_chunk_of_queries_at_a_time(spark, monkeypatch):
    events, gather, keep = [], topk.chunk_search, topk.kept
    monkeypatch.setattr(topk, "CHUNK", 3)
    monkeypatch.setattr(topk, "chunk_search", lambda *a: events.append("gathered") or gather(*a))
    monkeypatch.setattr(topk, "kept", lambda df, label: (keep(df, label), events.append(label))[0])
    rows = [(i, [float(i % 7), float(i % 11), -1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 10 == 0, k=2, scale=1.0).collect())
    want = []
    for q, v in rows[::10]:
        best = sorted((-sum(x * y for x, y in zip(v, o)), i) for i, o in rows if i != q)[:2]
        want += [(q, rank, i, int(-score)) for rank, (score, i) in enumerate(best, 1)]
    assert found == sorted(want)
    assert events[-8:] == ["gathered", "top-k-chunk"] * 4
