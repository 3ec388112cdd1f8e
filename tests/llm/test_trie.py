"""The trie of rebuilt conversations against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retailscope.llm import queries, trie
from tests.compare import compare, connect
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [(p, m) for p, m in members.items() if p[: len(path)] == path]
        children = [p for p, _ in below if len(p) == len(path) + 1]
        leaves = [p for p, _ in below if not any(q[:-1] == p for q, _ in below if q)]
        saved = sum((len(m) - 1) * len(p[-1][1]) for p, m in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(1)).withColumn("place", F.lit("x")).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    df = queries.QUERIES["op13_prefix_trie"](spark, str(folder))
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_op13_matches_its_sql(spark):
    ok, message = compare(spark, connect(SMALL), "op13", queries.QUERIES["op13_prefix_trie"], queries.CHECKS["op13_prefix_trie"], SMALL)
    assert ok, message


def test_shared_heads(spark, tmp_path):
    """Copies, long and short conversations, absent bases and one that is rebuilt to nothing."""
    rows = []
    for c in [*range(0, 40), 100, 105, 106, 230, 231, 232, 999, -5, -107]:
        for k in range((c * 7) % 9 + (c % 3 == 0)):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", f"turn {k} of {c % 4 if c < 100 else 0}"))
    assert found(spark, rows, tmp_path) == expected(rows)


def test_odd_rows(spark, tmp_path):
    rows = [
        (0, None, "user", "b"), (0, None, "user", "a"), (0, 3, None, "x"), (0, 3, "", "x"), (0, 1, "user", None), (0, 9, "user", "é\U0001f600"), (0, 9, "user", "é\U0001f600"),
        (None, 0, "user", "left out"), (1, None, None, None), (2, 0, "user", ""), (3, 0, "us", "er"), (4, 0, "use", "r"), (5, -1, "user", "b"), (5, -2, "user", "a"), (207, 0, "user", "alone"),
    ]
    assert found(spark, rows, tmp_path) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_one_conversation_over_many_slices(spark, tmp_path):
    """A conversation with most of all rows is scanned in slices and composed."""
    rows = [(700, k, "user", f"turn {k % 5}") for k in range(600)] + [(703, k, "user", f"turn {k % 5}") for k in range(590)] + [(c, 0, "user", "turn 0") for c in range(8)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in.parquet")
    turns = trie.prefixes(spark.read.parquet(f"{tmp_path}/in.parquet"), 0).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.place) for r in turns] == sorted((c, k) for c, k, _, _ in rows)
    for k in trie.N:
        for a, b in zip(turns, turns[1:], strict=False):
            assert b[f"e{k}"] == (a[f"q{k}"] if a.conv_id == b.conv_id else 0)
    same = {r.place: tuple(r[f"q{k}"] for k in trie.N) for r in turns if r.conv_id == 700}
    assert all(tuple(r[f"q{k}"] for k in trie.N) == same[r.place] for r in turns if r.conv_id == 703)
    assert found(spark, rows, tmp_path / "table") == expected(rows)


def test_collisions_are_seen(spark, tmp_path, monkeypatch):
    """With primes that make nearly all hashes equal, no draw passes; with equal classes neither."""
    rows = [(c, k, "user", f"{c} {k}") for c in range(30) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(trie, "PRIMES", (3, 3, 3))
        m.setattr(trie, "BASES", (2, 2, 2))
        with pytest.raises(RuntimeError):
            trie.build(docs, F.col("conv_id"), F.lit(0), 1)
    monkeypatch.setattr(trie, "turn_class", lambda role, text, draw: F.length(text).cast("long"))
    with pytest.raises(RuntimeError):
        trie.build(docs, F.col("conv_id"), F.lit(0), 1)


def test_a_long_list_of_equal_conversations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = [(c, 0, "user", "the same") for c in range(1_000, 1_090)]
    assert found(spark, rows, tmp_path) == expected(rows)


def test_references_lead_to_the_texts(spark):
    rows = [(0, k, "user", f"base {k}") for k in range(6)] + [(3, k, "user", f"own {k}") for k in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    nodes = trie.nodes_of(trie.build(docs, F.lit(0).cast("long"), F.lit(2), 2)).filter("conv_id = 3").orderBy("depth").collect()
    assert [tuple(n.turn) for n in nodes] == [(3, k) for k in range(2, 8)]
    assert {n.parent_conv_id for n in nodes[1:]} == {3} and nodes[0].parent_conv_id == 0


@given(st.lists(st.lists(st.integers(0, 3), max_size=6), min_size=1, max_size=5), st.integers(0, 5))
@settings(max_examples=50, deadline=None)
def test_products_compose(parts, prime):
    """A product of parts is that of the whole sequence, whatever the cuts."""
    p, base = trie.PRIMES[prime % 3], trie.BASES[prime % 3]
    whole = [x for part in parts for x in part]
    total, n = 0, 0
    for part in parts:
        own = sum(x * pow(base, k, p) for k, x in enumerate(part)) % p
        total, n = (total + pow(base, n, p) * own) % p, n + len(part)
    assert total == sum(x * pow(base, k, p) for k, x in enumerate(whole)) % p
    assert list(trie.powers(base, np.arange(50), p)) == [pow(base, k, p) for k in range(50)]


def test_sql_knows_crc32():
    sql = queries.CHECKS["op13_prefix_trie"]
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM (VALUES (123456789, 0, 'user', 'x')) t(conv_id, turn, role, text)")
    h = zlib.crc32(b"123456789") % 6
    assert len(con.execute(sql).fetchall()) == (2 if h == 0 else 1)
