"""Groups of similar texts against all pairs compared exactly."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from retailscope.llm import neardup

BIG = "/root/testdata/sf0.1"


def shingle_set(text, words=5):
    split = (text or "").encode().lower().split()
    return frozenset(tuple(split[k : k + words]) for k in range(max(1, len(split) - words + 1))) if split else frozenset()


def similar_pairs(sets, least=0.8):
    """All pairs of different sets at `least` or more: two such sets share one of the rarest fifth of each."""
    counts = Counter(s for x in sets for s in x)
    rank = {s: k for k, (s, _) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0])))}
    index, pairs = defaultdict(list), set()
    for at, x in enumerate(sets):
        rarest = sorted(rank[s] for s in x)[: len(x) - -(-len(x) * 8 // 10) + 1]
        near = {other for s in rarest for other in index[s]}
        pairs |= {(other, at) for other in near if len(x & sets[other]) / len(x | sets[other]) >= least}
        for s in rarest:
            index[s].append(at)
    return pairs


def groups_of(texts):
    """The smallest id of the group of each id, by exact similarity."""
    by_set = defaultdict(list)
    for k, t in texts.items():
        by_set[shingle_set(t)].append(k)
    sets = list(by_set)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = similar_pairs(sets)
    for a, b in pairs:
        parent[root(a)] = root(b)
    least = {}
    for at, x in enumerate(sets):
        least[root(at)] = min([*by_set[x], least.get(root(at), by_set[x][0])])
    return {k: least[root(at)] for at, x in enumerate(sets) for k in by_set[x]}, [(by_set[sets[a]][0], by_set[sets[b]][0]) for a, b in pairs]


def smallest_of_similar(texts):
    return sorted(set(groups_of(texts)[0].values()))


def test_recall_over_differing_sets(spark):
    """All similar pairs of different shingle sets in the largest table; the stage keeps one document of each group."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    groups, pairs = groups_of(texts)
    kept = {r.doc_id for r in neardup.one_of_similar(docs).select("doc_id").collect()}
    assert len(pairs) >= 40
    lost = [p for p in pairs if p[0] in kept and p[1] in kept]
    assert len(lost) <= 0.1 * len(pairs)
    # nothing that has no similar document goes
    assert set(groups.values()) <= kept
    assert len(kept) - len(set(groups.values())) <= 0.1 * len(pairs)


def near_copies(rng, base, n, changed):
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.choice(len(words), changed, replace=False):
            words[at] = f"w{rng.integers(1_000_000)}"
        out.append(" ".join(words))
    return out


def test_large_groups_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = [f"b{k}" for k in range(200)]
    texts = near_copies(rng, base, 300, 2) + [" ".join(base)] * 200 + [f"text number {k} of its own with words {k + 1}" for k in range(50)]
    texts += [None, "", " \n", None, "one two", "ONE  two", "one two three"]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, " ".join(base), "y"), (None, "no id here at all but five words", "y"), (5, texts[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string").withColumn("row", F.lit(1)).repartition(5)
    found = neardup.one_of_similar(docs)
    assert found.columns == ["doc_id", "text", "places", "row"]
    got = [r.doc_id for r in found.collect()]
    want = smallest_of_similar({k: t for k, t in enumerate(texts)})
    assert sorted(k for k in got if k is not None) == want and got.count(None) == 1


def test_empty_table(spark):
    assert neardup.one_of_similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_places_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    shared = rng.integers(1 << 62, size=800).astype(np.uint64)
    a, b = (np.unique(np.concatenate([shared, rng.integers(1 << 62, size=100).astype(np.uint64)])) for _ in range(2))
    assert abs((neardup.places_of(a) == neardup.places_of(b)).mean() - neardup.similarity(a, b)) < 0.15
    assert neardup.similarity(a[:0], b[:0]) == 1 and neardup.similarity(a[:0], b) == 0


def test_partners_that_are_no_centres_are_found(spark, monkeypatch):
    """Pairs that only share lists of many other texts: none of the two need be among a list's centres."""
    rng = np.random.default_rng(3)
    shared = [f"s{k}" for k in range(300)]
    texts = []
    for k in range(40):  # similar within a pair only, two texts of different pairs at about 0.6
        base = shared + [f"own{k}-{j}" for j in range(100)]
        texts += near_copies(rng, base, 2, 2)
    want = smallest_of_similar(dict(enumerate(texts)))
    assert len(want) == 40
    monkeypatch.setattr(neardup, "MEET", 7)
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(int(k), texts[k]) for k in order], "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in neardup.one_of_similar(docs).select("doc_id").collect()) == want


def test_every_pair_of_a_list_is_compared(spark, monkeypatch):
    """One list of pairs of equal places: links between members that are never centres."""
    monkeypatch.setattr(neardup, "MEET", 5)
    rng = np.random.default_rng(4)
    rows, texts = [], []
    for k in range(30):  # the first band is common to all, the others to the two of a pair
        own = rng.integers(1 << 32, size=neardup.PLACES, dtype=np.uint64).astype(np.uint32)
        own[: neardup.TOGETHER] = 7
        for at in range(2):
            places = own.copy()
            places[neardup.TOGETHER + 1 :: neardup.TOGETHER] = rng.integers(1 << 32, size=15, dtype=np.uint64).astype(np.uint32)
            rows.append((2 * k + at, bytearray(places.tobytes())))
            texts.append((2 * k + at, f"text number {k} " * 9))
    nodes = spark.createDataFrame(rows, "node long, places binary")
    stored = spark.createDataFrame(texts, "node long, text string")
    links = neardup.stars(neardup.similar_links(nodes, lambda asked: stored.join(asked, "node"), 5, 0.8)).collect()
    assert sorted((r.a, r.b) for r in links) == [(2 * k + 1, 2 * k) for k in range(30)]


def test_a_long_list_of_barely_similar_copies_gives_few_rows(spark, monkeypatch):
    """Copies of one text, many of them at less than 0.8: as many links as members at most, and the groups of all pairs."""
    monkeypatch.setattr(neardup, "MEET", 20)
    monkeypatch.setattr(neardup, "LIST", 3)
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(200)]
    texts = [t for changed in (2, 6, 9, 12, 15) for t in near_copies(rng, base, 30, changed)]
    want = smallest_of_similar(dict(enumerate(texts)))
    assert 10 < len(want) < 140
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in neardup.one_of_similar(docs).select("doc_id").collect()) == want

    sets = [neardup.shingles(t, 5) for t in texts]
    places = [neardup.places_of(s) for s in sets]
    nodes = spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in enumerate(places)], "node long, places binary")
    stored = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    wrote = []
    monkeypatch.setattr(neardup, "kept", lambda df, label, *rest, own=neardup.kept: wrote.append((label, own(df, label, *rest))) or wrote[-1][1])
    links = neardup.stars(neardup.similar_links(nodes, lambda asked: stored.join(asked, "node"), 5, 0.8)).collect()
    roots = {r.a: r.b for r in links}
    assert sorted({roots.get(k, k) for k in range(len(texts))}) == want
    # what meets in lists of more than three is in no table of pairs
    assert [df.count() for label, df in wrote if label == "likely-rest"] == [0]


def test_blocks_verify_pairs_exactly():
    """Links of two blocks of a list connect what exact similarity connects; pairs of another first list are left to it."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts = near_copies(rng, [f"b{k}" for k in range(200)], 60, 2) + ["", None, "one", "two words"]
    places = [neardup.places_of(neardup.shingles(t, 5)) for t in texts]
    for p in places:
        p[: neardup.TOGETHER] = 9
    n = len(texts)
    group = pa.table({"band": pa.array([0] * n, pa.int32()), "p": [0] * n, "q": [1] * n, "own": np.arange(n) % 2, "node": np.arange(n), "root": np.arange(n), "places": [p.tobytes() for p in places], "text": texts})
    a, b = neardup.linked_blocks(group, 5, 0.8)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        assert (x + y) % 2 and root(x) != root(y)
        parent[root(x)] = root(y)
    found = [root(k) for k in range(n)]
    parent = list(range(n))
    sets = [neardup.shingles(t, 5) for t in texts]
    for x in range(0, n, 2):
        for y in range(1, n, 2):
            if (places[x] == places[y]).sum() >= neardup.LEAST and neardup.similarity(sets[x], sets[y]) >= 0.8:
                parent[root(x)] = root(y)
    want = [root(k) for k in range(n)]
    assert [found.index(x) for x in found] == [want.index(x) for x in want] and len(set(want)) < n - 10
    other = group.set_column(0, "band", pa.array([1] * n, pa.int32()))
    assert not len(neardup.linked_blocks(other, 5, 0.8)[0])


def test_the_stage_joins_near_fingerprints_too(spark):
    """Copies that repeat the same lines: SimHash finds them and the sets of shingles don't; groups chain over both links."""
    import corpus_pipeline

    line = " ".join(f"b{k}" for k in range(31))  # an odd number of shingles when it is repeated: no bit of theirs is undecided
    own = [" ".join(f"{c}{k}" for k in range(20)) for c in "uvw"]
    texts = {k: " ".join([line] * 40 + [x]) for k, x in enumerate(own)}
    texts[3] = f"{line} {own[2]}"  # the set of shingles of the third, nearly, without its repeats
    texts[4] = " ".join(f"other{k}" for k in range(60))
    near = np.bitwise_count(np.uint64(neardup.fingerprint(texts[0])) ^ np.uint64(neardup.fingerprint(texts[1])))
    assert near <= neardup.BITS and neardup.similarity(*(neardup.shingles(texts[k], 5) for k in (0, 1))) < 0.8
    assert np.bitwise_count(np.uint64(neardup.fingerprint(texts[2])) ^ np.uint64(neardup.fingerprint(texts[3]))) > neardup.BITS
    rows = [(k + 1, t) for k, t in texts.items()] + [(None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(neardup.one_of_similar(docs).collect()) > 3
    assert sorted(r.doc_id for r in corpus_pipeline.no_copies(spark, docs, "").collect()) == [1, 5, 9]
    assert corpus_pipeline.no_copies(spark, docs.limit(0), "").collect() == []
