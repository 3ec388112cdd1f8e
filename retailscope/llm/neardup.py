"""SimHash near-duplicates by an inverted index over the bytes of the fingerprints.

Fingerprints that differ in at most 3 of 64 bits share at least 5 of their 8 bytes, place for place. So at least 3 of
the shared bytes lie in one half, and the pair meets in one of eight posting lists, each for three places and their
bytes. Pairs that meet are tallied: those with 5 or more equal bytes are verified bit by bit. Long posting lists are
not paired up: they are cut finer, by all ways to choose two more places, into lists of fingerprints with 40 equal
bits. Such a list has at most 2^24 different members, and is linked by a search that visits each member once and looks
for its neighbours either among the members left or among the 2,324 ways to change up to 3 of the other 24 bits.

Equal fingerprints are one node, so copies cost nothing; components come from rounds of large and small stars, each
written to shared storage. Missing or wordless texts have fingerprint zero and link like any other. Repeated rows each
get a result. Rows without an id never name a component; a component of such rows only has none. An empty table gives
an empty result. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.llm.common import kept, parts_of, release, texts_of

BITS = 3
WORDS = 3
SEED = 42
#: Posting lists up to this length are paired up in the plan, longer ones are cut finer and linked in the tasks.
LIST = 64
HALVES = ((0, 1, 2, 3), (4, 5, 6, 7))
TRIPLES = [t for half in HALVES for t in combinations(half, 3)]
FIVES = list(combinations(range(8), 5))


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        return xxh64_intdigest(b" ".join(words), SEED)
    shingles = [b"%b %b %b" % s for s in zip(words, words[1:], words[2:], strict=False)]
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), "<u8", len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                found = np.array([fingerprint(t) for t in texts_of(part)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(job, "doc_id long, fp long")


def mask(places: tuple[int, ...]) -> int:
    """The bytes at these places, as a signed long."""
    return int(np.uint64(sum(255 << 8 * p for p in places)).view(np.int64))


#: For every triple the numbers of the fives that contain it.
WITHIN = [[n for n, five in enumerate(FIVES) if set(t) <= set(five)] for t in TRIPLES]


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a > b: enough links between different fingerprints to connect all that lie within `BITS` bits."""
    fp = F.col("fp")
    postings = nodes.select("fp", F.posexplode(F.array(*(fp.bitwiseAND(F.lit(mask(t))) for t in TRIPLES))).alias("list", "bytes"))
    sizes = postings.groupBy("list", "bytes").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = kept(postings.join(sizes, ["list", "bytes"]), "postings")
    short = met.filter(F.col("size") <= LIST)
    differing = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum(((differing.bitwiseAND(F.lit(mask((p,)))) == 0).cast("int") for p in range(8)), F.lit(0))
    pairs = (
        short.select("list", "bytes", F.col("fp").alias("a"))
        .join(short.select("list", "bytes", F.col("fp").alias("b")), ["list", "bytes"])
        .filter((F.col("a") > F.col("b")) & (tally >= 8 - BITS) & (F.bit_count(differing) <= BITS))
        .select("a", "b")
    )
    fives = F.get(F.array(*(F.array(*map(F.lit, w)) for w in WITHIN)), F.col("list"))
    masks = F.array(*(F.lit(mask(five)) for five in FIVES))
    cells = met.filter(F.col("size") > LIST).select("fp", F.explode(fives).alias("five")).distinct()
    lists = cells.groupBy("five", fp.bitwiseAND(F.get(masks, F.col("five"))).alias("bytes")).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for five, fps in zip(batch.column("five").to_pylist(), batch.column("fps"), strict=True):
                free = sum(255 << (8 * p) for p in range(8) if p not in FIVES[five])
                a, b = linked(fps.values.to_numpy(zero_copy_only=False), free)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return pairs.union(lists.select("five", "fps").mapInArrow(job, "a long, b long")).distinct()


def flips(free: int) -> np.ndarray:
    """All ways to change one to `BITS` of the free bits."""
    bits = [1 << k for k in range(64) if free >> k & 1]
    return np.array([sum(c) for n in range(1, BITS + 1) for c in combinations(bits, n)], np.uint64)


def linked(fps: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning tree of each component of different fingerprints that differ in the free bits only."""
    left = np.sort(np.asarray(fps).view(np.uint64))
    ways = flips(free) if len(left) > 4_000 else None
    if ways is not None and len(left) <= len(ways):
        ways = None
    alive = np.ones(len(left), bool)
    child, parent = [], []
    if ways is None:
        while len(left) > 1:
            frontier = [left[0]]
            left = left[1:]
            while frontier and len(left):
                node = frontier.pop()
                near = np.bitwise_count(left ^ node) <= BITS
                if near.any():
                    found = left[near]
                    left = left[~near]
                    child.append(found)
                    parent.append(np.full(len(found), node))
                    frontier += list(found)
    else:
        for at in range(len(left)):
            if not alive[at]:
                continue
            alive[at] = False
            frontier = [left[at]]
            while frontier:
                node = frontier.pop()
                tries = node ^ ways
                place = np.minimum(np.searchsorted(left, tries), len(left) - 1)
                place = place[(left[place] == tries) & alive[place]]
                if len(place):
                    alive[place] = False
                    child.append(left[place])
                    parent.append(np.full(len(place), node))
                    frontier += list(left[place])
    if not child:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(child).view(np.int64), np.concatenate(parent).view(np.int64)


def stars(edges: DataFrame) -> DataFrame:
    """(a, b), a > b -> every node but the smallest of its component, with that smallest node."""

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = kept(edges, "links")
    before = mark(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = kept(large, "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).filter(F.col("a") > F.col("b")).distinct()
        now = kept(small, "small-stars")
        after = mark(now)
        if after == before:
            break
        before = after
    return now


def rooted(nodes: DataFrame) -> DataFrame:
    """The nodes (fp, first) with the root of their component."""
    roots = stars(links(nodes.select("fp"))).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable over links."""
    prints = kept(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = rooted(kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes"))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that with the smallest id (rows without one come last).

    Copies are combined before anything is shuffled, so a large group costs each task one row.
    """
    nodes = rooted(kept(kept(fingerprints(docs, id_col, text_col), "fingerprints").groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes"))
    chosen = nodes.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("best")).select(F.col("best.fp").alias("fp"))

    @F.arrow_udf("long")
    def print_of(texts: pa.Array) -> pa.Array:
        release()
        return pa.array(np.array([fingerprint(t or "") for t in texts.to_pylist()], np.uint64).view(np.int64))

    # the row travels as one column, whatever its columns are called
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), print_of(F.col(text_col).cast("string")).alias("fp"))
    order = F.struct(F.col("row")[id_col].isNull(), F.col("row")[id_col], F.col("row")[text_col], F.xxhash64("row"))
    return rows.groupBy("fp").agg(F.min_by("row", order).alias("row")).join(chosen, "fp", "left_semi").select("row.*")


#: One-byte-and-more places of a min-wise fingerprint, places that make one posting list, and the least number of equal
#: places of a pair that is verified: four of five are expected at a similarity of 0.8, and 40 of 64 missed once in 5,000.
PLACES, TOGETHER, LEAST = 64, 4, 40
_WAYS = np.random.default_rng(SEED).integers(1 << 63, size=(2, PLACES), dtype=np.int64).view(np.uint64) | np.uint64(1)
PART = 65_536
#: Members of a long list, and bytes of their texts, that meet those of another block, or their own, in one group.
MEET, MEET_BYTES = 1024, 4_000_000


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted different hashes of a text's word shingles; shorter texts have one of all their words, wordless ones none."""
    from xxhash import xxh64_intdigest

    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    listed = [b" ".join(split)] if len(split) < words else map(b" ".join, zip(*(split[k:] for k in range(words)), strict=False))
    return np.unique(np.fromiter((xxh64_intdigest(x, SEED) for x in listed), np.uint64))


def places_of(hashes: np.ndarray) -> np.ndarray:
    """The least of each of `PLACES` mixings of the hashes: two sets agree in a place with the probability of their similarity."""
    out = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), PART):
        mixed = (hashes[at : at + PART, None] * _WAYS[0] + _WAYS[1]) >> np.uint64(32)
        out = np.minimum(out, mixed.min(axis=0).astype(np.uint32))
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def similar_links(nodes: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b), a > b: verified links between nodes (node, places), by an inverted index over their places.

    Every `TOGETHER` neighbouring places make a posting list. First a list's members are paired with three of them, which an
    aggregate names; different lists have different centres. That joins most of what is similar. Then all pairs of a list's
    members that are not yet in one component are compared, so that no link is lost. Lists of up to `LIST` members are paired
    up in the plan. The members of longer ones meet in blocks, with their texts, and a group of two blocks gives no more
    links than it has members, whatever the number of its pairs (`linked_blocks`). Pairs are tallied over all places, and
    those with enough equal ones are verified on their texts (node, text). Links within a component of the first step are
    returned as its star.
    """
    bands = F.array(*(F.xxhash64(F.lit(at), F.substring("places", 4 * at + 1, 4 * TOGETHER)) for at in range(0, PLACES, TOGETHER)))
    postings = kept(nodes.select("node", F.posexplode(bands).alias("band", "bytes")), "postings")
    centres = F.array(F.min("node"), F.max("node"), F.min_by("node", F.xxhash64("node", "band")))
    lists = kept(postings.groupBy("band", "bytes").agg(F.count(F.lit(1)).alias("n"), centres.alias("centres")).filter("n > 1"), "lists")
    met = postings.join(lists.drop("n"), ["band", "bytes"]).select("node", F.explode("centres").alias("centre")).filter("node != centre")
    pairs = met.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()

    @F.arrow_udf("int")
    def equal(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(-1, PLACES) for x in (left, right))
        return pa.array((a == b).sum(axis=1).astype(np.int32))

    @F.arrow_udf("double")
    def exact(left: pa.Array, right: pa.Array) -> pa.Array:
        release()
        return pa.array([similarity(shingles(a, words), shingles(b, words)) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())

    def side(table: DataFrame, name: str, value: str) -> DataFrame:
        return table.select(F.col("node").alias(name), F.col(value).alias(f"{value}_{name}"))

    def verified(likely: DataFrame) -> DataFrame:
        asked = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        stored = kept(texts(asked), "pair-texts")
        met = likely.join(side(stored, "a", "text"), "a").join(side(stored, "b", "text"), "b")
        return met.filter(exact("text_a", "text_b") >= least).select("a", "b")

    enough = equal("places_a", "places_b") >= LEAST
    tallied = pairs.join(side(nodes, "a", "places"), "a").join(side(nodes, "b", "places"), "b").filter(enough)
    found = stars(verified(kept(tallied.select("a", "b"), "likely-pairs")))

    # lists of up to three members have met in all pairs
    roots = nodes.join(found.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))
    longer = kept(postings.join(lists.filter("n > 3").select("band", "bytes"), ["band", "bytes"]).join(roots, "node"), "longer-lists")
    open_ = longer.groupBy("band", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    members = longer.join(open_, ["band", "bytes"])
    short = kept(members.filter(F.col("n") <= LIST).drop("n", "low", "high").join(nodes, "node"), "open-lists")

    def half(name: str) -> DataFrame:
        return short.select("band", "bytes", *[F.col(c).alias(d) for c, d in (("node", name), ("root", f"root_{name}"), ("places", f"places_{name}"))])

    across = half("a").join(half("b"), ["band", "bytes"]).filter((F.col("a") > F.col("b")) & (F.col("root_a") != F.col("root_b")))
    rest = kept(across.filter(enough).select("a", "b").distinct(), "likely-rest")
    if rest.head(1):
        found = found.union(verified(rest.join(pairs, ["a", "b"], "left_anti")))

    long_ = kept(members.filter(F.col("n") > LIST).select("band", "bytes", "node", "root"), "long-lists")
    if not long_.head(1):
        return found
    stored = kept(texts(long_.select("node").distinct()), "list-texts")
    sizes = long_.join(stored.select("node", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")), "node").groupBy("band", "bytes").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(MEET), F.sum("size") / F.lit(MEET_BYTES))).cast("int").alias("blocks")
    )
    dealt = long_.join(sizes, ["band", "bytes"]).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(nodes, "node").join(stored, "node")

    def job(group: pa.Table) -> pa.Table:
        release()
        a, b = linked_blocks(group, words, least)
        return pa.table({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

    meeting = dealt.select("band", "bytes", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "root", "places", "text")
    return found.union(meeting.groupBy("band", "bytes", "p", "q").applyInArrow(job, "a long, b long").distinct())


def linked_blocks(group: pa.Table, words: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of a list's members, or within one: enough to connect all verified pairs of different roots.

    All pairs are tallied; those whose first common list is another one are left to that. Of those with enough equal places,
    the ones not connected yet are verified exactly, each member with all its partners at once.
    """
    band, p, q = (group.column(c)[0].as_py() for c in ("band", "p", "q"))
    own, node, label = (group.column(c).to_numpy() for c in ("own", "node", "root"))
    label = label.copy()
    places = np.frombuffer(b"".join(group.column("places").to_pylist()), np.uint32).reshape(-1, PLACES)
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    near = np.zeros((len(left), len(right)), bool)
    for at, k in enumerate(left):
        equal = places[right] == places[k]
        near[at] = (equal.sum(axis=1) >= LEAST) & (equal.reshape(-1, PLACES // TOGETHER, TOGETHER).all(axis=2).argmax(axis=1) == band) & (label[right] != label[k])
    if p == q:
        near &= node[left, None] > node[None, right]
    asked = np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])
    if not len(asked):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    texts = group.column("text").take(pa.array(asked)).to_pylist()
    sets = [shingles(t, words) for t in texts]
    size = np.zeros(len(node), np.int64)
    size[asked] = list(map(len, sets))
    end = np.cumsum(size)
    different, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(different), bool)
    a, b = [], []
    for at, k in enumerate(left):
        partners = right[near[at]]
        partners = partners[label[partners] != label[k]]
        if not len(partners):
            continue
        mine = flat[end[k] - size[k] : end[k]]
        mark[mine] = True
        upto = np.concatenate([[0], np.cumsum(mark[np.concatenate([flat[end[j] - size[j] : end[j]] for j in partners])])])
        mark[mine] = False
        both = np.diff(upto[np.concatenate([[0], np.cumsum(size[partners])])])
        either = size[k] + size[partners] - both
        similar = partners[np.where(either > 0, both / np.maximum(either, 1), 1.0) >= least]
        for other in similar[np.unique(label[similar], return_index=True)[1]]:
            a.append(node[k])
            b.append(node[other])
            label[label == label[other]] = label[k]
    return np.array(a, np.int64), np.array(b, np.int64)


def one_of_similar(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of texts whose sets of word shingles are similar, with all its columns.

    The group's row is that with the smallest id (rows without one come last, then a hash of the row decides). Texts with
    the same set of shingles are one node. Rows that are equal in every column are one row.
    """
    return _one_of(docs, words, least, id_col, text_col, simhash=False)


def one_of_near(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`one_of_similar` over groups that SimHash fingerprints within `BITS` bits join as well, as `near_duplicates` does.

    A group is a component over both kinds of links, so that neither is lost to what the other has dropped before.
    """
    return _one_of(docs, words, least, id_col, text_col, simhash=True)


def simhash_links(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b), a > b: links between nodes (high, low, node) whose rows (high, low, fp) have near fingerprints."""
    met = prints.select("high", "low", "fp").distinct().join(nodes.select("high", "low", "node"), ["high", "low"]).select("node", "fp")
    met = kept(met, "node-prints")
    first = kept(met.groupBy("fp").agg(F.min("node").alias("first")), "print-nodes")
    equal = met.join(first, "fp").filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = links(first.select("fp"))
    near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return equal.union(near.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))


def _one_of(docs: DataFrame, words: int, least: float, id_col: str, text_col: str, simhash: bool) -> DataFrame:
    @F.arrow_udf("struct<high: long, low: long, places: binary, fp: long>")
    def printed(texts: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest

        release()
        rows = []
        for t in texts.to_pylist():
            found = shingles(t, words)
            fp = int(np.uint64(fingerprint(t or "")).view(np.int64)) if simhash else None
            rows.append([*(xxh64_intdigest(found.tobytes(), k) - (1 << 63) for k in (1, 2)), places_of(found).tobytes(), fp])
        kinds = {"high": pa.int64(), "low": pa.int64(), "places": pa.binary(), "fp": pa.int64()}
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    # the row travels as one column, whatever its columns are called; two hashes stand for it until the end
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    marked = docs.select(row.alias("row")).select("row", F.xxhash64("row").alias("h1"), F.xxhash64(F.lit(1), "row").alias("h2"))
    text, key = F.col("row")[text_col].cast("string"), F.col("row")[id_col]
    order = F.struct(key.isNull().alias("absent"), key.alias("key"), "h1", "h2")
    prints = kept(marked.select(order.alias("best"), printed(text).alias("p")).select("best", "p.*"), "prints")
    nodes = prints.groupBy("high", "low").agg(F.min("best").alias("best"), F.first("places").alias("places"))
    nodes = kept(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def texts(asked: DataFrame) -> DataFrame:
        wanted = nodes.join(asked, "node").select("node", "best.h1", "best.h2")
        return marked.select("h1", "h2", text.alias("text")).join(wanted, ["h1", "h2"]).groupBy("node").agg(F.first("text").alias("text"))

    joined = similar_links(nodes.select("node", "places"), texts, words, least)
    if simhash:
        joined = joined.union(simhash_links(prints, nodes)).distinct()
    roots = stars(joined).select(F.col("a").alias("node"), F.col("b").alias("root"))
    rooted_ = nodes.select("node", "best").join(roots, "node", "left")
    chosen = rooted_.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select("best.h1", "best.h2")
    return marked.join(chosen, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("row").alias("row")).select("row.*")
