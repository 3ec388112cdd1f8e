"""Prefix trie of rebuilt conversations, by fingerprints that compose.

A rebuilt conversation is the head of another one (its base) followed by its own turns from some place on. Sequences of
turns are elements of a monoid: number of turns, characters, and three polynomial hashes, sums of x(i) B^i modulo primes
of 31 bits. (m, P) followed by (n, Q) is (m + n, P + B^m Q). Prefix products of the original conversations are scanned
once, in slices sorted by conversation and turn: each slice is scanned alone, and the products of what earlier slices
hold of its first conversation, one for each slice, are put in front. So one conversation may spread over many slices.

The hash of a rebuilt prefix is then put together from products alone: the base's head, and the own prefix without its
head, shifted to its new place by a power of B (a negative one is an inverse). No rebuilt text is ever made: turns of
rebuilt conversations refer to the stored ones.

Prefixes of equal depth and hash are one node. This is verified: all members' last turns must have the same reference
class and the same parent, and all stored turns of a class the same role and text; by induction over depth the
sequences are then equal. If a check fails, all hashes are drawn anew.

Sums over subtrees need no walk. A node is owned by its smallest member, and a member's owned nodes are the lower end
of its path. So a subtree's nodes are those from the top downward that its owner owns, and all that other members own.

Turns are ordered by turn (missing first), then role, the text's first 32 characters, and a hash of both. Missing roles
and texts are empty. Rows without a conversation id are left out. Repeated rows are turns of their own. An absent base
gives no head. A conversation may be rebuilt to no turn at all; it is a member of the root. An empty table gives no
node. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.llm.common import kept, met, task
from retailscope.session import slice_count

#: Primes of 31 bits and a base for each of them.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1566083941, 1812433253)
N = range(len(PRIMES))
#: Conversation ids that share a block of a node's list.
BLOCK = 4096
#: A key with this share of all rows counts as hot; so at most so many are.
SHARE = 1024
#: Draws of hashes before giving up.
DRAWS = 3
KEY = ["depth", "a", "b"]


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo the prime."""
    out, square = np.ones(len(exponents), np.uint64), np.uint64(base)
    left, p = exponents.astype(np.uint64), np.uint64(prime)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % p, out)
        square = square * square % p
        left = left >> np.uint64(1)
    return out


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix products within each conversation of one sorted slice, before and after each turn."""
    conv, place, chars, product = None, 0, 0, [0] * len(PRIMES)
    slice_ = task()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column("conv_id").to_numpy()
        sizes = batch.column("n_chars").to_numpy()
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        ahead = start == 0 if ids[0] == conv else np.zeros(n, bool)
        at = np.arange(n) - start + np.where(ahead, place, 0)

        def running(values: np.ndarray, carried: int) -> np.ndarray:
            upto = np.cumsum(values)
            return upto - (upto - values)[start] + np.where(ahead, carried, 0)

        upto = running(sizes, chars)
        columns = {"slice": np.full(n, slice_, np.int32), "conv_id": ids, "place": at, "n_chars": sizes, "chars": upto, "turn_class": batch.column("turn_class").to_numpy()}
        for k, (base, prime) in enumerate(zip(BASES, PRIMES, strict=True)):
            term = (batch.column(f"x{k}").to_numpy().astype(np.uint64) * powers(base, at, prime) % np.uint64(prime)).astype(np.int64)
            after = running(term, product[k]) % prime
            columns[f"q{k}"], columns[f"e{k}"] = after, (after - term) % prime
            product[k] = int(after[-1])
        conv, place, chars = ids[-1], int(at[-1]) + 1, int(upto[-1])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


SCANNED = "slice int, conv_id long, place long, n_chars long, chars long, turn_class long, " + ", ".join(f"q{k} long, e{k} long" for k in N)


def carries(turns: DataFrame) -> list[tuple]:
    """What earlier slices hold of a slice's first conversation: (slice, conv_id, turns, characters, products, powers).

    Needs one row for each slice in the driver.
    """
    last = F.max_by(F.struct("place", "chars", *(f"q{k}" for k in N)), F.struct("conv_id", "place"))
    edges = turns.groupBy("slice").agg(F.min("conv_id").alias("head"), F.max("conv_id").alias("tail"), last.alias("last")).collect()
    out, before = [], (None, 0, 0, [0] * len(PRIMES))
    for edge in sorted(edges, key=lambda e: e.slice):
        conv, turns_, chars, product = before
        total = (edge.tail, edge.last.place + 1, edge.last.chars, [edge.last[f"q{k}"] for k in N])
        if conv == edge.head:
            shift = [pow(BASES[k], turns_, PRIMES[k]) for k in N]
            out.append((edge.slice, conv, turns_, chars, *product, *shift))
            if edge.tail == edge.head:
                total = (conv, turns_ + total[1], chars + total[2], [(product[k] + shift[k] * total[3][k]) % PRIMES[k] for k in N])
        before = total
    return out


def prefixes(conversations: DataFrame, draw: int) -> DataFrame:
    """conv_id, place (from 0), n_chars, chars, turn_class, and products before (e) and after (q) each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    drawn = [F.pmod(F.xxhash64(F.lit(f"{draw}/{k}"), role, text), F.lit(p)).alias(f"x{k}") for k, p in enumerate(PRIMES)]
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 32).alias("start"),
        turn_class(role, text, draw).alias("turn_class"), F.char_length(text).cast("long").alias("n_chars"), *drawn,
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "start", "turn_class"]
    dealt = rows.repartitionByRange(slice_count(conversations.sparkSession), *order).sortWithinPartitions(*order)
    turns = kept(dealt.select("conv_id", "n_chars", "turn_class", *(f"x{k}" for k in N)).mapInArrow(scan, SCANNED), "turns")
    schema = "slice int, conv_id long, _n long, _chars long, " + ", ".join([f"_q{k} long" for k in N] + [f"_s{k} long" for k in N])
    ahead = conversations.sparkSession.createDataFrame(carries(turns), schema)  # one row for each slice at most
    joined = turns.join(F.broadcast(ahead), ["slice", "conv_id"], "left")
    first = F.col("_n").isNull()
    composed = [F.when(first, F.col(f"{x}{k}")).otherwise((F.col(f"_q{k}") + F.col(f"_s{k}") * F.col(f"{x}{k}")) % PRIMES[k]).alias(f"{x}{k}") for k in N for x in "qe"]
    return joined.select("conv_id", (F.col("place") + F.coalesce("_n", F.lit(0))).alias("place"), "n_chars", (F.col("chars") + F.coalesce("_chars", F.lit(0))).alias("chars"), "turn_class", *composed)


def turn_class(role: Column, text: Column, draw: int) -> Column:
    return F.xxhash64(F.lit(draw), role, text)


def classes_hold(conversations: DataFrame, draw: int) -> bool:
    """Whether all stored turns of one class have the same role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(role.alias("role"), text.alias("text"))
    found = conversations.select(turn_class(role, text, draw).alias("turn_class"), turn.alias("turn")).groupBy("turn_class").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    return found.filter("low != high").isEmpty()


@dataclass
class Trie:
    """members: each rebuilt conversation at each depth from 0; nodes: one row each; n: how many of both.

    A member's row has the place of its last turn (turn_conv, turn_place) among the stored conversations' turns.
    """

    conversations: DataFrame
    members: DataFrame
    nodes: DataFrame
    hot: DataFrame


def build(conversations: DataFrame, base: Column, head: Column, longest: int) -> Trie:
    """The trie of conversations rebuilt from the first `head` turns of the one named `base` and the own turns after as many.

    Both are expressions of conv_id; `head` is at most `longest`, a small number.
    """
    for draw in range(DRAWS):
        found = _built(conversations, base, head, longest, draw)
        wrong = (F.col("low_class") != F.col("high_class")) | (F.col("low_parent") != F.col("high_parent"))
        if found.nodes.filter(wrong).isEmpty() and classes_hold(conversations, draw):
            return found
    raise RuntimeError("different sequences of turns have had equal hashes in every draw")


def _built(conversations: DataFrame, base: Column, head: Column, longest: int, draw: int) -> Trie:
    turns = prefixes(conversations, draw)
    item = F.struct("place", "n_chars", "chars", "turn_class", *(f"{x}{k}" for k in N for x in "qe"))
    # at most `longest` turns of each conversation
    heads = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own_turns"), F.max("chars").alias("own_chars"), F.sort_array(F.collect_list(F.when(F.col("place") < longest, item))).alias("head"))
    heads = kept(heads, "heads")
    total = heads.agg(F.coalesce(F.sum("own_turns"), F.lit(0))).first()[0]
    hot = heads.filter(F.col("own_turns") * SHARE > max(total, SHARE)).select("conv_id")
    h = F.col("h")
    named = heads.select("*", base.alias("base"), head.cast("int").alias("h")).join(
        heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head")), "base", "left"
    ).withColumn("taken", F.least(h, F.coalesce(F.size("base_head"), F.lit(0))))

    def upto(head: str, n: Column, field: str) -> Column:
        """A field of the product of a head's first n turns."""
        return F.coalesce(F.get(F.col(head), n - 1)[field], F.lit(0))

    own_left = F.greatest(F.col("own_turns") - h, F.lit(0))
    chars_left = F.when(own_left > 0, F.col("own_chars") - upto("head", h, "chars")).otherwise(0)
    shift = [F.get(F.array(*(F.lit(pow(BASES[k], -d, PRIMES[k])) for d in range(longest + 1))), h - F.col("taken")) for k in N]
    rebuilt = kept(
        named.select(
            "conv_id", "base", "h", "taken", F.slice(F.coalesce("base_head", F.array()), F.lit(1), F.col("taken")).alias("base_head"),
            (F.col("taken") + own_left).alias("turns"), (upto("base_head", F.col("taken"), "chars") + chars_left).alias("total"),
            (upto("base_head", F.col("taken"), "chars") - upto("head", h, "chars")).alias("chars_moved"),
            *(upto("base_head", F.col("taken"), f"q{k}").alias(f"_b{k}") for k in N), *(upto("head", h, f"q{k}").alias(f"_o{k}") for k in N), *(s.alias(f"_s{k}") for k, s in enumerate(shift)),
        ),
        "rebuilt",
    )

    def node(values: list[Column], prefix: str) -> list[Column]:
        return [(F.shiftleft(values[0], 31) + values[1]).alias(f"{prefix}a"), values[2].alias(f"{prefix}b")]

    def moved(x: str) -> list[Column]:
        return [(F.col(f"_b{k}") + F.col(f"_s{k}") * F.pmod(F.col(f"{x}{k}") - F.col(f"_o{k}"), F.lit(PRIMES[k]))) % PRIMES[k] for k in N]

    zero = [F.lit(0).cast("long")] * len(PRIMES)
    none = F.lit(0).cast("long")
    root = rebuilt.select("conv_id", none.alias("depth"), *node(zero, ""), *node(zero, "p"), none.alias("turn_class"), none.alias("n_chars"), none.alias("before"), F.lit(None).cast("long").alias("turn_conv"), F.lit(None).cast("long").alias("turn_place"), F.col("turns").cast("long").alias("turns"), "total")
    taken = rebuilt.select("*", F.explode("base_head").alias("t")).select(
        "conv_id", F.col("t.place") + 1, *node([F.col(f"t.q{k}") for k in N], ""), *node([F.col(f"t.e{k}") for k in N], "p"), "t.turn_class", "t.n_chars", F.col("t.chars") - F.col("t.n_chars"), "base", "t.place", "turns", "total"
    )
    own = met(turns, rebuilt.drop("base_head"), ["conv_id"], hot).filter(F.col("place") >= h).select(
        "conv_id", F.col("place") - h + F.col("taken") + 1, *node(moved("q"), ""), *node(moved("e"), "p"), "turn_class", "n_chars", F.col("chars") - F.col("n_chars") + F.col("chars_moved"), "conv_id", "place", "turns", "total"
    )
    members = kept(root.union(taken).union(own), "members")
    parent = F.struct("pa", "pb")
    nodes = members.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_chars").alias("n_chars"), F.min("before").alias("before"), F.sum("total").alias("all_chars"),
        F.min_by("total", "conv_id").alias("owner_chars"), F.max("turns").alias("deepest"), F.min("turn_class").alias("low_class"), F.max("turn_class").alias("high_class"),
        F.min(parent).alias("low_parent"), F.max(parent).alias("high_parent"), F.min_by(F.struct("turn_conv", "turn_place"), "conv_id").alias("turn"),
    )
    return Trie(rebuilt.select("conv_id", "turns", "total"), members, kept(nodes, "nodes"), hot)


def nodes_of(trie: Trie) -> DataFrame:
    """depth, a and b (the node's name), conv_id (its smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, and turn (conversation and place of the last turn)."""
    nodes = trie.nodes
    owned = nodes.groupBy("conv_id").agg(F.sum("n_chars").alias("owned"), F.max((F.col("deepest") == F.col("depth")).cast("int")).alias("leaf"))
    below = met(trie.members.select("conv_id", *KEY), owned, ["conv_id"], trie.hot).groupBy(*KEY).agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("n_leaves"), F.min_by("owned", "conv_id").alias("owner_owned"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("low_parent.pa").alias("a"), F.col("low_parent.pb").alias("b")]
    children = kept(nodes.filter("depth > 0").select(*up).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children")), "children")
    total = nodes.count()
    parents = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    child = nodes.filter("depth > 0").select(*up, F.struct(*KEY).alias("node"))
    named = met(child, parents, KEY, children.filter(F.col("n_children") * SHARE > max(total, SHARE)).select(*KEY)).select("node.*", "parent_conv_id")
    from_top = F.col("owner_chars") - F.col("before")
    saved = F.col("all_chars") - F.col("n_convs") * F.col("before") - (from_top + F.col("owned") - F.col("owner_owned"))
    return (
        nodes.join(below.select(*KEY, "owned", "owner_owned", "n_leaves"), KEY)
        .join(children, KEY, "left")
        .join(named, KEY, "left")
        .select(*KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"), "turn")
    )


def ends_of(trie: Trie) -> DataFrame:
    """depth, a, b, block and ids: the members that end at a node, ascending, in blocks of at most `BLOCK` ids."""
    ends = trie.members.filter(F.col("depth") == F.col("turns"))
    return ends.groupBy(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))


def digests(ends: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256 of the ids in decimal, joined by commas.

    The digest is sequential by its nature: a node's blocks pass one task one after another and none is held.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for depth, a, b, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if (depth, a, b) != node:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (depth, a, b), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*KEY, "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, digest.hexdigest())], [*KEY, "ends_sha256"])

    text = F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")
    dealt = ends.select(*KEY, "block", text).repartition(*KEY).sortWithinPartitions(*KEY, "block")
    return dealt.select(*KEY, "ids").mapInArrow(job, "depth long, a long, b long, ends_sha256 string")
