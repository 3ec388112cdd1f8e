"""Balanced shards of documents by label propagation under quotas.

Documents are linked through groups: those of one group (equal texts, or the same value of any column) are neighbours. A
document may be in several groups. Links are never listed; a group stands for them by its count in each shard.

All linked documents start in a shard by a hash of their row. In each round every one of them looks for the shard that
holds most members of its groups, itself included, and wishes to move there; equal counts go by a hash of group and
shard, so that members agree. Wishes are counted by source, target, gain and a hash, and the driver cuts these sums, one
number for each pair of shards, to quotas that no shard's capacity is broken by. The wishes with the highest gain move,
up to a limit for each pair of shards; groups of ordinary size move as a whole. Odd rounds let documents wish for any
shard, so that full shards trade; even rounds let them wish for shards with room, so that what doesn't fit into a full
shard gathers in another one. It ends when two rounds in a row move nothing, or after `rounds`.

Quotas leave an eighth more room than there is at the end. At last each shard keeps its linked documents, those of larger
groups first, as far as it has room. Others, group by group, and all documents without neighbours fill the room that is
left. So the shards' counts are at most one apart, always.

Every row is placed, repeated ones and those without an id too. A missing value is in no group of that column. An empty
table gives an empty result. Columns of the input are kept as they are; they travel as one value, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailscope.functions.ordered import running_totals
from retailscope.llm.common import kept, met

SHARDS = 16
ROUNDS = 40
#: A group with this share of all rows counts as large; there are at most so many for each grouping.
SHARE = 1024
#: Classes of hashes within one class of gain, and classes of gain (powers of two).
HASHES, GAINS = 1024, 32
LAST = HASHES * GAINS
#: While labels propagate a shard may hold an eighth more than at the end.
SPARE = 8


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def quotas(wishes: np.ndarray, load: Sequence[int], capacity: Sequence[int]) -> np.ndarray:
    """How many of the wishes[source, target] may be fulfilled at once, so that no shard takes more than it has room for.

    Starts with all and cuts what enters overfull shards, in proportion, until none is left. A shard that is overfull
    from the start takes nothing until it has room.
    """
    moved = wishes.astype(np.int64).copy()
    while True:
        over = np.asarray(load) + moved.sum(axis=0) - moved.sum(axis=1) - np.asarray(capacity)
        entering = moved.sum(axis=0)
        full = np.flatnonzero((over > 0) & (entering > 0))
        if not len(full):
            return moved
        for target in full:
            cut = min(int(over[target]), int(entering[target]))
            share = moved[:, target] * cut // entering[target]
            rest = cut - int(share.sum())
            for source in np.argsort(-(moved[:, target] - share), kind="stable")[:rest]:
                share[source] += 1
            moved[:, target] -= share


def balanced(docs: DataFrame, groups: Sequence[Column], shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of `docs` with `shard` (from 0), `slot` (gapless from 0 in each shard) and `neighbours` (a document has any)."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    links = F.array_compact(F.array(*(F.when(g.isNotNull(), F.xxhash64(F.lit(k), g)) for k, g in enumerate(groups))))
    rows = kept(docs.select(doc, links.alias("groups"), F.monotonically_increasing_id().alias("row")), "rows")
    total = rows.count()
    capacity = capacities(total, shards)
    state, load = propagated(rows, total, [c + -(-c // SPARE) for c in capacity], rounds)

    # the smallest groups of a shard are the last to keep their place
    held = state.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("held"))
    hot = state.filter(F.col("size") * SHARE > total).select("group", "shard").distinct()
    placed = met(state.filter("lead"), held, ["group", "shard"], hot).select("row", "group", "shard", "held")
    joined = rows.join(placed, "row", "left").select(
        "doc", "row", F.coalesce("shard", F.lit(shards)).alias("cell"), (-F.coalesce("held", F.lit(0))).alias("few"), F.coalesce("group", F.lit(0)).alias("group")
    )
    ranked = running_totals(joined, {"rank": F.lit(1).cast("bigint")}, ["few", "group", "row"], ["cell"])
    return _dealt(ranked, load, capacity).select("doc.*", "shard", "slot", "neighbours")


def _dealt(ranked: DataFrame, load: Sequence[int], capacity: Sequence[int]) -> DataFrame:
    """Shard and slot by rank: within a shard's room, or in the room left over. Sums of one number a shard each."""
    shards = len(capacity)
    keeps = [min(a, b) for a, b in zip(load, capacity, strict=True)]
    over = np.cumsum([0] + [a - k for a, k in zip(load, keeps, strict=True)]).tolist()
    room = np.cumsum([0] + [c - k for c, k in zip(capacity, keeps, strict=True)]).tolist()
    longs = lambda values: F.array(*(F.lit(int(v)).cast("bigint") for v in values))
    cell = F.col("cell")
    stays = F.col("rank") <= F.get(longs([*keeps, 0]), cell)
    # place among those without one: what is over in earlier shards, then documents without neighbours
    place = F.col("rank") - 1 - F.get(longs([*keeps, 0]), cell) + F.get(longs(over), cell)
    spare = F.size(F.filter(longs(room[1:]), lambda upto: upto <= F.col("place"))).cast("int")
    dealt = ranked.withColumn("stays", stays).withColumn("place", place).withColumn("spare", F.least(spare, F.lit(shards - 1)))
    return dealt.select(
        "doc",
        F.when(F.col("stays"), cell).otherwise(F.col("spare")).cast("int").alias("shard"),
        F.when(F.col("stays"), F.col("rank") - 1).otherwise(F.col("place") - F.get(longs(room), F.col("spare")) + F.get(longs(keeps), F.col("spare"))).cast("bigint").alias("slot"),
        (cell < shards).alias("neighbours"),
    )


def propagated(rows: DataFrame, total: int, capacity: Sequence[int], rounds: int) -> tuple[DataFrame, list[int]]:
    """Shards of documents with neighbours, one row for each group that a document is in (the first has `lead`), and the shards' loads."""
    shards = len(capacity)
    members = rows.select("row", F.posexplode("groups").alias("at", "group"))
    sizes = kept(members.groupBy("group").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "groups")
    hot = sizes.filter(F.col("size") * SHARE > total).select("group")
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    linked = met(members, sizes, ["group"], hot).select("row", "group", "size", "at", start.alias("shard"))
    # groups of one are gone, so a document's first group is the first that is left
    first = linked.groupBy("row").agg(F.min("at").alias("first"))
    state = kept(linked.join(first, "row").select("row", "group", "size", "shard", (F.col("at") == F.col("first")).alias("lead")), "state")
    load = loads(state, shards)
    idle, tried = 0, set()
    for turn in range(rounds):
        room = [k for k in range(shards) if turn % 2 == 0 or (load[k] < capacity[k] and k not in tried)]
        wishes = kept(wished(state, room, total, capacity[0] // 2, hot, turn), "wishes")
        limits, refused = admitted(wishes, load, capacity)
        # a shard that couldn't take all makes way for another one
        news = set() if turn % 2 == 0 else refused - tried
        tried |= news
        idle = 0 if limits or news else idle + 1
        if idle == 2:
            break
        if limits:
            least = F.get(F.array(*(F.lit(limits.get(k, -1)) for k in range(shards * shards))), F.col("source") * shards + F.col("target"))
            moves = wishes.filter(F.col("rank") <= least).select("row", "target")
            state = kept(state.join(moves, "row", "left").select("row", "group", "size", F.coalesce("target", "shard").alias("shard"), "lead"), "state")
            load = loads(state, shards)
    return state, load


def loads(state: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r.n for r in state.filter("lead").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(k, 0) for k in range(shards)]


def wished(state: DataFrame, room: Sequence[int], total: int, stay: int, hot: DataFrame, turn: int) -> DataFrame:
    """row, source, target and rank (lower moves first) of documents that would rather be in another shard.

    A group's counts are at most one row for each shard; groups that are in one shard only have no wish of their own.
    """
    counts = state.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("group").agg(F.collect_list(F.struct(F.col("shard").alias("target"), "n")).alias("counts"))
    met_ = met(state, listed, ["group"], hot)
    votes = met_.select("row", "shard", "group", "size", F.explode("counts").alias("c")).groupBy("row", "shard", F.col("c.target").alias("target")).agg(
        F.sum("c.n").alias("votes"), F.min("group").alias("group"), F.max("size").alias("size")
    )
    # a group that fits into half a shard leaves one without room, if it has members elsewhere; a larger one stays
    allowed = F.col("target").isin(list(room)) | ((F.col("target") == F.col("shard")) & (F.col("size") > stay))
    own = F.max(F.when(F.col("target") == F.col("shard"), F.col("votes"))).alias("own")
    best = votes.filter(allowed).groupBy("row", "shard").agg(
        F.max(F.struct("votes", F.xxhash64("group", "target").alias("tie"), "target", "group", "size")).alias("best"), own
    ).filter("best.target != shard")
    gain = F.least(F.floor(F.log2(F.greatest(F.col("best.votes") - F.coalesce("own", F.lit(0)), F.lit(0)) + 1)), F.lit(GAINS - 1))
    whole = F.when(F.col("best.size") * SHARE > total, F.col("row")).otherwise(F.col("best.group"))
    rank = (F.lit(GAINS - 1) - gain) * HASHES + F.pmod(F.xxhash64(F.lit(turn), whole), F.lit(HASHES))
    return best.select("row", F.col("shard").alias("source"), F.col("best.target").alias("target"), rank.cast("int").alias("rank"))


def admitted(wishes: DataFrame, load: Sequence[int], capacity: Sequence[int]) -> tuple[dict[int, int], set[int]]:
    """The highest rank that may move, by source x shards + target, and the shards that can't take all who wish.

    One number for each pair of shards reaches the driver.
    """
    shards = len(capacity)
    ranks = wishes.groupBy("source", "target", "rank").agg(F.count(F.lit(1)).alias("n"))
    sums = np.zeros((shards, shards), np.int64)
    for r in ranks.groupBy("source", "target").agg(F.sum("n").alias("n")).collect():
        sums[r.source, r.target] = r.n
    moved = quotas(sums, load, capacity)
    out = {int(k): LAST for k in np.flatnonzero((moved == sums) & (sums > 0))}
    partly = [int(k) for k in np.flatnonzero((moved < sums) & (moved > 0))]
    if partly:
        pair = F.col("source") * shards + F.col("target")
        most = F.get(F.array(*(F.lit(int(m)).cast("bigint") for m in moved.ravel())), F.col("pair"))
        # at most LAST rows for each pair of shards
        upto = F.sum("n").over(Window.partitionBy("pair").orderBy("rank"))
        fits = ranks.select(pair.alias("pair"), "rank", "n").filter(F.col("pair").isin(partly)).withColumn("upto", upto).filter(F.col("upto") <= most)
        out |= {r.pair: r.rank for r in fits.groupBy("pair").agg(F.max("rank").alias("rank")).collect()}
    return out, {int(k) for k in np.flatnonzero((moved < sums).any(axis=0))}
