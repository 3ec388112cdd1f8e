"""Documents packed into few sequences of bounded length by minimum bin slack.

Only the counts of piece lengths (at most one for each length) decide the packing. Each bin takes the longest piece
left and then the fullest feasible combination of the others, found by a subset-sum over a bitset; the same
combination is taken as often as pieces allow, which is what repeating the search would find. Pieces then find their
place by their rank among the pieces of their length, so that no task holds more than its own rows.

Missing texts count as empty (the end id alone). Repeated rows are packed as often as they occur. Rows without an id
keep their empty id. An empty table gives no pieces. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailscope.llm.common import crc32, kept, release, slices, task, texts_of, token_cache

#: Words that a task remembers, and bytes of texts that it encodes together.
CACHED = 800_000
PART = 8_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are full."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))] if total else []


def fullest(counts: np.ndarray, space: int) -> list[int]:
    """Lengths (ascending index into `counts`, repeats allowed) whose sum fills `space` best; longer ones preferred."""
    reach, mask = 1, (1 << (space + 1)) - 1
    layers = []
    for length in range(min(space, len(counts) - 1), 0, -1):
        have = min(int(counts[length]), space // length)
        taken = 1
        while have > 0:
            taken_now = min(taken, have)
            layers.append((length, taken_now, reach))
            reach = (reach | reach << (length * taken_now)) & mask
            have -= taken_now
            taken *= 2
        if reach >> space & 1:
            break
    best = reach.bit_length() - 1
    chosen = []
    for length, taken, before in reversed(layers):
        if not before >> best & 1:
            best -= length * taken
            chosen += [length] * taken
    return chosen


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of one bin), over all pieces; `counts[length]` pieces of each length."""
    counts = counts.copy()
    plan = []
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return plan
        counts[longest] -= 1
        combination = [longest, *fullest(counts, capacity - longest)]
        counts[longest] += 1
        need = np.bincount(combination, minlength=len(counts))
        times = int((counts[need > 0] // need[need > 0]).min())
        counts -= times * need
        plan.append((times, combination))


def places(plan: list[tuple[int, list[int]]], capacity: int) -> dict[str, np.ndarray]:
    """Rows by (length, rank of the first piece): the bin and offset of ranks from there on, `one bin further` each."""
    taken = np.zeros(capacity + 1, np.int64)
    keys, bins, offsets = [], [], []
    at = 0
    for times, combination in plan:
        offset = 0
        for length in combination:
            keys.append(length << 44 | int(taken[length]))
            bins.append(at)
            offsets.append(offset)
            taken[length] += times
            offset += length
        at += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return {"key": np.array(keys, np.int64)[order], "bin": np.array(bins, np.int64)[order], "offset": np.array(offsets, np.int64)[order]}


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED, together: int = PART) -> DataFrame:
    """Pieces of all documents, each with its rank among the task's pieces of its length."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep=vocabulary)
        cache, part, seen = token_cache(vocabulary, cached), task(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, together):
                rows = []
                for doc, raw in zip(some.column("doc_id").to_pylist(), cache.encode(texts_of(some), end_id), strict=True):
                    for n, (start, length) in enumerate(cut(len(raw), capacity)):
                        rows.append((doc, n, start, length, crc32(raw[start : start + length]), part, int(seen[length])))
                        seen[length] += 1
                kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(job, PIECES)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED, together: int = PART) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    `cached` bounds the memory of a task's words (about 200 bytes each), at the cost of encoding more of them again;
    `together`, bytes of texts, that of what a task does at once.
    """
    spark = docs.sparkSession
    cuts = kept(pieces(docs, vocabulary, end_id, capacity, id_col, text_col, cached, together), "pieces")
    per_task = kept(cuts.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row.length] = row.n
    placed = places(plan_bins(counts, capacity), capacity)
    # one row for each task and length; earlier tasks' pieces come first
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("part", "length", "before")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            key = batch.column("length").to_numpy() << 44 | rank
            at = np.searchsorted(placed["key"], key, "right") - 1
            sequence = placed["bin"][at] + key - placed["key"][at]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence, pa.int64()), pa.array(placed["offset"][at], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    if not len(placed["key"]):
        return spark.createDataFrame([], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return cuts.join(before, ["part", "length"]).mapInArrow(job, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
