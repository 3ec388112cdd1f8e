"""Exact inner-product search, block at a time.

Vectors are kept in blocks of neighbours, each a forward index (a matrix) with the highest and lowest value of every
dimension. A query's bound for a block is the sum over dimensions of its weight times the value that favours it. For
each query the blocks of a part are taken in the order of their bounds, in waves, and scored until the bound falls
below the query's k-th score so far. The vectors are read where they lie and never shuffled; the queries travel, in
chunks of bounded size, and only k rows for each query and task come back to be merged. One chunk passes through the
driver at a time: its k best are written to the shared folder, and it is released, before the next is gathered.

Vectors that are missing or hold missing or non-finite components take no part, nor do rows without an id. Queries
meet vectors of their own length only. A repeated query id is answered once, by its smallest vector; rows that share
the query's id are its own and never its candidates; other repeated rows are candidates each. Products and sums are
exact as long as they stay within 2^53. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailscope.llm.common import kept, parts_of

BLOCK = 64
#: Blocks considered together, and queries sent at a time.
PART = 256
CHUNK = 8_192
NONE = np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vec (doubles) of the rows that take part."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length."""
    lengths = np.asarray(column.value_lengths())
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        out[int(width)] = rows, values[starts[rows][:, None] + np.arange(width)] if width else np.zeros((len(rows), 0))
    return out


def forward_blocks(vectors: DataFrame, scale: float) -> DataFrame:
    """Blocks of vectors near one another: width, ids, values, tops and bottoms of each dimension."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for width, (rows, values) in matrices(batch.column("vec")).items():
                values = np.floor(values * scale)
                pivots = values[:: max(1, len(values) // 64)]
                nearest = np.argmax(values @ pivots.T - (pivots**2).sum(axis=1) / 2, axis=1) if width else np.zeros(len(rows), int)
                order = np.lexsort((ids[rows], nearest))
                out = []
                for at in range(0, len(order), BLOCK):
                    some = order[at : at + BLOCK]
                    own = values[some]
                    out.append((width, ids[rows[some]].tobytes(), own.tobytes(), own.max(axis=0).tobytes(), own.min(axis=0).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["width", "ids", "values", "tops", "bottoms"])

    return vectors.mapInArrow(job, "width int, ids binary, values binary, tops binary, bottoms binary")


class Best:
    """The k best (score, id) of each query so far; higher scores first, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), NONE)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = (scores >= self.scores[rows, -1:]).any(axis=1)
        rows, scores = rows[hit], scores[hit]
        if not len(rows):
            return
        k = self.scores.shape[1]
        both = np.concatenate([self.scores[rows], scores], axis=1)
        who = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        who = np.where(np.isneginf(both), NONE, who)
        order = np.lexsort((who, -both), axis=1)[:, :k]
        self.scores[rows] = np.take_along_axis(both, order, axis=1)
        self.ids[rows] = np.take_along_axis(who, order, axis=1)


def search_part(best: Best, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, blocks: list[tuple]) -> int:
    """Score the blocks that can still matter, best bounds first; returns how many query-block pairs were scored."""
    tops = np.stack([np.frombuffer(b[2]) for b in blocks])
    bottoms = np.stack([np.frombuffer(b[3]) for b in blocks])
    bounds = np.maximum(queries, 0) @ tops.T + np.minimum(queries, 0) @ bottoms.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    scored, done, wave = 0, 0, 1
    while done < len(blocks):
        some = order[:, done : done + wave]
        live = np.take_along_axis(bounds, some, axis=1) >= best.scores[rows, -1:]
        if not live.any():
            break  # bounds only fall from here on
        for block in np.unique(some[live]):
            asking = np.flatnonzero(((some == block) & live).any(axis=1))
            held = np.frombuffer(blocks[block][0], np.int64)
            values = np.frombuffer(blocks[block][1]).reshape(len(held), queries.shape[1])
            scores = queries[asking] @ values.T
            scores[ids[asking][:, None] == held[None, :]] = -np.inf
            best.add(rows[asking], scores, held)
            scored += len(asking)
        done, wave = done + wave, 2 * wave
    return scored


def chunk_search(blocks: DataFrame, chunk: pa.Table, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query of the chunk, written to the shared folder."""
    sent = blocks.sparkSession.sparkContext.broadcast((chunk.column("id").to_numpy(), matrices(chunk.column("vec").combine_chunks()) if len(chunk) else {}))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, by_width = sent.value
        best = Best(len(query_ids), k)
        for batch in batches:
            for part in parts_of(batch, PART):
                found: dict[int, list[tuple]] = {}
                for width, *block in zip(*(part.column(c).to_pylist() for c in ("width", "ids", "values", "tops", "bottoms")), strict=True):
                    if width in by_width:
                        found.setdefault(width, []).append(block)
                for width, held in found.items():
                    rows, queries = by_width[width]
                    search_part(best, rows, query_ids[rows], queries, held)
        row, place = np.nonzero(best.ids != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(best.ids[row, place]), pa.array(best.scores[row, place].astype(np.int64))], ["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = blocks.mapInArrow(job, "query_id long, vec_id long, score long").withColumn("rank", rank.cast("int"))
    out = kept(found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-k-chunk")
    sent.destroy()
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; `is_query` is a condition on the column `id`."""
    plain = usable(vectors, id_col, vector_col)
    blocks = kept(forward_blocks(plain, scale), "forward-blocks")
    asked = kept(plain.filter(is_query).groupBy("id").agg(F.min("vec").alias("vec")).select("id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec")), "top-k-queries")
    chunks = max(1, -(-asked.count() // CHUNK))
    parts = [chunk_search(blocks, asked.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == at).toArrow(), k) for at in range(chunks)]
    return reduce(DataFrame.union, parts)
