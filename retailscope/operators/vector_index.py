"""An index over vectors that is laid out by cells, and exact searches that read few of them.

A bounded sample gives cell centres for each of the most frequent widths; every vector goes to its nearest centre and is
stored there in blocks, as its direction and as a code of one byte per component with the norm of what the code leaves
out. For each cell the widest angle to its centre is known, so no vector of the cell is more similar to a question than
the cosine of the question's angle to the centre less that angle.

Questions stay a table. Each of them asks for the cells that may hold its hits; requests meet the cells' blocks through
a shuffle, questions in parts of bounded size and cells in blocks of bounded size, so neither a popular cell nor many
equal vectors end up in one task. A first wave asks for the nearest cells; a second one for all others whose bound is not
below the k-th hit so far. Both searches are exact. `search` multiplies with the directions. `search_by_codes` multiplies
with the codes, which gives each similarity from below and above, and reads the directions only of those vectors whose
upper bound reaches the k-th lower bound.

Vectors that are missing, without length or not finite take no part; questions meet vectors of their own width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailscope.session import slice_count, staged

#: Most cells for one width, widths that have cells of their own, and vectors that the centres are fitted on.
CELLS, WIDTHS, SAMPLE = 4_096, 16, 8_192
ROUNDS = 8
#: Vectors in a block, and the first wave's vectors for each wanted hit.
BLOCK, FIRST = 2_048, 64
#: Bytes of questions' vectors in one part.
QUESTION_BYTES = 8_000_000
#: What rounding may add to a product of unit vectors.
SLACK = 1e-9
#: Cell of the vectors whose width has no centres.
OTHERS = -1


@dataclass
class Index:
    """blocks: cell, block, width, ids, vectors, codes, scales, errors. centres by width with the number of their first
    cell; for each cell its vectors, blocks and widest angle. All but the blocks is bounded by the constants above."""

    blocks: DataFrame
    centres: dict[int, tuple[int, np.ndarray]]
    sizes: dict[int, int]
    counts: dict[int, int]
    radii: dict[int, float]

    @property
    def vectors(self) -> int:
        return sum(self.sizes.values())


def directions(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, unit vectors) of the vectors of each width that have a length."""
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == width)
        stacked = values[starts[rows][:, None] + np.arange(width)]
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.sqrt((stacked * stacked).sum(axis=1))
        good = np.isfinite(norms) & (norms > 0)
        yield int(width), rows[good], stacked[good] / norms[good, None]


def _plain(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.where("embedding is not null").select(F.col(key).cast("bigint").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))


def _rows(matrix: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(matrix)]


def _batch(columns: dict, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], list(columns))


def fit(chunks: DataFrame, cells: int | None = None, seed: int = 42) -> dict[int, tuple[int, np.ndarray]]:
    """Centres of the `WIDTHS` most frequent widths by spherical k-means on about `SAMPLE` vectors in all."""
    plain = _plain(chunks, "chunk_id")
    widths = plain.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.width: r.n for r in widths.where("width > 0").orderBy(F.desc("n"), "width").limit(WIDTHS).collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    share = min(1.0, SAMPLE / total)
    some = plain.where(F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE)
    out, first = {}, 0
    rng = np.random.default_rng(seed)
    for width, _, unit in directions(some.toArrow()["embedding"].combine_chunks()):
        if width not in sizes or not len(unit):
            continue
        wanted = min(cells or int(np.sqrt(sizes[width])), CELLS, len(unit))
        centres = unit[rng.choice(len(unit), max(1, wanted), replace=False)]
        for _ in range(ROUNDS):
            nearest = (unit @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, unit)
            norms = np.sqrt((sums * sums).sum(axis=1))
            centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centres)
        out[width] = first, centres
        first += len(centres)
    return out


def build(chunks: DataFrame, cells: int | None = None, seed: int = 42) -> Index:
    """The index of `chunks` (chunk_id, embedding), written to the shared folder."""
    spark = chunks.sparkSession
    centres = fit(chunks, cells, seed)
    held = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            for width, rows, unit in directions(batch.column("embedding")):
                if width in held.value:
                    first, own = held.value[width]
                    products = unit @ own.T
                    nearest = products.argmax(axis=1)
                    angles = np.arccos(np.clip(products[np.arange(len(rows)), nearest], -1, 1))
                    cell = first + nearest
                else:
                    cell, angles = np.full(len(rows), OTHERS), np.full(len(rows), np.pi)
                yield _batch({"cell": cell, "width": np.full(len(rows), width), "chunk_id": ids[rows], "vector": _rows(unit), "angle": angles}, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64()))

    assigned = staged(_plain(chunks, "chunk_id").mapInArrow(assign, "cell int, width int, chunk_id bigint, vector binary, angle double"), "assigned-vectors")
    cells_ = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()  # one row for each cell
    sizes = {r.cell: r.n for r in cells_}
    counts = {c: -(-n // BLOCK) for c, n in sizes.items()}
    blocks = _lookup(F.col("cell"), counts, "bigint")
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), blocks).cast("int")
    order = ["cell", "block", "width", "chunk_id"]
    dealt = assigned.withColumn("block", block).repartitionByRange(slice_count(spark), "cell", "block").sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []

        def packed() -> pa.RecordBatch:
            cell, block, width = key
            unit = np.frombuffer(b"".join(vectors)).reshape(len(ids), width)
            scales = np.abs(unit).max(axis=1) / 127
            codes = np.rint(unit / scales[:, None]).astype(np.int8)
            left = unit - codes * scales[:, None]
            errors = np.sqrt((left * left).sum(axis=1))
            binaries = {"ids": np.array(ids, np.int64), "vectors": unit, "codes": codes, "scales": scales, "errors": errors}
            return _batch({"cell": [cell], "block": [block], "width": [width]} | {n: [v.tobytes()] for n, v in binaries.items()}, (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5))

        for batch in batches:
            for cell, block, width, chunk_id, vector in zip(*(batch.column(c).to_pylist() for c in (*order, "vector")), strict=True):
                if key and ((cell, block, width) != key or len(ids) == 2 * BLOCK):
                    yield packed()
                    ids, vectors = [], []
                key = cell, block, width
                ids.append(chunk_id)
                vectors.append(vector)
        if ids:
            yield packed()

    kept = dealt.select(*order, "vector").mapInArrow(pack, "cell int, block int, width int, ids binary, vectors binary, codes binary, scales binary, errors binary")
    return Index(staged(kept, "vector-blocks"), centres, sizes, counts, {r.cell: r.radius for r in cells_})


def _lookup(cell: Column, values: dict[int, int], kind: str) -> Column:
    """The number of a cell; one literal for each cell."""
    top = max(values, default=0)
    return F.get(F.array(*(F.lit(values.get(c, 1)).cast(kind) for c in range(OTHERS, top + 1))), cell - OTHERS)


def _questions(queries: DataFrame) -> DataFrame:
    """query_id, width and vector (unit) of the questions that take part."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("query_id").to_numpy(zero_copy_only=False)
            for width, rows, unit in directions(batch.column("embedding")):
                yield _batch({"query_id": ids[rows], "width": np.full(len(rows), width), "vector": _rows(unit)}, (pa.int64(), pa.int32(), pa.binary()))

    return _plain(queries, "query_id").mapInArrow(job, "query_id bigint, width int, vector binary")


def _requests(index: Index, questions: DataFrame, k: int) -> DataFrame:
    """`questions` with the cells that they ask for: without `least` the nearest ones, else the others that may reach it."""
    held = questions.sparkSession.sparkContext.broadcast((index.centres, index.sizes, index.radii))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sizes, radii = held.value
        for batch in batches:
            widths = batch.column("width").to_numpy()
            least = batch.column("least").to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                if width not in centres:
                    # asked for once, in the first wave
                    rows = rows[np.isnan(least[rows])]
                    asked, cells = rows, np.full(len(rows), OTHERS)
                else:
                    first, own = centres[width]
                    number = first + np.arange(len(own))
                    n = np.array([sizes.get(c, 0) for c in number])
                    unit = np.frombuffer(b"".join(batch.column("vector").take(pa.array(rows)).to_pylist())).reshape(len(rows), width)
                    angles = np.arccos(np.clip(unit @ own.T, -1, 1))
                    order = np.argsort(angles, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    near = np.zeros(angles.shape, bool)
                    np.put_along_axis(near, order, before < FIRST * k, axis=1)
                    bound = np.cos(np.maximum(0, angles - np.array([radii.get(c, 0.0) for c in number])))
                    floor = least[rows][:, None]
                    wanted = np.where(np.isnan(floor), near, ~near & (bound >= floor - SLACK)) & (n > 0)
                    at, cell = np.nonzero(wanted)
                    asked, cells = rows[at], number[cell]
                some = batch.take(pa.array(asked))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cells, pa.int32())], [*some.schema.names, "cell"])

    return questions.mapInArrow(job, "query_id bigint, width int, vector binary, least double, cell int")


def _met(index: Index, requests: DataFrame, parts: int, columns: list[str]) -> DataFrame:
    """Parts of questions with every block of the cells that they ask for."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    grouped = requests.groupBy("cell", "width", part).agg(F.collect_list(F.struct("query_id", "vector", "least")).alias("asked"))
    every = grouped.withColumn("block", F.explode(F.sequence(F.lit(0), (_lookup(F.col("cell"), index.counts, "int") - 1))))
    return every.join(index.blocks.select("cell", "block", "width", "ids", *columns), ["cell", "block", "width"]).select("cell", "block", "width", "asked", "ids", *columns)


def _each(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple]:
    """cell, block, the questions' ids, vectors and limits, the vectors' ids and the columns, of each meeting."""
    for at in range(batch.num_rows):
        row = batch.slice(at, 1)
        width = row.column("width")[0].as_py()
        asked = row.column("asked").flatten()
        own = np.frombuffer(b"".join(asked.field("vector").to_pylist())).reshape(-1, width)
        least = np.nan_to_num(asked.field("least").to_numpy(zero_copy_only=False), nan=-np.inf)
        values = [row.column(c)[0].as_py() for c in ("ids", *columns)]
        yield row.column("cell")[0].as_py(), row.column("block")[0].as_py(), asked.field("query_id").to_numpy(), own, least, np.frombuffer(values[0], np.int64), *values[1:]


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row, or less than everything."""
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _parts(questions: DataFrame, question_bytes: int) -> int:
    held = questions.agg(F.coalesce(F.sum(F.octet_length("vector")), F.lit(0))).first()[0]
    return max(1, -(-held // question_bytes))


HIT = "query_id bigint, chunk_id bigint, similarity double"


def _k_best(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _limits(questions: DataFrame, values: DataFrame, value: str, k: int) -> DataFrame:
    """`questions` with `least`, the k-th highest value found for each (less than any similarity if there are fewer)."""
    best = Window.partitionBy("query_id").orderBy(F.desc(value))
    kth = values.select("query_id", value).withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col(value).alias("least"))
    return questions.drop("least").join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))).select("query_id", "width", "vector", "least")


def _asking(queries: DataFrame) -> DataFrame:
    return staged(_questions(queries).withColumn("least", F.lit(float("nan"))), "questions")


def search(index: Index, queries: DataFrame, k: int, question_bytes: int = QUESTION_BYTES) -> DataFrame:
    """query_id, chunk_id, similarity (12 places) and rank of the k nearest vectors; ties go by chunk id."""
    questions = _asking(queries)
    parts = _parts(questions, question_bytes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, query_ids, own, least, ids, raw in _each(batch, ["vectors"]):
                products = np.round(own @ np.frombuffer(raw).reshape(len(ids), -1).T, 12)
                q, c = np.nonzero(products >= np.maximum(_top(products, k), least - SLACK)[:, None])  # ties with the k-th included
                order = np.lexsort((ids[c], -products[q, c], q))
                q, c = q[order], c[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, c = q[first], c[first]
                yield _batch({"query_id": query_ids[q], "chunk_id": ids[c], "similarity": products[q, c]}, (pa.int64(), pa.int64(), pa.float64()))

    def wave(asking: DataFrame) -> DataFrame:
        return _met(index, _requests(index, asking, k), parts, ["vectors"]).mapInArrow(score, HIT)

    near = staged(_k_best(wave(questions), k).drop("rank"), "near-hits")
    return _k_best(near.union(wave(_limits(questions, near, "similarity", k))), k)


def search_by_codes(index: Index, queries: DataFrame, k: int, question_bytes: int = QUESTION_BYTES) -> DataFrame:
    """As `search`, with `candidates`: how many vectors were read and compared exactly for the question."""
    questions = _asking(queries)
    parts = _parts(questions, question_bytes)
    columns = ["codes", "scales", "errors"]

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, block, query_ids, own, least, ids, codes, scales, errors in _each(batch, columns):
                codes = np.frombuffer(codes, np.int8).reshape(len(ids), -1).astype(np.float64)
                about = (own @ codes.T) * np.frombuffer(scales)
                errors = np.frombuffer(errors)
                low, high = about - errors - SLACK, about + errors + SLACK
                q, c = np.nonzero(high >= np.maximum(_top(low, k), least)[:, None])
                n = len(q)
                yield _batch({"query_id": query_ids[q], "chunk_id": ids[c], "cell": np.full(n, cell), "block": np.full(n, block), "low": low[q, c], "high": high[q, c]}, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))

    def wave(asking: DataFrame) -> DataFrame:
        return _met(index, _requests(index, asking, k), parts, columns).mapInArrow(estimate, "query_id bigint, chunk_id bigint, cell int, block int, low double, high double")

    near = staged(wave(questions), "near-candidates")
    found = staged(near.union(wave(_limits(questions, near, "low", k))), "candidates")
    likely = staged(found.join(_limits(questions, found, "low", k), "query_id").where("high >= least").select("query_id", "chunk_id", "cell", "block", "width", "vector"), "likely-candidates")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, block, width, ids, raw in zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "width", "ids", "vectors")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                n = len(ids)
                yield _batch({"cell": np.full(n, cell), "block": np.full(n, block), "width": np.full(n, width), "chunk_id": ids, "stored": _rows(np.frombuffer(raw).reshape(n, width))}, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))

    key = ["cell", "block", "width"]
    touched = index.blocks.join(likely.select(*key).distinct(), key, "left_semi").select(*key, "ids", "vectors")
    vectors = touched.mapInArrow(unpack, "cell int, block int, width int, chunk_id bigint, stored binary")

    @F.arrow_udf("double")
    def product(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([round(float(np.frombuffer(a.as_buffer()) @ np.frombuffer(b.as_buffer())), 12) for a, b in zip(left, right, strict=True)], pa.float64())

    exact = likely.join(vectors, [*key, "chunk_id"]).select("query_id", "chunk_id", product("vector", "stored").alias("similarity"))
    counted = exact.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    return _k_best(counted, k)
