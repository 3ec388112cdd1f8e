"""Token ids as canonical length-limited Huffman codes, in blocks that decode on their own.

Lengths come from the counts of all ids (package-merge, at most `LONGEST` bits, so that every code can be looked up
in one table). A block holds whole documents; every `STEP` ids it notes a bit offset, and decoding reads all
stretches between two notes at the same time, one table look-up for each id.

Missing texts count as empty and give the end id alone. Rows keep their multiplicity: repeated rows are stored as
often as they occur, next to each other. Rows without an id come first. An empty table gives an empty file.
Columns other than the two named ones are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailscope.llm.common import crc32, kept, parts_of, slices, task, texts_of, token_cache
from retailscope.session import shared_folder

LONGEST = 16
STEP = 256
BLOCK_IDS = 65_536
#: Bytes of texts that are encoded together.
PART = 8_000_000
BLOCKS = "shard int, block int, before long, doc_ids array<long>, lengths array<long>, ids binary"
FILE = "shard int, block int, start long, doc_ids array<long>, lengths array<long>, marks binary, payload binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code length of each symbol (0: never seen), optimal among codes of at most `longest` bits."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if not len(used):
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(np.ceil(np.log2(len(used)))))
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # each level is the leaves merged with the pairs of the level below; where[l] tells leaves from pairs
    levels, pairs = [], np.empty(0, np.int64)
    for _ in range(longest):
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        both = both[at]
        even = len(both) // 2 * 2
        pairs = both[0:even:2] + both[1:even:2]
    take = 2 * n - 2
    depth = np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for symbol in order[lengths[order] > 0]:
        code <<= int(lengths[symbol]) - before
        before = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> tuple[bytes, bytes]:
    """Bit string of the ids, and the bit offset of every `step`-th of them."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    total = int(ends[-1]) if len(ids) else 0
    marks = starts[::step].astype("<u4" if total < 2**32 else "<u8").tobytes()
    if not total:
        return b"", marks
    # a code covers at most two words of 32 bits from its first one on; places never overlap, so sums are unions
    shifted = codes[ids].astype(np.uint64) << (64 - bits - (starts & 31)).astype(np.uint64)
    word = starts >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(total // 32 + 2, np.uint64)
    out[word[first]] = np.add.reduceat(shifted >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(shifted & np.uint64(2**32 - 1), first)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], marks


class Decoder:
    """Looks up the next `width` bits; `blocks` decodes many blocks side by side."""

    def __init__(self, lengths: np.ndarray, step: int = STEP):
        self.step = step
        self.width = max(1, int(lengths.max(initial=0)))
        codes = codes_of(lengths)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = 1 << (self.width - lengths[order].astype(np.int64))
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.bits = np.ones(1 << self.width, np.uint8)
        filled = int(spans.sum())
        self.symbol[:filled] = np.repeat(order, spans)
        self.bits[:filled] = np.repeat(lengths[order], spans)
        assert not len(order) or codes[order[0]] == 0

    def blocks(self, payloads: list[bytes], marks: list[bytes], totals: list[int]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8).astype(np.uint32)
        windows = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]  # the 32 bits from each byte on
        base = np.cumsum([0, *map(len, payloads)]) * 8
        lanes = [np.frombuffer(m, "<u4" if len(m) == 4 * -(-n // self.step) else "<u8").astype(np.int64) + base[i] for i, (m, n) in enumerate(zip(marks, totals, strict=True))]
        held = [len(x) for x in lanes]
        at = np.concatenate(lanes) if lanes else np.empty(0, np.int64)
        left = np.concatenate([np.minimum(self.step, n - self.step * np.arange(h)) for n, h in zip(totals, held, strict=True)]) if lanes else np.empty(0, np.int64)
        out = np.zeros((self.step, len(at)), np.uint32)
        order = np.argsort(-left, kind="stable")
        at, left = at[order], left[order]
        for k in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -k, "left"))
            spot = at[:live]
            look = (windows[spot >> 3] << (spot & 7).astype(np.uint32)) >> np.uint32(32 - self.width)
            out[k, :live] = self.symbol[look]
            at[:live] += self.bits[look]
        lines = np.empty((len(at), self.step), np.uint32)
        lines[order] = out.T
        found, row = [], 0
        for n, h in zip(totals, held, strict=True):
            found.append(lines[row : row + h].ravel()[:n])
            row += h
        return found


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of all documents in ascending order of id, in blocks of whole documents; shards and blocks number the order."""
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # bounds are drawn from the keys alone, so no text is in them
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shard, block = token_cache(vocabulary, 900_000), task(), 0
        docs_, ids, held, before = [], [], 0, 0

        def full():
            lengths = [len(x) for x in ids]
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "before": [before], "doc_ids": [docs_], "lengths": [lengths], "ids": [narrow(np.concatenate(ids))]}, pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())]))

        for batch in batches:
            for part in slices(batch, PART):
                for doc, raw in zip(part.column("doc_id").to_pylist(), cache.encode(texts_of(part), end_id), strict=True):
                    docs_.append(doc)
                    ids.append(raw)
                    held += len(raw)
                    if held >= BLOCK_IDS:
                        yield full()
                        docs_, ids, held, before, block = [], [], 0, before + held, block + 1
        if docs_:
            yield full()

    return ordered.mapInArrow(job, BLOCKS)


def narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each if all are below 65,536 (marked 2), else in four (marked 4)."""
    if len(ids) and ids.max() >= 65_536:
        return b"4" + ids.astype("<u4").tobytes()
    return b"2" + ids.astype("<u2").tobytes()


def widen(held: bytes) -> np.ndarray:
    return np.frombuffer(held, "<u4" if held[:1] == b"4" else "<u2", offset=1).astype(np.uint32)


def id_counts(blocks: DataFrame) -> DataFrame:
    """How often each id occurs in all blocks."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for held in batch.column("ids").to_pylist():
                found = np.bincount(widen(held), minlength=len(total))
                found[: len(total)] += total
                total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return blocks.select("ids").mapInArrow(job, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(blocks: DataFrame, path: str) -> None:
    """Write the blocks' ids under `path`: `codebook` (id, bits) and `blocks`.

    The driver sees one count for each id of the vocabulary and one total for each shard.
    """
    spark = blocks.sparkSession
    counted = id_counts(blocks).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"]] = counted["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    own = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    starts, first = {}, 0
    for row in sorted(blocks.groupBy("shard").agg(F.max(F.col("before") + own).alias("n")).collect()):  # one row for each shard
        starts[row.shard] = first
        first += row.n

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codes_of(lengths)
        for batch in batches:
            for row in parts_of(batch, 16):
                packed = [pack(widen(x), lengths, codes) for x in row.column("ids").to_pylist()]
                start = [starts[s] + b for s, b in zip(row.column("shard").to_pylist(), row.column("before").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [row.column("shard"), row.column("block"), pa.array(start, pa.int64()), row.column("doc_ids"), row.column("lengths"), pa.array([m for _, m in packed], pa.binary()), pa.array([p for p, _ in packed], pa.binary())],
                    ["shard", "block", "start", "doc_ids", "lengths", "marks", "payload"],
                )

    blocks.mapInArrow(job, FILE).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 (and the ids, if asked for)."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # at most one row for each id of the vocabulary
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"]] = book["bits"]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for part in parts_of(batch, 96):
                sizes = part.column("lengths").to_pylist()
                found = decoder.blocks(part.column("payload").to_pylist(), part.column("marks").to_pylist(), [sum(x) for x in sizes])
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                for doc_ids, start, own, ids in zip(part.column("doc_ids").to_pylist(), part.column("start").to_pylist(), sizes, found, strict=True):
                    cuts = np.cumsum([0, *own])
                    raw = ids.astype("<u4")
                    out["doc_id"] += doc_ids
                    out["start"] += (start + cuts[:-1]).tolist()
                    out["n_tokens"] += own
                    out["ids_crc32"] += [crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    if with_ids:
                        out["ids"] += [raw[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int64()))] if with_ids else [])
                yield pa.RecordBatch.from_pydict(out, pa.schema(kinds))

    return spark.read.parquet(f"{path}/blocks").mapInArrow(job, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenise, count, code and write all documents; returns the folder of the files."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/huffman-{uuid.uuid4().hex}"
    write(kept(token_blocks(docs, vocabulary, end_id, id_col, text_col), "token-blocks", "zstd"), path)
    return path
