"""Helpers shared by the operators: tables, folds, word and token caches, results kept on shared storage."""

from __future__ import annotations

import array
import contextlib
import ctypes
import gc
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailscope.session import staged

SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """Remainder of the key's CRC-32 (as text); a missing key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(parts), F.lit(0))


def kept(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """`df` written to the shared folder and read again, so that lost executors cost no recomputation."""
    return staged(df, label, compression)


def discard(df: DataFrame) -> None:
    """Delete a table that `kept` wrote, once all that was made of it is written itself."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is written or gathered within takes its shuffle files along when it ends, instead of when the driver's garbage is
    collected. Results that are read lazily, later, are to be made outside."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def met(rows: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Inner join of `rows` with `other`, which has each key once, where some keys may hold a large share of `rows`.

    `hot` names those keys and must be bounded by construction, as keys with a fixed share of all rows are. They meet by
    broadcast, so that their rows stay spread over the tasks; the other keys meet by a shuffle.
    """
    marked = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    rows = rows.join(marked, keys, "left")
    near = rows.filter("_hot").drop("_hot").join(F.broadcast(other.join(marked, keys).drop("_hot")), keys)
    return near.unionByName(rows.filter("_hot is null").drop("_hot").join(other, keys))


def task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def by_batch(df: DataFrame, job: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(job, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; missing ones are empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def parts_of(batch: pa.RecordBatch, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that what is made of it stays small beside it."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def slices(batch: pa.RecordBatch, size: int = 2_000_000, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes in the column `name`, one row at least, whatever the rows' lengths."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        stop = int(max(at + 1, np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


class TokenCache:
    """Token ids of texts by the tokenizers library, remembered by word; for byte-level BPE vocabularies.

    Their texts are first cut where letters, digits, marks and white space meet, and no token crosses a cut. So the
    ids of a text are those of its words, each with its leading space, as long as no other white space is next to a
    space; and the ids of a word are those of its runs of letters and of other characters. These units are found among
    the bytes of all texts at once, looked up in a bounded cache, and only unseen ones are encoded. Where a cut isn't
    certain (other white space, apostrophes, rare characters), the word or the text is encoded whole. When the cache
    is full, only the units of the texts at hand stay.
    """

    SPACED, LETTER, OTHER, DOUBT = range(4)
    KINDS = np.full(256, DOUBT, np.uint8)
    KINDS[33:127] = OTHER
    KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
    KINDS[ord("'")] = DOUBT
    KINDS[ord(" ")] = SPACED

    #: Unseen words that are encoded as one text.
    JOINED = 500

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Which ids begin with a space.
        self.opens = np.zeros(max(pieces.values(), default=0) + 1, bool)
        self.opens[[i for piece, i in pieces.items() if piece.startswith("Ġ")]] = True
        self.forget()

    def forget(self) -> None:
        #: Ids by unit, which begins with its space if it has one, and how many characters all of them have.
        self.words: dict[str, bytes] = {}
        self.held = 0

    def raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in found]

    def spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before them. Many words are one text, in which each id that begins with a space begins a word."""
        parts = [words[k : k + self.JOINED] for k in range(0, len(words), self.JOINED)]
        out = []
        for part, raw in zip(parts, self.raw([" " + " ".join(part) for part in parts]), strict=True):
            cuts = (4 * np.flatnonzero(self.opens[np.frombuffer(raw, np.uint32)])).tolist()
            if len(cuts) != len(part) or cuts[0]:
                out += self.raw([" " + w for w in part])
                continue
            out += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        return out

    def learn(self, new: list[str]) -> None:
        """Ids of unseen units, but of words that white space begins or ends, or that are empty."""
        inner = [u for u in new if u[0] != " "]
        heads = [u for u in new if u[0] == " " and len(u) > 1 and not u[1].isspace() and not u[-1].isspace()]
        self.held += sum(map(len, inner)) + sum(map(len, heads))
        self.words.update(zip(heads, self.spaced([u[1:] for u in heads]), strict=True))
        self.words.update(zip(inner, self.raw(inner), strict=True))

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All texts' units one after another, where each text's begin (and the last one's end), and which are words without sure cuts.

        A word begins with the space before it, or with its text. It is cut where letters (A-Z, a-z and those of À to ÿ) and
        other visible characters of ASCII meet. A line's end counts with the others if it is the last of them and a letter follows.
        """
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
        size = int(bounds[-1])
        raw = np.frombuffer(data, np.uint8)[:size] if size else np.zeros(0, np.uint8)
        kind = self.KINDS[raw]
        wide = np.flatnonzero(raw == 0xC3)
        wide = wide[(raw[wide + 1] != 0x97) & (raw[wide + 1] != 0xB7)]
        kind[wide] = kind[wide + 1] = self.LETTER
        begins = kind == self.SPACED
        begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        line = np.flatnonzero(raw == 10)
        line = line[(line + 1 < size) & ~begins[line]]
        line = line[(kind[line + 1] == self.LETTER) & ~begins[line + 1] & np.isin(kind[line - 1], (self.LETTER, self.OTHER))]
        kind[line] = self.OTHER
        letter = kind == self.LETTER
        turns = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        turns = turns[(kind[turns] != self.SPACED) & (kind[turns - 1] != self.SPACED)]
        words = np.flatnonzero(begins)
        doubtful = np.unique(np.searchsorted(words, np.flatnonzero(kind == self.DOUBT), "right") - 1)
        change = np.zeros(size + 1, np.int8)
        change[words[doubtful]] += 1
        change[np.append(words, size)[doubtful + 1]] -= 1
        begins[turns[np.cumsum(change, dtype=np.int8)[turns] == 0]] = True
        starts = np.flatnonzero(begins)
        doubt = np.zeros(len(starts), bool)
        doubt[np.searchsorted(starts, words[doubtful])] = True
        cut = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, size)), data]) if size else texts.slice(0, 0)
        return cut, np.searchsorted(starts, bounds), doubt

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Ids of each text (unsigned 32-bit) with `end_id` after them."""
        if not texts:
            return []
        cut, first, doubt = self.units(pa.array(texts, pa.large_string()))
        coded = cut.dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ids = list(map(self.words.get, words))
        if len(self.words) > self.most or self.held > 20 * self.most:
            self.forget()
            self.words = {w: found for w, found in zip(words, ids, strict=True) if found is not None}
            self.held = sum(map(len, self.words))
        missing = [k for k, found in enumerate(ids) if found is None]
        new = list(map(words.__getitem__, missing))
        self.learn(new)
        unsure = np.zeros(len(words), bool)
        for k, found in zip(missing, map(self.words.get, new), strict=True):
            if found is None:
                ids[k], unsure[k] = b"", True
            else:
                ids[k] = found
        upto = np.concatenate([[0], np.cumsum(unsure[at])])
        whole = upto[first[1:]] > upto[first[:-1]]
        # a text's first word has no space before it; white space at its end would meet the next word's
        for k in np.flatnonzero(first[1:] - first[:-1] > 1):
            if doubt[first[k]] and words[at[first[k]]][-1].isspace():
                whole[k] = True
        units = [*ids, np.uint32(end_id).tobytes()]
        at = np.insert(at.astype(np.int64), first[1:], len(words))
        ends = first[1:] + np.arange(1, len(texts) + 1)
        size = np.fromiter(map(len, units), np.int64, len(units)) // 4
        place = np.cumsum(size) - size
        blob = np.frombuffer(b"".join(units), np.uint32)
        taken = size[at]
        upto = np.cumsum(taken)
        kind = np.int32 if max(len(blob), upto[-1]) < 2**31 else np.int64
        flat = blob[np.repeat((place[at] - (upto - taken)).astype(kind), taken) + np.arange(upto[-1], dtype=kind)]
        bounds = np.concatenate([[0], upto[ends - 1]])
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        again = np.flatnonzero(whole)
        for k, found in zip(again, self.raw([texts[k] for k in again]), strict=True):
            out[k] = np.frombuffer(found + np.uint32(end_id).tobytes(), np.uint32)
        return out


_CACHES: dict[str, TokenCache] = {}


def token_cache(path: str, most: int = 600_000) -> TokenCache:
    """One cache for each vocabulary and worker, of at most so many words."""
    if path not in _CACHES:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _CACHES[path] = TokenCache(path)
    _CACHES[path].most = most
    return _CACHES[path]


_RELEASED: list[int] = []


def release(keep: str | None = None) -> None:
    """Drop the caches that another operator left in this worker, once in each task; Spark reuses workers from stage to stage.

    What the allocators hold without need goes back to the system, so that workers don't keep the peak of an earlier stage.
    """
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else -1
    others = [path for path in _CACHES if path != keep]
    if _RELEASED == [attempt] and not others:
        return
    _RELEASED[:] = [attempt]
    for path in others:
        del _CACHES[path]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def crc32(data: bytes | np.ndarray) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
