"""Texts scored by a weighted backoff automaton over smoothed word n-grams.

All training words are symbols of their own, beside one for unseen words and one for a text's end, and all pairs and
triples of neighbouring words are counted; pairs also begin with a text's beginning. The model grows with the input
and is a set of tables: nothing is left out but n-grams that occur less than `LEAST` times, at any size.

Histories are the automaton's states. A state has an arc for each continuation that occurs `LEAST` times or more, with
count / (total + different) of the history plus what the state's failure arc would give; the failure arc leads to the
history without its oldest word and has the mass that the arcs leave. The root has an arc for every symbol, with
(count + 1) / (words + different words + 1). So each state's distribution sums to one.

Texts are kept in batches, as places among the batch's different words. A batch asks for what it needs of the automaton by
buckets of hashes: it sends its different n-grams with its own counts of them, the bucket adds up those of all batches, and
the sums come back in the same order. This is done three times: for words and pairs; for triples of pairs with arcs, and what
the words' arcs hold in all; for what the pairs' arcs hold in all. Each n-gram is owned by one of the batches that count it,
which alone adds it to its history's sums. What has come back is the batch's slice of the automaton; every text of the batch
passes through that slice, by arcs and failure arcs, and adds up its logarithms from left to right. Words, pairs and triples
are told apart by their level and 64-bit hashes. Nothing but the number of words travels through the driver.

Missing texts count as empty: they have the end alone. Rows without an id are training rows. Repeated rows count and
are scored as often as they occur. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.llm.common import freeing, kept, release, slices, task

#: Symbols for unseen words.
CLASSES = 1
#: Keys that a batch sends in one row, at most.
HEAD = 100_000
#: The least count of an arc, 1 or 2.
LEAST = 2
SEED = 42
#: Bytes of texts in a batch.
PART = 3_000_000
#: Batches whose n-grams a bucket holds, if there are more than its least number takes.
BATCHES = 12
#: Levels of n-grams, and of the sums over a history's arcs.
WORD, PAIR, TRIPLE, AFTER_WORD, AFTER_PAIR = 1, 2, 3, 4, 5
#: How many numbers are added up for each n-gram: counts, or counts and number of a history's arcs.
SUMS = {WORD: 1, PAIR: 1, TRIPLE: 1, AFTER_WORD: 2, AFTER_PAIR: 2}


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words of the texts (A-Z in lower case), the word at each place, and each text's places."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = np.array([bool(w) for w in words], bool)[at] if words else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(real)])
    return words, at[real], before[ends]


def hashes_of(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w.encode(), SEED) for w in words), np.uint64, len(words)).view(np.int64)


#: No word holds white space.
BEGIN, END = (int(h) for h in hashes_of(["\nbegin", "\nend"]))
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of longs, equal to xxhash64(a, b) in a plan."""
    def step(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
        k = value.view(np.uint64) * _P2
        h = (seed + _P5 + np.uint64(8)) ^ ((k << np.uint64(31) | k >> np.uint64(33)) * _P1)
        h = (h << np.uint64(27) | h >> np.uint64(37)) * _P1 + _P4
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        return h ^ h >> np.uint64(32)

    return step(b, step(a, np.full(len(a), 42, np.uint64))).view(np.int64)


LINES = "batch long, held_out boolean, doc_ids array<long>, sizes binary, words binary, codes binary"


def sequences(docs: DataFrame) -> DataFrame:
    """Texts in batches of about `PART` bytes, of training or held-out texts: batch (a number of its own), held_out, doc_ids,
    sizes (words and the end of each text), words (hashes of the different ones) and codes (places among them, in two bytes if
    they fit)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number = task() << 32
        for batch in batches:
            for held in (False, True):
                for part in slices(batch.filter(pc.equal(batch.column("held_out"), held)), PART):
                    words, at, ends = words_of(part.column("text"))
                    codes = np.insert(at, ends[1:], len(words))
                    binaries = [np.diff(ends) + 1, np.append(hashes_of(words), END), codes]
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
                    raw = [v.astype(k) for v, k in zip(binaries, (np.int32, np.int64, np.int32 if len(words) >> 16 else np.uint16), strict=True)]
                    cells = [pa.array([x], pa.binary()) for x in (raw[0].tobytes(), raw[1].tobytes(), packed(raw[2]))]
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([held]), ids, *cells], ["batch", "held_out", "doc_ids", "sizes", "words", "codes"])
                    number += 1

    return docs.mapInArrow(job, LINES)


def packed(values: np.ndarray) -> bytes:
    """Compressed, the same byte of all values side by side."""
    return pa.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpack(held: bytes | pa.Buffer, kind: type, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(held, size * count, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, count).T).view(kind).ravel()


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """sizes, words and codes of each row."""
    for row in zip(*(batch.column(c) for c in ("sizes", "words", "codes")), strict=True):
        sizes, words, codes = (x.as_buffer() for x in row)
        sizes, words = np.frombuffer(sizes, np.int32), np.frombuffer(words, np.int64)
        yield sizes, words, unpack(codes, np.int32 if len(words) - 1 >> 16 else np.uint16, int(sizes.sum())).astype(np.int32)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different keys (unsigned, ascending), a place of each, each place's key among them, and how often each occurs."""
    order = np.argsort(keys)
    held = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = held[1:] != held[:-1]
    starts = np.flatnonzero(fresh)
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return held[starts], order[starts], which, np.diff(starts, append=len(keys))


def asked_rows(number: int, asked: list[tuple[int, np.ndarray, list[np.ndarray]]], buckets: int, most: int) -> pa.RecordBatch:
    """A row for each level and bucket, and more of them for over `most` keys; asked: level, ascending keys and numbers to add up."""
    rows = []
    for level, keys, numbers in asked:
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.union1d(np.flatnonzero(np.diff(bucket, prepend=-1)), np.arange(0, len(keys), most)).tolist()
        for x, y in zip(cuts, [*cuts[1:], len(keys)], strict=False):
            sent = np.concatenate([v[x:y].astype(np.int64) for v in numbers])
            rows.append((number, int(bucket[x]), level, x, y - x, packed(np.diff(keys[x:y], prepend=np.uint64(0))), packed(sent)))
    return pa.RecordBatch.from_pydict({name: [row[k] for row in rows] for k, name in enumerate(ASKED.names)}, ASKED)


ASKED = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("level", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary())])
REPLIES = pa.schema([("batch", pa.int64()), ("level", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("different", pa.int64()), ("tokens", pa.int64()), ("reply", pa.binary())])


def added(asked: pa.Table, least: int) -> pa.Table:
    """The sums over all batches of the numbers sent for each key, doubled, with 1 added in the batch that owns the key.

    Pairs and triples that occur less than `least` times are 0. For words: how many the batch owns, and its tokens.
    """
    release()
    out = []
    for level in pc.unique(asked.column("level")).to_pylist():
        own = asked.filter(pc.equal(asked.column("level"), level))
        sizes = own.column("size").to_pylist()
        which, times = ranked(np.concatenate([np.cumsum(unpack(k.as_buffer(), np.uint64, n)) for k, n in zip(own.column("keys"), sizes, strict=True)]))[2:]
        sent = np.concatenate([unpack(v.as_buffer(), np.int64, SUMS[level] * n).reshape(-1, n) for v, n in zip(own.column("numbers"), sizes, strict=True)], axis=1)
        owner = np.full(len(times), -1)
        owner[which[sent[0] > 0]] = np.flatnonzero(sent[0])
        replies = np.empty_like(sent)
        for k, v in enumerate(sent):
            # doubles hold whole numbers up to 2^53
            sums = np.bincount(which, v, len(times)).astype(np.int64)
            if level in (PAIR, TRIPLE):
                sums[sums < least] = 0
            owner[sums == 0] = -1
            replies[k] = sums[which]
        replies *= 2
        replies[0, owner[owner >= 0]] += 1
        cuts = np.cumsum([0, *sizes]).tolist()
        for batch, at, x, y in zip(own.column("batch").to_pylist(), own.column("at").to_pylist(), cuts, cuts[1:], strict=False):
            totals = (int((replies[0, x:y] & 1).sum()), int(sent[0, x:y].sum())) if level == WORD else (0, 0)
            out.append((batch, level, at, y - x, *totals, packed(np.ascontiguousarray(replies[:, x:y]).ravel())))
    return pa.Table.from_pydict({name: [row[k] for row in out] for k, name in enumerate(REPLIES.names)}, REPLIES)


class Slice:
    """What a batch knows of the automaton after so many waves of replies, by the places of its tokens."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, codes: np.ndarray, replies: list[dict], waves: int, least: int):
        self.words, self.codes, begin = words.view(np.uint64), codes, len(words)
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.last = np.concatenate([np.array([begin], np.int32), codes[:-1]])
        self.last[self.first] = begin
        pair = joint(np.append(words, BEGIN)[self.last], words[codes]).view(np.uint64)
        self.pairs, self.where, self.which, self.times = ranked(pair)
        inner = np.ones(len(codes), bool)
        inner[self.first] = False
        inner[(self.first + 1)[sizes > 1]] = False
        self.order = np.argsort(self.words)
        self.third = np.flatnonzero(inner)
        if not waves:
            return
        held = self.held(replies)
        self.counts, self.owns_word = np.zeros(begin + 1, np.int64), np.zeros(begin, bool)
        self.counts[self.order], self.owns_word[self.order] = held[WORD][0] >> 1, held[WORD][0] & 1 == 1
        self.counts[begin] = self.counts[np.flatnonzero(words == END)[0]]
        self.n, self.owns_pair = held[PAIR][0] >> 1, held[PAIR][0] & 1 == 1
        often = self.n[self.which] > 0
        self.at = self.third[often[self.third - 1] & often[self.third]]
        self.triples, self.where3, self.which3, self.times3 = ranked(joint(pair[self.at - 1].view(np.int64), pair[self.at].view(np.int64)).view(np.uint64))
        histories = np.append(self.words, np.uint64(BEGIN & (1 << 64) - 1))
        self.histories = np.argsort(histories)
        self.histories = self.histories[self.counts[self.histories] >= least]
        self.history_keys = histories[self.histories]
        self.inner_pairs = np.zeros(len(self.pairs), bool)
        self.inner_pairs[self.which[self.third - 1]] = True
        self.inner_pairs &= self.n > 0
        if waves == 1:
            return
        self.after_word = self.spread(held[AFTER_WORD], self.histories, begin + 1)
        self.n3, self.owns_triple = held[TRIPLE][0] >> 1, held[TRIPLE][0] & 1 == 1
        if waves == 3:
            self.after_pair = self.spread(held[AFTER_PAIR], np.flatnonzero(self.inner_pairs), len(self.pairs))

    @staticmethod
    def held(replies: list[dict]) -> dict[int, np.ndarray]:
        parts = {level: [np.zeros((sums, 0), np.int64)] for level, sums in SUMS.items()}
        for r in sorted(replies, key=lambda r: (r["level"], r["at"])):
            parts[r["level"]].append(unpack(r["reply"], np.int64, SUMS[r["level"]] * r["size"]).reshape(-1, r["size"]))
        return {level: np.concatenate(own, axis=1) for level, own in parts.items()}

    @staticmethod
    def spread(found: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Count and number of the arcs of all histories, from those of some of them."""
        out = np.zeros((2, size), np.int64)
        out[:, at] = found >> 1
        return out

    def asks(self, wave: int, training: bool) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
        """What is asked in a wave: level, ascending keys and the batch's own numbers, which are 0 for held-out texts."""
        own = int(training)
        if wave == 0:
            return [(WORD, self.words[self.order], [own * np.bincount(self.codes, minlength=len(self.words))[self.order]]), (PAIR, self.pairs, [own * self.times])]
        if wave == 1:
            arcs = np.flatnonzero(self.owns_pair)
            sums = self.sums(self.last[self.where[arcs]], self.n[arcs], len(self.words) + 1)
            return [(AFTER_WORD, self.history_keys, [v[self.histories] for v in sums]), (TRIPLE, self.triples, [own * self.times3])]
        arcs = np.flatnonzero(self.owns_triple)
        sums = self.sums(self.which[self.at[self.where3[arcs]] - 1], self.n3[arcs], len(self.pairs))
        return [(AFTER_PAIR, self.pairs[self.inner_pairs], [v[self.inner_pairs] for v in sums])]

    @staticmethod
    def sums(history: np.ndarray, n: np.ndarray, size: int) -> list[np.ndarray]:
        return [np.bincount(history, n, size), np.bincount(history, minlength=size)]

    @staticmethod
    def states(total: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Denominator and failure mass of histories, 1 where they have no arcs.

        What occurs less than `LEAST` times occurs once: the different continuations are the arcs and the rest of the total.
        """
        bottom = np.maximum(2 * total - after[0] + after[1], 1)
        return bottom, np.where(after[0] > 0, np.maximum(1 - after[0] / bottom, 1e-12), 1.0)

    def weigh(self, tokens: int, different: int) -> None:
        """Failure masses of words (the text's beginning last) and pairs; arcs' probabilities of pairs and triples (else 0)."""
        bottom, self.left = self.states(self.counts, self.after_word)
        v, w = self.last[self.where], self.codes[self.where]
        self.p = np.where(self.n > 0, self.n / bottom[v] + self.left[v] * ((self.counts[w] + 1) / float(tokens + different + 1)), 0.0)
        bottom, self.below = self.states(self.n, self.after_pair)
        at = self.at[self.where3]
        uv, vw = self.which[at - 1], self.which[at]
        self.p3 = np.where(self.n3 > 0, self.n3 / bottom[uv] + self.below[uv] * self.p[vw], 0.0)

    def traverse(self, root: np.ndarray) -> np.ndarray:
        """Log10 probabilities of the texts, from the beginning's state, by arcs and failure arcs.

        Each token leads to the state of the last two words, if that pair has arcs, else to that of the last word, whichever
        arc was taken; so all places are passed at the same time. A place adds the failure arc of its pair, that of its word
        and its arc, as far as they are taken, and a text's logarithms are added from left to right.
        """
        steps = np.zeros((len(self.codes), 3))
        with np.errstate(divide="ignore"):
            pair, triple = np.log10(self.p)[self.which], np.log10(self.p3)[self.which3]
        steps[self.third, 0] = np.log10(self.below)[self.which[self.third - 1]]
        known = pair > -np.inf
        steps[:, 1] = np.where(known, 0.0, np.log10(self.left)[self.last])
        steps[:, 2] = np.where(known, pair, root[self.codes])
        known = triple > -np.inf
        steps[self.at[known]] = 0.0
        steps[self.at[known], 2] = triple[known]
        text = np.zeros(len(self.codes), np.int64)
        text[self.first] = 1
        return np.bincount(np.repeat(np.cumsum(text) - 1, 3), steps.ravel(), len(self.first))


@dataclass
class Known:
    """Batches with their replies, and how many tokens and different words the training texts have."""

    tokens: int
    different: int
    lines: DataFrame
    replies: list[DataFrame]


def slices_of(batch: pa.RecordBatch, least: int, waves: int = 3) -> Iterator[Slice]:
    for row, found in zip(unpacked(batch), batch.column("replies"), strict=True):
        yield Slice(*row, found.as_py(), waves, least)


def learn(lines: DataFrame) -> Known:
    """Each batch's slice of the automaton that the training texts' lines make."""
    spark, least, most = lines.sparkSession, LEAST, HEAD
    answered = F.struct("level", "at", "size", "reply")
    nothing = F.array().cast("array<struct<level:int,at:int,size:int,reply:binary>>")
    met, replies, tokens, different = lines.withColumn("replies", nothing), [], 0, 0
    with freeing(spark):
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // BATCHES)

    def ask(wave: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                for number, held, part in zip(batch.column("batch").to_pylist(), batch.column("held_out").to_pylist(), slices_of(batch, least, wave), strict=True):
                    yield asked_rows(number, part.asks(wave, not held), buckets, most)

        return job

    for wave in range(3):
        with freeing(spark):
            asked = met.select("batch", "held_out", "sizes", "words", "codes", "replies").mapInArrow(ask(wave), "batch long, bucket int, level int, at int, size int, keys binary, numbers binary")
            answers = asked.groupBy("bucket").applyInArrow(lambda rows: added(rows, least), "batch long, level int, at int, size int, different long, tokens long, reply binary")
            replies.append(kept(answers, "replies"))
            if not wave:
                total = replies[0].agg(F.sum("tokens"), F.sum("different")).first()
                tokens, different = total[0] or 0, total[1] or 0
        found = replies[0]
        for more in replies[1:]:
            found = found.union(more)
        found = found.groupBy("batch").agg(F.collect_list(answered).alias("replies"))
        met = lines.join(found, "batch", "left").withColumn("replies", F.coalesce("replies", nothing))
    return Known(tokens, different, met, replies)


@dataclass
class Tables:
    """words: w, c, left; pairs: key, v, w, n, p and below, their own failure mass; triples: uv, vw, n, p."""

    tokens: int
    different: int
    begin: float
    words: DataFrame
    pairs: DataFrame
    triples: DataFrame


def tables_of(known: Known) -> Tables:
    """The whole automaton as tables: each n-gram from the batch that owns it."""
    tokens, different, least = known.tokens, known.different, LEAST

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, least):
                part.weigh(tokens, different)
                words, pair = part.words.view(np.int64), part.pairs.view(np.int64)
                own, arcs, arcs3 = np.flatnonzero(part.owns_word), np.flatnonzero(part.owns_pair), np.flatnonzero(part.owns_triple)
                at, at3 = part.where[arcs], part.at[part.where3[arcs3]]
                none = np.zeros(len(own))
                sets = [(WORD, words[own], words[own], words[own], part.counts[own], none, part.left[own])]
                sets.append((PAIR, pair[arcs], np.append(words, BEGIN)[part.last[at]], words[part.codes[at]], part.n[arcs], part.p[arcs], part.below[arcs]))
                sets.append((TRIPLE, part.triples.view(np.int64)[arcs3], pair[part.which[at3 - 1]], pair[part.which[at3]], part.n3[arcs3], part.p3[arcs3], np.ones(len(arcs3))))
                sets.append((0, *(np.array([BEGIN]),) * 3, part.counts[-1:], np.zeros(1), part.left[-1:]))
                for level, *columns in sets:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), level, np.int32)), *map(pa.array, columns)], ["level", "key", "a", "b", "n", "p", "left"])

    rows = kept(known.lines.mapInArrow(job, "level int, key long, a long, b long, n long, p double, left double"), "automaton", "zstd")
    level = {k: rows.filter(F.col("level") == k) for k in (0, WORD, PAIR, TRIPLE)}
    begin = level[0].first()
    words = level[WORD].select(F.col("key").alias("w"), F.col("n").alias("c"), "left")
    pairs = level[PAIR].select("key", F.col("a").alias("v"), F.col("b").alias("w"), "n", "p", F.col("left").alias("below"))
    triples = level[TRIPLE].select(F.col("a").alias("uv"), F.col("b").alias("vw"), "n", "p")
    return Tables(tokens, different, begin.left if begin else 1.0, words, pairs, triples)


class Model:
    """The whole automaton in memory, to look into those of small corpora."""

    def __init__(self, model: Tables):
        words = sorted(((r.c, r.w, r.left) for r in model.words.collect() if r.w != END), reverse=True)
        self.lexicon, self.head = len(words), Head({w: (k, c) for k, (c, w, _) in enumerate(words)})
        self.symbols, self.end = self.lexicon + CLASSES + 2, self.lexicon + CLASSES
        number = {w: k for k, (_, w, _) in enumerate(words)} | {END: self.end, BEGIN: self.end + 1}
        counts = np.array([c for c, _, _ in words] + [0] * CLASSES + [r.c for r in model.words.filter(F.col("w") == END).collect()] + [-1.0])
        self.root = np.log10(np.maximum((counts + 1) / (model.tokens + model.different + 1), 1e-300))
        left = [1.0] + [x for _, _, x in words] + [1.0] * (CLASSES + 1) + [model.begin]
        failures, state, pairs = [0] * len(left), {}, {r.key: r for r in model.pairs.collect()}
        triples = model.triples.collect()
        for uv in sorted({r.uv for r in triples}):
            state[uv] = len(left)
            left.append(pairs[uv].below)
            failures.append(1 + number[pairs[uv].w])
        target = {key: state.get(key, 1 + number[r.w]) for key, r in pairs.items()}
        self.arcs = {(1 + number[r.v], number[r.w]): (np.log10(r.p), target[key]) for key, r in pairs.items()}
        self.arcs |= {(state[r.uv], number[pairs[r.vw].w]): (np.log10(r.p), target[r.vw]) for r in triples}
        self.failure_logs, self.failures = np.log10(left), failures


class Head(dict):
    """Rank and count by word, kept by hash."""

    def __getitem__(self, word: str) -> tuple[int, int]:
        return super().__getitem__(int(hashes_of([word])[0]))


class Automaton:
    """Scores symbols one after another by arcs and failure arcs."""

    def __init__(self, model: Model):
        self.model, self.begin = model, 1 + model.end + 1

    def score(self, symbols: list[int]) -> float:
        """Log10 probability of a text's symbols, from the state of a text's beginning."""
        model, state, total = self.model, self.begin, 0.0
        for symbol in symbols:
            while state and (state, symbol) not in model.arcs:
                total += model.failure_logs[state]
                state = model.failures[state]
            log, state = model.arcs[state, symbol] if state else (model.root[symbol], symbol + 1)
            total += log
        return total


def fit(texts: DataFrame) -> tuple[Model, Tables]:
    """The automaton of the column `text` in memory, and as tables."""
    plain = texts.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("held_out"))
    tables = tables_of(learn(kept(sequences(plain), "lines")))
    return Model(tables), tables


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents, learned from those that are not held out."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    known = learn(kept(sequences(plain), "lines", "zstd"))
    tokens, different, least = known.tokens, known.different, LEAST
    size = np.log10(tokens + different + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at, (part, raw) in enumerate(zip(slices_of(batch, least), batch.column("sizes"), strict=True)):
                part.weigh(tokens, different)
                sizes = np.frombuffer(raw.as_buffer(), np.int32).astype(np.int64)
                times = part.counts[:-1]
                root = np.log10(times + 1) - size
                by_text = lambda values: np.add.reduceat(values, part.first)  # noqa: B023, E731
                ids = batch.column("doc_ids").slice(at, 1).flatten()
                columns = [ids, pa.array(np.full(len(sizes), batch.column("held_out")[at].as_py())), pa.array(sizes), pa.array(by_text((times[part.codes] > 0).astype(np.int64))), pa.array(by_text(root[part.codes])), pa.array(part.traverse(root))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = known.lines.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
