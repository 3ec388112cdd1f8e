"""Language of whole texts by a linear-chain conditional random field over their words.

A word's features are its character n-grams, its prefixes and suffixes, and whether it stands in the lexicon of
frequent training words; all are hashed into one table of weights with a column for each language. Transitions between
the languages of neighbouring words are learned too: training sequences are spliced from passages of different
documents, as in code-switched text. Forward-backward gives each word its distribution over languages; a text's
language is the one with the largest expected number of words, and its score is that share.

The field is fitted on a bounded sample: about `DOCUMENTS` documents of each language, `PASSAGES` passages of
`PASSAGE` words spread over each whole text. Prediction reads whole texts.

A text that is missing or has no letter is `und` with score 0; so is every text if there is nothing to learn from.
Ties go to the first language in order of name. Rows keep their order and multiplicity; a column that bears the name
of the result is replaced; other columns stay as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.llm.common import release, slices

UNKNOWN = "und"
DOCUMENTS = 300
PASSAGES = 8
PASSAGE = 12
#: Characters that a training passage may have.
LONGEST = 1_000
#: Passages spliced into a training sequence, and the size of the table of weights.
SPLICED = 4
TABLE = 1 << 17
#: Occurrences in the sample that put a word into the lexicon.
FREQUENT = 3
ROUNDS = 60
STEP = 0.15
DECAY = 2e-6
#: Bytes of texts whose words are labelled together.
PART = 1_000_000
RESULT = "struct<lang:string,score:double>"

_NOT_LETTER = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1_000_003)


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words (lower case, letters only) of the texts, the word at each place, and each text's places.

    Words are cut at white space; those without a letter are left out.
    """
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    ends = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = [w if w.isalpha() else _NOT_LETTER.sub("", w) for w in coded.dictionary.to_pylist()]
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = np.array([bool(w) for w in words], bool)[at] if len(words) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(real)])
    return words, at[real], before[ends]


def slot(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (((hashes + np.uint64(kind)) * _MIX) >> np.uint64(64 - (TABLE.bit_length() - 1))).astype(np.int64)


def word_features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, slot) of all features, by word."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - first[word]
    left = size[word] - place
    owners, slots = [], []
    with np.errstate(over="ignore"):
        gram = np.zeros(len(code), np.uint64)
        for n in range(1, 6):
            following = np.zeros(len(code), np.uint64)
            following[: max(0, len(code) - n + 1)] = code[n - 1 :]
            gram = gram * _BASE + following
            # all short n-grams; of the longer ones only prefixes and suffixes
            for kind, fits in ((n, left >= n),) if n < 4 else ((n, (left >= n) & (place == 0)), (n + 10, left == n)):
                owners.append(word[fits])
                slots.append(slot(gram[fits], kind))
        whole = whole_words(code, first, place)
        known = np.isin(whole, lexicon)
        owners.append(np.flatnonzero(known))
        slots.append(slot(whole[known], 99))
    owners, slots = np.concatenate(owners), np.concatenate(slots)
    order = np.argsort(owners, kind="stable")
    return owners[order], slots[order]


def whole_words(code: np.ndarray, first: np.ndarray, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, _BASE, np.uint64))
        return np.add.reduceat(code * powers[place], first) if len(first) else np.zeros(0, np.uint64)


@dataclass
class Field:
    """Languages, weights (slots x languages), transitions, start weights and the lexicon's hashes."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            if any(some):
                owners, slots = word_features(some, self.lexicon)
                out[at : at + len(some)] = np.add.reduceat(self.weights[slots], np.searchsorted(owners, np.arange(len(some))), axis=0)
        return out

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distribution of each word over the languages, and each text's places."""
        words, at, ends = words_of(texts)
        scores = self.emissions(words)[at] if len(at) else np.zeros((0, len(self.languages)))
        return marginals(scores, ends[:-1], self.transitions, self.start), ends

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        out, shares = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return out, shares
        labelled, ends = self.label(texts)
        counts = np.diff(ends)
        full = np.flatnonzero(counts)
        if len(full):
            expected = np.add.reduceat(labelled, ends[:-1][full], axis=0) / counts[full][:, None]
            best = np.argmax(np.round(expected, 12), axis=1)
            shares[full] = np.clip(expected[np.arange(len(full)), best], 0, 1)
            for k, b in zip(full, best, strict=True):
                out[k] = self.languages[b]
        return out, shares


def marginals(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, start: np.ndarray, columns: int = 128) -> np.ndarray:
    """Forward-backward over all sequences laid end to end; `starts` are the places where one begins.

    The places are cut into rows of `columns`, which are worked on side by side. A first pass finds how each row maps
    the message that enters it; a scan over rows hands the messages on; a second pass fills in the rows. A place where
    a sequence starts forgets what came before.
    """
    total, labels = scores.shape
    if not total:
        return scores
    rows = -(-total // columns)
    emitted = np.ones((rows * columns, labels))
    emitted[:total] = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -50))
    fresh = np.zeros(rows * columns, bool)
    fresh[starts[starts < total]] = True
    fresh[0] = True
    fresh[total:] = True
    emitted = np.ascontiguousarray(emitted.reshape(rows, columns, labels).transpose(1, 0, 2))
    fresh = fresh.reshape(rows, columns).T
    news = [np.flatnonzero(f) for f in fresh]
    step, begin = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    through = np.broadcast_to(np.eye(labels), (rows, labels, labels)).copy()
    for t in range(columns):
        before = through[news[t]].sum(axis=2, keepdims=True)
        through = (through.reshape(-1, labels) @ step).reshape(rows, labels, labels) * emitted[t][:, None, :]
        through[news[t]] = before * (begin * emitted[t][news[t]])[:, None, :]
        if t % 4 == 3:
            through /= through.max(axis=(1, 2), keepdims=True)
    ahead, back = np.empty((rows, labels)), np.empty((rows, labels))
    message = np.ones(labels)
    for r in range(rows):
        ahead[r] = message
        message = message @ through[r]
        message /= message.sum()
    message = np.ones(labels)
    for r in range(rows - 1, -1, -1):
        back[r] = message
        message = through[r] @ message
        message /= message.max()
    forward = np.empty((columns, rows, labels))
    for t in range(columns):
        ahead = (ahead @ step) * emitted[t]
        if len(news[t]):
            ahead[news[t]] = begin * emitted[t][news[t]]
        ahead /= ahead.sum(axis=1, keepdims=True)
        forward[t] = ahead
    for t in range(columns - 1, -1, -1):
        forward[t] *= back
        back = (emitted[t] * back) @ step.T
        if len(news[t]):
            back[news[t]] = 1
        back /= back.max(axis=1, keepdims=True)
    out = forward.transpose(1, 0, 2).reshape(-1, labels)[:total]
    return out / out.sum(axis=1, keepdims=True)


def fit(passages: list[tuple[str, str]]) -> Field:
    """A field from (language, passage of words) pairs; neighbours in the list are spliced."""
    languages = sorted({lang for lang, _ in passages})
    count = len(languages)
    empty = Field(languages, np.zeros((TABLE, count), np.float32), np.zeros((count, count)), np.zeros(count), np.zeros(0, np.uint64))
    words, at, ends = words_of(pa.array([p for _, p in passages], pa.string()))
    if not count or not len(at):
        return Field([], empty.weights[:, :0], empty.transitions[:0, :0], empty.start[:0], empty.lexicon)
    gold = np.repeat([languages.index(lang) for lang, _ in passages], np.diff(ends))
    starts = np.unique(ends[:-1][::SPLICED])
    starts = starts[starts < len(at)]
    often = np.bincount(at, minlength=len(words)) >= FREQUENT
    common = [w for w, o in zip(words, often, strict=True) if o and w]
    if common:
        size = np.fromiter(map(len, common), np.int64, len(common)) + 2
        code = np.frombuffer("".join(f"<{w}>" for w in common).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        first = np.cumsum(size) - size
        lexicon = np.unique(whole_words(code, first, np.arange(len(code)) - np.repeat(first, size)))
    else:
        lexicon = empty.lexicon
    owners, slots = word_features(words, lexicon)
    heads = np.searchsorted(owners, np.arange(len(words)))
    inside = np.ones(len(at), bool)
    inside[starts] = False
    inner = np.flatnonzero(inside)
    seen_moves = np.bincount(gold[inner - 1] * count + gold[inner], minlength=count * count).reshape(count, count)
    seen_starts = np.bincount(gold[starts], minlength=count)
    values = [np.zeros((TABLE, count)), np.zeros((count, count)), np.zeros(count)]
    first_moment, second_moment = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    one = np.eye(count)[gold]
    for turn in range(1, ROUNDS + 1):
        weights, moves, begin = values
        scores = np.add.reduceat(weights[slots], heads, axis=0)[at]
        found = marginals(scores, starts, moves, begin)
        residual = found - one
        by_word = np.stack([np.bincount(at, residual[:, k], len(words)) for k in range(count)], axis=1)
        slope = np.stack([np.bincount(slots, by_word[owners, k], TABLE) for k in range(count)], axis=1)
        expected = pair_counts(scores, starts, inner, moves, begin)
        slopes = [slope / len(at) + DECAY * weights, (expected - seen_moves) / len(at) + DECAY * moves, (found[starts].sum(axis=0) - seen_starts) / len(at) + DECAY * begin]
        for k, g in enumerate(slopes):
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
            second_moment[k] = 0.99 * second_moment[k] + 0.01 * g * g
            values[k] = values[k] - STEP * (first_moment[k] / (1 - 0.9**turn)) / (np.sqrt(second_moment[k] / (1 - 0.99**turn)) + 1e-8)
    return Field(languages, values[0].astype(np.float32), values[1], values[2], lexicon)


def pair_counts(scores: np.ndarray, starts: np.ndarray, inner: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Expected numbers of transitions; sequences of training are short, so they run side by side."""
    count = scores.shape[1]
    emitted = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -50))
    sizes = np.diff(np.append(starts, len(scores)))
    step, first = np.exp(moves - moves.max()), np.exp(begin - begin.max())
    ahead, back = np.empty_like(emitted), np.ones_like(emitted)
    for t in range(int(sizes.max())):
        here = starts[sizes > t] + t
        a = (ahead[here - 1] @ step if t else np.broadcast_to(first, (len(here), count))) * emitted[here]
        ahead[here] = a / a.sum(axis=1, keepdims=True)
    for t in range(int(sizes.max()) - 1, 0, -1):
        here = starts[sizes > t] + t
        b = (emitted[here] * back[here]) @ step.T
        back[here - 1] = b / b.max(axis=1, keepdims=True)
    right = emitted[inner] * back[inner]
    left = ahead[inner - 1]
    share = 1 / np.einsum("ni,ij,nj->n", left, step, right)
    return np.einsum("ni,nj,n->ij", left, right, share) * step


def passages_of(docs: DataFrame, lang: Column, key: Column, text: Column, documents: int = DOCUMENTS) -> list[tuple[str, str]]:
    """A bounded sample of (language, passage) pairs in a repeatable order of their own.

    Documents are taken by the hash of their key and text, at a rate that leaves about `documents` of each language;
    the passages lie evenly spaced in the whole text.
    """
    plain = docs.select(lang.cast("string").alias("lang"), text.cast("string").alias("text"), F.xxhash64(key, text).alias("h")).filter("lang is not null and text is not null")
    counted = {r.lang: r["n"] for r in plain.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not counted:
        return []
    rates = F.create_map(*(x for k, n in counted.items() for x in (F.lit(k), F.lit(min(1.0, documents / n)))))
    taken = plain.filter(F.pmod("h", F.lit(1_000_000)) < rates[F.col("lang")] * 1_000_000)

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            words = t.split()
            many = max(1, min(PASSAGES, len(words) // PASSAGE))
            firsts = [k * max(0, len(words) - PASSAGE) // max(1, many - 1) for k in range(many)]
            out.append([p for f in firsts if len(p := " ".join(words[f : f + PASSAGE])) <= LONGEST])
        return pa.array(out, pa.list_(pa.string()))

    rows = taken.select("lang", "h", F.posexplode(cut("text")).alias("n", "passage")).select("lang", "passage", F.xxhash64("h", "n", "lang").alias("at"))
    return [(r.lang, r.passage) for r in rows.orderBy("at", "lang", "passage").limit(2 * documents * PASSAGES * len(counted)).collect()]


def identify(docs: DataFrame, field: Field, text_col: str = "text", into: str = "language") -> DataFrame:
    """`docs` with a struct of lang and score in the column `into`."""
    held = docs.sparkSession.sparkContext.broadcast(field)  # its size depends on the table and the languages alone

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        release()
        langs, scores = [], []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), PART):
            some, shares = held.value.predict(part.column("text"))
            langs += some
            scores.append(shares)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang", "score"])

    return docs.withColumn(into, predict(F.col(text_col).cast("string")))
