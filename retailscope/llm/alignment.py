"""Two tokenizers' tokens of the same text, grouped by where both end, by pointer jumping.

Both token sequences of a text cover the same bytes: a space and the text. Every token points to the farthest-right
token of the other sequence that overlaps it; a token of B that ends where a token of A ends points to itself. Doubling
these successors (each takes its successor's successor, for all tokens of many texts at once) converges to the terminal
token of each overlapping component, which labels its group. The terminal token of B and the token of A that ends with
it are the group's link.

Texts are cut before each space that stands between two characters other than white space. No token of a byte-level BPE
or of a vocabulary without inner U+2581 crosses such a cut, so the groups of a text are those of its segments one
after another; a vocabulary that doesn't allow this has its texts taken whole. Likewise a segment is cut between its
first letters and a mark that no token of either vocabulary has after a letter. Segments are aligned once and
remembered, up to a bound.

Of two tokens that end together one's bytes end the other's. So the pairs that can be linked are known from the two
vocabularies: at most as many as their tokens have bytes, whatever the size of the corpus. They have fixed numbers,
links are stored as these, tasks count into one array of them, and the corpus-wide counts travel as one such array.

Missing and empty texts, and those whose joined bytes of A or B aren't a space and the text, have no tokens: zeros and
an empty `groups`. Rows without an id, repeated rows and equal texts are each a row of their own and all count. An
empty table gives an empty result. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.llm.common import release, slices

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"
#: Segments that a worker remembers, and characters of text that are aligned together.
MOST = 200_000
CHARACTERS = 2_500_000
#: A space between two characters other than white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: What ASCII texts that can be cut at every space don't hold, and the same for all texts.
RARE = ("  ", " \n", "\n ", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f")
ODD = re.compile(r"\s | \s|^\s|\s$|^$")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes for characters from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}

LETTERS = re.compile(r"[^\W\d_]+")
#: Marks that may follow a word; letters and these are never cut out together before the merges.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~\n"


@dataclass
class Vocabulary:
    """Bytes of each token by id."""

    tokens: list[bytes]

    @property
    def lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))


def byte_level(tokenizer) -> Vocabulary:
    alphabet = byte_alphabet()
    ids = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (1 + max(ids.values()))
    for token, at in ids.items():
        out[at] = bytes(map(alphabet.__getitem__, token)) if set(token) <= alphabet.keys() else token.encode()
    return Vocabulary(out)


def pieces(processor) -> Vocabulary:
    out = []
    for k in range(processor.vocab_size()):
        piece = processor.id_to_piece(k)
        if processor.is_byte(k):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if processor.is_control(k) or processor.is_unknown(k) else piece.replace("▁", " ").encode())
    return Vocabulary(out)


def linkable(a: Vocabulary, b: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pairs of which one's bytes end the other's, by A's id and then B's."""
    found = set()
    for first, second, flip in ((a, b, False), (b, a, True)):
        by_bytes: dict[bytes, list[int]] = {}
        for at, token in enumerate(second.tokens):
            by_bytes.setdefault(token, []).append(at)
        for at, token in enumerate(first.tokens):
            for start in range(len(token)):
                found.update((other, at) if flip else (at, other) for other in by_bytes.get(token[start:], ()))
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def jumped(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each token (A's first, then B's) the number among B's of its component's terminal token.

    The ends are byte offsets, ascending, of two token sequences over the same bytes.
    """
    n = len(ends_a)
    # tokens follow one another without gaps, so the one that holds the last byte overlaps and is the farthest right
    over_a = np.searchsorted(ends_b, ends_a)
    over_b = np.searchsorted(ends_a, ends_b)
    together = ends_a[over_b] == ends_b
    successor = np.concatenate([n + over_a, np.where(together, n + np.arange(len(ends_b)), over_b)])
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor - n
        successor = further


class Aligner:
    """Groups and links of texts under one pair of vocabularies, with remembered segments."""

    def __init__(self, path_a: str, path_b: str, most: int = MOST):
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path_a)
        self.tokenizer.encode_special_tokens = True
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a, self.b = byte_level(self.tokenizer), pieces(self.processor)
        self.length_a, self.length_b = self.a.lengths, self.b.lengths
        self.pair_a, self.pair_b = linkable(self.a, self.b)
        self.base = np.int64(len(self.b.tokens))
        self.pairs = self.pair_a * self.base + self.pair_b
        self.names = [str(k) for k in range(max(len(self.a.tokens), len(self.b.tokens)))]
        self.pair_names = [f"{a}|{b}" for a, b in zip(self.pair_a.tolist(), self.pair_b.tolist(), strict=True)]
        # a byte-level vocabulary without a normalizer gives back every byte
        self.lossless = self.tokenizer.normalizer is None
        names = map(self.processor.id_to_piece, range(len(self.b.tokens)))
        self.cuttable = not any(re.search("[^▁]▁", name) for name in names)
        self.marks = self.certain() if self.cuttable else frozenset()
        self.most = most
        self.forget()

    def certain(self) -> frozenset[tuple[int, str]]:
        """Last bytes of a letter and marks that are neighbours in no token: what is on both sides has tokens of its own."""
        inner = {pair for v in (self.a, self.b) for t in v.tokens for pair in zip(t, t[1:], strict=False)}
        sure = [m for m in MARKS if (ord("a"), m) not in inner] if len(self.processor.encode("a")) == 1 else []
        return frozenset((b, chr(m)) for m in sure for b in range(256) if (b, m) not in inner)

    def forget(self) -> None:
        """`known`: place of a segment, `tails`: of the rest of one after its letters (-1 if its bytes differ); by place its
        groups as text, its links, and its tokens of A and B."""
        self.known: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.texts: list[str] = []
        self.links: list[bytes] = []
        self.n_a, self.n_b = array("i"), array("i")
        self.held = 0

    def segments(self, text: str) -> list[str]:
        if not self.cuttable:
            return [text]
        plain = text.isascii() and not any(x in text for x in RARE) and text[0] not in " \n" and text[-1] not in " \n"
        return text.split(" ") if plain or not ODD.search(text) else CUT.split(text)

    def learn(self, segments: list[str]) -> None:
        """Remember unseen segments; those with certain marks after their letters are put together from two parts."""
        cut, whole, tails = [], {}, {}
        for segment in segments:
            head = "" if segment.isalpha() or not (found := LETTERS.match(segment)) else found[0]
            tail = segment[len(head) :]
            if head.isalpha() and tail and (head[-1].encode()[-1], tail[0]) in self.marks:
                cut.append((segment, head, tail))
                if head not in self.known:
                    whole[head] = None
                if tail not in self.tails:
                    tails[tail] = None
            else:
                whole[segment] = None
        self.held += sum(map(len, segments)) + sum(map(len, whole)) + sum(map(len, tails))
        if whole:
            words = list(whole)
            self.store(self.known, words, " ", self.ids_a([" " + w for w in words]), self.processor.encode(words, num_threads=1))
        if tails:
            rests = list(tails)
            # the letter in front is one piece, which is dropped
            self.store(self.tails, rests, "", self.ids_a(rests), [x[1:] for x in self.processor.encode(["a" + t for t in rests], num_threads=1)])
        known, ends, texts, links = self.known, self.tails, self.texts, self.links
        for segment, head, tail in cut:
            x, y = known[head], ends[tail]
            if x < 0 or y < 0:
                known[segment] = -1
                continue
            known[segment] = len(texts)
            texts.append(f"{texts[x]};{texts[y]}")
            links.append(links[x] + links[y])
            self.n_a.append(self.n_a[x] + self.n_a[y])
            self.n_b.append(self.n_b[x] + self.n_b[y])

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def matching(self, segments: list[str], lead: str, found_a: list[list[int]], found_b: list[list[int]]) -> list[bool]:
        """Which segments, after the lead, are what their tokens' bytes make."""
        return [
            b"".join(map(self.a.tokens.__getitem__, x)) == b"".join(map(self.b.tokens.__getitem__, y)) == (lead + s).encode()
            for s, x, y in zip(segments, found_a, found_b, strict=True)
        ]

    def store(self, places: dict[str, int], segments: list[str], lead: str, found_a: list[list[int]], found_b: list[list[int]]) -> None:
        """Align segments, all tokens at once, and remember them."""
        ids_a, ids_b = np.fromiter(chain.from_iterable(found_a), np.int64), np.fromiter(chain.from_iterable(found_b), np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        n_a, n_b = np.fromiter(map(len, found_a), np.int64), np.fromiter(map(len, found_b), np.int64)
        whole = (lead + lead.join(segments)).encode()
        joined = b"".join(map(self.b.tokens.__getitem__, ids_b.tolist())) == whole and (self.lossless or b"".join(map(self.a.tokens.__getitem__, ids_a.tolist())) == whole)
        if not joined or not n_b.all() or ends_a[-1] != len(whole) or (ends_a[np.cumsum(n_a) - 1] != ends_b[np.cumsum(n_b) - 1]).any():
            same = self.matching(segments, lead, found_a, found_b)
            places.update((s, -1) for s, ok in zip(segments, same, strict=True) if not ok)
            if any(same):
                self.store(places, *([x for x, ok in zip(c, same, strict=True) if ok] if c is not lead else lead for c in (segments, lead, found_a, found_b)))
            return
        label = jumped(ends_a, ends_b)
        terminal = np.flatnonzero(label[len(ids_a) :] == np.arange(len(ids_b)))
        last_a = np.searchsorted(ends_a, ends_b[terminal])
        links = np.searchsorted(self.pairs, ids_a[last_a] * self.base + ids_b[terminal]).astype(np.int32)
        # labels don't decrease along either sequence, so each group is a run of both
        groups = list(map(self.pair_names.__getitem__, links.tolist()))
        first_a, first_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], terminal[:-1] + 1])
        longer = np.flatnonzero((first_a < last_a) | (first_b < terminal))
        names_a, names_b = list(map(self.names.__getitem__, ids_a.tolist())), list(map(self.names.__getitem__, ids_b.tolist()))
        bounds = (longer, first_a[longer], last_a[longer] + 1, first_b[longer], terminal[longer] + 1)
        for k, x, u, y, v in zip(*(x.tolist() for x in bounds), strict=True):
            groups[k] = f"{','.join(names_a[x:u])}|{','.join(names_b[y:v])}"
        raw, start = links.tobytes(), 0
        places.update(zip(segments, range(len(self.texts), len(self.texts) + len(segments)), strict=True))
        for stop in np.searchsorted(terminal, np.cumsum(n_b) - 1, "right").tolist():
            self.texts.append(groups[start] if stop == start + 1 else ";".join(groups[start:stop]))
            self.links.append(raw[4 * start : 4 * stop])
            start = stop
        self.n_a.frombytes(n_a.astype(np.int32).tobytes())
        self.n_b.frombytes(n_b.astype(np.int32).tobytes())

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, bytes]]:
        """Tokens of A and B, groups, the groups as text, and the links' numbers, of each text."""
        if len(self.known) > self.most or self.held > 20 * self.most:
            self.forget()
        cut = [self.segments(t) if t else [] for t in texts]
        new = list({s: None for segments in cut for s in segments if s not in self.known})
        if new:
            self.learn(new)
        n_a, n_b = np.array(self.n_a, np.int64), np.array(self.n_b, np.int64)
        for segments in cut:
            at = list(map(self.known.__getitem__, segments))
            if not at or -1 in at:
                yield 0, 0, 0, "", b""
                continue
            links, places = b"".join(map(self.links.__getitem__, at)), np.array(at)
            yield int(n_a[places].sum()), int(n_b[places].sum()), len(links) // 4, ";".join(map(self.texts.__getitem__, at)), links


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str, most: int) -> Aligner:
    """One for each pair of vocabularies and worker."""
    if (path_a, path_b) not in _ALIGNERS:
        release()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b, most)
    found = _ALIGNERS[path_a, path_b]
    found.most = most
    return found


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`: ids in order) and links (numbers of pairs, four bytes each).

    Texts are read by `path_a`, a byte-level BPE of the tokenizers library that gets a space in front of the text, and by
    `path_b`, a sentencepiece model that adds one itself.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b, most)
        for batch in batches:
            for part in slices(batch, CHARACTERS):
                found = list(own.align([t or "" for t in part.column("text").to_pylist()]))
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.large_binary()), strict=True)]
                columns[3:] = [c.cast(k) for c, k in zip(columns[3:], (pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(job, SCHEMA)


@dataclass
class LinkCounts:
    """Counts over the corpus by number of pair, and which are the highest of their id of B."""

    a: np.ndarray
    b: np.ndarray
    n: np.ndarray
    best: np.ndarray


def link_counts(aligned: DataFrame, path_a: str, path_b: str) -> LinkCounts:
    """How often each pair is linked. `aligned` is read once; its size in the driver is that of the vocabularies."""
    own = Aligner(path_a, path_b, 0)
    most = len(own.pairs)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most, np.int64)
        for batch in batches:
            for part in slices(batch, CHARACTERS, "links"):
                total += np.bincount(np.frombuffer(b"".join(part.column("links").to_pylist()), np.int32), minlength=most)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["link", "n"])

    found = aligned.select("links").mapInArrow(job, "link int, n long").groupBy("link").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(most, np.int64)
    n[found["link"].to_numpy()] = found["n"].to_numpy()
    highest = np.zeros(int(own.base), np.int64)
    np.maximum.at(highest, own.pair_b, n)
    return LinkCounts(own.pair_a, own.pair_b, n, (n > 0) & (n == highest[own.pair_b]))


def with_link_sums(aligned: DataFrame, counts: LinkCounts) -> DataFrame:
    """`aligned` with n_best and count_sum in place of its links."""
    held = aligned.sparkSession.sparkContext.broadcast((counts.n, counts.best))

    @F.arrow_udf("struct<n_best: long, count_sum: long>")
    def sums(links: pa.Array) -> pa.Array:
        n, best = held.value
        found = [np.frombuffer(x.as_buffer(), np.int32) for x in links]
        sizes = np.array([len(x) for x in found])
        flat = np.concatenate(found) if len(found) else np.zeros(0, np.int32)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        columns = [pa.array(t[upto[1:]] - t[upto[:-1]]) for t in (np.concatenate([[0], np.cumsum(v[flat], dtype=np.int64)]) for v in (best, n))]
        return pa.StructArray.from_arrays(columns, ["n_best", "count_sum"])

    return aligned.withColumn("_sums", sums("links")).select(*(c for c in aligned.columns if c != "links"), "_sums.*")
