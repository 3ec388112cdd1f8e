"""Distinct sampled segmentations of texts into SentencePiece pieces, by Gumbel top-k without replacement.

The lattice of a normalised text has an edge for every piece that matches, and for any character that is no piece an
edge for its bytes. A piece's weight falls with its rank in the vocabulary (`SHARPNESS` times the logarithm of rank +
1); summing weights from the end back gives each node the probability of every next edge, and a segmentation its
probability among all of them. No piece crosses from a word into the next word's space mark, so the lattice of a text
is that of its words one after another, and equal words share one.

Perturbing every segmentation's log-probability by its own Gumbel and taking the k largest samples without
replacement. The best-first search does so without listing them: the whole text's largest perturbed value is a Gumbel;
at every node of a path taken, all other edges together have a largest perturbed value below the path's own, drawn as
a truncated Gumbel; the largest such value of any path so far names the next segmentation, which leaves there and is
drawn freely from then on. The largest value left after k segmentations turns each one's log-probability into the
probability that it is included, given that value.

All draws come from the row's key and the place of the draw, so they don't depend on partitions. Missing texts count as
empty; an empty text has one segmentation, without pieces. Texts with fewer segmentations than asked for give all,
each with inclusion 1. Rows with equal keys and texts get equal samples; rows without a key share one seed. An empty
table gives an empty result. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.llm.common import crc32, parts_of, texts_of

MARK = "▁"
SHARPNESS = 2.0
SAMPLES = 2
#: Documents whose lattices are built together.
PART = 2_000
#: From this length on, places are left where no longer piece begins; bitmaps of 2^`STEM_BITS` hashes tell.
STEM = 2
STEM_BITS = 18

_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1_099_511_628_211)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values from any."""
    with np.errstate(over="ignore"):
        x = (x + _ODD).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 from 64-bit keys."""
    return ((mixed(x) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


class Table:
    """Ids by hash: each hash has its place in one of two arrays, told by different bits of it."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray):
        self.bits = 18
        while True:
            self.places = [np.full(1 << self.bits, len(hashes), np.int32) for _ in range(2)]
            first, second = self.where(hashes)
            _, kept = np.unique(first, return_index=True)
            rest = np.setdiff1d(np.arange(len(hashes)), kept)
            self.places[0][first[kept]] = kept
            self.places[1][second[rest]] = rest
            if len(np.unique(second[rest])) == len(rest):
                break
            self.bits += 1
        self.hashes, self.ids = np.append(hashes, ~hashes[:1]), np.append(ids, -1).astype(np.int32)

    def where(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.uint64(self.bits)
        return (hashes >> (np.uint64(64) - bits)).astype(np.int32), (hashes >> np.uint64(20) & np.uint64((1 << self.bits) - 1)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are there, and their ids."""
        first, second = self.where(hashes)
        place = self.places[0][first]
        hit = self.hashes[place] == hashes
        other = np.flatnonzero(~hit)
        place[other] = self.places[1][second[other]]
        hit[other] = self.hashes[place[other]] == hashes[other]
        found = np.flatnonzero(hit)
        return found, self.ids[place[found]]


class Vocabulary:
    """Pieces by length and hash, their weights, and what each id stands for."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        size = self.processor.get_piece_size()
        ids = range(size)
        self.bytes_id = np.full(256, self.processor.unk_id(), np.int64)
        rank = np.array([-self.processor.get_score(i) for i in ids])
        rank = np.argsort(np.argsort(np.where(np.isfinite(rank), rank, 1e18), kind="stable"), kind="stable")
        self.weight = -sharpness * np.log(rank + 1.0)
        self.byte_weight = -sharpness * np.log(size + 1.0)
        self.meaning: list[bytes] = [b""] * size
        by_length: dict[int, list[int]] = {}
        for i in ids:
            piece = self.processor.id_to_piece(i)
            if self.processor.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.meaning[i] = bytes([int(piece[3:5], 16)])
            elif not (self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_unused(i)):
                if re.search(f"[^{MARK}]{MARK}", piece):
                    raise ValueError(f"{piece!r} crosses from a word into the next")
                by_length.setdefault(len(piece), []).append(i)
                self.meaning[i] = piece.replace(MARK, " ").encode()
        self.meanings = np.array(self.meaning, object)
        self.lengths, self.stems = {}, {}
        stems: dict[int, list[np.ndarray]] = {}
        for n, own in sorted(by_length.items()):
            codes = np.array([[ord(c) for c in self.processor.id_to_piece(i)] for i in own], np.uint64)
            self.lengths[n] = Table(self.hashes(codes), np.array(own, np.int32))
            for k in range(STEM, n):
                stems.setdefault(k, []).append(self.hashes(codes[:, :k]))
        #: What longer pieces begin with: a bit for each hash's last bits, so some more pass.
        for n, found in stems.items():
            self.stems[n] = np.zeros(1 << STEM_BITS, bool)
            self.stems[n][np.concatenate(found) & np.uint64((1 << STEM_BITS) - 1)] = True
        self.longest = max(self.lengths, default=1)

    @staticmethod
    def hashes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(codes.shape[1]):
                out = out * _BASE + mixed(codes[:, k])
        return out

    def normal(self, text: str) -> str:
        return self.processor.normalize(text)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of the ids, without the space that the normaliser put before it."""
        text = b"".join(self.meanings[ids].tolist() if isinstance(ids, np.ndarray) else map(self.meaning.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Lattice:
    """Nodes and edges of different words laid end to end; `entry` is each word's first node."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size + 1) - size - 1
        code = np.frombuffer(("\0".join(words) + "\0" if words else "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        total = len(code)
        left = (np.repeat(first + size, size + 1) - np.arange(total)).astype(np.int32)  # 0 at a word's last node
        spread = mixed(code)
        sources, steps, kinds = [], [], []
        single = np.zeros(total, bool)
        at = np.flatnonzero(left > 0).astype(np.int32)
        gram = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, min(vocabulary.longest, int(size.max(initial=0))) + 1):
                if n > 1:  # only places with n characters left go on
                    more = left[at] >= n
                    at, gram = at[more], gram[more]
                    if not len(at):
                        break
                gram = gram * _BASE + spread[at + n - 1]
                if n in vocabulary.lengths:
                    hit, ids = vocabulary.lengths[n].find(gram)
                    sources.append(at[hit])
                    steps.append(np.full(len(hit), n, np.int32))
                    kinds.append(ids)
                    if n == 1:
                        single[at[hit]] = True
                if n in vocabulary.stems:
                    more = np.flatnonzero(vocabulary.stems[n][gram & np.uint64((1 << STEM_BITS) - 1)])
                    at, gram = at[more], gram[more]
        bare = np.flatnonzero(~single & (left > 0)).astype(np.int32)
        sources.append(bare)
        steps.append(np.ones(len(bare), np.int32))
        kinds.append(-1 - code[bare].astype(np.int32))  # a character's bytes
        source, step, kind = np.concatenate(sources), np.concatenate(steps), np.concatenate(kinds)
        order = np.argsort(source, kind="stable")
        source, step, kind = source[order], step[order], kind[order]
        weight = vocabulary.weight[np.maximum(kind, 0)]
        bare = np.flatnonzero(kind < 0)
        weight[bare] = vocabulary.byte_weight * utf8_length(-1 - kind[bare])
        beyond = np.zeros(total)
        far = left[source]
        order = np.argsort(far.astype(np.int16) if far.max(initial=0) < 32_768 else far, kind="stable")  # nodes near the end first
        source_, onward, weight_ = source[order], (source + step)[order], weight[order]
        count = np.bincount(far)
        ends = np.cumsum(count)
        for a, b in zip((ends - count)[count > 0], ends[count > 0], strict=True):
            heads = np.flatnonzero(np.diff(source_[a:b], prepend=-1))
            beyond[source_[a:b][heads]] = np.logaddexp.reduceat(weight_[a:b] + beyond[onward[a:b]], heads)
        del far, order, source_, onward, weight_  # as long as the edges, and not needed beside what follows
        self.source, self.target, self.kind = source, source + step, kind
        self.log = weight + beyond[self.target] - beyond[source]
        self.degree = np.bincount(source, minlength=total).astype(np.int32)
        self.begin = np.concatenate([[0], np.cumsum(self.degree)])
        upto = np.cumsum(np.exp(self.log))
        with np.errstate(divide="ignore"):
            #: Logarithm of the share of a node's other edges together.
            self.others = np.log(np.maximum(-np.expm1(np.minimum(self.log, 0.0)), 0.0))
        self.others[self.degree[source] == 1] = -np.inf
        # a node's shares add up to one, so what all earlier nodes have is their number
        inner = np.flatnonzero(self.degree)
        share = upto - np.repeat(np.concatenate([[0.0], upto])[self.begin[inner]], self.degree[inner])
        share[self.begin[inner] + self.degree[inner] - 1] = 1.0
        #: Ascending over all edges: the node plus the share of its edges up to this one.
        self.ladder = source + np.minimum(share, 1.0)
        self.entry, self.left = first, left

    def draw(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each node to the end of its word: (lane, edge), by lane and then in order."""
        lanes, edges = [], []
        count = np.zeros(len(nodes), np.int64)
        live = np.flatnonzero(self.left[nodes] > 0)
        live = live[np.argsort(nodes[live])]  # equal words side by side: look-ups stay near one another
        nodes, keys = nodes[live], keys[live]
        step = np.uint64(1)
        while len(live):
            with np.errstate(over="ignore"):
                edge = np.searchsorted(self.ladder, nodes + uniform(keys + step * _ODD), "right")
            edge = np.clip(edge, self.begin[nodes], self.begin[nodes + 1] - 1)
            lanes.append(live)
            edges.append(edge)
            count[live] += 1
            nodes = self.target[edge]
            more = self.left[nodes] > 0
            live, nodes, keys = live[more], nodes[more], keys[more]
            step += np.uint64(1)
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for k, (lane, edge) in enumerate(zip(lanes, edges, strict=True)):
            out[first[lane] + k] = edge
        return np.repeat(np.arange(len(count)), count), out


def utf8_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


#: Places in a stretch, largest values first to leave there, log-probabilities before them, and the stretch's own.
Leaves = tuple[list[int], list[float], list[float], float]


class Search:
    """Best-first search over one text's lattice: paths taken and the values of what leaves them."""

    def __init__(self, lattice: Lattice, key: int, most: int):
        self.lattice, self.drawn, self.most = lattice, 0, most
        self.own = mixed(np.array([key ^ 0xA5A5], np.uint64))
        self.frontier: list[tuple[float, int, int, float]] = []
        self.paths: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[float] = []
        self.shut: dict[tuple[int, int], list[int]] = {}

    def uniforms(self, count: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = uniform(self.own + np.arange(self.drawn, self.drawn + count, dtype=np.uint64) * _ODD)
        self.drawn += count
        return out

    def add(self, value: float, lanes: np.ndarray, edges: np.ndarray, fresh: int, before: float) -> Generator[tuple[float, np.ndarray, float], Leaves]:
        """Take a path; `fresh` is the first edge it doesn't share with one taken before, `before` its log-probability there.

        Gives one stretch after another (value, edges, log-probability before them), and is sent what leaves it.
        """
        number = len(self.paths)
        self.paths.append((lanes, edges))
        self.values.append(value)
        found: list[tuple[float, int, float]] = []
        for at in range(fresh, len(edges), STRETCH):
            some = edges[at : at + STRETCH]
            best, values, priors, total = yield value, some, before
            self.drawn += len(some)
            found = sorted(found + [(-v, at + k, prior) for k, v, prior in zip(best, values, priors, strict=True) if v > -np.inf])[: self.most]
            before += total
            if len(found) == self.most and before + NOISE < -found[-1][0]:
                break  # what leaves further on is less likely than any draw can make up for
        for negative, place, prior in found:
            heapq.heappush(self.frontier, (negative, number, place, prior))

    def branch(self) -> tuple[float, int, int, int, float] | None:
        """Leave the path with the largest value: (value, path, place, edge taken, log-probability before)."""
        if not self.frontier:
            return None
        value, number, place, before = heapq.heappop(self.frontier)
        lattice = self.lattice
        old = int(self.paths[number][1][place])
        shut = self.shut.setdefault((number, place), [old])
        node = lattice.source[old]
        edges = np.setdiff1d(np.arange(lattice.begin[node], lattice.begin[node + 1]), shut)
        share = np.exp(lattice.log[edges])
        edge = int(edges[min(np.searchsorted(np.cumsum(share) / share.sum(), self.uniforms(1)[0], "right"), len(edges) - 1)])
        shut.append(edge)
        rest = np.setdiff1d(edges, [edge])
        if len(rest):
            loc = np.array([before + np.logaddexp.reduce(lattice.log[rest])])
            heapq.heappush(self.frontier, (-float(below(-value, loc, self.uniforms(1))[0]), number, place, before))
        return -value, number, place, edge, before


#: Nodes of a path looked at together, and more than a draw can add to a log-probability (its number is below 1 - 2^-54).
STRETCH = 256
NOISE = 38.0


def below(most: float, loc: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels at these locations, given that they lie below `most`."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(loc), -np.inf, loc - np.log(np.exp(np.minimum(loc - most, 700.0)) - np.log(u)))


def sent(adding: Generator, value: Leaves) -> tuple[float, np.ndarray, float] | None:
    """What a generator gives next when it is sent a value; nothing at its end."""
    try:
        return adding.send(value)
    except StopIteration:
        return None


def leaves(lattice: Lattice, stretches: list[tuple[Search, float, np.ndarray, float]]) -> list[Leaves]:
    """Where it is best to leave each stretch: (its search, the path's value, edges, log-probability before them)."""
    size = np.array([len(edges) for _, _, edges, _ in stretches])
    value, before = (np.array([x[k] for x in stretches])[:, None] for k in (1, 3))
    drawn = np.array([search.drawn for search, *_ in stretches], np.uint64)[:, None]
    own = np.concatenate([search.own for search, *_ in stretches])[:, None]
    places = np.arange(size.max(initial=0))
    real = places < size[:, None]
    some = np.zeros(real.shape, np.int64)
    some[real] = np.concatenate([edges for _, _, edges, _ in stretches])
    logs = np.where(real, lattice.log[some], 0.0)
    upto = before + np.cumsum(logs, axis=1) - logs
    with np.errstate(over="ignore"):
        u = uniform(own + (drawn + places.astype(np.uint64)) * _ODD)
    values = below(value, np.where(real, upto + lattice.others[some], -np.inf), u)
    # of a path, only the largest can be next, and after it the next largest
    most = stretches[0][0].most
    best = np.argpartition(-values, most - 1, axis=1)[:, :most] if most < len(places) else np.broadcast_to(places, real.shape)
    rows = np.arange(len(size))[:, None]
    return list(zip(best.tolist(), values[rows, best].tolist(), upto[rows, best].tolist(), logs.sum(axis=1).tolist(), strict=True))


def units_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different units (a word with its space marks), the unit at each place, and how many each text has."""
    if any(MARK + MARK in t or t and t[0] != MARK for t in texts):
        cut = [_UNIT.findall(t) for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        coded = pa.array([u for own in cut for u in own], pa.large_string()).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts
    # every mark opens a unit; what is before the first is empty
    split = pc.split_pattern(pa.array(texts, pa.large_string()), MARK)
    ends = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    at = np.delete(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends[:-1])
    return [MARK + w for w in coded.dictionary.to_pylist()], at, np.diff(ends) - 1


def sample_texts(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k of (ids, log-probability, perturbed value, inclusion), largest value first."""
    words, at, counts = units_of([vocabulary.normal(t) if t else "" for t in texts])
    lattice = Lattice(vocabulary, words)
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(texts)), counts)
    unit = np.arange(len(at)) - (ends - counts)[row]

    def lane_keys(rows: np.ndarray, units_: np.ndarray, sample: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(keys[rows] + np.uint64(sample) * _BASE) + mixed(units_.astype(np.uint64))

    lane, edge = lattice.draw(lattice.entry[at], lane_keys(row, unit, 0))
    bounds = np.searchsorted(lane, np.concatenate([[0], ends]))
    gumbels = -np.log(-np.log(uniform(mixed(keys ^ np.uint64(0x5A5A)))))
    searches = [Search(lattice, int(own), k) for own in keys]

    def take(paths: list[tuple[Search, float, np.ndarray, np.ndarray, int, float]]) -> None:
        """Add each search's path; stretches of different searches are looked at together."""
        live = [(search, adding, some) for search, *path in paths for adding in [search.add(*path)] for some in [next(adding, None)] if some]
        while live:
            found = leaves(lattice, [(search, *some) for search, _, some in live])
            live = [(search, adding, some) for (search, adding, _), own in zip(live, found, strict=True) for some in [sent(adding, own)] if some]

    take([(s, float(gumbels[r]), lane[bounds[r] : bounds[r + 1]], edge[bounds[r] : bounds[r + 1]], 0, 0.0) for r, s in enumerate(searches)])
    for sample in range(1, k):
        left = [(r, b) for r, s in enumerate(searches) if (b := s.branch())]
        if not left:
            break
        # all that follows the branches is drawn at once: the rest of the word, then the words after it
        nodes, lanes, owners = [], [], []
        for r, (_, number, place, taken, _) in left:
            here = int(searches[r].paths[number][0][place])
            after = np.arange(here, ends[r])
            start = lattice.entry[at[after]]
            start[0] = lattice.target[taken]
            nodes.append(start)
            lanes.append(after)
            owners.append(np.full(len(after), r))
        nodes, lanes, owners = np.concatenate(nodes), np.concatenate(lanes), np.concatenate(owners)
        drawn, found = lattice.draw(nodes, lane_keys(owners, unit[lanes], sample))
        owner = owners[drawn]
        cuts = np.searchsorted(owner, np.array([[r, r + 1] for r, _ in left]))
        paths = []
        for (r, (value, number, place, taken, before)), (a, b) in zip(left, cuts, strict=True):
            old_lanes, old_edges = searches[r].paths[number]
            new_lanes = np.concatenate([old_lanes[: place + 1], lanes[drawn[a:b]]])
            new_edges = np.concatenate([old_edges[:place], [taken], found[a:b]])
            paths.append((searches[r], value, new_lanes, new_edges, place + 1, before + float(lattice.log[taken])))
        take(paths)
    out = []
    for s in searches:
        cut = -s.frontier[0][0] if s.frontier else -np.inf
        own = []
        for (_, edges), value in zip(s.paths, s.values, strict=True):
            log = float(lattice.log[edges].sum())
            own.append((ids_of(vocabulary, lattice.kind[edges]), log, value, float(-np.expm1(-np.exp(min(log - cut, 700.0))))))
        out.append(own)
    return out


def ids_of(vocabulary: Vocabulary, kinds: np.ndarray) -> np.ndarray:
    """Piece ids; a character that is no piece becomes its bytes."""
    bare = kinds < 0
    if not bare.any():
        return kinds
    if kinds[bare].min() >= -128:  # ASCII: a byte each
        return np.where(bare, vocabulary.bytes_id[np.where(bare, -1 - kinds, 0)], kinds)
    return np.array([i for kind in kinds.tolist() for i in ([kind] if kind >= 0 else vocabulary.bytes_id[list(chr(-1 - kind).encode())].tolist())], np.int64)


_VOCABULARIES: dict[tuple[str, float], Vocabulary] = {}


def vocabulary_at(path: str, sharpness: float) -> Vocabulary:
    """One for each worker."""
    if (path, sharpness) not in _VOCABULARIES:
        _VOCABULARIES[path, sharpness] = Vocabulary(path, sharpness)
    return _VOCABULARIES[path, sharpness]


def sample(docs: DataFrame, path: str, k: int = SAMPLES, seed: int = 0, sharpness: float = SHARPNESS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sample (from 0), n_pieces, log_prob, perturbed, inclusion, ids_crc32, text_crc32 of the decoded ids."""
    kinds = [("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("ids_crc32", pa.int64()), ("text_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_at(path, sharpness)
        for batch in batches:
            for part in parts_of(batch, PART):
                docs_ = part.column("doc_id").to_pylist()
                keys = mixed(np.array([d if d is not None else -1 for d in docs_], np.int64).view(np.uint64) ^ np.uint64(seed))
                rows = []
                for doc, own in zip(docs_, sample_texts(vocabulary, texts_of(part), keys, k), strict=True):
                    for n, (ids, log, value, inclusion) in enumerate(own):
                        text = vocabulary.decode(ids)
                        rows.append((doc, n, len(ids), log, value, inclusion, crc32(ids.astype("<u4")), crc32(text.encode())) + ((ids.tolist(),) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

    schema = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long, text_crc32 long" + (", ids array<int>" if with_ids else "")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(job, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """`rows` with the text of the ids in the column `into`; missing ids give a missing text."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        vocabulary = vocabulary_at(path, SHARPNESS)
        return pa.array([None if own is None else vocabulary.decode(own) for own in ids.to_pylist()], pa.string())

    return rows.withColumn(into, text(F.col(ids_col)))
