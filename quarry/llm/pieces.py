"""SentencePiece encoding, decoding, and sampled segmentations without replacement.

Encoding and decoding are the library's. Sampling works on the lattice of all segmentations of a text into
pieces (a piece spans no space; characters without a piece fall back to bytes), where a piece weighs
1 / (rank + 10): vocabularies of merges give ranks only. Segmentations come out in the order of
Gumbel-perturbed log-probabilities. The search is top-down: the best segmentation inherits the value of the root;
at each of its steps the other branches together get the value of a Gumbel variable cut off at their parent's,
and the largest of these says where the next segmentation leaves the ones before. It is A* with exact bounds (the
lattice's own sums), so k segmentations cost k passes. What the other branches of a step weigh together is summed
over those branches, in double precision, and every one of them stays open until it is taken. All segmentations
are distinct, and each has an inclusion score: the logarithm of the probability to be among the k, given the value
at which the k + 1st would come.

Rows: a null text counts as empty: no pieces, no samples. A text with fewer than k segmentations gives all it
has. Random numbers hash doc_id (a seed of its own for null), place and pass, so reruns and repeated rows agree. An
empty table gives no rows. Other columns are ignored by ``encode`` and kept by ``with_pieces``.

Results are whole: the ids of the encoding, the text that the library decodes from all of them, and the ids of each
segmentation; numbers, checksums and the comparison stand beside them and are made from them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, fields
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bytewords import U64, alone, chunks, give_back, mix, powers

SPACE_MARK = "▁"
RANK_SHIFT = 10.0
_P, _Q = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
#: The seed of rows without an id.
NO_ID = -0x5EED5EED5EED5EED
#: Nodes of lattices and words that a Python worker keeps (at about 50 bytes each), and nodes made at once.
KEPT_NODES, KEPT_WORDS, AT_ONCE = 2 << 20, 1 << 20, 1 << 16
#: Edges of a node for which room is kept.
USUAL_EDGES = 4
#: Bytes of text that are walked at once; the arrays of a walk take many times as much.
TEXT_AT_ONCE = 1 << 18


@dataclass
class Edges:
    """Edges of lattices by node, the longest piece first. log: the logarithm of the probability at the node; size:
    characters; piece: its id, -2 - c for the bytes of the character c."""

    log: np.ndarray
    size: np.ndarray
    piece: np.ndarray

    @classmethod
    def room(cls, n: int) -> Edges:
        return cls(np.zeros(n), np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.int32))

    def columns(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


def _before(counts: np.ndarray) -> np.ndarray:
    """Sums of what comes before each place, and of all."""
    return np.concatenate([[0], np.cumsum(counts)])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Lattice:
    """The pieces of a model with their weights, and the lattices of words."""

    SLOT_BITS = 20

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        # a piece with the space mark anywhere but in front would span words
        kept = [(i, p) for i, p in ((i, sp.id_to_piece(i)) for i in usable) if SPACE_MARK not in p[1:]]
        self.ids = np.array([i for i, _ in kept], dtype=np.int64)
        weights = 1.0 / (np.array([max(0.0, -sp.get_score(i)) for i, _ in kept]) + RANK_SHIFT)
        total = weights.sum() + 1.0 / RANK_SHIFT
        self.logs = np.log(weights / total)
        self.byte_log = float(np.log(1.0 / (size + RANK_SHIFT) / total)) - 1.0
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self._beginnings([p for _, p in kept])
        self.nodes = _Nodes()
        self.words = _Encoded(sp)

    def _beginnings(self, pieces: list[str]) -> None:
        """Hashes of all beginnings of pieces, sorted, and the piece that each is (-1: it only begins some)."""
        sizes = np.array([len(p) for p in pieces])
        self.longest = int(sizes.max())
        codes = np.frombuffer("".join(p.ljust(self.longest, "\0") for p in pieces).encode("utf-32-le"), dtype="<u4").reshape(len(pieces), -1)
        h, hashes, piece = np.zeros(len(pieces), dtype=U64), [], []
        for n in range(self.longest):
            on = np.flatnonzero(sizes > n)
            h[on] = h[on] * _P + mix(codes[on, n].astype(U64))
            hashes.append(h[on])
            piece.append(np.where(sizes[on] == n + 1, on, -1))
        found, which = np.concatenate(hashes), np.concatenate(piece)
        order = np.lexsort((which, found))
        found, which = found[order], which[order]
        last = np.append(found[1:] != found[:-1], True)
        self.hashes, self.piece_of = found[last], which[last].astype(np.int32)
        # the first bits of a hash lead to its place; places that several share are searched for
        slots = (self.hashes >> U64(64 - self.SLOT_BITS)).astype(np.int64)
        self.slots = np.full(1 << self.SLOT_BITS, -1, dtype=np.int32)
        self.slots[slots] = np.arange(len(slots))
        self.slots[np.flatnonzero(np.bincount(slots, minlength=1 << self.SLOT_BITS) > 1)] = -2
        self.single = self.look_up(mix(np.arange(1 << 16, dtype=U64)))

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Places in hashes; -1 where nothing begins so."""
        at = self.slots[(h >> U64(64 - self.SLOT_BITS)).astype(np.int64)]
        several = np.flatnonzero(at == -2)
        if len(several):
            at[several] = np.minimum(np.searchsorted(self.hashes, h[several]), len(self.hashes) - 1)
        at[(at >= 0) & (self.hashes[at] != h)] = -1
        return at

    def _singles(self, chars: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """``look_up`` of single characters."""
        at = self.single[np.minimum(chars, len(self.single) - 1)]
        far = np.flatnonzero(chars >= len(self.single))
        at[far] = self.look_up(mixed[far])
        return at

    def edges(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, Edges]:
        """Number of edges of each node, and the edges: the lattices of words (ranges of codes, each after a space mark).

        Nodes are worked on by their distance from the word's end, those of the longest words first, so the nodes of
        a distance, and their edges, lie next to each other. At the end they are put in the order of the words.
        """
        nodes = sizes + 1  # the mark and the characters
        by = np.argsort(-nodes, kind="stable")
        length, most = nodes[by], int(nodes.max())
        many = np.searchsorted(-length, -np.arange(1, most + 1), side="right")
        base = _before(many)  # base[d - 1]: the first node d characters from an end
        total = int(base[-1])
        left = np.repeat(np.arange(1, most + 1), many)
        word = np.arange(total) - base[left - 1]
        at = length[word] - left
        chars = np.full(total, ord(SPACE_MARK), dtype=np.int64)
        inner = np.flatnonzero(at)
        chars[inner] = codes[starts[by][word[inner]] + at[inner] - 1]
        mixed = mix(chars.astype(U64))
        after = word + np.repeat(np.append(0, base[:most - 1]), many)  # the next node of the word, or the end of all
        after[:many[0]] = total

        degree, found = np.zeros(total, dtype=np.int64), []
        live = at_char = np.arange(total)
        for n in range(1, self.longest + 1):
            if n > 1:
                at_char = after[at_char]
                h = h * _P + mixed[at_char]
                k = self.look_up(h)
            else:
                h, k = mixed, self._singles(chars, mixed)
            on = np.flatnonzero((k >= 0) & (left[live] > n))  # further on there is more of the word
            own = self.piece_of[k]
            hit = np.flatnonzero((k >= 0) & (own >= 0))
            own = own[hit]
            node, ids, logs = live[hit], self.ids[own], self.logs[own]
            to = after[at_char[hit]]
            if n == 1:  # characters without a piece of their own
                alone = np.ones(total, dtype=bool)
                alone[node] = False
                alone = np.flatnonzero(alone)
                c = chars[alone]
                node, to = np.concatenate([node, alone]), np.concatenate([to, after[alone]])
                ids, logs = np.concatenate([ids, -2 - c]), np.concatenate([logs, self.byte_log * _utf8_size(c)])
            rank = degree[node]
            found.append((node, rank, ids, logs, to))
            degree[node] = rank + 1
            if not len(on):
                break
            live, at_char, h = live[on], at_char[on], h[on]
        start = _before(degree)
        place = _before(nodes)[:-1][by][word] + at  # where a node, and then its edges, lie in the order of the words
        degree_of = np.empty(total, dtype=np.int64)
        degree_of[place] = degree
        place = _before(degree_of)[place]
        made, log, to_ = Edges.room(int(start[-1])), np.empty(start[-1]), np.empty(start[-1], dtype=np.int64)
        last, last_place = start[1:] - 1, place + degree - 1
        for n, (node, rank, ids, logs, to) in enumerate(found, 1):
            p = last[node] - rank
            log[p], to_[p] = logs, to
            p = last_place[node] - rank
            made.size[p], made.piece[p] = n, ids

        beta = np.zeros(total + 1)  # the last is the end of a word
        for a, b in zip(base[:-1].tolist(), base[1:].tolist()):
            s, t = int(start[a]), int(start[b])
            x, first, own = log[s:t] + beta[to_[s:t]], start[a:b] - s, degree[a:b]
            top = np.maximum.reduceat(x, first)
            beta[a:b] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, own)), first))
            log[s:t] = x - np.repeat(beta[a:b], own)

        made.log[np.repeat(place - start[:-1], degree) + np.arange(start[-1])] = log
        return degree_of, made


def _utf8_size(c: np.ndarray) -> np.ndarray:
    return 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)


class _Nodes:
    """Lattices of the words met so far, by hash. Before there are more than ``most`` nodes, the words that were met in one
    chunk of texts only are dropped, and of the rest those met most often are kept, half of the room at most. The words of a
    chunk are all kept while it is worked on."""

    def __init__(self, most: int = KEPT_NODES):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.first = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        #: Number of nodes of each word, and of chunks that had it again (halved whenever words are dropped).
        self.size, self.met = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        # the system gives memory only to what is written: room kept ahead costs nothing, and copies are rare
        self.start, self.edges, self.used = np.zeros(self.most + 1, dtype=np.int64), Edges.room(USUAL_EDGES * self.most), 0

    def get(self, lattice: Lattice, codes: np.ndarray, own: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first node of each of the words with the hashes ``own`` (sorted)."""
        at, known = _known(self.hashes, own)
        for drop in (self._drop, self.clear):
            if self.used and self.used + int((sizes[~known] + 1).sum()) > self.most:
                drop()
                at, known = _known(self.hashes, own)
        self.met[at[known]] += 1
        new = np.flatnonzero(~known)
        if len(new):
            size = sizes[new] + 1
            made = (own[new], _before(size)[:-1] + self.used, size, np.zeros(len(new), dtype=np.int32))
            for a, b in chunks(size, AT_ONCE):
                self._append(*lattice.edges(codes, starts[new[a:b]], sizes[new[a:b]]))
            self.hashes, self.first, self.size, self.met = _inserted((self.hashes, self.first, self.size, self.met), at[new], made)
        return self.first[at + _before(~known)[:-1]]

    def _drop(self) -> None:
        often = np.flatnonzero(self.met)
        often = often[np.argsort(-self.met[often], kind="stable")]
        often = often[np.cumsum(self.size[often]) <= self.most // 2]
        kept = np.sort(often)
        by = kept[np.argsort(self.first[kept])]  # in the order of their nodes, which move to the front
        self.used = 0
        for a, b in chunks(self.size[by], AT_ONCE):
            nodes, size = _ranges(self.first[by[a:b]], self.size[by[a:b]]), self.size[by[a:b]]
            begin, degree = self.start[nodes], self.start[nodes + 1] - self.start[nodes]
            edges, held = _ranges(begin, degree), int(self.start[self.used])
            for x in self.edges.columns():
                x[held:held + len(edges)] = x[edges]
            self.first[by[a:b]] = self.used + _before(size)[:-1]
            self.start[self.used + 1:self.used + len(nodes) + 1] = held + np.cumsum(degree)
            self.used += len(nodes)
        self.hashes, self.first, self.size, self.met = self.hashes[kept], self.first[kept], self.size[kept], self.met[kept] >> 1

    def _append(self, degree: np.ndarray, edges: Edges) -> None:
        held = int(self.start[self.used])
        self.start = _fit(self.start, self.used + len(degree) + 1)
        self.start[self.used + 1:self.used + len(degree) + 1] = held + np.cumsum(degree)
        self.used += len(degree)
        grown = [_fit(x, held + len(edges.log)) for x in self.edges.columns()]
        for to, x in zip(grown, edges.columns()):
            to[held:held + len(x)] = x
        self.edges = Edges(*grown)


def _fit(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, or a copy with room for ``n`` values and a quarter more."""
    if n <= len(x):
        return x
    out = np.empty(n + n // 4, dtype=x.dtype)
    out[:len(x)] = x
    return out


def _inserted(columns: Sequence[np.ndarray], at: np.ndarray, new: Sequence[np.ndarray]) -> list[np.ndarray]:
    """``columns`` with the values ``new`` before the (ascending) places ``at``."""
    total = len(columns[0]) + len(at)
    place = at + np.arange(len(at))
    old = np.ones(total, dtype=bool)
    old[place] = False
    out = []
    for x, y in zip(columns, new):
        out.append(np.empty(total, dtype=x.dtype))
        out[-1][place], out[-1][old] = y, x
    return out


def _known(table: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``own`` in a sorted table, and which are there."""
    at = np.searchsorted(table, own)
    known = np.zeros(len(own), dtype=bool)
    inside = at < len(table)
    known[inside] = table[at[inside]] == own[inside]
    return at, known


class _Encoded:
    """The library's pieces of the words met so far. Words are independent: no piece spans a single space."""

    def __init__(self, sp, most: int = KEPT_WORDS):
        self.sp, self.most = sp, most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.number = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        self.ids, self.starts, self.used = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64), 0

    def get(self, own: np.ndarray, text_of: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Numbers of the words with the hashes ``own`` (sorted). text_of: the texts of some of them."""
        if len(self.hashes) + len(own) > self.most:
            self.clear()
        at, known = _known(self.hashes, own)
        new = np.flatnonzero(~known)
        if len(new):
            texts = text_of(new)
            made = self.sp.encode(texts, num_threads=1)
            ends = int(self.starts[self.used]) + np.cumsum(np.fromiter(map(len, made), dtype=np.int64, count=len(made)))
            numbers = np.arange(len(new)) + self.used
            self.starts, self.ids = _fit(self.starts, self.used + len(new) + 1), _fit(self.ids, int(ends[-1]))
            self.ids[self.starts[self.used]:ends[-1]] = np.fromiter(chain.from_iterable(made), dtype=np.int32)
            self.starts[self.used + 1:self.used + len(new) + 1] = ends
            self.used += len(new)
            self.hashes, self.number = _inserted((self.hashes, self.number), at[new], (own[new], numbers))
        return self.number[at + _before(~known)[:-1]]


def _stir(h: np.ndarray, x) -> np.ndarray:
    """``h`` with ``x`` mixed in. The constant keeps 0 from staying 0."""
    return mix(h * _P + np.asarray(x, dtype=np.int64).view(U64) + _Q)


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1]; 1 is what the very last value is rounded to."""
    x = (h >> U64(11)).astype(np.float64)
    x += 0.5
    x *= 1 / float(1 << 53)
    return x


#: Complements below this are summed.
SMALL = 1e-4
#: Random numbers of branches are held below 1, at the double before it, so no Gumbel variable of mass 1 is above 36.75. Sums of
#: logarithms may be off by much less than the rest.
MOST_U, MOST_G = 1 - 2.0**-53, 38.0
#: Steps of a segmentation whose branches are looked at first.
FIRST_STEPS = 24
#: What a random number is for.
STEP, BRANCH, ROOT, CHOICE, REST = range(5)


def _use(turn: int, use: int) -> U64:
    return U64(((turn << 3) + use) * int(_P) & 0xFFFFFFFFFFFFFFFF)


@dataclass
class _Paths:
    """One segmentation of each of some ``texts``: steps (word, node, edge), those of text k from ``bounds[k]`` on, the
    perturbed value ``g`` of each, and the logarithm of the probability of each step."""

    texts: np.ndarray
    bounds: np.ndarray
    word: np.ndarray
    node: np.ndarray
    edge: np.ndarray
    g: np.ndarray
    log: np.ndarray


@dataclass
class _Open:
    """Branches that were not taken: at step ``step`` of the segmentation number ``path`` of ``text``, all edges but
    those in ``used`` (bits). before: the log-probability up to there; g: their largest perturbed value."""

    text: np.ndarray
    path: np.ndarray
    step: np.ndarray
    before: np.ndarray
    used: np.ndarray
    g: np.ndarray

    def take(self, at: np.ndarray) -> _Open:
        return _Open(*(getattr(self, f.name)[at] for f in fields(self)))

    def plus(self, other: _Open) -> _Open:
        return _Open(*(np.concatenate([getattr(self, f.name), getattr(other, f.name)]) for f in fields(self)))


def _cut_gumbel(log_mass: np.ndarray, below: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these log masses, cut off at ``below``."""
    return log_mass - np.logaddexp(log_mass - below, np.log(-np.log(u)))


def _largest(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest finite values of each group, by group, the largest first."""
    order = np.lexsort((-values, group))
    own = group[order]
    return order[(np.arange(len(own)) - np.searchsorted(own, own) < n) & np.isfinite(values[order])]


class _Walk:
    """Segmentations of all words of some texts, sampled step by step."""

    def __init__(self, lattice: Lattice, texts: list[str], seeds: np.ndarray):
        self.lattice, self.n_texts = lattice, len(texts)
        full = [i for i, t in enumerate(texts) if t]
        joined = " ".join(texts[i] for i in full)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        gaps = np.flatnonzero(codes == 32)
        starts = np.concatenate([[0], gaps + 1]) if full else np.zeros(0, dtype=np.int64)
        ends = np.append(gaps, len(codes)) if full else np.zeros(0, dtype=np.int64)
        at = _before(np.array([len(texts[i]) + 1 for i in full], dtype=np.int64))[:-1]
        self.text = np.array(full, dtype=np.int64)[np.searchsorted(at, starts, side="right") - 1] if full else np.zeros(0, dtype=np.int64)
        up, down = powers(len(codes) + 1)
        sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix(codes.astype(U64)) * up[:len(codes)], dtype=U64)])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
        self.joined, self.starts, self.ends = joined, starts, ends
        self.own, self.one, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = (ends - starts)[self.one]
        first = lattice.nodes.get(lattice, codes, self.own, starts[self.one], sizes)
        self.start, self.edges = lattice.nodes.start, lattice.nodes.edges
        #: First node and number of nodes of each word; the last word of each text.
        self.first, self.size = first[self.which], (sizes + 1)[self.which]
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.seed = _stir(np.zeros(len(texts), dtype=U64), seeds)
        nth = np.arange(len(self.which)) - self.bounds[self.text]
        self.key = _stir(self.seed[self.text], nth) if len(nth) else np.zeros(0, dtype=U64)

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text. Texts with spaces in runs or at the edges, or with the space mark, are
        encoded whole; the rest word by word, as no piece spans a space there."""
        words = self.lattice.words
        named = lambda new: [self.joined[a:b] for a, b in zip(self.starts[self.one[new]].tolist(), self.ends[self.one[new]].tolist())]
        numbers = words.get(self.own, named)[self.which]
        sizes = words.starts[numbers + 1] - words.starts[numbers]
        flat = words.ids[_ranges(words.starts[numbers], sizes)]
        ends = _before(sizes)
        out = []
        for t, a, b in zip(texts, self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            if t and ("  " in t or t[0] == " " or t[-1] == " " or SPACE_MARK in t):
                out.append(np.array(self.lattice.sp.encode(t), dtype=np.int32))
            else:
                out.append(flat[ends[a]:ends[b]])
        return out

    def _random(self, words: np.ndarray, at: np.ndarray, turn: int, use: int) -> np.ndarray:
        h = at.astype(U64)
        h *= _Q
        h += self.key[words]
        h += _use(turn, use)
        return _unit(mix(h))

    def _rest(self, node: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The logarithm of the probability of all edges of ``node`` but ``edge``, summed one by one; -inf for none."""
        out, row, e, end, own = np.zeros(len(node)), np.arange(len(node)), self.start[node], self.start[node + 1], edge
        while len(row):
            p = np.exp(self.edges.log[e])
            p[e == own] = 0
            out[row] += p
            e = e + 1
            on = e < end
            row, e, end, own = row[on], e[on], end[on], own[on]
        with np.errstate(divide="ignore"):
            return np.log(out)

    def _of_texts(self, texts: np.ndarray, turn: int, use: int) -> np.ndarray:
        return _unit(_stir(self.seed[texts], np.full(len(texts), -1 - (turn << 3) - use)))

    def steps(self, words: np.ndarray, at: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """node and edge of the steps from node ``at`` of each of ``words`` to its end, and where those of each word begin."""
        start, log, size = self.start, self.edges.log, self.edges.size
        rounds, count = [], np.zeros(len(words), dtype=np.int64)
        row, first = np.arange(len(words)), self.first[words]
        node, end = first + at, first + self.size[words]
        # the random number of a word's node ``at``, told by the node itself
        key = self.key[words] - first.view(U64) * _Q + _use(turn, STEP)
        while len(row):
            h = node.view(U64) * _Q
            h += key
            e, u = start.take(node), _unit(mix(h))
            u -= np.exp(log.take(e))
            on = np.flatnonzero(u >= 0)
            left, last = u[on], start.take(node[on] + 1) - 1
            while len(on):  # what is left of u is larger than the edges so far
                own = e[on]
                more = np.flatnonzero((left >= 0) & (own < last))
                on, left, last, own = on[more], left[more], last[more], own[more] + 1
                e[on] = own
                left -= np.exp(log.take(own))
            rounds.append((row, node, e))
            count[row] += 1
            node = node + size.take(e)
            more = np.flatnonzero(node < end)
            row, node, end, key = row[more], node[more], end[more], key[more]
        begin = _before(count)
        nodes, edges = np.empty(begin[-1], dtype=np.int64), np.empty(begin[-1], dtype=np.int64)
        for k, (row, node, e) in enumerate(rounds):
            place = begin.take(row)
            place += k
            nodes[place], edges[place] = node, e
        return nodes, edges, begin

    def left_open(self, paths: _Paths, turn: int, since: np.ndarray, want: int) -> _Open:
        """The ``want`` best of the branches that these paths leave out from step ``since`` (of each) on.

        The first steps are looked at, and then all those whose bound, what came before and a Gumbel variable of mass 1
        (the largest there is, then the step's own), reaches the worst of the best so far: no other step has a better branch.
        """
        counts = np.diff(paths.bounds)
        total = _before(paths.log)
        before = total[:-1] - np.repeat(total[paths.bounds[:-1]], counts)
        first = np.minimum(FIRST_STEPS, paths.bounds[1:] - since)
        step = _ranges(since, first)
        of = np.repeat(np.arange(len(counts)), first)
        value = self._branches(paths, step, of, before[step], self._branch_random(paths, turn, step))
        best = _largest(value, of, want)
        least = np.full(len(counts), np.inf)
        np.minimum.at(least, of[best], value[best])
        least[np.bincount(of[best], minlength=len(counts)) < want] = -np.inf
        more = before > np.repeat(least - MOST_G, counts)
        more &= np.arange(len(before)) >= np.repeat(since + first, counts)
        more = np.flatnonzero(more)
        u, own = self._branch_random(paths, turn, more), np.searchsorted(paths.bounds, more, side="right") - 1
        on = np.flatnonzero(before[more] - np.log(-np.log(u)) > least[own] - 1)  # the bound with the step's own Gumbel variable
        if len(on):
            more, own = more[on], own[on]
            value = np.concatenate([value[best], self._branches(paths, more, own, before[more], u[on])])
            step, of = np.concatenate([step[best], more]), np.concatenate([of[best], own])
            best = _largest(value, of, want)
        step = step[best]
        used = np.int64(1) << (paths.edge[step] - self.start[paths.node[step]])
        return _Open(paths.texts[of[best]], np.full(len(best), turn), step, before[step], used, value[best])

    def _branch_random(self, paths: _Paths, turn: int, step: np.ndarray) -> np.ndarray:
        word = paths.word[step]
        return np.minimum(self._random(word, paths.node[step] - self.first[word], turn, BRANCH), MOST_U)

    def _branches(self, paths: _Paths, step: np.ndarray, of: np.ndarray, before: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The largest perturbed value of the branches left out at these steps of the paths ``of``; -inf where there are none.

        Where an edge leaves ``SMALL`` or more to the others, that is the difference to 1. Where it leaves less, the
        difference would be rounding errors: the others are summed.
        """
        node, edge = paths.node[step], paths.edge[step]
        rest = -np.expm1(paths.log[step])
        log = np.log(np.maximum(rest, SMALL))
        small = np.flatnonzero(rest < SMALL)
        log[small] = self._rest(node[small], edge[small])
        some = self.start[node + 1] - self.start[node] > 1
        value = np.full(len(step), -np.inf)
        value[some] = _cut_gumbel(before[some] + log[some], paths.g[of[some]], u[some])
        return value

    def sampled(self, k: int) -> tuple[list[_Paths], np.ndarray]:
        """The segmentations, first to k-th, and the value of the best that is left of each text."""
        texts = np.flatnonzero(np.diff(self.bounds))
        every = np.arange(len(self.which))
        node, edge, begin = self.steps(every, np.zeros(len(every), dtype=np.int64), 0)
        g = -np.log(-np.log(self._of_texts(texts, 0, ROOT)))
        bounds = begin[self.bounds[np.append(texts, self.n_texts)]]
        paths = [_Paths(texts, bounds, np.repeat(every, np.diff(begin)), node, edge, g, self.edges.log[edge])]
        kappa = np.full(self.n_texts, -np.inf)
        if not len(texts):
            return paths, kappa
        left = self.left_open(paths[0], 0, bounds[:-1], k)
        for turn in range(1, k):
            if not len(left.text):
                break
            order = np.lexsort((-left.g, left.text))
            first = np.concatenate([[True], np.diff(left.text[order]) > 0])
            now, left = left.take(order[first]), left.take(order[~first])
            made, since, again = self._leave(paths, now, turn)
            paths.append(made)
            left = left.plus(again).plus(self.left_open(made, turn, since, k - turn))
        np.maximum.at(kappa, left.text, left.g)
        return paths, kappa

    def _leave(self, paths: list[_Paths], now: _Open, turn: int) -> tuple[_Paths, np.ndarray, _Open]:
        """The segmentations that leave at ``now`` (one of a text), the step from which each is new, and what is still
        open at the places where they leave."""
        n, start, edges = len(now.text), self.start, self.edges
        head, word, node = (np.empty(n, dtype=np.int64) for _ in range(3))  # first step of the path that is left; word and node of the step
        for p in np.unique(now.path).tolist():
            on, old = np.flatnonzero(now.path == p), paths[p]
            head[on] = old.bounds[np.searchsorted(old.texts, now.text[on])]
            word[on], node[on] = old.word[now.step[on]], old.node[now.step[on]]
        degree = start[node + 1] - start[node]
        j = np.arange(int(degree.max()))
        free = (j < degree[:, None]) & ((now.used[:, None] >> j) & 1 == 0)
        logs = np.where(free, edges.log[start[node][:, None] + np.minimum(j, degree[:, None] - 1)], -np.inf)
        top = logs.max(axis=1)
        p = np.exp(logs - top[:, None])
        total = np.cumsum(p, axis=1)
        pick = (total <= (self._of_texts(now.text, turn, CHOICE) * total[:, -1])[:, None]).sum(axis=1)
        rows = np.arange(n)
        p[rows, pick] = 0
        rest = p.sum(axis=1)
        on = np.flatnonzero(rest > 0)
        value = _cut_gumbel(now.before[on] + top[on] + np.log(rest[on]), now.g[on], self._of_texts(now.text[on], turn, REST))
        again = _Open(now.text[on], now.path[on], now.step[on], now.before[on], now.used[on] | np.int64(1) << pick[on], value)

        chosen = start[node] + pick
        at = node - self.first[word] + edges.size[chosen]
        inside = at < self.size[word]
        begin = word + ~inside
        counts = self.bounds[now.text + 1] - begin
        tail, tail_at = _ranges(begin, counts), np.zeros(int(counts.sum()), dtype=np.int64)
        tail_at[_before(counts)[:-1][inside]] = at[inside]
        *new, tail_begin = self.steps(tail, tail_at, turn)
        new.insert(0, np.repeat(tail, np.diff(tail_begin)))
        kept = now.step - head + 1
        added = np.diff(tail_begin[_before(counts)])
        bounds = _before(kept + added)
        made = [np.empty(bounds[-1], dtype=np.int64) for _ in range(3)]
        old_place, new_place = _ranges(bounds[:-1], kept), _ranges(bounds[:-1] + kept, added)
        of, from_ = np.repeat(now.path, kept), _ranges(head, kept)
        for p in np.unique(now.path).tolist():
            on = of == p
            for to, x in zip(made, (paths[p].word, paths[p].node, paths[p].edge)):
                to[old_place[on]] = x[from_[on]]
        made[2][bounds[:-1] + kept - 1] = chosen
        for to, x in zip(made, new):
            to[new_place] = x
        return _Paths(now.text, bounds, *made, now.g, edges.log[made[2]]), bounds[:-1] + kept, again

    def ids(self, paths: _Paths) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the paths, one after the other, and where each begins; bytes are written out."""
        ids = self.edges.piece[paths.edge]
        byte = np.flatnonzero(ids < 0)
        if not len(byte):
            return ids, paths.bounds
        c = -2 - ids[byte].astype(np.int64)
        width = np.ones(len(ids), dtype=np.int64)
        width[byte] = _utf8_size(c)
        after = _before(width)
        out = np.repeat(ids, width)
        chars, which = np.unique(c, return_inverse=True)
        utf8 = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        size = width[byte]
        out[_ranges(after[byte], size)] = self.lattice.byte_ids[utf8[_ranges(_before(_utf8_size(chars))[which], size)]]
        return out, after[paths.bounds]

    def log_probs(self, paths: _Paths) -> np.ndarray:
        return np.add.reduceat(paths.log, paths.bounds[:-1]) if len(paths.texts) else np.zeros(0)


def inclusion(log_prob: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(x))): the probability to come before ``kappa``."""
    x = log_prob - kappa
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(x > 4, 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.clip(x, -30, 4))))))


def sample_segmentations(lattice: Lattice, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to ``k`` distinct segmentations: ids, log-probability, log inclusion score."""
    walk = _Walk(lattice, texts, seeds)
    paths, kappa = walk.sampled(k)
    out: list[list] = [[] for _ in texts]
    for p in paths:
        ids, bounds = walk.ids(p)
        logs = walk.log_probs(p)
        for t, a, b, log, score in zip(p.texts.tolist(), bounds[:-1], bounds[1:], logs.tolist(), inclusion(logs, kappa[p.texts]).tolist()):
            out[t].append((ids[a:b], log, score))
    return out


@cache
def lattice_of(path: str) -> Lattice:
    return Lattice(path)


SCHEMA = ("doc_id long, n_pieces long, ids_crc32 long, decoded_same boolean, sample_pieces array<long>, sample_crc32 array<long>, "
          "sample_log_prob array<double>, sample_log_inclusion array<double>, piece_ids array<int>, decoded string, sample_ids array<array<int>>")
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _checksums(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """CRC-32 of each range of ``ids``, as little-endian unsigned 32-bit integers."""
    flat = np.ascontiguousarray(ids, dtype="<u4")
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.int64())


def _lists(bounds: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _row_batch(doc_id: pa.Array, texts: list[str], lattice: Lattice, k: int) -> pa.RecordBatch:
    walk = _Walk(lattice, texts, doc_id.fill_null(NO_ID).to_numpy())
    encoded = walk.encoded(texts)
    decoded = lattice.sp.decode(encoded, num_threads=1)
    ids, bounds = np.concatenate(encoded), _before(np.array([len(x) for x in encoded], dtype=np.int64))

    paths, kappa = walk.sampled(k)
    there = np.zeros((len(texts), len(paths)), dtype=bool)
    size = np.zeros(there.shape, dtype=np.int64)
    log, score = (np.zeros(there.shape) for _ in range(2))
    made = [walk.ids(p) for p in paths]
    for j, (p, (_, own)) in enumerate(zip(paths, made)):
        there[p.texts, j], size[p.texts, j], log[p.texts, j] = True, np.diff(own), walk.log_probs(p)
        score[p.texts, j] = inclusion(log[p.texts, j], kappa[p.texts])
    begin = _before(size.ravel())  # where the ids of each sample lie, text by text; none where there is no sample
    sampled = np.empty(begin[-1], dtype=np.int32)
    for j, (p, (own, _)) in enumerate(zip(paths, made)):
        sampled[_ranges(begin[p.texts * len(paths) + j], size[p.texts, j])] = own

    offsets, ends = _before(there.sum(axis=1)), _before(size[there])
    lists = [_lists(offsets, x) for x in (pa.array(size[there]), _checksums(sampled, ends), pa.array(log[there]), pa.array(score[there]))]
    digests = [pa.array(np.diff(bounds)), _checksums(ids, bounds), pa.array([x == y for x, y in zip(decoded, texts)], pa.bool_())]
    whole = [_lists(bounds, pa.array(ids, pa.int32())), pa.array(decoded, pa.string()), _lists(offsets, _lists(ends, pa.array(sampled)))]
    return pa.RecordBatch.from_arrays([doc_id, *digests, *lists, *whole], names=_NAMES)


def encode(docs: DataFrame, model: str, k: int = 2) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): the ids of its pieces, the text decoded from them, the ids of ``k``
    sampled segmentations with their log-probabilities and inclusion scores; numbers and checksums of all ids, and
    whether decoding gives the text again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("pieces", lattice_of.cache_clear)
        lattice = lattice_of(model)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for a, b in chunks(pc.binary_length(texts).to_numpy(), TEXT_AT_ONCE):
                yield _row_batch(batch.column(0).slice(a, b - a), texts.slice(a, b - a).to_pylist(), lattice, k)
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def with_pieces(docs: DataFrame, model: str, text: str = "text", to: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of each text's pieces; null for a null text."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        sp = lattice_of(model).sp
        return pd.Series([None if t is None else sp.encode(t) for t in texts], dtype=object)

    return docs.withColumn(to, ids(F.col(text)))


def from_pieces(docs: DataFrame, model: str, ids: str = "piece_ids", to: str = "text") -> DataFrame:
    """``docs`` with the text that each list of ids stands for."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        sp = lattice_of(model).sp
        return pd.Series([None if x is None else sp.decode([int(i) for i in x]) for x in rows], dtype=object)

    return docs.withColumn(to, text(F.col(ids)))
