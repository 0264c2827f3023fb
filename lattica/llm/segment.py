"""SentencePiece encoding and decoding with k distinct sampled segmentations of a text.

All segmentations of a text into pieces form a lattice, weighted by piece probabilities. The k
segmentations are drawn without replacement by Gumbel top-k, as a perturbed A-star search: a
partial segmentation has the log-probability of all its completions (the exact estimate, from a
backward pass over the lattice), perturbed by Gumbel noise. Expanding a node, one child goes on
with its parent's perturbed score; it is drawn by its probability. The others' scores are Gumbel
variates cut at that score, and wait in a queue. The best one waiting is where the next sample
leaves the path of an earlier one. Only the k best waiting branches of a text can still matter, so
its queue holds no more, and a branch that is too unlikely for any noise to bring it in is not made.

Pieces never hold a space mark behind another character (this is asserted), so a text's lattice is
the chain of its chunks' lattices; chunks that end alike share nodes, which are kept from slice to
slice, and the random completions of all chunks of many texts are drawn at once. Piece probabilities are counted over
the whole table with the vocabulary's own encoding, plus one for each piece; the vocabulary itself
is given. Noise is a hash of the row's key, the sample and the place: the same row gives the same
samples anywhere.

log_prob is a segmentation's share of all segmentations of the text, perturbed its Gumbel score,
inclusion the probability that it exceeds the best score left out (1 where none is left).

Defined cases: a null or empty text has one segmentation, the empty one; a text with fewer than k
segmentations gives them all; a literal space mark is decoded as a space, as in the format; null
keys hash as null; repeated rows give the same samples each, and rows that share a key but not the
text share their noise; an empty table gives an empty result; other columns are ignored, whatever
their names. A text longer than a slice is worked on alone.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import text as tx
from lattica.session import ship

MARK = "▁"
SAMPLES = 4
# bytes are of words, spaces or line ends; between which of them a chunk ends
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x20], _KIND[0x0A] = 1, 2
_PARTS = np.array([False, True, True, False, False, True, True, True, False])
_JOINED = 64  # chunks that are encoded together
_WALK = 1 << 15  # chunks that are completed together
_SLICE = 1 << 20
_HELD = 1 << 20  # chunks that are counted together at most
_CALL = 1024
_NODES = 1 << 18  # held from slice to slice


class _Table:
    """A hash table from numbers to numbers, both from 0 on."""

    def __init__(self, size: int) -> None:
        self.held, self.bits = 0, max(4, (2 * size).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int32)

    def clear(self) -> None:
        self.held = 0
        self.key.fill(-1)
        self.value.fill(-1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _room(self, n: int) -> None:
        if 2 * (self.held + n) > len(self.key):
            used = self.key >= 0
            key, value = self.key[used], self.value[used]
            self.__init__(2 * (self.held + n))
            self.add(key, value)

    def _placed(self, key: np.ndarray) -> np.ndarray:
        """The slots of keys that weren't held, equal ones in one slot."""
        slot = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):
            at, k = slot[todo], key[todo]
            free = self.key[at] < 0
            self.key[at[free]] = k[free]  # of several keys the last one gets the slot
            left = np.flatnonzero(self.key[at] != k)
            todo = todo[left]
            slot[todo] = (at[left] + 1) & (len(self.key) - 1)
        return slot

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        """Keys that differ and aren't held yet."""
        self._room(len(key))
        self.held += len(key)
        self.value[self._placed(key)] = value

    def number(self, key: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys' values, and the new ones among them, which get the numbers from start on."""
        out = self.find(key)
        new = np.flatnonzero(out < 0)
        fresh = key[new]
        if len(new):
            self._room(len(new))
            slot, each = self._placed(fresh), np.arange(len(new))
            self.value[slot] = each
            owner = self.value[slot]
            first = owner == each
            ids = start + np.cumsum(first)[owner] - 1
            self.value[slot], out[new], fresh = ids, ids, fresh[first]
            self.held += len(fresh)
        return out, fresh

    def find(self, key: np.ndarray) -> np.ndarray:
        """The keys' values; -1 where there is none."""
        slot = self._slot(key)
        out, held = self.value[slot].astype(np.int64), self.key[slot]
        other = np.flatnonzero(held != key)
        if len(other):
            out[other] = -1
            todo = other[held[other] >= 0]
            while len(todo):
                slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
                held = self.key[slot[todo]]
                same = held == key[todo]
                out[todo[same]] = self.value[slot[todo[same]]]
                todo = todo[~same & (held >= 0)]
        return out


class _Trie:
    """A trie as a hash table from (state, character) to the next state; the root is 0."""

    def __init__(self, words: list[str]) -> None:
        states: dict[int, int] = {}
        self.ends = []
        for w in words:
            s = 0
            for c in w:
                s = states.setdefault(s << 21 | ord(c), len(states) + 1)
            self.ends.append(s)
        self.states = len(states) + 1
        self.next = _Table(2 * len(states))
        self.begin = np.full(0x110000, -1, dtype=np.int32)  # the states of single characters
        for w in {w[0] for w in words}:
            self.begin[ord(w)] = states[ord(w)]
        self.next.add(np.fromiter(states, dtype=np.int64, count=len(states)), np.arange(1, len(states) + 1))

    def child(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        return self.next.find((state << 21) | char)


class Pieces:
    """The vocabulary: places of pieces, and of bytes for characters that it lacks."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) for i in range(n)]
        self.byte = {int(self.model.id_to_piece(i)[1:-1], 16): i for i in range(n) if self.model.is_byte(i)}
        self.place = {self.model.id_to_piece(i): i for i in range(n) if not special[i] and not self.model.is_byte(i)}
        if len(self.byte) != 256 or any("\n" in p or MARK in p.lstrip(MARK) for p in self.place):
            raise ValueError("a vocabulary with byte fallback is needed whose pieces hold no line end, and no space mark behind another character")
        self.size = n
        self.trie = _Trie(list(self.place))
        self.piece_of = np.full(self.trie.states, -1, dtype=np.int64)
        self.piece_of[self.trie.ends] = list(self.place.values())
        # what each piece stands for
        plain = [b"" if special[i] else self.model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in self.byte.items():
            plain[i] = bytes([b])
        self.plain = pa.array(plain, pa.large_binary())
        self.marked = np.array([not special[i] and self.model.id_to_piece(i).startswith(MARK) for i in range(n)])
        self.special = np.array(special)


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def decode(path: str, ids: list[int]) -> str:
    """The text of a segmentation."""
    return pieces(path).model.decode([int(i) for i in ids])


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct chunks of texts, spaces as they are; which of them follow one another; and how many each text has."""
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    data, at = tx.raw(texts)
    full = at[:-1] < at[1:]
    data = np.insert(data, at[:-1][full], 0x20)
    at = at + np.concatenate([[0], np.cumsum(full)])
    kind = _KIND[data]
    first = np.ones(len(data) + 1, dtype=bool)
    first[1:-1] = _PARTS[kind[:-1] * 3 + kind[1:]]
    first[at] = True
    begin = np.flatnonzero(first)
    wide = len(data) >= 1 << 31
    cut = pa.Array.from_buffers(pa.large_string() if wide else pa.string(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int64 if wide else np.int32)), pa.py_buffer(data)])
    coded = cut.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.diff(np.searchsorted(begin, at))


class Graph:
    """Lattices of chunks as arrays over nodes and edges, kept from slice to slice.

    A node stands for the rest of a chunk, so chunks that end alike share nodes. Node 0 is the end; a node has
    the number of the node behind its first character and its edges, the longest piece first."""

    NODE = (("char", np.int64), ("rest", np.int64), ("first", np.int64), ("degree", np.int64), ("total", np.float64))
    # then is the first edge of the next node, or -1; share the log-probability among a node's edges, rival a
    # bound of the others' shares; chance the probability, above 1 for a node's last edge
    EDGE = (("piece", np.int32), ("then", np.int32), ("source", np.int32), ("share", np.float64), ("rival", np.float32), ("chance", np.float64))

    def __init__(self, v: Pieces, log_p: np.ndarray) -> None:
        self.v, self.log_p = v, log_p
        self._allocate()

    def _allocate(self) -> None:
        self.nodes, self.edges, self.known = 1, 0, _Table(_NODES)
        for arrays, n in ((self.NODE, _NODES), (self.EDGE, 3 * _NODES)):
            for name, kind in arrays:
                setattr(self, name, np.zeros(n, dtype=kind))

    def clear(self) -> None:
        if len(self.char) > 2 * _NODES:  # what one long text has taken isn't kept
            self._allocate()
        self.nodes, self.edges = 1, 0
        self.known.clear()

    def _room(self, arrays: tuple, n: int) -> None:
        for name, kind in arrays:
            held = getattr(self, name)
            if len(held) < n:
                wider = np.zeros(max(n, 2 * len(held)), dtype=kind)
                wider[: len(held)] = held
                setattr(self, name, wider)

    def roots(self, lens: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The first edges of chunks of some lengths, whose characters follow one another; nodes not held yet are made."""
        if self.nodes + len(chars) // 2 > _NODES:
            self.clear()
        order = np.argsort(-lens, kind="stable")
        ends, root, begins = np.cumsum(lens)[order], np.zeros(len(lens), dtype=np.int64), [self.nodes]
        longer = np.searchsorted(-lens[order], -np.arange(1, int(lens.max(initial=0)) + 1), side="right")
        for back, m in enumerate(longer.tolist(), 1):  # the places with `back` characters left
            key = root[:m] << 21 | chars[ends[:m] - back]
            node, fresh = self.known.number(key, self.nodes)
            if len(fresh):
                a, z = self.nodes, self.nodes + len(fresh)
                self._room(self.NODE, z)
                self.char[a:z], self.rest[a:z] = fresh & 0x1FFFFF, fresh >> 21
                self.nodes = z
                begins.append(z)
            root[:m] = node
            if m == 1 and len(fresh) and back < len(longer):  # what stands before a new node of the longest chunk is new too
                ids = np.arange(self.nodes, self.nodes + len(longer) - back)
                key = np.append(node, ids[:-1]) << 21 | chars[ends[0] - len(longer) : ends[0] - back][::-1]
                self.known.add(key, ids)
                self._room(self.NODE, self.nodes + len(ids))
                self.char[ids], self.rest[ids] = key & 0x1FFFFF, key >> 21
                self.nodes += len(ids)
                begins += (ids + 1).tolist()
                root[0] = ids[-1]
                break
        if len(begins) > 1:
            self._connect(begins)
        out = np.empty_like(root)
        out[order] = self.first[root]
        return out

    def _connect(self, begins: list[int]) -> None:
        """The edges of the last nodes, which begin and end there for each number of characters left."""
        v, low, e0 = self.v, begins[0], self.edges
        at = np.arange(low, self.nodes)
        pos, state, steps = at, at, []
        while len(at):  # all pieces from all places, a character more each time
            state = v.trie.child(state, self.char[pos]) if steps else v.trie.begin[self.char[pos]].astype(np.int64)
            on = np.flatnonzero(state >= 0)
            at, state, pos = at[on], state[on], self.rest[pos[on]]
            p = v.piece_of[state]
            hit = np.flatnonzero(p >= 0)
            steps.append((at[hit] - low, p[hit], pos[hit]))
            on = np.flatnonzero(pos)
            at, state, pos = at[on], state[on], pos[on]
        alone = np.zeros(self.nodes - low, dtype=bool)  # characters that are a piece
        alone[steps[0][0]] = True
        missing = np.flatnonzero(~alone)
        degree = np.bincount(np.concatenate([x[0] for x in steps]), minlength=len(alone)) + ~alone
        slot = e0 + np.cumsum(degree)
        self._room(self.EDGE, int(slot[-1]))
        self.edges = int(slot[-1])
        self.first[low : self.nodes], self.degree[low : self.nodes] = slot - degree, degree
        to = np.zeros(self.edges - e0, dtype=np.int64)  # the next node
        slot[missing] -= 1  # such a character is the chain of its bytes
        chains = []
        for c in np.unique(self.char[low + missing]).tolist():
            where = missing[self.char[low + missing] == c]
            ids = [v.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")]
            self.piece[slot[where]], to[slot[where] - e0] = ids[0], self.rest[low + where]
            chains.append((slot[where], ids))
        for where, p, node in steps:
            slot[where] -= 1
            x = slot[where]
            self.piece[x], to[x - e0] = p, node
        self.source[e0 : self.edges] = np.repeat(np.arange(low, self.nodes), degree)
        weight = self.log_p[self.piece[e0 : self.edges]]
        for x, ids in chains:
            weight[x - e0] = self.log_p[ids].sum()
        for a, b in zip(begins, begins[1:]):  # noqa: B905
            x, y = int(self.first[a]), int(self.first[b - 1] + self.degree[b - 1])
            d, begin = self.degree[a:b], self.first[a:b] - x
            score = weight[x - e0 : y - e0] + self.total[to[x - e0 : y - e0]]
            top = np.maximum.reduceat(score, begin)
            odds = np.exp(score - top.repeat(d))
            whole = np.add.reduceat(odds, begin)
            self.total[a:b] = top + np.log(whole)
            self.chance[x:y], self.share[x:y] = odds / whole.repeat(d), score - self.total[a:b].repeat(d)
        self.rival[e0 : self.edges] = np.log((1.0 - np.minimum(self.chance[e0 : self.edges], 1.0) + 1e-15).astype(np.float32)) + np.float32(1e-4)
        self.chance[self.first[low : self.nodes] + degree - 1] = 2.0
        self.then[e0 : self.edges] = np.where(to > 0, self.first[to], -1)
        for x, ids in chains:  # nodes of one edge each
            for i in ids[1:]:
                n, m = self.nodes, self.edges
                self._room(self.NODE, n + len(x))
                self._room(self.EDGE, m + len(x))
                node, edge = np.arange(n, n + len(x)), np.arange(m, m + len(x))
                self.first[node], self.degree[node] = edge, 1
                self.piece[edge], self.then[edge], self.source[edge], self.share[edge], self.rival[edge], self.chance[edge] = i, self.then[x], node, 0.0, -np.inf, 2.0
                self.then[x], x = edge, edge
                self.nodes, self.edges = n + len(x), m + len(x)


_DEPTH, _SAMPLE, _ALL = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, (1 << 64) - 1
_MOST = 38.0  # no exponential variate of a 53-bit number is below e**-38


def _uniform(h: np.ndarray) -> np.ndarray:
    u = (h >> np.uint64(11)).astype(np.float64)
    u *= 2.0**-53
    u += 2.0**-54
    return u


def _walk(g: Graph, e: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A random completion of the chunk from each node, given by its first edge: edges one after the other, and their numbers."""
    lens = np.ones(len(e), dtype=np.int64)
    act, picks = np.arange(len(e)), []
    while len(act):
        u = g.chance.take(e)
        if (u < 1).any():
            u = _uniform(tx.mix(seed + np.uint64(_DEPTH * (len(picks) + 1) & _ALL))) - u
        else:  # one edge each
            u = -u
        todo = np.flatnonzero(u >= 0)
        at, u = e[todo], u[todo]
        while len(todo):
            at += 1
            u -= g.chance.take(at)
            e[todo] = at
            on = np.flatnonzero(u >= 0)
            todo, at, u = todo[on], at[on], u[on]
        picks.append((act, e))
        then = g.then.take(e)
        on = np.flatnonzero(then >= 0)
        act, e, seed = act[on], then[on], seed[on]
        lens[act] += 1
    begin = np.cumsum(lens)
    out = np.empty(int(begin[-1]) if len(begin) else 0, dtype=np.int64)
    begin -= lens
    for depth, (act, e) in enumerate(picks):
        out[begin[act] + depth if depth else begin] = e
    return out, lens


def _spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each span, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class _Open:
    """The k best open branches of each text: where they leave which sample's path, and by which edge."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), -np.inf)
        self.phi = np.zeros((n, k))
        self.at = {name: np.zeros((n, k), dtype=np.int64) for name in ("step", "edge", "of")}

    def offer(self, text: np.ndarray, score: np.ndarray, phi: np.ndarray, **at: np.ndarray) -> None:
        k = self.score.shape[1]
        order = np.lexsort((-score, text))
        new = np.ones(len(order), dtype=bool)
        new[1:] = text[order[1:]] != text[order[:-1]]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        for r in range(min(k, int(rank.max(initial=-1)) + 1)):
            x = order[rank == r]
            low = self.score[text[x]].argmin(1)
            better = score[x] > self.score[text[x], low]
            x, low = x[better], low[better]
            self.score[text[x], low], self.phi[text[x], low] = score[x], phi[x]
            for name, values in at.items():
                self.at[name][text[x], low] = values[x] if isinstance(values, np.ndarray) else values


def _expand(g: Graph, path: np.ndarray, share: np.ndarray, begin: np.ndarray, end: np.ndarray, perturbed: np.ndarray, keys: np.ndarray, sample: int, texts: np.ndarray, step: np.ndarray, phi: np.ndarray, queue: _Open) -> None:
    """Offers the branches that leave the paths of some texts from a step on.

    A branch's score is a Gumbel variate around its log-probability, cut at its path's own score. It
    exceeds that log-probability by no more than _MOST, so a path is left where none can enter the queue."""
    width = 16
    while len(texts):
        width = max(16, min(width, (1 << 19) // len(texts)))
        least = queue.score.min(1)
        idx = (begin[texts] + step)[:, None] + np.arange(width)
        ok = idx < end[texts][:, None]
        np.minimum(idx, len(path) - 1, out=idx)
        e = path[idx]
        after = np.cumsum(np.concatenate([phi[:, None], np.where(ok, share[idx], 0.0)], axis=1), axis=1)
        row, col = np.nonzero(ok & (after[:, :-1] + g.rival[e] + _MOST > least[texts][:, None]))
        taken = e[row, col]
        node, before, place = g.source[taken], after[row, col], step[row] + col
        text, count = texts[row], g.degree[node]
        which = np.repeat(np.arange(len(row)), count)
        edge = _spans(g.first[node], count)
        f = before[which] + g.share[edge]
        keep = np.flatnonzero((edge != taken[which]) & (f + _MOST > least[text][which]))
        which, edge, f = which[keep], edge[keep], f[keep]
        slot = (edge - g.first[node][which]).astype(np.uint64)
        noise = tx.mix(keys[text][which] ^ tx.mix(((place.astype(np.uint64) << np.uint64(20)) + np.uint64((sample + 1) << 12))[which] + slot))
        u = _uniform(noise)
        # a score above the least needs -log(u), which is 1 - u at least, below exp(f - least)
        keep = np.flatnonzero(1.0 - u < 1.000001 * np.exp(np.minimum(f - least[text][which], 1.0)))
        which, edge, f, u = which[keep], edge[keep], f[keep], u[keep]
        text = text[which]
        score = f - np.log(np.exp(f - perturbed[text]) - np.log(u))
        keep = np.flatnonzero(score > least[text])
        if len(keep):
            queue.offer(text[keep], score[keep], f[keep], step=place[which[keep]], edge=edge[keep], of=sample)
        step, phi = step + width, after[:, -1]
        on = np.flatnonzero((begin[texts] + step < end[texts]) & (phi + _MOST > queue.score[texts].min(1)))
        texts, step, phi, width = texts[on], step[on], phi[on], width + 48


def _walks(g: Graph, first: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [_walk(g, first[i : i + _WALK].copy(), tx.mix(seed[i : i + _WALK])) for i in range(0, max(1, len(first)), _WALK)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass
class Sample:
    """The nth segmentation of some texts: its pieces, one text after the other."""

    texts: np.ndarray
    pieces: np.ndarray
    at: np.ndarray
    log_prob: np.ndarray
    perturbed: np.ndarray


def search(g: Graph, roots: np.ndarray, per: np.ndarray, keys: np.ndarray, k: int) -> tuple[list[Sample], np.ndarray]:
    """Samples of texts given as the roots of their chunks and their numbers, and the best perturbed
    score of each text that was left out.

    A sample takes its source's path up to the branch, then the branch, then a random completion."""
    n = len(per)
    begin_chunk = np.cumsum(per) - per
    of = np.repeat(np.arange(n), per)
    place = tx.mix(keys[of] ^ tx.mix((np.arange(len(roots)) - begin_chunk[of] + 1).astype(np.uint64)))
    queue = _Open(n, k)
    out: list[Sample] = []
    # of each sample: edges, where texts begin, and where the chunks begin that it drew; a text's first of these, and its number in the text
    paths: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(k):
        seed = np.uint64(_SAMPLE * (s + 1) & _ALL)
        if s == 0:
            path, lens = _walks(g, roots, place ^ seed)
            heads, head, nth = np.concatenate([[0], np.cumsum(lens)]), begin_chunk, np.zeros(n, dtype=np.int64)
            texts, at = np.arange(n), heads[np.append(begin_chunk, len(roots))]
            perturbed = -np.log(-np.log(_uniform(tx.mix(keys ^ np.uint64(0xA0761D6478BD642F)))))
            from_step, phi = np.zeros(n, dtype=np.int64), np.zeros(n)
        else:
            best = queue.score.argmax(1)
            perturbed = queue.score[np.arange(n), best]
            texts = np.flatnonzero(perturbed > -np.inf)
            best = best[texts]
            step, edge, source = (queue.at[name][texts, best] for name in ("step", "edge", "of"))
            phi = queue.phi[texts, best]
            queue.score[texts, best] = -np.inf
            chunk = np.zeros(len(texts), dtype=np.int64)
            for src in range(s):
                x = np.flatnonzero(source == src)
                _, at, heads, head, nth = paths[src]
                behind = np.searchsorted(heads, at[texts[x]] + step[x], side="right") - 1 - head[texts[x]]
                chunk[x] = nth[texts[x]] + np.maximum(behind, -1)
            # the rest of the branch's chunk, and of the text
            going = np.flatnonzero(g.then[edge] >= 0)
            inner, inner_n = _walk(g, g.then[edge[going]], tx.mix(keys[texts[going]] ^ tx.mix(step[going].astype(np.uint64) + (seed >> np.uint64(1)))))
            mid = np.zeros(len(texts), dtype=np.int64)
            mid[going] = inner_n
            behind = per[texts] - chunk - 1
            first = np.cumsum(behind) - behind
            x = _spans(begin_chunk[texts] + chunk + 1, behind)
            fresh, lens = _walks(g, roots[x], place[x] ^ seed)
            fresh_at = np.concatenate([[0], np.cumsum(lens)])
            tail = fresh_at[first]
            tail_n = fresh_at[first + behind] - tail
            length, head, nth = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            length[texts], head[texts], nth[texts] = step + 1 + mid + tail_n, first, chunk + 1
            at = np.concatenate([[0], np.cumsum(length)])
            to = at[texts]
            heads = fresh_at[:-1] + np.repeat(to + step + 1 + mid - tail, behind)
            path = np.empty(at[-1], dtype=np.int64)
            for src in range(s):
                x = np.flatnonzero(source == src)
                path[_spans(to[x], step[x])] = paths[src][0][_spans(paths[src][1][texts[x]], step[x])]
            path[to + step] = edge
            path[_spans(to + step + 1, mid)] = inner
            path[_spans(to + step + 1 + mid, tail_n)] = fresh
            from_step = step + 1
        paths.append((path, at, heads, head, nth))
        full = at[:-1][texts] < at[1:][texts]
        log_prob, share = np.zeros(len(texts)), g.share[path]
        if full.any():
            log_prob[full] = np.add.reduceat(share, at[:-1][texts[full]])
        out.append(Sample(texts, g.piece[path], at, log_prob, perturbed[texts]))
        some = np.flatnonzero(full)
        _expand(g, path, share, at[:-1], at[1:], perturbed, keys, s, texts[some], from_step[some], phi[some], queue)
    return out, queue.score.max(1)


def sampled(texts: pa.Array | list[str], keys: np.ndarray, v: Pieces, log_p: np.ndarray, k: int, graph: Graph | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each sample: its texts, its number, the pieces and where each text's begin, log_prob, perturbed and inclusion."""
    graph = graph or Graph(v, log_p)
    distinct, which, per = chunks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    chars = np.frombuffer(tx.raw(distinct)[0].tobytes().decode().encode("utf-32-le"), dtype="<u4").astype(np.int64)
    chars[chars == 0x20] = ord(MARK)
    roots = graph.roots(pc.utf8_length(distinct).to_numpy().astype(np.int64), chars)[which]
    found, left = search(graph, roots, per, keys, k)
    for s, x in enumerate(found):
        with np.errstate(over="ignore"):
            inclusion = np.where(left[x.texts] > -np.inf, -np.expm1(-np.exp(np.minimum(x.log_prob - left[x.texts], 50.0))), 1.0)
        yield x.texts, s, x.pieces, np.append(x.at[:-1][x.texts], x.at[-1]), x.log_prob, x.perturbed, inclusion


def _own_counts(v: Pieces, distinct: pa.Array, times: np.ndarray) -> np.ndarray:
    """How often each piece is in the vocabulary's own encoding of chunks that occur some times; equal times are encoded together."""
    order = np.argsort(times, kind="stable")
    values, begin = np.unique(times[order], return_index=True)
    groups = [(c, i, min(i + _JOINED, z)) for c, a, z in zip(values.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True) for i in range(a, z, _JOINED)]
    # behind a line end a chunk has no mark put before it; the first id is that of the mark
    held, at = tx.raw(pc.binary_join_element_wise(*(pa.scalar(x, distinct.type) if isinstance(x, str) else x for x in ("", distinct.take(pa.array(order)), "\n"))))
    n = np.zeros(v.size, dtype=np.int64)
    for i in range(0, len(groups), _CALL):
        part = groups[i : i + _CALL]
        ids = v.model.encode([held[at[a] : at[z]].tobytes().decode() for _, a, z in part], num_threads=1)
        lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) - 1
        flat = np.fromiter(chain.from_iterable(x[1:] for x in ids), dtype=np.int64, count=int(lens.sum()))
        n += np.bincount(flat, np.repeat([float(c) for c, *_ in part], lens), v.size).astype(np.int64)
    n[v.byte[0x0A]] -= int(times.sum())
    return n


def _counting(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        n = np.zeros(v.size, dtype=np.int64)
        held: list[pa.Table] = []
        for b in chain(tx.slices(batches, limit=_SLICE), [None]):
            if b is not None:
                distinct, which, _ = chunks(b["text"])
                held.append(pa.table({"chunk": distinct.cast(pa.large_string()), "times": np.bincount(which, minlength=len(distinct))}))
            if held and (b is None or sum(map(len, held)) > _HELD or sum(t.nbytes for t in held) > _HELD << 5):
                all_of = pa.concat_tables(held).group_by("chunk", use_threads=False).aggregate([("times", "sum")])
                n += _own_counts(v, all_of["chunk"].combine_chunks(), all_of["times_sum"].to_numpy())
                held = []
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n[found])], ["piece", "n"])

    return run


def piece_probabilities(texts: DataFrame, path: str) -> list[float]:
    """Log-probabilities of all pieces, from their counts in all texts; as many numbers as pieces."""
    n = np.ones(pieces(path).size)
    counted = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counting(path), "piece int, n long")
    for r in counted.groupBy("piece").agg(F.sum("n").alias("n")).collect():
        n[r["piece"]] += r["n"]
    return np.log(n / n.sum()).tolist()


def sample_segmentations(rows: DataFrame, keys: list[str], path: str, k: int = SAMPLES) -> DataFrame:
    """keys, sample, ids, log_prob, perturbed and inclusion of up to k segmentations of each text.

    ids are little-endian unsigned 32-bit numbers, one after the other."""
    ship(rows.sparkSession)
    log_p = piece_probabilities(rows, path)
    inner = rows.select(F.struct(*keys).alias("key"), F.xxhash64(*keys).alias("seed"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["sample", "ids", "log_prob", "perturbed", "inclusion"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = pieces(path), np.array(log_p)
        graph = Graph(v, p)
        for b in tx.slices(batches, limit=_SLICE):
            seeds = tx.mix(b["seed"].to_numpy().view(np.uint64))
            for texts, s, ids, at, log_prob, perturbed, inclusion in sampled(b["text"], seeds, v, p, k, graph):
                packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * at).astype("<i4")), pa.py_buffer(ids.astype("<u4"))])
                which = b["key"].take(pa.array(texts))
                yield pa.RecordBatch.from_arrays([which, pa.array(np.full(len(texts), s, dtype=np.int32)), packed, *(pa.array(x) for x in (log_prob, perturbed, inclusion))], ["key", *names])

    schema = inner.select("key").schema.add("sample", "integer").add("ids", "binary").add("log_prob", "double").add("perturbed", "double").add("inclusion", "double")
    return inner.mapInArrow(run, schema).select(*(F.col("key").getField(c).alias(c) for c in keys), *names)


def texts_of(path: str, ids: pa.BinaryArray) -> pa.Array:
    """The texts that packed ids stand for: the pieces' bytes without the first mark.

    Ids that don't begin with a mark, hold special ones or make no UTF-8 are left to the model."""
    v = pieces(path)
    data, at = tx.raw(ids.fill_null(b""))
    flat, at = np.frombuffer(data.tobytes(), "<u4").astype(np.int64), at // 4
    full = at[:-1] < at[1:]
    odd = np.zeros(len(ids), dtype=bool)
    if (special := v.special[flat]).any():
        odd = tx.per_text(special, at) > 0
    odd[full] |= ~v.marked[flat[at[:-1][full]]]
    if not odd.any():
        raw, ends = tx.raw(v.plain.take(pa.array(flat)))
        whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[at]), pa.py_buffer(raw)])
        with contextlib.suppress(pa.ArrowInvalid):
            return pc.binary_replace_slice(whole, 0, 1, b"").cast(pa.binary()).cast(pa.string())
    return pa.array([v.model.decode(flat[a:z].tolist()) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())


def decoded(found: DataFrame, path: str) -> DataFrame:
    """found and the text that its ids stand for; null ids stand for the empty text."""
    ship(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*b.columns, texts_of(path, b.column(b.schema.get_field_index("ids")))], [*b.schema.names, "decoded"])

    return found.mapInArrow(run, T.StructType([*found.schema.fields]).add("decoded", "string"))
