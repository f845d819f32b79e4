"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

All segmentations of a text are paths of a lattice whose edges are the pieces of a public vocabulary. A path's weight is
the product of its pieces' weights, here ``(1 + rank) ** -alpha`` for the piece of that rank. Perturbing each path's log
probability by Gumbel noise and taking the k largest draws k different segmentations without replacement. That is done
top down without listing paths: a set of paths has the Gumbel-distributed maximum of its total probability, splitting a
set at a piece splits its maximum, and a best-first (A-star) search over such sets emits the paths in order. The bound
left on top of its agenda when k paths are out gives each of them its inclusion score, the log probability that it would
have been among them.

No piece goes on past a space or crosses a line break, so the lattice is a chain of small ones, one a word with the
spaces before it; they are built for many different words at once and kept for the next batches. Sets far down a path are almost never opened; beyond ``SPLITS`` pieces they are kept as one
set, which is split only if it comes up. Draws are counter-based hashes of (row key, path, place,
step), so they depend on the row alone.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, table
from .rolling import U, mix

MODEL = "piece_bpe_32k.model"
N_SAMPLES = 2
ALPHA = 1.0
SPLITS = 64
BATCH_CHARS = 4_000_000
#: Characters of words whose lattices a worker keeps (some 60 bytes each, beside the words themselves), and that are built at once.
KEPT_CHARS, ADDED_CHARS = 4_000_000, 300_000


class Vocabulary:
    """Pieces, their log weights, and a trie of them for looking up all substrings of many words at once."""

    def __init__(self, model: str, alpha: float):
        import public_tokenizers
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.byte_id = np.zeros(256, np.int64)
        normal = []
        for i, p in enumerate(self.pieces):
            if m.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                normal.append(i)
        self.weight = np.full(len(self.pieces), -alpha * math.log(1 + len(normal)))
        self.weight[normal] = -alpha * np.log(1 + np.arange(len(normal)))  # ids are in the order of rank
        self.bytes = [b""] * len(self.pieces)
        for i in normal:
            self.bytes[i] = self.pieces[i].replace("▁", " ").encode()
        for b in range(256):
            self.bytes[self.byte_id[b]] = bytes([b])
        self.text = pa.array(self.bytes, pa.large_binary())
        children: dict[tuple[int, int], int] = {}
        ends = {}
        for i in normal:
            node = 0
            for c in map(ord, self.pieces[i]):
                node = children.setdefault((node, c), len(children) + 1)
            ends[node] = i
        # Children by open addressing: (node, character) lies at the first free slot after its hash.
        keys, values = np.array([n << 21 | c for n, c in children], np.int64), np.array(list(children.values()), np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.child = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.child[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)
        self.start = np.zeros(0x110000, np.int32)  # the node of each first character, 0: none
        for (n, c), child in children.items():
            if n == 0:
                self.start[c] = child
        self.ends = np.full(len(children) + 2, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie's node after each of these by each character, 0: none."""
        want = node << 21 | char
        slot = self._slot(want)
        got = self.keys[slot]
        out = np.where(got == want, self.child[slot], 0)
        open_ = np.flatnonzero((got != want) & (got >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[open_]]
            hit = got == want[open_]
            out[open_[hit]] = self.child[slot[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary(model: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(model, alpha)


class Lattices:
    """The lattices of different words side by side: node = place between characters, edges ordered by their first node.

    Words stay from batch to batch, as most of a batch's words are in the ones before too; beyond ``KEPT_CHARS`` the
    store starts anew. What is stored for a word depends on that word alone.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}  # a word's first node
        self.n_nodes = self.n_edges = 0
        self.ptr, self.end = np.zeros(1, np.int32), np.zeros(0, bool)
        self.to, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.log_q, self.cum = np.zeros(0), np.zeros(0)

    def nodes(self, words: list[str]) -> np.ndarray:
        """The first node of each of the (different) words."""
        new = [w for w in words if w not in self.index]
        if self.n_nodes and self.n_nodes + sum(map(len, new)) + len(new) > KEPT_CHARS:
            self.forget()
            new = words
        a = 0
        while a < len(new):
            z, size = a, 0
            while z < len(new) and (z == a or size + len(new[z]) <= ADDED_CHARS):
                size += len(new[z])
                z += 1
            self._add(new[a:z])
            a = z
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _append(self, name: str, at: int, values: np.ndarray) -> None:
        have = getattr(self, name)
        if at + len(values) > len(have):
            more = np.empty(max(at + len(values), 3 * len(have) // 2), have.dtype)
            more[:at] = have[:at]
            setattr(self, name, more)
            have = more
        have[at : at + len(values)] = values

    def _add(self, words: list[str]) -> None:
        v = self.v
        lengths = np.array([len(w) for w in words], np.int64)
        firsts = np.concatenate([[0], np.cumsum(lengths + 1)])  # a word's first node; its last one has no edges
        n = int(firsts[-1])
        chars = np.frombuffer("\0".join([*words, ""]).replace(" ", "▁").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        last = np.zeros(n, bool)
        last[firsts[1:] - 1] = True
        ahead = np.repeat(firsts[1:] - 1, lengths + 1)  # last node of the node's word
        at = np.flatnonzero(~last)
        # All places walk down the trie together; the zero between words is in no piece, so none walks past its word.
        state = v.start[chars[at]]
        node, state = at[state > 0].astype(np.int32), state[state > 0].astype(np.int64)
        found, depth = [], 1
        while len(node):
            piece = v.ends[state]
            is_piece = piece >= 0
            found.append((node[is_piece], piece[is_piece], depth))
            child = v.step(state, chars[node + depth])
            hit = child > 0
            node, state = node[hit], child[hit]
            depth += 1
        lone = np.ones(n, bool)
        if found:
            lone[found[0][0]] = False  # no piece of one character: its bytes instead
        lone[last] = False
        lone = np.flatnonzero(lone)
        code = chars[lone]
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        count = np.zeros(n, np.int32)
        for x, _, _ in found:
            count[x] += 1
        count[lone] += 1
        ptr = np.concatenate([[0], np.cumsum(count)])
        m = int(ptr[-1])
        to, pieces, w = np.zeros(m, np.int32), np.zeros(m, np.int32), np.zeros(m)
        slot = ptr[1:] - 1
        for x, piece, depth in found:  # longest first within a node
            own = slot[x]
            to[own], pieces[own], w[own] = x + depth, piece, v.weight[piece]
            slot[x] = own - 1
        to[slot[lone]], pieces[slot[lone]], w[slot[lone]] = lone + 1, -1 - code, n_bytes * v.weight[v.byte_id[0]]
        # Log weight of all ways from a node to its word's end, from the end backwards.
        beta = np.zeros(n)
        left = ahead[at] - at
        order = np.argsort(left, kind="stable")
        nodes, cuts = at[order], np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        log_q = np.empty(m)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            these = nodes[a:b]
            c = count[these]
            starts = np.cumsum(c) - c
            e = np.repeat(ptr[these] - starts, c) + np.arange(int(c.sum()))
            x = w[e] + beta[to[e]]
            top = np.maximum.reduceat(x, starts)
            b_ = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, c)), starts))
            beta[these] = b_
            log_q[e] = x - np.repeat(b_, c)
        np.minimum(log_q, 0.0, out=log_q)
        log_q[ptr[:-1][count == 1]] = 0.0
        cum = np.exp(log_q)
        have, rank = np.flatnonzero(count > 1), 1
        while len(have):
            e = ptr[have] + rank
            cum[e] += cum[e - 1]
            rank += 1
            have = have[count[have] > rank]
        cum[ptr[1:][count > 0] - 1] = 2.0  # rounding never leaves a node without an edge
        for name, values in (("to", to + np.int32(self.n_nodes)), ("piece", pieces), ("log_q", log_q), ("cum", cum)):
            self._append(name, self.n_edges, values)
        self._append("ptr", self.n_nodes, (ptr + self.n_edges).astype(np.int32))
        self._append("end", self.n_nodes, last)
        self.index.update(zip(words, (firsts[:-1] + self.n_nodes).tolist(), strict=True))
        self.n_nodes += n
        self.n_edges += m

    def edges(self, first: int) -> tuple[int, int]:
        """All edges of the node that edge ``first`` starts at, as a range."""
        node = int(np.searchsorted(self.ptr[: self.n_nodes + 1], np.int32(first), "right")) - 1  # (one type: else all are cast)
        return int(self.ptr[node]), int(self.ptr[node + 1])

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths from the nodes to their words' ends: which start each edge belongs to, in order, and the edges."""
        who, where, edges, step = np.arange(len(node), dtype=np.int32), [], [], 0
        live = ~self.end[node]
        who, node, key = who[live], node[live], key[live]
        while len(who):
            u = uniform(key, step)
            e = self.ptr[node]
            behind = np.flatnonzero(self.cum[e] <= u)
            while len(behind):
                e[behind] += 1
                behind = behind[self.cum[e[behind]] <= u[behind]]
            where.append(who)
            edges.append(e)
            node = self.to[e]
            live = ~self.end[node]
            who, node, key = who[live], node[live], key[live]
            step += 1
        if not where:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        count = np.bincount(np.concatenate(where), minlength=int(where[0].max()) + 1)
        first = np.cumsum(count) - count
        out, owner = np.zeros(int(count.sum()), np.int32), np.repeat(np.arange(len(count), dtype=np.int32), count)
        for s, (x, e) in enumerate(zip(where, edges, strict=True)):
            out[first[x] + s] = e
        return owner, out


@lru_cache(maxsize=2)
def lattices(v: Vocabulary) -> Lattices:
    return Lattices(v)


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    return (mix(key + U((step * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) >> U(11)).astype(np.float64) * 2.0**-53


_M = (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M
    return x ^ (x >> 31)


def _uniform(key: int) -> float:
    return (_mix(key) >> 11) * 2.0**-53


def _one_below(mass: float, bound: float, u: float) -> float:
    g = mass - math.log(-math.log(min(max(u, 1e-300), 1 - 1e-16)))
    x = bound - g
    return bound - (x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x)))


def _gumbel_below(mass: np.ndarray, bound: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at ``mass`` given that they are at most ``bound``."""
    with np.errstate(invalid="ignore"):
        g = mass - np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))
        # -log(exp(-bound) + exp(-g)), the truncated variable, in a stable form.
        return np.where(mass == -np.inf, -np.inf, bound - np.logaddexp(0.0, bound - g))


def _log_rest(log_p: np.ndarray) -> np.ndarray:
    """log(1 - exp(log_p)); -inf where nothing is left."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(log_p))


class _Search:
    """The agenda of one text: sets of paths, best bound first."""

    __slots__ = ("agenda", "key", "l", "paths", "tie")

    def __init__(self, key: int, l: Lattices):
        self.l, self.key, self.agenda, self.paths, self.tie = l, key, [], [], 0

    def draw(self, *what: int) -> int:
        k = self.key
        for w in what:
            k = _mix(k ^ (w * 0xD1342543DE82EF95 & _M))
        return k

    def push(self, bound: float, *node) -> None:
        if bound > -math.inf:
            self.tie += 1
            heapq.heappush(self.agenda, (-bound, self.tie, node))

    def split(self, r: int, stop: int, bound: float, k: int) -> None:
        """The set of all paths that part from path ``r`` beyond ``SPLITS`` pieces, as the sets that part at each of them.

        One of them, drawn by its probability, holds the maximum; the others stay below it.
        """
        path = self.paths[r][0]
        log_q = self.l.log_q[path]
        here = log_q[stop:]
        before = float(log_q[:stop].sum()) + np.cumsum(here) - here
        mass = before + _log_rest(here)
        open_ = np.flatnonzero(mass > -np.inf)
        share = np.cumsum(np.exp(mass[open_] - mass[open_].max()))
        best = min(int(np.searchsorted(share, _uniform(self.draw(8, r)) * share[-1], "right")), len(open_) - 1)
        g = _gumbel_below(mass[open_], bound, uniform(mix(open_.astype(np.uint64) + U(self.draw(9, r))), 0))
        g[best] = bound
        for i in np.argsort(-g, kind="stable")[: k + 1]:
            t = stop + int(open_[i])
            self.push(float(g[i]), r, t, (int(path[t]),), float(before[open_[i]]))

    def branch(self, r: int, t: int, gone: tuple, bound: float, before: float) -> int:
        """The edge that opens a set parted at piece ``t``, and what is left of it beside that edge."""
        a, b = self.l.edges(int(self.paths[r][0][t]))
        left = [e for e in range(a, b) if e not in gone]
        log_q = self.l.log_q[left].tolist()
        top = max(log_q)
        share, u, pick = [math.exp(x - top) for x in log_q], _uniform(self.draw(3, r, t, len(gone))), 0
        u *= sum(share)
        while pick < len(left) - 1 and u >= share[pick]:
            u -= share[pick]
            pick += 1
        rest = sum(x for i, x in enumerate(share) if i != pick)
        if rest > 0:
            self.push(_one_below(before + top + math.log(rest), bound, _uniform(self.draw(4, r, t, len(gone)))), r, t, (*gone, left[pick]), before)
        elif len(left) > 1:  # so far below that it can only be told in logarithms
            rest = max(x for i, x in enumerate(log_q) if i != pick) + math.log(len(left) - 1)
            self.push(_one_below(before + rest, bound, _uniform(self.draw(4, r, t, len(gone)))), r, t, (*gone, left[pick]), before)
        return left[pick]

    def next(self, k: int) -> tuple[int, int, int, float] | None:
        """The best set on the agenda: the path that it parts from, the place, the edge there, and its bound."""
        while self.agenda:
            bound, _, (r, t, gone, before) = heapq.heappop(self.agenda)
            if gone:
                return r, t, self.branch(r, t, gone, -bound, before), -bound
            self.split(r, t, -bound, k)  # many pieces at once
        return None


def _draws(keys: np.ndarray, *what: int) -> np.ndarray:
    """``_Search.draw`` of many texts."""
    for w in what:
        keys = mix(keys ^ U(w * 0xD1342543DE82EF95 & _M))
    return keys


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the segments of ``x`` that ``at`` bounds; an empty one is 0."""
    out, full = np.zeros(len(at) - 1), np.diff(at) > 0
    if full.any():
        out[full] = np.add.reduceat(x, at[:-1][full])
    return out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _emit(searches: list[_Search], keys: np.ndarray, path: np.ndarray, at: np.ndarray, bound: np.ndarray, step: np.ndarray, r: int, k: int, l: Lattices) -> None:
    """Paths (side by side) that are the best of their sets, and the sets left: those that part at each later piece."""
    log_q, size = l.log_q[path], np.diff(at)
    place = np.arange(len(path)) - np.repeat(at[:-1], size)
    stop = np.minimum(size, step + SPLITS)
    col = np.arange(SPLITS)
    valid = col < (stop - step)[:, None]
    where = np.minimum((at[:-1] + step)[:, None] + col, max(0, len(path) - 1))
    here = np.where(valid, log_q[where], 0.0) if len(path) else np.zeros((len(size), SPLITS))
    head = _sums(np.where(place < np.repeat(step, size), log_q, 0.0), at) if r else np.zeros(len(size))
    before = head[:, None] + np.cumsum(here, 1) - here
    mass = np.where(valid, before + _log_rest(here), -np.inf)
    g = _gumbel_below(mass, bound[:, None], uniform(mix(col.astype(np.uint64) + _draws(keys, 1, r)[:, None]), 0))
    best = np.argsort(-g, 1, kind="stable")[:, : k + 1]
    row = np.arange(len(size))[:, None]
    tops, befores, places = g[row, best].tolist(), before[row, best].tolist(), (best + step[:, None]).tolist()
    rest = _sums(np.where(place >= np.repeat(stop, size), log_q, 0.0), at)
    far_mass = np.where((stop < size) & (rest < 0), head + here.sum(1) + _log_rest(np.minimum(rest, 0.0)), -np.inf)
    far = _gumbel_below(far_mass, bound, uniform(_draws(keys, 2, r), 0))
    total, ends = _sums(log_q, at), at.tolist()
    for d, s in enumerate(searches):
        own = path[ends[d] : ends[d + 1]]
        s.paths.append((own, float(bound[d]), float(total[d])))
        for x, b, t in zip(tops[d], befores[d], places[d], strict=True):
            if x > -math.inf:
                s.push(x, r, t, (int(own[t]),), b)
        s.push(float(far[d]), r, int(stop[d]), (), 0.0)


class Samples:
    """Segmentations of the texts of a batch, side by side: ``text`` and ``at`` (bounds in ``ids``) of each, and its scores."""

    def __init__(self, searches: list[_Search], l: Lattices):
        own = [p for s in searches for p in s.paths]
        self.text = np.repeat(np.arange(len(searches)), [len(s.paths) for s in searches])
        self.sample = np.concatenate([np.arange(len(s.paths)) for s in searches]) if searches else np.zeros(0, np.int64)
        self.perturbed, self.log_prob = np.array([p[1] for p in own]), np.array([p[2] for p in own])
        left = [-s.agenda[0][0] if s.agenda else -math.inf for s in searches]
        self.inclusion = np.array([_inclusion(p[2] - x) for s, x in zip(searches, left, strict=True) for p in s.paths])
        size = np.array([len(p[0]) for p in own], np.int64)
        pieces = l.piece[np.concatenate([p[0] for p in own])] if own else np.zeros(0, np.int32)
        self.ids, self.at = _ids(pieces, np.concatenate([[0], np.cumsum(size)]), l.v)


def sample_batch(texts: list[str], keys: np.ndarray, k: int, v: Vocabulary) -> Samples:
    """For each text up to ``k`` different segmentations: piece ids, log probability, perturbed value, inclusion score."""
    l = lattices(v)
    data, offsets = flat(pa.array([" " + (t.replace("▁", " ") if "▁" in t else t) if t else "" for t in texts], pa.large_string()))
    space, line = data == 0x20, data == 0x0A
    cut = line | space
    cut[1:] = line[1:] | line[:-1] | space[1:] & ~space[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    first = np.flatnonzero(cut)
    chunks = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    start = l.nodes(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()] if len(first) else np.zeros(0, np.int64)
    word_at = np.searchsorted(first, offsets)
    n_words = np.diff(word_at)
    number = mix(np.arange(int(n_words.max(initial=0)), dtype=np.uint64))
    keys = keys.view(np.uint64)
    searches = [_Search(int(key), l) for key in keys]
    who, old, edge, place = np.arange(len(texts)), [None] * len(texts), None, np.zeros(len(texts), np.int64)
    bound = -np.log(-np.log(uniform(_draws(keys, 6), 0) * (1 - 1e-15) + 1e-300))
    for r in range(k):
        # The word that holds the place where each path parts from an older one (the first: the text's start).
        word = np.zeros(len(who), np.int64) if r == 0 else np.array([int(l.end[l.to[p[:t]]].sum()) for p, t in zip(old, place, strict=True)], np.int64)
        size = n_words[who] - word
        at = np.concatenate([[0], np.cumsum(size)])
        which = _ranges(word_at[who] + word, size)
        nodes = start[which]
        if r:
            nodes[at[:-1]] = l.to[edge]
        owner, edges = l.walk(nodes, number[which - np.repeat(word_at[who], size)] ^ np.repeat(_draws(keys[who], 5, r), size))
        cuts = np.searchsorted(owner, at)
        if r:
            ends = cuts.tolist()
            parts = [x for i, (p, t) in enumerate(zip(old, place.tolist(), strict=True)) for x in (p[:t], edge[i : i + 1], edges[ends[i] : ends[i + 1]])]
            edges = np.concatenate(parts)
            cuts = np.concatenate([[0], np.cumsum(np.diff(cuts) + place + 1)])
        these = [searches[d] for d in who]
        _emit(these, keys[who], edges, cuts, bound, place + (r > 0), r, k, l)
        if r + 1 == k:
            break
        jobs = [(d, job) for d, s in zip(who.tolist(), these, strict=True) if (job := s.next(k)) is not None]
        if not jobs:
            break
        who = np.array([d for d, _ in jobs])
        old = [searches[d].paths[job[0]][0] for d, job in jobs]
        place, edge = np.array([job[1] for _, job in jobs], np.int64), np.array([job[2] for _, job in jobs], np.int32)
        bound = np.array([job[3] for _, job in jobs])
    return Samples(searches, l)


def _inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))): the log probability that a Gumbel variable at x is above 0."""
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def _ids(pieces: np.ndarray, at: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian 32-bit ids and the bounds of each path's; a character without a piece is its UTF-8 bytes' pieces."""
    lone = np.flatnonzero(pieces < 0)
    if not len(lone):
        return pieces.astype("<u4"), at
    code = -1 - pieces[lone].astype(np.int64)
    extra = (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    count = np.ones(len(pieces), np.int64)
    count[lone] += extra
    ends = np.cumsum(count)
    out, first = np.repeat(pieces, count), (ends - count)[lone]
    for n in range(4):
        own = extra == n
        c, x = code[own], first[own]
        for i in range(n + 1):
            low = c >> 6 * (n - i)
            byte = low if n == 0 else (low & 0x3F | 0x80) if i else low | (0xC0, 0xE0, 0xF0)[n - 1]
            out[x + i] = v.byte_id[byte]
    return out.astype("<u4"), np.concatenate([[0], ends])[at]


def decode_flat(ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> list[memoryview]:
    """UTF-8 bytes of many id lists side by side: spaces for their marks, without the space that encoding put in front."""
    data, offsets = flat(v.text.take(pa.array(ids.astype(np.int64))))
    ends, view = offsets[at].tolist(), memoryview(np.ascontiguousarray(data))
    return [view[a + (a < b and view[a] == 0x20) : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode_samples(docs: DataFrame, n_samples: int = N_SAMPLES, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, digest: bool = False) -> DataFrame:
    """Up to ``n_samples`` rows a text: doc_id, sample, ids (little-endian 32 bits), log_prob, perturbed, log_inclusion.

    A null or empty text has one segmentation, without pieces. A text with fewer segmentations than asked for has each of
    them, with inclusion score 0. Rows equal in id and text get equal samples. A U+2581 in a text is a space.
    ``digest``: instead of ids their number, their CRC-32 and the SHA-256 of the text that they decode to, in one pass.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    own = ["n_pieces long", "ids_crc32 long", "decoded_sha256 string"] if digest else ["ids binary"]
    columns = ["sample int", *own, "log_prob double", "perturbed double", "log_inclusion double"]
    names = ["doc_id", *(c.split()[0] for c in columns)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, alpha)
        for b in parts:
            sizes = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            keys = b.column(1).to_numpy(zero_copy_only=False)
            a = 0
            while a < b.num_rows:
                z = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:]), BATCH_CHARS, "right")))
                texts = [t or "" for t in b.column(2).slice(a, z - a).to_pylist()]
                found = sample_batch(texts, keys[a:z], n_samples, v)
                ends, blob = found.at.tolist(), memoryview(found.ids).cast("B")
                blobs = [blob[4 * x : 4 * y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                if digest:
                    decoded = decode_flat(found.ids, found.at, v)
                    own = [pa.array(np.diff(found.at)), pa.array([zlib.crc32(x) for x in blobs], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
                else:
                    own = [pa.array([x.tobytes() for x in blobs], pa.binary())]
                own = [pa.array(found.sample.astype(np.int32)), *own, *(pa.array(x, pa.float64()) for x in (found.log_prob, found.perturbed, found.inclusion))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a).take(pa.array(found.text)), *own], names)
                a = z

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(columns))


def decode_samples(samples: DataFrame, model: str = MODEL) -> DataFrame:
    """``samples`` with ``decoded``, the text of ``ids``, and ``n_pieces``, ``ids_crc32``."""
    from pyspark.sql import types as T

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in parts:
            blobs = b.column("ids").to_pylist()
            at = np.cumsum([0, *(len(x) // 4 for x in blobs)])
            texts = [x.tobytes().decode("utf-8", "replace") for x in decode_flat(np.frombuffer(b"".join(blobs), "<u4"), at, v)]
            more = [pa.array(texts, pa.string()), pa.array(np.diff(at)), pa.array([zlib.crc32(x) for x in blobs], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "decoded", "n_pieces", "ids_crc32"])

    schema = T.StructType([*samples.schema.fields, T.StructField("decoded", T.StringType()), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return samples.mapInArrow(run, schema)


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_samples(table(spark, sf_dir, "documents"), digest=True)
