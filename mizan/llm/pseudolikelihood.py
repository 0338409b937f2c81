"""Language-model scores by masked pseudo-likelihood.

A window network predicts every token from the two tokens on each side of it:
their vectors pass a hidden layer, which gives the token's class and, within
the class, the token. A document's score is the sum of the logarithms of these
conditional probabilities.

Words are counted over all documents. The HEAD most frequent are tokens of that
softmax, and the others fall into RARE of its tokens, buckets, by hash. Within
a bucket, every word that occurs often enough (``least``: MIN_COUNT times, and
more often in a large corpus, with the root of its tokens) has its own vector
and a leaf of a binary tree, whose nodes decide by the hidden layer and start
at the words' counts. The root tells all rarer words of the bucket, one leaf,
from the others; such a word has its share of their counts, for which the words of all documents meet
the counted ones in a join, and all words that were not counted have the share
of one occurrence. So the probabilities of all words sum to 1, and vocabulary
and parameters grow with the input.

Every partition trains on all its documents, from the same start, and the
models are averaged: the softmax weighted by tokens, through a reduction tree,
and each row of the trees and word vectors weighted by its uses. A short turn
on the first batch of each partition comes before the full one.

Defined results: null and empty texts have no tokens, sum 0.0 and a null mean;
repeated rows score alike; texts of any length are scored to the end; an empty
table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import documents, even_keys, text_or_empty, written
from mizan.llm.textkit import CACHES, chunks, mix, released, word_hashes, words

#: Classes, tokens in a class; tokens for rare words; 0 stands for the edge.
CLASSES, PER_CLASS, RARE = 32, 32, 63
BASE = CLASSES * PER_CLASS
HEAD = BASE - RARE - 1
#: Least count of a word with its own parameters; the root of the tokens is
#: divided by ROOT_PART.
MIN_COUNT, ROOT_PART = 10, 200
#: Learning rate of trees and word vectors; their rows, and rare words, that one task averages.
TAIL_RATE, TASK_ROWS, TASK_WORDS = 0.4, 50_000, 2_000_000
SIDE, DIM, HIDDEN, BATCH, RATE, SEED = 2, 8, 16, 8192, 0.004, 11
FAN_IN = 16
#: Levels of the trees whose decisions are taken for a whole bucket at once, and
#: the rows that they fill.
LEVELS, TOP = 6, 33
#: Bytes of text whose words are counted at once; partial counts that a task holds.
COUNTED, HELD_WORDS = 4 << 20, 800_000

_SHAPES = {"E": (BASE, DIM), "W": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,), "Wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "Wo": (CLASSES, HIDDEN, PER_CLASS), "bo": (CLASSES, PER_CLASS)}


def start_model() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return {n: (rng.standard_normal(s) * (0.3 if n == "E" else 0.1)).astype(np.float32) for n, s in _SHAPES.items()}


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in _SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, s in _SHAPES.items():
        size = int(np.prod(s))
        out[n], at = flat[at : at + size].reshape(s).astype(np.float32), at + size
    return out


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The same parameters without copies."""
    out, at = {}, 0
    for n, s in _SHAPES.items():
        size = int(np.prod(s))
        out[n], at = flat[at : at + size].reshape(s), at + size
    return out


_BASE_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


class Vocabulary(list):
    """Words by falling count, with ``counts`` of them, ``rest`` (the count of
    all other words, by bucket) and ``table`` (all words and their counts)."""

    def __init__(self, words=(), counts=(), rest=None, table: DataFrame | None = None):
        super().__init__(words)
        self.counts = np.array(counts if len(counts) else np.ones(len(self)), np.float64)
        self.rest = np.zeros(RARE) if rest is None else np.asarray(rest, np.float64)
        self.table = table

    def parts(self) -> tuple:
        """What the tail and the tokens are built of."""
        return list(self), self.counts, self.rest

    def packed(self) -> tuple:
        """A name and the same with hashes for words, to be broadcast."""
        return uuid.uuid4().hex, _hashes(self), self.counts, self.rest


def least(total: int) -> int:
    """Occurrences from which a word has its own parameters."""
    return max(MIN_COUNT, int(total**0.5 / ROOT_PART))


class Tail:
    """Trees within the buckets and vectors of the words beyond the HEAD.

    A bucket with S leaves has S - 1 nodes: the root, row 1 of its rows, and a
    heap of the others' leaves: node k above 2k and 2k + 1, in row k + 1, leaves
    from S - 1. ``base`` is the softmax token of each token."""

    def __init__(self, words: list[str] | np.ndarray, counts: np.ndarray, rest: np.ndarray):
        bucket = _bucket(_hashes(words[HEAD:]))
        self.base = np.concatenate([np.arange(BASE), bucket + 1]).astype(np.int16)
        owner = np.concatenate([np.arange(RARE), bucket])
        size = np.bincount(owner, minlength=RARE)
        first = np.cumsum(size) - size
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(owner), np.int64)
        place[order] = np.arange(len(owner)) - first[owner[order]]
        many, self.rest = size[owner] > 1, place == 0
        leaf = np.where(self.rest, 1, size[owner] - 1 + place - 1)
        depth = np.frexp(leaf)[1].astype(np.int64) - 1
        deepest = depth.max(initial=0)
        # Leaves from left to right, so that those below a node are together.
        aligned = np.where(self.rest, 0, leaf << (deepest - depth))
        self.rank = np.empty(len(owner), np.int64)
        self.rank[np.lexsort((aligned, owner))] = np.arange(len(owner))
        self.owner, self.first, self.size = owner, first, size
        # The decisions from the root down: row, and -1 or 1 for the child. A
        # 0 is none, in the bucket's row 0, which is no node. Those of the
        # first levels are in the first TOP rows of the bucket.
        self.path = np.repeat(first[owner].astype(np.int32)[None], deepest + 1, 0)
        self.turn = np.zeros((deepest + 1, len(owner)), np.int8)
        self.path[0] += many
        self.turn[0] = np.where(many, np.where(self.rest, -1, 1), 0)
        for level in range(1, deepest + 1):
            j = np.flatnonzero(depth >= level)
            left = depth[j] - level
            self.path[level, j] += (leaf[j] >> (left + 1)).astype(np.int32) + 1
            self.turn[level, j] = 2 * ((leaf[j] >> left) & 1) - 1
        # The first levels of each leaf together: the row within the bucket.
        self.column = np.zeros((len(owner), LEVELS), np.int8)
        self.column[:, : deepest + 1] = (self.path[:LEVELS] - first[owner]).T
        self.side = np.zeros((len(owner), LEVELS), np.int8)
        self.side[:, : deepest + 1] = self.turn[:LEVELS].T
        mass = np.concatenate([rest, counts[HEAD:]]) + 0.5
        self.start = np.zeros((len(owner), HIDDEN + 1), np.float32)
        for b in range(RARE):
            n, own = int(size[b]) - 1, mass[order[first[b] : first[b] + size[b]]]
            if n < 1:
                continue
            self.start[first[b] + 1, HIDDEN] = np.log(own[1:].sum() / own[0])
            heap = np.zeros(2 * n)
            heap[n:] = own[1:]
            for level in range(n.bit_length(), -1, -1):
                k = np.arange(1 << level, min(2 << level, n))
                heap[k] = heap[2 * k] + heap[2 * k + 1]
            k = np.arange(1, n)
            self.start[first[b] + k + 1, HIDDEN] = np.log(heap[2 * k + 1] / heap[2 * k])
        self.nodes, self.vectors = self.start.copy(), np.zeros((len(self.base), DIM), np.float32)

    def load(self, flat: np.ndarray) -> Tail:
        """Takes its rows from behind the softmax model; without any, the start."""
        if len(flat) > _BASE_SIZE:
            at = _BASE_SIZE + self.nodes.size
            self.nodes = flat[_BASE_SIZE:at].reshape(self.nodes.shape).copy()
            self.vectors = flat[at:].reshape(self.vectors.shape).copy()
        return self

    def train(self) -> None:
        """Squares and uses of each row."""
        self.node_squares, self.vector_squares = np.ones(len(self.nodes), np.float32), np.ones(len(self.vectors), np.float32)
        self.node_uses, self.vector_uses = np.zeros(len(self.nodes), np.float32), np.zeros(len(self.vectors), np.float32)

    def leaves(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """The places of targets in a bucket, in order of their leaves, the
        leaves, which of these are below the first levels, and for each bucket
        the run of its leaves and its first rows."""
        own = np.flatnonzero(((target > 0) & (target <= RARE)) | (target >= BASE))
        n = max(len(own), 1)
        j = np.where(target[own] >= BASE, target[own] - BASE + RARE, target[own] - 1)
        key = np.sort(self.rank.take(j) * n + np.arange(len(own)))
        by = key % n
        own, j = own.take(by), j.take(by)
        ends = np.cumsum(np.bincount(self.owner.take(j), minlength=RARE)).tolist()
        runs = [(a, b, f, min(s, TOP)) for a, b, f, s in zip([0, *ends], ends, self.first.tolist(), self.size.tolist()) if b > a]
        return own, j, np.flatnonzero(self.turn[LEVELS].take(j)) if len(self.turn) > LEVELS else own[:0], runs

    def above(self, wide: np.ndarray, j: np.ndarray, runs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the first levels: the decisions' places in a table of leaves by
        rows, their signs and the odds against them."""
        z = np.empty((len(j), TOP), np.float32)
        for a, b, f, s in runs:
            np.matmul(wide[a:b], self.nodes[f : f + s].T, out=z[a:b, :s])
        at = self.column.take(j, 0) + (np.arange(len(j)) * TOP)[:, None]
        sign = self.side.take(j, 0).astype(np.float32)
        return at, sign, _odds(z.ravel().take(at), sign)

    def decide(self, wide: np.ndarray, level: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Below: node of each leaf, its row, sign and odds."""
        node, sign = self.path[level].take(j), self.turn[level].take(j).astype(np.float32)
        rows = self.nodes.take(node, 0)
        return node, rows, sign, _odds(np.einsum("nk,nk->n", rows, wide), sign)

    def log_chances(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of targets in a bucket, and the logarithm of their path."""
        own, j, deep, runs = self.leaves(target)
        wide = _wide(h, own)
        _, sign, odds = self.above(wide, j, runs)
        value = (np.log1p(odds) * np.abs(sign)) @ np.full(LEVELS, -1, np.float32)
        wide, j, below = wide.take(deep, 0), j.take(deep), np.zeros(len(deep), np.float32)
        for level in range(LEVELS, len(self.path)):
            _, _, sign, odds = self.decide(wide, level, j)
            below -= np.log1p(odds) * np.abs(sign)
        value[deep] += below
        return own, value

    def learn(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Changes the nodes; the places in ``target`` and the gradient for ``h``."""
        own, j, deep, runs = self.leaves(target)
        wide = _wide(h, own)
        at, sign, odds = self.above(wide, j, runs)
        # The child's chance less one, in its direction.
        odds /= 1 + odds
        d = np.zeros((len(j), TOP), np.float32)
        d.ravel()[at] = odds * -sign
        grown, g = np.empty_like(wide), np.zeros((len(runs), TOP, wide.shape[1]), np.float32)
        for i, (a, b, f, s) in enumerate(runs):
            np.matmul(d[a:b, :s], self.nodes[f : f + s], out=grown[a:b])
            np.matmul(d[a:b, :s].T, wide[a:b], out=g[i, :s])
        # Nodes of each bucket that decided something.
        bucket = np.repeat(np.arange(len(runs)), [b - a for a, b, _, _ in runs])
        uses = np.bincount((at + ((bucket - np.arange(len(j))) * TOP)[:, None])[sign != 0])
        used = np.flatnonzero(uses)
        if len(used):
            row = np.array([f for _, _, f, _ in runs])[used // TOP] + used % TOP
            self.node_uses[row] += uses[used]
            _step(self.nodes, self.node_squares, row, g.reshape(-1, wide.shape[1])[used])
        wide, j, below = wide.take(deep, 0), j.take(deep), np.zeros((len(deep), wide.shape[1]), np.float32)
        for level in range(LEVELS, len(self.path)):
            node, rows, sign, odds = self.decide(wide, level, j)
            odds /= 1 + odds
            odds *= -sign
            _descend(self.nodes, self.node_squares, self.node_uses, node, odds[:, None] * wide, rows)
            rows *= odds[:, None]
            below += rows
        grown[deep] += below
        return own, grown[:, :HIDDEN]

    def learn_vectors(self, token: np.ndarray, grown: np.ndarray) -> None:
        i = np.flatnonzero(token >= BASE)
        key = np.sort(token[i].astype(np.int64) * len(token) + i)
        row = key // max(len(token), 1)
        _descend(self.vectors, self.vector_squares, self.vector_uses, row, grown.take(key - row * len(token), 0))


def _wide(h: np.ndarray, own: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Hidden layers and a one for the nodes' last column."""
    h = h[own]
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def _odds(z: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Odds against the child on the side of ``sign``."""
    z *= -sign
    np.clip(z, -60, 60, out=z)
    return np.exp(z, out=z)


def _descend(table: np.ndarray, squares: np.ndarray, uses: np.ndarray, row: np.ndarray, g: np.ndarray, held: np.ndarray | None = None) -> None:
    """A step against the gradients ``g`` of rows whose equal ones are together;
    ``held`` is what the table has there, if that is known."""
    if not len(row):
        return
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    n = np.diff(first, append=len(row))
    row, total = row.take(first), g.take(first, 0)
    uses[row] += n
    # Rows that occur once need no sum.
    many = np.flatnonzero(n > 1)
    if len(many):
        n = n.take(many)
        begin = np.cumsum(n) - n
        total[many] = np.add.reduceat(g.take(np.repeat(first.take(many) - begin, n) + np.arange(n.sum()), 0), begin)
    _step(table, squares, row, total, None if held is None else held.take(first, 0))


def _step(table: np.ndarray, squares: np.ndarray, row: np.ndarray, g: np.ndarray, held: np.ndarray | None = None) -> None:
    """By the squares of each row's gradients so far."""
    size = squares.take(row)
    size += np.einsum("nk,nk->n", g, g)
    squares[row] = size
    np.sqrt(size, out=size)
    g *= (np.float32(-TAIL_RATE) / size)[:, None]
    g += table.take(row, 0) if held is None else held
    table[row] = g


def _hashes(words: list[str] | np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; hashes are left as they are."""
    if isinstance(words, np.ndarray):
        return words
    found = [word_hashes(data, offsets[:-1], offsets[1:], lower=False) for _, data, offsets in chunks(pa.array(words, pa.string()))]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(RARE)).astype(np.int64)


class Tokens:
    """Token of each word: frequent ones in order, others by hash."""

    def __init__(self, frequent: list[str] | np.ndarray):
        known = _hashes(frequent)
        order = np.argsort(known)
        bits = min(len(known).bit_length() + 2, 26)
        # Where the known hashes of each first bits begin; the last hash is
        # repeated, so that a look beyond the end finds it or nothing.
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(known[order], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.most = int(np.diff(self.first, append=len(known)).max())
        order = np.append(order, np.repeat(order[-1:], self.most + 1))
        self.known, self.token = known[order], (order + 1 + RARE).astype(np.int32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.empty(len(hashes), np.int32)
        left, at, h = np.arange(len(hashes)), self.first.take((hashes >> self.shift).astype(np.int64)), hashes
        for _ in range(self.most):
            held = self.known.take(at) == h
            out[left[held]] = self.token.take(at[held])
            miss = np.flatnonzero(~held)
            left, at, h = left.take(miss), at.take(miss) + 1, h.take(miss)
        out[left] = _bucket(h) + 1
        return out

    def __getitem__(self, word: str) -> int:
        return int(self.of(_hashes([word]))[0])


def layout(texts, tokens: Tokens, rare: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts with edges between them, and how many each has.
    ``rare`` takes the hashes of each text's words that have only a bucket."""
    found, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _, data, offsets in chunks(_lowered(texts)):
        start, end, bounds = words(data, offsets)
        h = word_hashes(data, start, end, lower=False)
        ids = tokens.of(h)
        found.append(ids)
        sizes.append(np.diff(bounds))
        if rare is not None:
            before = np.append(0, np.cumsum(ids <= RARE))
            rare += np.split(h[ids <= RARE], before[bounds[1:-1]])
    size = np.concatenate(sizes)
    out = np.zeros(int(size.sum()) + SIDE * (len(size) + 1), np.int32)
    out[_places(size)] = np.concatenate(found)
    return out, size


def _lowered(texts) -> pa.Array:
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    return pc.utf8_lower(texts.fill_null(""))


def _offsets() -> list[int]:
    return [o for o in range(-SIDE, SIDE + 1) if o]


def _hidden(p: dict, ids: np.ndarray, at: np.ndarray, order: np.ndarray, tail: Tail | None = None):
    """Of the places ``at``, which rise: the tokens from the first one's window
    to the last one's, each place's row among them, and in the given order their
    windows' vectors and hidden layers."""
    token = ids[at[0] - SIDE : at[-1] + SIDE + 1]
    each = p["E"].take(token if tail is None else tail.base.take(token), 0)
    if tail is not None:
        each += tail.vectors.take(token, 0)
    n = len(token) - 2 * SIDE
    x = np.empty((n, 2 * SIDE, DIM), np.float32)
    for slot, o in enumerate(_offsets()):
        x[:, slot] = each[SIDE + o : SIDE + o + n]
    place = at[order] - at[0]
    x = x.reshape(n, -1).take(place, 0)
    h = x @ p["W"]
    h += p["b"]
    return token, place, x, np.tanh(h, out=h)


def _values(p: dict, h: np.ndarray, target: np.ndarray, spans: list) -> tuple:
    """The hidden layers with a one behind, the weights with the biases below,
    before the softmax the values of all classes and below them of all tokens of
    each target's class, and where in these the target's own are."""
    n = len(h)
    wide = _wide(h)
    outer = np.concatenate([p["Wc"], p["bc"][None]])
    inner = np.concatenate([p["Wo"], p["bo"][:, None]], 1)
    z = np.empty((2 * n, PER_CLASS), np.float32)
    np.matmul(wide, outer, out=z[:n])
    for c, a, b in spans:
        np.matmul(wide[a:b], inner[c], out=z[n + a : n + b])
    np.minimum(z, 80, out=z)  # far above what occurs; float32 ends at 88
    own = np.arange(2 * n) * PER_CLASS
    own[:n] += target // PER_CLASS
    own[n:] += target % PER_CLASS
    return wide, outer, inner, z, own


def _by_class(target: np.ndarray):
    """Order that brings the targets of a class together, and the runs."""
    group = target // PER_CLASS
    order = np.argsort(group.astype(np.int16), kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=CLASSES))
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(np.append(0, ends), ends)) if b > a]


def log_probabilities(p: dict, ids: np.ndarray, at: np.ndarray, tail: Tail | None = None) -> np.ndarray:
    """Of the tokens at the places ``at``, given both sides; a token of a
    bucket stands for its rarer words if there is a ``tail``."""
    out = np.empty(len(at), np.float32)
    for i in range(0, len(at), BATCH):
        part = at[i : i + BATCH]
        full = ids[part].astype(np.int64)
        target = full if tail is None else tail.base[full]
        order, spans = _by_class(target)
        *_, h = _hidden(p, ids, part, order, tail)
        *_, z, own = _values(p, h, target[order], spans)
        value = z.ravel().take(own)
        value -= np.log(np.exp(z, out=z) @ np.ones(PER_CLASS, np.float32))
        value = value[: len(part)] + value[len(part) :]
        if tail is not None:
            own, path = tail.log_chances(h, full[order])
            value[own] += path
        out[i + order] = value
    return out


class Trainer:
    def __init__(self, p: dict, tail: Tail | None = None):
        self.flat, self.step, self.tail = pack(p).astype(np.float32), 0, tail
        self.p = _views(self.flat)
        if tail is not None:
            tail.train()
        self.g, self.m, self.v = (np.zeros_like(self.flat) for _ in range(3))

    def learn(self, ids: np.ndarray, at: np.ndarray) -> None:
        for i in range(0, len(at), BATCH):
            self._batch(ids, at[i : i + BATCH])

    def _batch(self, ids: np.ndarray, at: np.ndarray) -> None:
        p, n, tail = self.p, len(at), self.tail
        full = ids[at].astype(np.int64)
        target = full if tail is None else tail.base[full]
        order, spans = _by_class(target)
        token, place, x, h = _hidden(p, ids, at, order, tail)
        wide, outer, inner, z, own = _values(p, h, target[order], spans)
        # Gradients are sums over the batch until the step.
        np.exp(z, out=z)
        z *= (1 / (z @ np.ones(PER_CLASS, np.float32)))[:, None]
        z.ravel()[own] -= 1
        g = _views(self.g)
        self.g[:] = 0
        weights = wide.T @ z[:n]
        g["Wc"][:], g["bc"][:] = weights[:HIDDEN], weights[HIDDEN]
        dh, below = z[:n] @ p["Wc"].T, np.empty((n, HIDDEN), np.float32)
        for c, a, b in spans:
            e = z[n + a : n + b]
            weights = wide[a:b].T @ e
            g["Wo"][c], g["bo"][c] = weights[:HIDDEN], weights[HIDDEN]
            np.matmul(e, p["Wo"][c].T, out=below[a:b])
        dh += below
        if tail is not None:
            own, grown = tail.learn(h, full[order])
            dh[own] += grown
        h *= h
        dh -= h * dh
        g["W"][:], g["b"][:] = x.T @ dh, np.ones(n, np.float32) @ dh
        # What each token's vector gets from the windows that it is in.
        m = len(token) - 2 * SIDE
        dx = np.zeros((m, 2 * SIDE, DIM), np.float32)
        dx.reshape(m, -1)[place] = dh @ p["W"].T
        each = np.zeros((len(token), DIM), np.float32)
        for slot, o in enumerate(_offsets()):
            each[SIDE + o : SIDE + o + m] += dx[:, slot]
        if tail is not None:
            tail.learn_vectors(token, each)
            token = tail.base.take(token)
        by = np.argsort(token.astype(np.int16), kind="stable")
        token = token.take(by)
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        g["E"][token[first]] = np.add.reduceat(each.take(by, 0), first)
        self.step += 1
        scale = np.float32(RATE * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step))
        grad = self.g
        grad /= np.float32(n)
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        self.flat -= scale * self.m / (np.sqrt(self.v) + 1e-7)


def _places(sizes: np.ndarray) -> np.ndarray:
    """Where the tokens stand in the layout."""
    first = SIDE + np.cumsum(sizes + SIDE) - sizes - SIDE
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@released
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, many = [], 0
    for batch in batches:
        for _, data, offsets in chunks(_lowered(batch.column(0)), COUNTED):
            start, end, _ = words(data, offsets)
            found, n, first = _grouped(word_hashes(data, start, end, lower=False))
            start, size = start[first], (end - start)[first]
            edges = np.append(0, np.cumsum(size))
            letters = data[np.repeat(start - edges[:-1], size) + np.arange(edges[-1])]
            held.append((found, n, pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(edges), pa.py_buffer(letters))))
            many += len(found)
        if many > HELD_WORDS:
            held = [_merged(held)]
            many = len(held[0][0])
            if 2 * many > HELD_WORDS:
                yield from _sent(*held[0])
                held, many = [], 0
    if held:
        yield from _sent(*_merged(held))


def _grouped(hashes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes, how often each occurs, and its first place."""
    coded = pa.array(hashes).dictionary_encode()
    place = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[place[::-1]] = np.arange(len(place) - 1, -1, -1)
    return coded.dictionary.to_numpy(), np.bincount(place, n, len(first)).astype(np.int64), first


def _merged(held: list[tuple]) -> tuple:
    hashes, n, found = zip(*held)
    hashes, n, first = _grouped(np.concatenate(hashes), np.concatenate(n))
    return hashes, n, pa.concat_arrays(found).take(pa.array(first))


def _sent(_: np.ndarray, n: np.ndarray, found: pa.Array) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(n), 100_000):
        yield pa.record_batch([found[i : i + 100_000].cast(pa.string()), pa.array(n[i : i + 100_000])], ["word", "n"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest = np.zeros(RARE, np.int64)
    for batch in batches:
        np.add.at(rest, _bucket(_hashes(batch.column(0).to_pylist())), batch.column(1).to_numpy(zero_copy_only=False))
    yield pa.record_batch([pa.array(np.arange(RARE)), pa.array(rest)], ["b", "n"])


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The HEAD most frequent words and all of the ``least`` count, counted
    over all whole texts."""
    counts = written(docs.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD).select("n").collect()
    total = counts.agg(F.sum("n")).first()[0] or 0
    floor = min(least(total), top[-1]["n"]) if top else 1
    held = counts.where(F.col("n") >= floor).toArrow()
    names, n = held["word"].to_pylist(), held["n"].to_numpy()
    order = sorted(range(len(names)), key=lambda i: (-n[i], names[i].encode()))
    order = order[: max(HEAD, int((n >= least(total)).sum()))]
    words, n = [names[i] for i in order], n[order]
    rest = np.zeros(RARE)
    for r in counts.mapInArrow(_by_bucket, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        rest[r["b"]] = r["n"]
    np.subtract.at(rest, _bucket(_hashes(words)), n)
    return Vocabulary(words, n, rest, counts)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Few models meet here; summed in one order, whatever order they come in.
    held = sorted((w, blob) for batch in batches for w, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    weight, total = sum(w for w, _ in held), None
    for _, blob in held:
        x = np.frombuffer(blob, np.float64)
        total = x if total is None else total + x
    if total is not None:
        yield pa.record_batch([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], ["weight", "total"])


def _average(models: DataFrame) -> np.ndarray | None:
    """Weighted mean through a tree: sums of sums, until a few rows are left."""
    n = models.count()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        models = written(models.repartition(n).mapInArrow(_sum, "weight double, total binary"), "sums")
        n = min(n, models.count())
    rows = sorted((r["weight"], bytes(r["total"])) for r in models.collect())
    weight = sum(w for w, _ in rows)
    return sum(np.frombuffer(t, np.float64) for _, t in rows) / weight if weight else None


def _touched(tail: Tail, start: np.ndarray) -> Iterator[tuple]:
    """Part, rows, uses and changes of the tail's used rows; the rows of the
    word vectors come after those of the nodes."""
    at, held = 0, start[_BASE_SIZE:]
    for table, uses in ((tail.nodes, tail.node_uses), (tail.vectors, tail.vector_uses)):
        old, held = held[: table.size].reshape(table.shape), held[table.size :]
        rows = np.flatnonzero(uses)
        cut = np.searchsorted((rows + at) // TASK_ROWS, np.arange((at + len(table)) // TASK_ROWS + 2))
        for part, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a:
                r = rows[a:b]
                yield part, (r + at).tobytes(), uses[r].astype(np.float64).tobytes(), (table[r] - old[r]).astype(np.float16).tobytes(), table.shape[1]
        at += len(table)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean change of each row of the tail, weighted by its uses."""
    held: dict[tuple, tuple] = {}
    for batch in batches:
        for part, rows, uses, change, wide in zip(*(c.to_pylist() for c in batch.columns)):
            rows, uses = np.frombuffer(rows, np.int64) - part * TASK_ROWS, np.frombuffer(uses, np.float64)
            weight, total = held.setdefault((part, wide), (np.zeros(TASK_ROWS), np.zeros((TASK_ROWS, wide))))
            weight[rows] += uses
            total[rows] += uses[:, None] * np.frombuffer(change, np.float16).reshape(-1, wide)
    for (part, wide), (weight, total) in held.items():
        rows = np.flatnonzero(weight)
        mean = (total[rows] / weight[rows, None]).astype(np.float16)
        yield pa.record_batch([pa.array([(rows + part * TASK_ROWS).tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary()), pa.array([wide], pa.int32())], ["rows", "change", "wide"])


#: What a worker builds of the broadcast vocabulary, once for all tasks.
_BUILT: dict[str, tuple[Tokens, Tail]] = {}
CACHES[__name__] = _BUILT.clear


def _built(name: str, hashes: np.ndarray, counts: np.ndarray, rest: np.ndarray, flat: np.ndarray) -> tuple[Tokens, Tail]:
    """The tokens, and the tail with its rows in ``flat``."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Tokens(hashes), Tail(hashes, counts, rest)
    tokens, tail = _BUILT[name]
    return tokens, copy.copy(tail).load(flat)


def train(docs: DataFrame, frequent: Vocabulary) -> np.ndarray:
    """``docs``: one column, text. Two turns of local training and averaging."""
    sc = docs.sparkSession.sparkContext
    tail = Tail(*frequent.parts())
    flat = np.concatenate([pack(start_model()), tail.nodes.ravel(), tail.vectors.ravel()])
    known = sc.broadcast(frequent.packed())
    for whole in (False, True):
        held = sc.broadcast(flat)

        @released
        def run(batches: Iterator[pa.RecordBatch], whole=whole, held=held) -> Iterator[pa.RecordBatch]:
            start, seen = held.value, 0
            tokens, tail = _built(*known.value, start)
            trainer = Trainer(_views(start), tail)
            for batch in batches:
                if not whole and seen:
                    continue
                for i in range(0, batch.num_rows if whole else min(256, batch.num_rows), 256):
                    ids, sizes = layout(batch.column(0).slice(i, 256), tokens)
                    trainer.learn(ids, _places(sizes))
                    seen += int(sizes.sum())
            if seen:
                model = (pack(trainer.p).astype(np.float64) * seen).tobytes()
                rows = [(-1, float(seen), None, None, model, 0), *((p, 0.0, r, u, c, w) for p, r, u, c, w in _touched(tail, start))]
                kinds = [pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
                for row in rows:
                    yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds)], ["part", "weight", "rows", "uses", "total", "wide"])

        models = written(docs.mapInArrow(run, "part int, weight double, rows binary, uses binary, total binary, wide int"), "models")
        mean = _average(models.where("part < 0").select("weight", "total"))
        if mean is None:
            return flat
        flat[:_BASE_SIZE] = mean
        parts = (len(tail.nodes) + len(tail.vectors)) // TASK_ROWS + 1
        changes = models.where("part >= 0").select("part", "rows", "uses", "total", "wide").repartition(parts, "part").mapInArrow(_merge, "rows binary, change binary, wide int")
        tail.load(flat)
        for r in changes.collect():
            rows, change = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["change"], np.float16).reshape(-1, r["wide"])
            if r["wide"] == DIM:
                tail.vectors[rows - len(tail.nodes)] += change
            else:
                tail.nodes[rows] += change
        flat = np.concatenate([flat[:_BASE_SIZE], tail.nodes.ravel(), tail.vectors.ravel()])
    return flat


def _deal(keys: list[int], hashes: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Hashes and values as bytes, by the part that owns the hash."""
    part = (mix(hashes) % np.uint64(len(keys))).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=len(keys)))
    for p, (a, b) in enumerate(zip(np.append(0, ends), ends)):
        if b > a:
            packed = [x[order[a:b]].tobytes() for x in (hashes, *values)]
            yield pa.record_batch([pa.array([keys[p]], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["p", "word", "row", "n"])


@released
def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document, by row, the logarithms of its rare words' counts;
    counted words come with row -1. Words without a count have 1."""
    by_part: dict[int, list] = {}
    for batch in batches:
        for p, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            by_part.setdefault(p, []).append([np.frombuffer(x, k) for x, k in zip(blobs, (np.uint64, np.int64, np.int64))])
    while by_part:
        _, held = by_part.popitem()
        word, row, n = (np.concatenate(x) for x in zip(*held))
        known = row < 0
        order = np.argsort(word[known])
        words, counts = np.append(word[known][order], np.uint64(0)), np.append(n[known][order], 1)
        at = np.searchsorted(words[:-1], word[~known])
        value = n[~known] * np.log(np.where(words[at] == word[~known], counts[at], 1))
        row, inverse = np.unique(row[~known], return_inverse=True)
        if len(row):
            yield pa.record_batch([pa.array(row), pa.array(np.bincount(inverse, value))], ["_row", "shares"])


def score(docs: DataFrame, flat: np.ndarray, frequent: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum) and mean_log_likelihood."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((flat, frequent.packed()))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, known = held.value
        tokens, tail = _built(*known, flat)
        p, rest = _views(flat), np.append(0, np.log(known[-1] + 1))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, rare = batch.slice(i, 256), []
                ids, sizes = layout(part.column(1), tokens, rare)
                at = _places(sizes)
                each = log_probabilities(p, ids, at, tail).astype(np.float64)
                each -= np.where(ids[at] <= RARE, rest[np.minimum(ids[at], RARE)], 0)
                value = np.append(0.0, np.cumsum(each))
                ends = np.cumsum(sizes)
                blobs = pa.array([h.tobytes() for h in rare], pa.binary())
                yield pa.record_batch([part.column(0), pa.array(sizes), pa.array(value[ends] - value[ends - sizes]), part.column(2), blobs], ["doc_id", "n_tokens", "likelihood", "_row", "rare"])

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("_row"))
    d = written(numbered.mapInArrow(run, "doc_id long, n_tokens long, likelihood double, _row long, rare binary"), "scores")
    rare = d.agg(F.sum(F.length("rare"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rare // 8 // TASK_WORDS + 1)

    keys = even_keys(spark, parts)

    @released
    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            hashes = np.frombuffer(b"".join(blobs), np.uint64)
            row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) // 8 for x in blobs])
            yield from _deal(keys, hashes, row, np.ones(len(row), np.int64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            yield from _deal(keys, _hashes(batch.column(0).to_pylist()), np.full(len(n), -1), n)

    kinds = "p int, word binary, row binary, n binary"
    packed = d.select("_row", "rare").mapInArrow(used, kinds).union(frequent.table.select("word", "n").mapInArrow(counted, kinds))
    shares = packed.repartition(parts, "p").mapInArrow(_shares, "_row long, shares double").groupBy("_row").agg(F.sum("shares").alias("shares"))
    d = d.drop("rare").join(shares, "_row", "left")
    d = d.select("doc_id", "n_tokens", (F.col("likelihood") + F.coalesce("shares", F.lit(0.0))).alias("log_likelihood"))
    return d.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op5_pseudolikelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    texts = docs.select(text_or_empty().alias("text"))
    frequent = vocabulary(texts)
    return score(docs, train(texts, frequent), frequent)
