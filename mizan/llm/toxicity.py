"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word enters as its own vector (if the training sample knows it) beside
the mean vector of its hashed character trigrams. Two recurrent layers read a
window of words forwards and backwards, attention pools their states, and a
logit comes out. All overlapping windows of a text are scored; the highest
logit decides, and a logistic curve fitted on the sample makes it a
probability. Everything is trained in numpy on the driver, on a bounded sample
of labelled rows; only labels and texts are used.

Labels are of whole documents, so each turn trains on the window that
currently looks most toxic in its document.

Defined results: null and empty texts score 0.0; labels that are null, or
whose document is missing, are ignored; without labels of both kinds all
scores are 0.0; repeated rows score alike; texts of any length are scored to
the end; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import documents, text_or_empty
from mizan.llm.textkit import released

#: Words in a window and between the starts of two windows.
WINDOW, STRIDE = 64, 48
#: The most labelled rows of each class that are learnt from, the longest text
#: among them (in characters), and the share of a score that means toxic.
SAMPLE, SAMPLE_CHARS, TOXIC_AT = 1200, 20_000, 0.3
HIDDEN, WORD_DIM, CHAR_DIM, BUCKETS = 8, 8, 4, 4096
EPOCHS, BATCH, RATE, DECAY, SEED = 10, 128, 0.01, 0.0005, 7
_REMEMBERED, _TOGETHER = 60_000, 2048
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class _Grams(dict):
    """Bucket of each trigram, by a hash that is the same in every process."""

    def __missing__(self, gram: str) -> int:
        h = 2166136261
        for c in gram:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        if len(self) > 100_000:
            self.clear()
        self[gram] = out = (h ^ h >> 15) % BUCKETS
        return out


_GRAMS = _Grams()


def trigrams(word: str) -> list[int]:
    s = f"<{word}>"
    return [_GRAMS[s[i : i + 3]] for i in range(len(s) - 2)]


def starts(n: int) -> range:
    """Starts of the overlapping windows of ``n`` words; the last reaches the end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)


@dataclass
class Model:
    vocabulary: dict[str, int]
    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0

    def vectors(self, words: list[str]) -> np.ndarray:
        """What goes into both directions for each word: 2 x 3 x HIDDEN numbers."""
        grams = [trigrams(w) for w in words]
        sizes = np.array([len(g) for g in grams])
        mean = np.add.reduceat(self.p["char"][np.concatenate(grams)], np.cumsum(sizes) - sizes) / sizes[:, None]
        x = np.concatenate([self.p["word"][[self.vocabulary.get(w, 0) for w in words]], mean], 1).astype(np.float32)
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _cell(xp: np.ndarray, h: np.ndarray, u: np.ndarray):
    g, k = h @ u, HIDDEN
    zr = _sigmoid(xp[:, : 2 * k] + g[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(xp[:, 2 * k :] + r * g[:, 2 * k :])
    return z * h + (1 - z) * n, (h, z, r, n, g[:, 2 * k :])


def _states(table: np.ndarray, ids: np.ndarray, p: dict, keep: bool = False):
    """States of both directions, time first. Row 0 of ``table`` is padding,
    whose update gate holds the state."""
    t, b, k = ids.shape[1], len(ids), HIDDEN
    out = np.empty((t, b, 2 * k), np.float32)
    memo: list = [[None] * t, [None] * t]
    for side, order in ((0, range(t)), (1, range(t - 1, -1, -1))):
        h, u, cols = np.zeros((b, k), np.float32), p["Uf" if side == 0 else "Ub"], slice(side * 3 * k, (side + 1) * 3 * k)
        part = np.ascontiguousarray(table[:, cols])
        for i in order:
            h, m = _cell(part[ids[:, i]], h, u)
            out[i, :, side * k : (side + 1) * k] = h
            if keep:
                memo[side][i] = m
    return out, memo


def _pool(states: np.ndarray, ids: np.ndarray, p: dict):
    s = states @ p["att"]
    s = np.where(ids.T > 0, s, -1e9)
    e = np.exp(s - s.max(0))
    a = e / e.sum(0)
    c = np.einsum("tb,tbk->bk", a, states)
    return a, c, c @ p["out"] + p["bias"][0]


def logits(table: np.ndarray, ids: np.ndarray, p: dict) -> np.ndarray:
    """Logits of windows, without what training keeps: gates lie in arrays of
    their own, so that every step runs over contiguous numbers."""
    t, b, k = ids.shape[1], len(ids), HIDDEN
    states = np.empty((2, t, b, k), np.float32)
    by_time = np.ascontiguousarray(ids.T)
    with np.errstate(over="ignore"):
        for side, order in ((0, range(t)), (1, range(t - 1, -1, -1))):
            u = p["Uf" if side == 0 else "Ub"]
            uz, ur, un = (np.ascontiguousarray(u[:, i * k : (i + 1) * k]) for i in range(3))
            tz, tr, tn = (np.ascontiguousarray(table[:, (side * 3 + i) * k : (side * 3 + i + 1) * k]) for i in range(3))
            h = np.zeros((b, k), np.float32)
            z, r, n, g = (np.empty((b, k), np.float32) for _ in range(4))
            for i in order:
                at = by_time[i]
                for out, part, w in ((z, tz, uz), (r, tr, ur)):
                    np.take(part, at, axis=0, out=out, mode="clip")
                    np.matmul(h, w, out=g)
                    out += g
                    np.negative(out, out=out)
                    np.exp(out, out=out)
                    out += 1
                    np.reciprocal(out, out=out)
                np.take(tn, at, axis=0, out=n, mode="clip")
                np.matmul(h, un, out=g)
                g *= r
                n += g
                n *= -2
                np.exp(n, out=n)
                n += 1
                np.divide(2, n, out=n)
                n -= 1
                h -= n
                h *= z
                h += n
                states[side, i] = h
    s = states[0] @ p["att"][:k] + states[1] @ p["att"][k:]
    s = np.where(by_time > 0, s, np.float32(-1e9))
    e = np.exp(s - s.max(0))
    # The pooled state only meets the output weights.
    o = states[0] @ p["out"][:k] + states[1] @ p["out"][k:]
    return (e * o).sum(0) / e.sum(0) + p["bias"][0]


def _padding() -> np.ndarray:
    row = np.zeros((1, 6 * HIDDEN), np.float32)
    row[0, :HIDDEN] = row[0, 3 * HIDDEN : 4 * HIDDEN] = 30.0
    return row


def _gradients(x: np.ndarray, ids: np.ndarray, y: np.ndarray, p: dict):
    """Loss gradients. ``x``: input vectors of the batch's distinct words, row
    0 unused; returns those of the parameters and of ``x``."""
    k = HIDDEN
    table = np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], 1).astype(np.float32)
    table[0] = _padding()[0]
    states, memo = _states(table, ids, p, keep=True)
    a, c, logit = _pool(states, ids, p)
    d = (_sigmoid(logit) - y) / len(y)
    g = {"out": c.T @ d, "bias": np.array([d.sum()], np.float32)}
    dc = d[:, None] * p["out"][None, :]
    ds = a * (np.einsum("tbk,bk->tb", states, dc) - np.einsum("bk,bk->b", c, dc))
    g["att"] = np.einsum("tb,tbk->k", ds, states)
    dstates = a[:, :, None] * dc[None] + ds[:, :, None] * p["att"]
    dtable, t = np.zeros_like(table), ids.shape[1]
    for side, order in ((0, range(t - 1, -1, -1)), (1, range(t))):
        u, name = p["Uf" if side == 0 else "Ub"], "Uf" if side == 0 else "Ub"
        du, dh = np.zeros_like(u), np.zeros((len(ids), k), np.float32)
        for i in order:
            h, z, r, n, gn = memo[side][i]
            dh = dh + dstates[i, :, side * k : (side + 1) * k]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], 1)
            du += h.T @ dg
            np.add.at(dtable[:, side * 3 * k : (side + 1) * 3 * k], ids[:, i], np.concatenate([dz, dr, dn], 1))
            dh = dh * z + dg @ u.T
        g[name] = du
    dtable[0] = 0
    dx = np.zeros_like(x)
    for side, w, b in ((0, "Wf", "bf"), (1, "Wb", "bb")):
        part = dtable[:, side * 3 * k : (side + 1) * 3 * k]
        g[w], g[b] = x.T @ part, part.sum(0)
        dx += part @ p[w].T
    return g, dx


def _windows(doc: list[int]) -> np.ndarray:
    out = np.zeros((len(starts(len(doc))), WINDOW), np.int32)
    for row, s in zip(out, starts(len(doc))):
        part = doc[s : s + WINDOW]
        row[: len(part)] = part
    return out


def train(texts: list[str], toxic: list[int]) -> Model | None:
    """Fit the network; ``None`` without examples of both kinds."""
    docs = [(words_of(t), y) for t, y in zip(texts, toxic)]
    docs = [(w, y) for w, y in docs if w]
    positive = sum(y for _, y in docs)
    if not 0 < positive < len(docs):
        return None
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for w, y in docs:
        seen[y].update(set(w))
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w in seen[0].keys() | seen[1].keys() if seen[0][w] + seen[1][w] >= 3))}
    # How much likelier a word is in toxic documents; where windows start from.
    total = [len(docs) - positive + 2, positive + 2]
    odds = {w: math.log((seen[1][w] + 1) / total[1]) - math.log((seen[0][w] + 1) / total[0]) for w in vocabulary}
    rng = np.random.default_rng(SEED)
    draw = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
    k, size = HIDDEN, WORD_DIM + CHAR_DIM
    p = {"word": 0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM)), "char": 0.1 * rng.standard_normal((BUCKETS, CHAR_DIM)), "Wf": draw(size, 3 * k), "Wb": draw(size, 3 * k), "bf": np.zeros(3 * k), "bb": np.zeros(3 * k), "Uf": draw(k, 3 * k), "Ub": draw(k, 3 * k), "att": draw(2 * k), "out": draw(2 * k), "bias": np.zeros(1)}
    p = {n: v.astype(np.float32) for n, v in p.items()}
    for w, i in vocabulary.items():
        p["word"][i, 0] = max(0.0, odds[w]) / 2
    # All distinct words of the sample, with their vocabulary rows and trigrams.
    index: dict[str, int] = {}
    coded = [([index.setdefault(w, len(index) + 1) for w in ws], y) for ws, y in docs]
    listed = list(index)
    row = np.array([0] + [vocabulary.get(w, 0) for w in listed])
    grams = [np.array([0])] + [np.array(trigrams(w)) for w in listed]
    gram_ends = np.cumsum([0] + [len(g) for g in grams])
    flat = np.concatenate(grams)
    windows = [_windows(d) for d, _ in coded]
    doc_of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    windows_ = np.concatenate(windows)
    y_doc = np.array([y for _, y in coded], np.float32)
    first = np.concatenate([[0.0], [max(0.0, odds.get(w, 0.0)) for w in listed]])
    look = np.partition(first[windows_], -3, axis=1)[:, -3:].sum(1)

    def inputs(words: np.ndarray) -> np.ndarray:
        sizes = gram_ends[words + 1] - gram_ends[words]
        at = np.concatenate([flat[gram_ends[w] : gram_ends[w + 1]] for w in words])
        mean = np.add.reduceat(p["char"][at], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]
        return np.concatenate([p["word"][row[words]], mean], 1).astype(np.float32)

    def table() -> np.ndarray:
        x = inputs(np.arange(len(row)))
        out = np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], 1).astype(np.float32)
        out[0] = _padding()[0]
        return out

    def highest(values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, doc_of))
        return order[np.append(np.flatnonzero(np.diff(doc_of[order])), len(order) - 1)]

    m = {n: np.zeros_like(v) for n, v in p.items()}
    v2 = {n: np.zeros_like(v) for n, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch:
            t = table()
            look = np.concatenate([logits(t, windows_[i : i + _TOGETHER], p) for i in range(0, len(windows_), _TOGETHER)])
        chosen = highest(look)
        # Clean documents also give a window at random: all of theirs are clean.
        other = np.flatnonzero(y_doc[doc_of] == 0)
        chosen = np.concatenate([chosen, rng.choice(other, min(len(other), len(chosen) // 2), replace=False)])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            pick = chosen[i : i + BATCH]
            words, local = np.unique(np.append(0, windows_[pick].ravel()), return_inverse=True)
            ids = local[1:].reshape(len(pick), WINDOW)
            x = inputs(words)
            g, dx = _gradients(x, ids, y_doc[doc_of[pick]], p)
            g["word"] = np.zeros_like(p["word"])
            np.add.at(g["word"], row[words], dx[:, :WORD_DIM])
            sizes = gram_ends[words + 1] - gram_ends[words]
            at = np.concatenate([flat[gram_ends[w] : gram_ends[w + 1]] for w in words])
            g["char"] = np.zeros_like(p["char"])
            np.add.at(g["char"], at, np.repeat(dx[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
            step += 1
            for n in p:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v2[n] = 0.999 * v2[n] + 0.001 * g[n] ** 2
                if n == "word":
                    p[n] *= 1 - DECAY
                p[n] -= (RATE * (m[n] / (1 - 0.9**step)) / (np.sqrt(v2[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    t = table()
    look = np.concatenate([logits(t, windows_[i : i + _TOGETHER], p) for i in range(0, len(windows_), _TOGETHER)])
    slope, offset = _curve(look[highest(look)], y_doc)
    return Model(vocabulary, p, slope, offset)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve through softened labels, by Newton's method."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    f = np.stack([x, np.ones_like(x)], 1).astype(np.float64)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = f.T @ (q - goal) + [1e-3 * (a - 1), 0]
        hess = (f * (q * (1 - q))[:, None]).T @ f + np.eye(2) * 1e-3
        da, db = np.linalg.solve(hess, grad)
        a, b = float(np.clip(a - da, 0.05, 20)), float(np.clip(b - db, -40, 40))
    return a, b


class Scorer:
    """Scores texts in one process; remembers the vectors of recent words."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.table[0] = _padding()[0]

    def _learn(self, words: set[str]) -> None:
        new, at = sorted(words), len(self.rows) + 1
        if at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(self.table) + len(new), 6 * HIDDEN), np.float32)])
        for i in range(0, len(new), 8192):
            self.table[at + i : at + i + len(new[i : i + 8192])] = self.model.vectors(new[i : i + 8192])
        self.rows.update(zip(new, range(at, at + len(new))))

    def scores(self, texts: list[str]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        if len(self.rows) > _REMEMBERED:
            self.rows = {}
        lists = [words_of(t) for t in texts]
        if new := set().union(*lists) - self.rows.keys():
            self._learn(new)
        held, owner, n = [], [], 0
        for d, words in enumerate(lists):
            if not words:
                continue
            ids = np.array(list(map(self.rows.__getitem__, words)), np.int32)
            at = np.array(starts(len(ids)))
            padded = np.zeros(at[-1] + WINDOW, np.int32)
            padded[: len(ids)] = ids
            for i in range(0, len(at), _TOGETHER):
                held.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[at[i : i + _TOGETHER]])
                owner.append(np.full(len(held[-1]), d))
                n += len(held[-1])
                if n >= _TOGETHER:
                    self._flush(held, owner, best)
                    held, owner, n = [], [], 0
        self._flush(held, owner, best)
        x = np.clip(self.model.slope * best + self.model.offset, -60, 60)
        return np.where(np.isneginf(best), 0.0, 1 / (1 + np.exp(-x)))

    def _flush(self, held: list, owner: list, best: np.ndarray) -> None:
        if held:
            np.maximum.at(best, np.concatenate(owner), logits(self.table, np.concatenate(held), self.model.p))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most ``most`` labelled rows of each class, outside the held-out fold,
    of texts of at most SAMPLE_CHARS characters, the same ones for the same
    rows. Texts that occur again count once, as toxic if any of them is."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fit = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    known = known.join(fit.select("doc_id").distinct(), "doc_id")
    chosen = [known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for kind in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * most narrow rows
    texts = fit.join(ids, "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    rows = sorted(texts.select("doc_id", "toxic", "text").collect())
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    d = docs.select("doc_id", text_or_empty().alias("text"))
    if model is None:
        d = d.select("doc_id", F.lit(0.0).alias("score"))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)

        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(held.value)
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    yield pa.record_batch([part.column(0), pa.array(scorer.scores(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

        d = d.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return d.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            at = batch.schema.names.index("text")
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(scorer.scores(texts) < TOXIC_AT))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(*sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
