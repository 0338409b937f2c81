"""Words, trees and counts of pseudo-likelihood, against plain forms."""

import numpy as np
import pyarrow as pa

from mizan.llm import pseudolikelihood


def test_pseudo_likelihood_tokens_and_trees():
    words = [f"w{i}" for i in range(9000)]
    tokens = pseudolikelihood.Tokens(words)
    probe = pseudolikelihood._hashes([*words[::7], "none", "w9000"])
    bucket = pseudolikelihood._bucket(probe) + 1
    assert tokens.of(probe).tolist() == [*range(64, 9064, 7), *bucket[-2:]]
    assert pseudolikelihood.Tokens([]).of(probe).tolist() == bucket.tolist()
    tail = pseudolikelihood.Tail(words, np.arange(9000, 0, -1).astype(float), np.ones(pseudolikelihood.RARE))
    h = np.random.default_rng(1).standard_normal((len(tail.path[0]), pseudolikelihood.HIDDEN)).astype(np.float32)
    target = np.concatenate([np.arange(pseudolikelihood.RARE) + 1, np.arange(pseudolikelihood.BASE, pseudolikelihood.BASE + 9000 - pseudolikelihood.HEAD)])
    tail.nodes += np.random.default_rng(2).standard_normal(tail.nodes.shape).astype(np.float32)
    own, got = tail.log_chances(h, target)
    wide = np.concatenate([h, np.ones((len(h), 1), np.float32)], 1)[own]
    want = -sum(np.log1p(np.exp(-s * (tail.nodes[p] * wide).sum(1))) * (s != 0) for p, s in ((p[own], t[own].astype(float)) for p, t in zip(tail.path, tail.turn)))
    assert sorted(own) == list(range(len(target))) and np.abs(got - want).max() < 1e-3
    # Steps raise the chance of what was seen, and tell which rows were used.
    tail.train()
    for _ in range(20):
        tail.learn(h, target)
    assert tail.log_chances(h, target)[1].mean() > got.mean() + 0.5
    used = np.bincount(tail.path[tail.turn != 0], minlength=len(tail.nodes))
    assert (tail.node_uses[used > 0] == 20 * used[used > 0]).all()


def test_pseudo_likelihood_counts(monkeypatch):
    monkeypatch.setattr(pseudolikelihood, "HELD_WORDS", 50)
    texts = pa.array(["A b\x0bÉ a", None, "", *(f"x{i % 40} \t b\n" for i in range(200))], pa.string())
    got = {}
    for batch in pseudolikelihood._count(pa.record_batch([texts.slice(i, 9)], ["text"]) for i in range(0, len(texts), 9)):
        for w, n in zip(*(c.to_pylist() for c in batch.columns)):
            got[w] = got.get(w, 0) + n
    assert got == {"a": 2, "b": 201, "é": 1, **{f"x{i}": 5 for i in range(40)}}
