"""Parts of the operators that need no Spark, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mizan.llm import bpe, html_text, jaccard, mixing, pseudolikelihood, quality, spans, textkit, toxicity


def test_shingles_match_plain_python():
    rng = random.Random(3)
    texts = ["", None, "  \n\t ", "one", "One two  three four", "É a b c d e É a b c d e"] + [" ".join(rng.choice("aA bB cé dd".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    got = list(textkit.shingle_sets(pa.array(texts, pa.string()), 5))
    seen = {}
    for text, s in zip(texts, got):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        assert len(s) == len(want)
        assert seen.setdefault(frozenset(want), tuple(s.tolist())) == tuple(s.tolist())


def test_bands_and_blocks():
    for n in range(1, 3000):
        k = jaccard.band(n)
        assert jaccard.band_top(k) >= n and (k == 0 or jaccard.band_top(k - 1) < n)
        top = int(n / 0.8)
        assert jaccard.band(top) - k in (0, 1) and (n + top) // 9 <= jaccard.most_different(k) + (n < 4)
    rng = np.random.default_rng(5)
    for n in (5, 9, 40, 300):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(len(a) * 0.2)
        b = a[drop:]
        assert jaccard.links(len(b), len(a), len(b))
        assert set(jaccard.keys(a, a)[0].tolist()) & set(jaccard.keys(b, b)[0].tolist())


def test_pivot_keeps_words_and_is_fair():
    rng = random.Random(1)
    total = np.zeros(40)
    for seed in range(300):
        rows = [[rng.randint(1, 9) * (20 if i % 13 == 0 else 1), 0.3, str(i)] for i in range(40)]
        rows.sort(key=lambda r: -r[0])
        words = sum(r[0] * r[1] for r in rows)
        mixing.pivot(rows, str(seed))
        assert abs(sum(r[0] * r[1] for r in rows) - words) < 1e-6 * words
        assert sum(0 < r[1] < 1 for r in rows) <= 1
        total += [r[1] for r in rows]
    assert abs(total.mean() / 300 - 0.3) < 0.02


def test_targets_fill_up():
    got = mixing.targets([("a", 10), ("b", 1000), (None, 1000)])
    assert got["a"] == 30 and abs(sum(got.values()) - 2010) < 1e-9
    assert abs(got["b"] / got[None] - 2) < 1e-9
    assert mixing.targets([]) == {} and mixing.targets([("x", 0)]) == {"x": 0.0}


def test_bpe_equals_the_library(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_vocabulary()
    ref = tokenizers.Tokenizer.from_file(path)
    file = str(tmp_path / "x.fst")
    words = [" the", "the", "then", " 12", "\n", " été", "ing"]
    bpe.compile_file(file, bpe.Vocabulary(path), [w.encode() for w in words])
    coder = bpe.Coder(file)
    for w in words:
        assert coder.lookup(w.encode()) == ref.encode(w).ids
    assert coder.lookup(b" th") is None and coder.lookup(b" they") is None
    rng = random.Random(2)
    letters = "abc DEF thé\n\t'’s 12²½٠ <|endoftext|>中\U0001f600\x1c\x85  "
    for _ in range(800):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>x", "a" * 450])
        ids = ref.encode(s, add_special_tokens=False).ids
        n, h, d = coder.digests(s)
        assert n == len(ids) and h == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert d == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_toxicity_learns_and_gradients_agree():
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(160):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        if i % 2:
            w[rng.randrange(len(w))] = rng.choice(["vile", "rotten"])
        texts.append(" ".join(w))
        labels.append(i % 2)
    m = toxicity.train(texts[:120], labels[:120])
    got = toxicity.Scorer(m).scores([*texts[120:], "", "..."])
    assert ((got[:40] >= toxicity.TOXIC_AT) == np.array(labels[120:])).mean() > 0.9
    assert got[-1] == got[-2] == 0.0
    assert toxicity.train([], []) is None and toxicity.train(["a"], [1]) is None
    # Every word is in a window, and windows overlap.
    for n in (1, 63, 64, 65, 200, 1000):
        at = list(toxicity.starts(n))
        assert at[0] == 0 and at[-1] + toxicity.WINDOW >= n and all(b - a < toxicity.WINDOW for a, b in zip(at, at[1:]))


def test_pseudo_likelihood_beats_chance_and_is_a_distribution():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(f"w{(i + j) % 50}" for j in range(60)) for i in (rng.randrange(50) for _ in range(120))]
    tokens = pseudolikelihood.Tokens(words)
    ids, sizes = pseudolikelihood.layout([*texts, ""], tokens)
    at = pseudolikelihood._places(sizes)
    assert len(at) == sizes.sum() and (ids[at] > 0).all()
    t = pseudolikelihood.Trainer(pseudolikelihood.start_model())
    before = pseudolikelihood.log_probabilities(t.p, ids, at).mean()
    for _ in range(200):
        t.learn(ids, at)
    assert pseudolikelihood.log_probabilities(t.p, ids, at).mean() > before + 2
    probe, place = ids[:5].copy(), np.array([2])
    total = 0.0
    for token in range(pseudolikelihood.CLASSES * pseudolikelihood.PER_CLASS):
        probe[2] = token
        total += float(np.exp(pseudolikelihood.log_probabilities(t.p, probe, place)[0]))
    assert abs(total - 1) < 1e-3


def test_html():
    page = "<title>t</title><p>a &amp; b<p>c<ul><li>x<li>y<ol><li>1<li>2</ol></ul><table><tr><th>N<th>V<tr><td>long name<td>1</table><div style='display:none'>no</div><pre>\n i\n  j</pre>"
    assert html_text.extract(page) == "a & b\n\nc\n\n- x\n- y\n  1. 1\n  2. 2\n\nN          V\nlong name  1\n\n i\n  j"
    assert html_text.extract(None) == html_text.extract("") == "" and html_text.extract("<div>" * 30000 + "x") == "x"
    assert html_text.extract("<p>cut <b class='open") == "cut"


def test_estimation_follows_agreement():
    patterns = [((1, 1, 1), 900), ((-1, -1, 1), 60), ((-1, -1, 0), 30), ((1, 0, 0), 200)]
    prior, chances = quality.estimate(patterns)
    assert quality._log_odds(prior, chances, (1, 1, 1)) > 0 > quality._log_odds(prior, chances, (-1, -1, 1))
    assert quality.estimate([]) == (0.5, [])


def test_sentences_cover_all_words():
    text = pa.array(["A b c. D e, f!\nG h", "", None, "x"], pa.string())
    (row, _, offsets, start, bounds, first, _, _), = spans._layout(text)
    assert row == 0 and bounds.tolist() == [0, 8, 8, 8, 9] and {0, 3, 5, 6, 8} <= set(first.tolist())


def test_passages_at_any_offset_share_a_run():
    rng = random.Random(4)
    for marks in (["", "", "", "", ".", ","], [""]):
        make = lambda n, m=marks: [f"w{rng.randrange(5000)}" + rng.choice(m) for _ in range(n)]
        gone = []
        for _ in range(400):
            passage, found = make(51), []
            before = rng.randrange(60), rng.randrange(60)
            texts = pa.array([" ".join(make(n) + passage + make(rng.randrange(60))) for n in before], pa.string())
            (_, _, _, _, bounds, first, full, h), = spans._layout(texts)
            code, _, a, b = spans.runs(first, full, h, bounds)
            edges, cover = np.append(first, len(h)), np.zeros(51, bool)
            shared = np.intersect1d(code[edges[a] < bounds[1]], code[edges[a] >= bounds[1]])
            for i in np.flatnonzero(np.isin(code, shared) & (edges[a] < bounds[1])):
                assert edges[a[i]] >= before[0] and edges[b[i]] <= before[0] + 51
                cover[edges[a[i]] - before[0] : edges[b[i]] - before[0]] = True
            gone.append(int(cover.sum()))
        assert min(gone) >= spans.MIN_WORDS and sum(gone) / len(gone) > 0.85 * 51, (min(gone), sum(gone) / len(gone))
