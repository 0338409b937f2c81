"""Whole operators on a small table with nulls, repeats and clashing columns."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from mizan.llm import bpe, fingerprint, html_text, jaccard, mixing, pseudolikelihood, quality, sharding, spans

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    out = [(i, make(rng.randint(1, 120)), "ab c"[i % 4] if i % 7 else None) for i in range(40)]
    for i in range(40, 52):  # copies and near copies
        base = out[i - 40][1].split(" ")
        base[rng.randrange(len(base))] = "changed" if i % 2 else base[0]
        out.append((i, " ".join(base) if i % 3 else out[i - 40][1], "a"))
    passage = make(70)
    out += [(60, make(30) + " " + passage + " " + make(20), "a"), (61, passage + "\n" + make(9), "b"), (62, None, "b"), (63, "", None), (64, "  \n ", "c"), (65, "only", "c"), (65, "only", "c"), (66, "É x", "c"), (67, unicodedata.normalize("NFD", "é X"), "c")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns whose names clash with those of the operators.
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, size int, fingerprint string")
    return df.persist()


def words(t):
    return re.findall(WORD, t or "")


def test_quality(docs, rows):
    got = sorted(quality.score_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for i, t, _ in rows:
        w = words(t)
        runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {p for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    assert [tuple(r) for r in got] == sorted(want)


def test_sharding(docs, rows):
    got = sharding.shard(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[j]) for j in range(8)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_fingerprint(docs, rows):
    form = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())).strip()
    order = sorted(rows, key=lambda r: -r[0])
    found = fingerprint.compare_edited(docs).collect()
    got = {(r["doc_id"], r["edited_sha256"]): r for r in found}
    prints, expected = {}, []
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        expected.append((i, len(t), sha))
        r = got[i, sha]
        assert prints.setdefault(form(t), r["fingerprint"]) == r["fingerprint"] and prints.setdefault(form(edited), r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert (r["near_next"] == 1.0) == (form(t) == form(after))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == sorted(expected)
    assert len(set(prints.values())) == len(prints)


def test_jaccard(docs, rows):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}) for i, t, _ in rows for w in [words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]]
    top = {i: i for i, _ in sets}
    find = lambda x: x if top[x] == x else find(top[x])
    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    assert sorted(map(tuple, jaccard.join(docs).collect())) == sorted((i, len(s), find(i)) for i, s in sets)


def test_spans(docs, rows):
    got = {(r["doc_id"], r["n_removed"]): r for r in spans.remove_repeats(docs).collect()}
    texts = defaultdict(list)
    for (i, _), r in got.items():
        texts[i].append(r["text"])
    before = dict((i, t) for i, t, _ in rows)
    assert texts[62] == [None] and texts[63] == [""] and texts[60] == [before[60]]
    assert len(words(texts[61][0])) < 30
    assert texts[40][0] != before[40] or len(words(before[40])) < 24


def test_spans_keep_the_first_of_repeated_rows(spark):
    rng = random.Random(5)
    text = " ".join(f"v{rng.randrange(900)}" + rng.choice(["", "", "", ","]) for _ in range(100))
    for ids in ((7, 7, 7), (None, None, None), (7, 7, 9)):
        df = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
        for parts in (1, 3):
            got = spans.remove_repeats(df.repartition(parts)).collect()
            kept = [r["text"] for r in got if r["doc_id"] != 9]
            assert kept == [text] * len(kept) and len(got) == 3
            assert all(len(words(r["text"])) < 50 for r in got if r["doc_id"] == 9)


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert {(r["doc_id"], r["taken"]) for r in got} == again and len(got) == len(rows)
    totals, goals, sizes = Counter(), {}, Counter()
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r["size"] == len(words(dict((i, t) for i, t, _ in rows)[r["doc_id"]])) and r["taken"] <= 3 * r["size"]
        totals[source[r["doc_id"]]] += r["taken"]
        goals[source[r["doc_id"]]] = r["target"]
    assert all(abs(totals[s] - g) <= 125 for s, g in goals.items())


def test_bpe_round_trip(docs, rows):
    name = bpe.build(docs, most=50)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, name), name).collect()}
    assert back == {i: t or "" for i, t, _ in rows}


def test_pseudo_likelihood(docs, rows):
    texts = docs.selectExpr("coalesce(text, '') text")
    frequent = pseudolikelihood.vocabulary(texts)
    got = {r["doc_id"]: r for r in pseudolikelihood.score(docs, pseudolikelihood.train(texts, frequent), frequent).collect()}
    assert got[62]["n_tokens"] == 0 and got[62]["log_likelihood"] == 0.0 and got[62]["mean_log_likelihood"] is None
    assert all(r["log_likelihood"] < 0 for r in got.values() if r["n_tokens"])


def test_pseudo_likelihood_predicts_every_word(spark):
    rng = random.Random(3)
    often = [f"w{i}" for i in range(1500)]
    lone = {"rare0": 3, "rare1": 1, "rare2": 7}
    bag = often * 12 + [w for w, n in lone.items() for _ in range(n)]
    rng.shuffle(bag)
    rows = [(i // 100, " ".join(bag[i : i + 100])) for i in range(0, len(bag), 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = pseudolikelihood.vocabulary(df.select("text"))
    # All words that occur often have their own parameters, not 960 of them.
    assert set(known) == set(often) and known.rest.sum() == 11
    flat = pseudolikelihood.train(df.select("text"), known)
    # With one word in a text, the probabilities of all words sum to 1.
    probe = [*often, *lone, "unseen"]
    got = {r["doc_id"]: r["log_likelihood"] for r in pseudolikelihood.score(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), flat, known).collect()}
    chance = {w: math.exp(got[i]) for i, w in enumerate(probe)}
    tokens = pseudolikelihood.Tokens(list(known))
    p, tail = pseudolikelihood.unpack(flat), pseudolikelihood.Tail(*known.parts()).load(flat)
    ids = np.array([0, 0, 1, 0, 0], np.int32)
    other = {}
    for b in range(pseudolikelihood.RARE + 1):  # 0 is the edge
        ids[2] = b
        other[b] = math.exp(pseudolikelihood.log_probabilities(p, ids, np.array([2]), tail)[0])
    assert abs(sum(chance[w] for w in often) + sum(other.values()) - 1) < 1e-3
    for w, n in lone.items():
        total = known.rest[tokens[w] - 1]
        assert abs(chance[w] - other[tokens[w]] * n / (total + 1)) < 1e-6
    total = known.rest[tokens["unseen"] - 1]
    assert abs(chance["unseen"] - other[tokens["unseen"]] / (total + 1)) < 1e-6


@pytest.mark.parametrize("op", [quality.score_quality, sharding.shard, fingerprint.compare_edited, jaccard.join, spans.remove_repeats, mixing.mix])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None)], "page_id long, url string, html string")
    assert sorted(map(tuple, html_text.extract_pages(pages).collect())) == [(1, "a"), (1, "a"), (2, "")]
