"""The pipeline's stages, each against plain Python on what it got."""

import random
import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from mizan.llm import bpe, html_text, pseudolikelihood, toxicity

WORD = r"[^\x20\x09-\x0D]+"
EDGES = [(900, None, "en", "a", 0), (901, "", "en", None, 0), (902, " \n ", "en", "b", 3), (None, "no id here at all", "en", "a", 17), (903, "x " * 20000, "en", "c", 40000)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    bad = ["zorgul", "vexpit", "krudnam"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, toxic = [], {}
    for i in range(200):
        text = make(rng.randint(20, 120))
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            w = text.split(" ")
            for _ in range(8):
                w[rng.randrange(len(w))] = rng.choice(bad)
            text = " ".join(w)
        rows.append((i, text, "en", "abc"[i % 3], len(text)))
    clean = [r for r in rows if not toxic[r[0]]]
    passage = make(70)
    rows += [(300 + k, clean[k][1], "en", "b", len(clean[k][1])) for k in range(20)]
    rows += [(330 + k, clean[30 + k][1] + " " + vocab[k], "en", "c", 5) for k in range(20)]
    rows += [(400 + k, make(40) + " " + passage + " " + make(30), "en", "a", 9) for k in range(6)]
    rows += [*EDGES, EDGES[0]]
    where = str(tmp_path_factory.mktemp("corpus"))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows, toxic, passage


def shingles(text):
    w = re.findall(WORD, (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_stages(spark, corpus, tmp_path):
    where, rows, toxic, passage = corpus
    docs, kept = spark.read.parquet(f"{where}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, where)
        out.write.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = lambda name: [r["doc_id"] for r in kept[name]]
    # Toxic documents go, clean ones stay.
    left = set(ids("toxicity"))
    assert sum(i in left for i, t in toxic.items() if t) <= 2 and sum(i in left for i, t in toxic.items() if not t) >= 146
    assert {None, 900, 901, 902, 903} <= left
    # One row of each group of near copies.
    before, after = kept["toxicity"], kept["ngram_jaccard"]
    sets, top = [shingles(r["text"]) for r in before], list(range(len(before)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((top[i], top[j]))
                top = [x if t == y else t for t in top]
    groups = defaultdict(set)
    for t, s, r in zip(top, sets, before):
        if s:
            groups[t].add(r["text"])
    assert Counter(next(t for t, g in groups.items() if r["text"] in g) for r in after if shingles(r["text"])) == Counter(dict.fromkeys(groups, 1))
    assert sum(not shingles(r["text"]) for r in after) == sum(not s for s in sets)
    # The passage stays once.
    middle = " ".join(passage.split(" ")[14:-14])
    assert sum(middle in (r["text"] or "") for r in kept["substring_dedup"]) == 1
    assert len(kept["substring_dedup"]) == len(after)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept["substring_dedup"])
    # Each row is taken 0 to 3 times, with its text.
    source = Counter((r["doc_id"], r["text"]) for r in kept["substring_dedup"])
    taken = Counter((r["doc_id"], r["text"]) for r in kept["mixing"])
    assert all(taken[k] <= 3 * source[k] for k in taken)
    # The library's ids.
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = defaultdict(list)
    for r in kept["mixing"]:
        texts[r["doc_id"]].append(r["text"] or "")
    assert len(kept["bpe"]) == len(kept["mixing"])
    for r in kept["bpe"]:
        got = [int.from_bytes(r["ids"][k : k + 4], "little") for k in range(0, len(r["ids"]), 4)]
        assert got in [library.encode(t, add_special_tokens=False).ids for t in set(texts[r["doc_id"]])]


def test_empty_corpus(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus[0])
        assert docs.collect() == []


def test_toxicity_scores(spark, corpus):
    where, rows, toxic, _ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    clash = docs.selectExpr("*", "1.5D score", "'x' held_out")
    model = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{where}/labels.parquet")))
    got = toxicity.score(clash, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    mine = {r["doc_id"]: r for r in got}
    held = [i for i in toxic if mine[i]["held_out"]]
    assert len(held) > 20 and sum(mine[i]["predicted"] == toxic[i] for i in held) >= 0.9 * len(held)
    twice = [r["score"] for r in got if r["doc_id"] == 900]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert toxicity.score(docs.limit(0), model).collect() == []
    few, labels = toxicity.sample(docs, spark.createDataFrame([(0, 0), (0, 1), (1, 0), (None, 1)], "doc_id long, toxic int"), 5)
    assert labels in ([1, 0], [1], [0], [])


def test_bpe_edges(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").selectExpr("*", "1 ids", "2 n_tokens")
    name = bpe.build(docs, most=40)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(docs, name).collect())
    assert got == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in corpus[1])
    assert bpe.encode_digests(docs.limit(0), bpe.build(docs.limit(0))).collect() == []


def test_empty_pages_and_scores(spark, corpus):
    pages = spark.createDataFrame([], "page_id long, html string, text string")
    assert html_text.extract_pages(pages).collect() == []
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    texts = docs.select("text")
    known = pseudolikelihood.vocabulary(texts)
    assert pseudolikelihood.score(docs, pseudolikelihood.train(texts, known), known).collect() == []
