"""Mixing: the same result for rows in any order, and whole copies."""

import random
from collections import Counter

from mizan.llm import mixing


def table(spark, rows, parts):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, mark string").repartition(parts)


def test_reruns_agree(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, i]), "w " * rng.randrange(30), rng.choice(["a", "b", "c", None]), 7, "m") for i in range(400)]
    rows += rows[:50]
    want = None
    for parts in (1, 3, 5):
        rng.shuffle(rows)
        df = table(spark, rows, parts)
        got = sorted(map(tuple, mixing.mix(df).collect()), key=str)
        texts = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.take(df).collect())
        assert len(got) == len(rows)
        want = want or (got, texts)
        assert (got, texts) == want


def test_take_gives_the_copies(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 90), "abc"[i % 3], 1, "m") for i in range(300)] + [(5, "w w w", "a", 1, "m")] * 40
    df = table(spark, rows, 4)
    counts = Counter()
    for r in mixing.rounded(df).collect():
        counts[r["doc_id"], r["source"], r["size"]] += r["copies"]
    taken = mixing.take(df)
    assert taken.columns == df.columns
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in taken.collect())
    assert got == Counter({k: n for k, n in counts.items() if n})
    goal = {r["source"]: r["target"] for r in mixing.rounded(df).select("source", "target").distinct().collect()}
    words = Counter()
    for (_, s, n), k in got.items():
        words[s] += n * k
    assert all(abs(words[s] - g) <= 90 for s, g in goal.items())


def test_runs_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    df = table(spark, [(1, "a b", "s", 1, "m")] * 50 + [(2, "c", "t", 1, "m")], 3)
    found = mixing.rounded(df).collect()
    assert sorted(r["nth"] for r in found if r["doc_id"] == 1) == list(range(50))
