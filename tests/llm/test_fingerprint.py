"""Digests that clash, and the order of rows."""

from mizan.llm import fingerprint
from pyspark.sql import functions as F


def test_forced_clash(spark, monkeypatch):
    rows = [(i, f"text number {i % 7} Ａ" if i % 2 else f"TEXT  number {i % 7} a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    right = {r["doc_id"]: r for r in fingerprint.compare_edited(df).collect()}
    whole, used = fingerprint.lane, []
    # The first two lanes know four values, so that different forms clash.
    monkeypatch.setattr(fingerprint, "lane", lambda form, seed: used.append(seed) or (F.pmod(whole(form, seed), F.lit(2)) if seed in fingerprint.SEEDS[:2] else whole(form, seed)))
    got = {r["doc_id"]: r for r in fingerprint.compare_edited(df).collect()}
    assert set(used) == set(fingerprint.SEEDS[:4])
    for i, r in right.items():
        assert (got[i]["near_edited"], got[i]["near_next"], got[i]["edited_sha256"]) == (r["near_edited"], r["near_next"], r["edited_sha256"])
        assert [j for j in right if right[j]["fingerprint"] == r["fingerprint"]] == [j for j in got if got[j]["fingerprint"] == got[i]["fingerprint"]]


def test_same_whatever_the_order(spark):
    df = spark.createDataFrame([(5, "b"), (5, "a"), (None, "x y z"), (2, None), (2, ""), (9, "q" * 3000)], "doc_id long, text string")
    runs = [sorted(map(tuple, fingerprint.compare_edited(df.repartition(n)).collect()), key=str) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 6
