"""Whole analyses with the demo lexicon."""

import duckdb
import pytest

from mizan import queries as Q
from mizan.cli import demo_lexicon
from mizan.plans.analyze import analyze_words
from mizan.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    words = "عندليب إلى zzz يكتبوا بالمدرسة معلمتان لأنهم محمد الله والله".split()
    rows = analyze_words(spark.createDataFrame([(w,) for w in [*words, None, ""]], "word string"), demo_lexicon(spark)).collect()
    return {w: sorted((r for r in rows if r["word"] == w), key=lambda r: r["rank"]) for w in words}


def test_readings(found):
    assert [len(r["inflections"]) for r in found["عندليب"]] == [5]
    assert found["zzz"] == []
    assert found["إلى"][0]["pos"] == "حرف"
    assert found["يكتبوا"][0]["suffixes"][0]["form"] == "وا" and found["يكتبوا"][0]["prefixes"][0]["form"] == "ي"
    assert found["بالمدرسة"][0]["suffixes"][0]["form"] == "ة"
    assert [a["form"] for a in found["معلمتان"][0]["suffixes"]] == ["ة", "ان"]
    assert found["لأنهم"][0]["enclitics"][0]["form"] == "هُمْ"
    assert found["محمد"][0]["type"] == "اسم علم" and {i["case"] for i in found["محمد"][0]["inflections"]} == {"مرفوع", "منصوب", "مجرور"}
    assert found["والله"][0]["lemma"] == "الله" and found["والله"][0]["score"] == 1.0


def test_scores_are_sorted(found):
    for rows in found.values():
        scores = [r["score"] for r in rows]
        assert scores == sorted(scores, reverse=True)
        for r in rows:
            inner = [i["score"] for i in r["inflections"]]
            assert inner == sorted(inner, reverse=True) and r["score"] == inner[0]


@pytest.mark.parametrize("name", ["normalize_word", "strip_case_ending", "tokenize_sentences", "clitic_candidates", "segment_words", "exceptional_lookup", "parse_pos_label", "fill_root_pattern", "correct_hamza", "instantiate_pattern", "compatibility", "toolword_readings", "propernoun_readings", "start_scores"])
def test_queries_match_sql(spark, name):
    c = duckdb.connect()
    for t in ("orders", "conversations", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = Q.queries()[name](spark, SF)
    names = sorted(mine.columns)
    want = c.sql(Q.oracle_sql()[name]).to_arrow_table().select(names).to_pylist()
    rows = lambda x: sorted(repr([r[n] for n in names]) for r in x)
    assert want and rows(r.asDict() for r in mine.collect()) == rows(want)


def test_sinks(spark):
    df = spark.createDataFrame([("a", None, True), ('q"x', "b,c", False)], "x string, y string, z boolean")
    assert [r["value"] for r in sinks.raw_lines(df).collect()] == ["a\t\ttrue", 'q"x\tb,c\tfalse']
    assert [r["value"] for r in sinks.csv_lines(df).collect()] == ["a,,true", '"q""x","b,c",false']
    assert sinks.table(df).splitlines()[1] == "---  ---  -----"
