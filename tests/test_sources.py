"""The lexicon loader, the model reader, exports and the command line."""

import csv
import io
import json
from dataclasses import fields

import pytest

import mizan
from mizan import cli, schemas
from mizan.sources import demo, language_model
from mizan.sources.lexicon import Lexicon, MissingTable, read_map


@pytest.fixture(scope="module")
def gz(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lexicon"))
    demo.write(folder)
    return folder, Lexicon.build(spark, folder, f"{folder}/built")


def test_files_give_the_tables_of_the_records(spark, gz):
    mine = cli.demo_lexicon(spark)
    for f in fields(Lexicon):
        rows = [sorted(map(repr, getattr(x, f.name).collect())) for x in (gz[1], mine)]
        assert rows[0] == rows[1] and rows[0], f.name
    manifest = {r["name"]: r for r in Lexicon.manifest(spark, f"{gz[0]}/built").collect()}
    assert set(manifest) == {f.name for f in fields(Lexicon)} and all(r["rows"] > 0 and r["bytes"] > 0 for r in manifest.values())


def test_maps_and_missing_tables(spark):
    rows = {"m": [{"key": "a", "value": 1}, {"key": "b", "value": 2}, {"key": "a", "value": 3}]}
    assert sorted(map(tuple, read_map(spark, rows, "m", "int").collect())) == [("a", 3), ("b", 2)]
    with pytest.raises(MissingTable):
        read_map(spark, "/nowhere", "m", "int")


def test_model_keeps_the_last_entry(spark):
    lines = ["S1 01 k 4", "S0 100", "S1 01 b 7", "S0 200", "S1 01 k 5", "B 021 kt 4 011 k 2 011 b 1 ", "B 021 kt 8 011 k 4 011 k 6 ", "A 011 k 8 011 b 4 "]
    start, emission, transition = language_model.from_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))
    assert {r["lemma"]: (r["total"], r["freq"]) for r in start.collect()} == {"ب": (100.0, 7.0), "ك": (200.0, 5.0)}
    assert {(r["unv"], r["lemma"]): r["p"] for r in emission.collect()} == {("كت", "ك"): 0.75, ("كت", "ب"): 0.25}
    assert [tuple(r) for r in transition.collect()] == [("ك", "ب", 0.5)]


def test_exports():
    assert set(mizan.__all__) <= set(dir(mizan)) | set(mizan._LATER) and callable(mizan.analyze_text) and callable(mizan.lemmatize)
    with pytest.raises(AttributeError):
        _ = mizan.nothing


def run(spark, capsys, *argv):
    assert cli.main(list(argv), spark) == 0
    return capsys.readouterr().out


def test_analyze_formats(spark, capsys):
    raw = run(spark, capsys, "analyze", "الكتاب", "zzz").splitlines()
    assert raw and all(len(x.split("\t")) == len(schemas.ANALYZE_COLUMNS) and x.split("\t")[0] == "الكتاب" for x in raw)
    assert run(spark, capsys, "analyze", "zzz") == ""
    rows = list(csv.reader(io.StringIO(run(spark, capsys, "analyze", "عندليب", "-i", "-f", "csv"))))
    assert tuple(rows[0]) == schemas.INFLECTED_COLUMNS and len(rows) == 6
    assert {r[rows[0].index("case")] for r in rows[1:]} == {"مرفوع", "منصوب", "مجرور"}
    lines = run(spark, capsys, "analyze", "كتاب", "--format", "table").splitlines()
    assert lines[0].split()[0] == "word" and set(lines[1]) <= {"-", " "} and len(lines) > 2


def test_analyze_json_in_order(spark, capsys):
    found = [json.loads(x) for x in run(spark, capsys, "analyze", "كتاب", "zzz", "إلى", "--json").splitlines()]
    assert [x["word"] for x in found] == ["كتاب", "zzz", "إلى"] and found[1]["analyses"] == []
    first = found[0]["analyses"][0]
    assert first["pos"] == "اسم" and isinstance(first["score"], float) and "case" not in first
    assert set(first["inflections"][0]) == {"diacritized", "case", "mood", "state", "score"}
    each = json.loads(run(spark, capsys, "analyze", "عندليب", "-i", "--json"))["analyses"]
    assert len(each) == 5 and all("inflections" not in a and a["inflected"] and a["case"] for a in each)


def test_text(spark, capsys, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO("ذهب الولد إلى zzz"))
    found = [json.loads(x) for x in run(spark, capsys, "text", "-f", "json").splitlines()]
    assert [x["token"] for x in found] == ["ذهب", "الولد", "إلى"]
    assert all(x["analyzed"] and x["lemma"] and x["stem"] for x in found) and found[0]["root"] == "ذهب" and found[2]["root"] is None
    rows = list(csv.reader(io.StringIO(run(spark, capsys, "text", "ذهب", "-f", "csv"))))
    assert tuple(rows[0]) == schemas.TEXT_COLUMNS and rows[1][0] == "ذهب"


@pytest.mark.parametrize("argv", [[], ["analyze", "x", "--json", "--format", "csv"]])
def test_wrong_arguments(argv):
    with pytest.raises(SystemExit) as e:
        cli.main(argv)
    assert e.value.code != 0
