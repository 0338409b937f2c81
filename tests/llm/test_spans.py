"""Span removal against brute force."""

import random
import re

import pyarrow as pa
import pytest

from mizan.llm import spans

#: Hash of each text, which orders rows of one doc_id.
MARKS: dict = {}


def brute(rows, least):
    """The text of each row after removal, with the operator's own clauses but
    runs compared as words, over sorted places."""
    places, clauses, pieces = {}, {}, {}
    for doc, text in dict.fromkeys(rows):
        if not text:
            continue
        (_, data, offsets, start, bounds, first, full, h), = spans._layout(pa.array([text]))
        raw, edges = data.tobytes(), [*first.tolist(), len(h)]
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        m = len(first)
        cuts = [*start[first].tolist(), len(raw)] if m else [len(raw)]
        pieces[doc, text] = raw[: cuts[0]], [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        runs = set()
        for i in range(m):
            if edges[i + 1] - edges[i] >= spans.ALONE:
                runs.add((i, i + 1))
            js = [j for j in range(i + 2, m + 1) if edges[j] - edges[i] >= spans.MIN_WORDS]
            runs |= {(i, js[0])} if js else set()
        for j in range(2, m + 1):
            js = [i for i in range(j - 1) if edges[j] - edges[i] >= spans.MIN_WORDS]
            runs |= {(js[-1], j)} if js else set()
        if least < spans.MIN_WORDS:
            begins = [i for i in range(m) if full[i]] + [m]
            runs |= {(a, b) for a, b in zip(begins, begins[spans.SEVERAL :]) if edges[b] - edges[a] >= least}
        clauses[doc, text] = set()
        for a, b in runs:
            places.setdefault(tuple(words[edges[a] : edges[b]]), []).append((doc is not None, doc or 0, a, b, text))
    for found in places.values():
        if len(found) > 1:
            first = min(found, key=lambda x: (x[0], x[1], MARKS[x[4]], x[2]))
            for x in found:
                if x != first:
                    clauses[x[1] if x[0] else None, x[4]] |= set(range(x[2], x[3]))
    return [(d, t if not t else (pieces[d, t][0] + b"".join(p for i, p in enumerate(pieces[d, t][1]) if i not in clauses[d, t])).decode()) for d, t in rows]


@pytest.mark.parametrize("least", [0, spans.MIN_WORDS])
def test_equals_brute_force(spark, least):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    make = lambda n: " ".join(word() + rng.choice(["", "", "", "", ".", ",", "!", "\n"]) for _ in range(n))
    short, long = "Ab c. De fg h! Ij.", make(60)
    rows = [(i, make(rng.randrange(40)) + rng.choice([" ", "\n"]) + rng.choice([short, long, long[30:], ""]) + " " + make(rng.randrange(20))) for i in range(60)]
    rows += [(70, rows[3][1]), (70, rows[3][1]), (71, None), (72, ""), (73, " \n "), (None, rows[5][1]), (None, rows[5][1]), (74, "x. x. x. x. x."), (75, make(3000)), (3, long + " tail here.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    MARKS.update({r["text"]: r["m"] for r in df.selectExpr("text", "xxhash64(text) m").collect()})
    for parts in (1, 4):
        got = spans.remove_repeats(df.repartition(parts), least).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(brute(rows, least), key=str)


def test_three_short_sentences(spark):
    text = "One two three. Four five six seven. Eight nine ten eleven."
    df = spark.createDataFrame([(1, "Start here now. " + text), (2, text + " And more of it.")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeats(df, 0).collect()}
    assert got == {1: "Start here now. " + text, 2: "And more of it."}


def test_ids_that_name_one_text(spark):
    """Where no two texts share a doc_id their hashes do not travel."""
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice("abcde") + rng.choice("fghij") + rng.choice(["", "", ".", ","]) for _ in range(n))
    passage = make(70)
    rows = [((-1) ** i * i * 2**40, make(rng.randrange(30)) + " " + rng.choice([passage, passage[60:], ""]) + " " + make(9)) for i in range(40)]
    rows += [rows[3], (None, passage), (99, None), (98, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    MARKS.update({r["text"]: r["m"] for r in df.selectExpr("text", "xxhash64(text) m").collect()})
    assert {r["mark"] for r in spans.repeated(df).collect()} == {None}
    got = [(r["doc_id"], r["text"]) for r in spans.remove_repeats(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, spans.MIN_WORDS), key=str)


def test_runs_travel_in_few_bytes():
    """At most 22 bytes a run, even if each goes to a part of its own."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + rng.choice(["", "", "."]) for _ in range(200)) for _ in range(50)]
    batch = pa.record_batch([pa.array(range(10**12, 10**12 + 50)), pa.array([7] * 50), pa.array(texts)], ["doc_id", "mark", "text"])
    for parts in (1, 5000):
        packed = list(spans._emit(list(range(parts)), spans.MIN_WORDS, False)(iter([batch])))
        runs = [spans._unpacked(*row[1:]) for b in packed for row in zip(*(c.to_pylist() for c in b.columns))]
        n = sum(len(r[0]) for r in runs)
        assert n > 5000 and {int(d) for r in runs for d in r[2]} == set(range(10**12, 10**12 + 50))
        assert sum(len(x) for b in packed for c in b.columns[3:] for x in c.to_pylist()) <= 22 * n
