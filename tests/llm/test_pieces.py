"""Work on whole columns of text, against the same done text by text."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from mizan.llm import bpe


def test_bpe_pieces(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path, file = bpe.default_vocabulary(), str(tmp_path / "x.fst")
    ref = tokenizers.Tokenizer.from_file(path)
    bpe.compile_file(file, bpe.Vocabulary(path), [b" the", b"'s"])
    coder, find = bpe.Coder(file), regex.compile(bpe.PATTERN).findall
    rng = random.Random(5)
    letters = "stremvld'''' \t\n\r D’é½٠12²_中\U0001f600\x1c\x85　\xa0.!"
    for i in range(600):
        parts = [*letters[: 11 + 40 * (i % 2)], "<|endoftext|>"[: 13 * (i % 3)]]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(rng.randint(1, 8))]
        column = pa.array([*texts, None], pa.string()).slice(i % 2)
        ((_, data, offsets),) = bpe.chunks(column)
        edges = bpe.cut_pieces(data, offsets)
        assert [data[a:b].tobytes().decode() for a, b in zip(edges, edges[1:])] == [p for t in texts[i % 2 :] for p in find(t)]
        # Text by text: no piece and no special token goes over the edge of a text.
        got = [np.frombuffer(ids[a:b], "<u4").tolist() for begin, ids in coder.encode_all(column) for a, b in zip(begin, begin[1:])]
        assert got == [ref.encode(t, add_special_tokens=False).ids for t in [*texts[i % 2 :], ""]]
    # Every different piece of a column is looked up once.
    seen, learn = [], coder._learn
    coder._learn = lambda piece: seen.append(piece) or learn(piece)
    coder.known.clear()
    list(coder.digests_all(pa.array(["zq" + " zq" * 1000 + " " + "x" * 150] * 3, pa.string())))
    assert sorted(seen) == [b" " + b"x" * 150, b" zq", b"zq"]


def test_long_texts_go_by_parts(monkeypatch):
    monkeypatch.setattr(bpe, "CUT", 64)
    find, rng, sizes = regex.compile(bpe.PATTERN).findall, random.Random(7), []
    kinds = bpe._kinds
    monkeypatch.setattr(bpe, "_kinds", lambda codes: sizes.append(len(codes)) or kinds(codes))
    for letters in ("strem' '  \nاé中\xa0 .1", "ab' '"):
        for _ in range(60):
            text = "".join(rng.choice(letters) for _ in range(1500)) + rng.choice(["", "x" * 300, " " * 300])
            data = np.frombuffer(text.encode(), np.uint8)
            edges = bpe.cut_pieces(data, np.array([0, len(data)]))
            assert [data[a:b].tobytes().decode() for a, b in zip(edges, edges[1:])] == find(text)
    assert np.median(sizes) < 3 * 64
