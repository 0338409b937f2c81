"""Byte-pair encoding and decoding with a frequent-word transducer.

Pieces of text (words with their leading space) are counted over all
documents. The most frequent ones are encoded once and compiled into a minimal
acyclic automaton: words share prefixes and suffixes, and each path numbers its
word, which leads to its ids. The automaton, the ids and the merge table form
one file that Spark hands to every executor, where it is memory-mapped. Pieces
that it lacks are merged exactly, pair by pair in rank order.

Defined results: a null text counts as empty and gives no ids; the text of a
special token becomes its id; texts of any length are encoded whole; repeated rows give repeated results; an empty table gives
an empty result; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import documents, text_or_empty, written
from mizan.llm.textkit import CACHES, chunks, released

#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most pieces in the automaton, and remembered by a worker.
LEXICON, REMEMBERED = 65536, 400_000
#: Bytes of text that are cut into pieces at once; a longer text is taken alone.
CUT = 1 << 20
#: What the pattern tells apart: other characters, letters, digits, white space.
_OTHER, _LETTER, _DIGIT, _SPACE, _UNSEEN = range(5)
_KIND = np.full(0x110000, _UNSEEN, np.uint8)
#: A lone blank between others than white space, before which a piece always begins.
_SAFE = regex.compile(rb"(?:[!-~]|[\xc3-\xdf][\x80-\xbf]|[\xe4-\xef][\x80-\xbf]{2}) [!-~\xc3-\xdf\xe4-\xf4]")
#: Letters of the contractions, after the apostrophe.
_SHORT = {b"s": 1, b"t": 1, b"m": 1, b"d": 1, b"re": 2, b"ve": 2, b"ll": 2}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in kept else chr(next(spare)) for b in range(256)}


class Vocabulary:
    """Merges, tokens and special tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        back = {c: b for b, c in letters.items()}
        ids = spec["model"]["vocab"]
        self.byte_id = [ids[letters[b]] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.token = [b""] * size
        for text, i in ids.items():
            self.token[i] = bytes(back[c] for c in text)
        for text, i in self.special.items():
            self.token[i] = text.encode()


def merge(piece: bytes, byte_id: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Join the adjacent pair of lowest rank, leftmost first, until none is left."""
    out = [byte_id[b] for b in piece]
    if len(out) > 400:
        return _merge_long(out, ranks)
    none = (1 << 60, 0)
    costs = [ranks.get(p, none) for p in zip(out, out[1:])]
    while costs:
        best = min(costs)
        if best is none or best[0] == none[0]:
            break
        i = costs.index(best)
        out[i : i + 2] = [best[1]]
        del costs[i]
        if i:
            costs[i - 1] = ranks.get((out[i - 1], out[i]), none)
        if i < len(costs):
            costs[i] = ranks.get((out[i], out[i + 1]), none)
    return out


def _merge_long(out: list[int], ranks) -> list[int]:
    """The same for long pieces, with a heap."""
    import heapq

    n = len(out)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[p][0], i, p) for i, p in enumerate(zip(out, out[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or (out[i], out[j]) != pair:
            continue
        out[i] = ranks[pair][1]
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for a in (prv[i], i):
            if a >= 0 and (b := nxt[a]) < n and (p := (out[a], out[b])) in ranks:
                heapq.heappush(heap, (ranks[p][0], a, p))
    return [t for t, ok in zip(out, alive) if ok]


def _kinds(codes: np.ndarray) -> np.ndarray:
    """The kind of each character; one not met before is asked of ``regex``."""
    kind = _KIND.take(codes)
    for c in np.unique(codes[kind == _UNSEEN]).tolist():
        _KIND[c] = next((k for k, p in ((_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_SPACE, r"\s")) if regex.match(p, chr(c))), _OTHER)
    return _KIND.take(codes) if (kind == _UNSEEN).any() else kind


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where in the UTF-8 bytes of texts the pieces of PATTERN begin, with the
    end behind. No piece goes over the edge of a text.

    A piece is a run of one kind, to which a blank before it belongs. Of other
    white space before a run, the last character is a piece of its own. An
    apostrophe that is such a piece takes the letters of a contraction."""
    if len(data) > 4 * CUT:
        # A long text goes by parts, so that little is held at once.
        held = memoryview(np.ascontiguousarray(data))
        cuts = [0, *(m.start() + len(m[0]) - 2 for i in range(CUT, len(data) - CUT, CUT) if (m := _SAFE.search(held, i, i + CUT - 8))), len(data)]
        parts = [cut_pieces(data[a:b], np.clip(offsets, a, b) - a)[:-1] + a for a, b in zip(cuts, cuts[1:]) if b - a <= 4 * CUT]
        if len(parts) == len(cuts) - 1:
            return np.append(np.concatenate(parts), len(data))
    wide = None
    if len(data) and data.max() > 127:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        wide = np.append(lead, len(data))
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        offsets = np.searchsorted(lead, offsets)
    else:
        codes = data
    n = len(codes)
    kind = _kinds(codes)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge = edge[:-1]
    # Runs of one kind within a text.
    run = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= edge
    start = run.copy()
    # The last of white space before a run in the same text.
    at = np.flatnonzero(run[1:] & ~edge[1:] & (kind[:-1] == _SPACE))
    start[at] = True
    blank = codes.take(at) == 32
    start[at[blank] + 1] = False
    # Contractions: an apostrophe alone, and letters after it.
    at = np.flatnonzero(start[:-1] & (codes[:-1] == 39) & (kind[1:] == _LETTER) & ~edge[1:])
    if len(at):
        second = codes.take(at + 1)
        third = np.where(at + 2 < n, codes.take(np.minimum(at + 2, n - 1)), 0)
        third[edge.take(np.minimum(at + 2, n - 1))] = 0
        for letters, size in _SHORT.items():
            held = (second == letters[0]) & ((third == letters[-1]) if size == 2 else True)
            some = at[held]
            start[some + 1] = False
            after = some + 1 + size
            start[after[after < n]] = True
    found = np.append(np.flatnonzero(start), n)
    return found if wide is None else wide.take(found)


def _strings(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(data)])


def _content(found: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a large binary array."""
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    return offsets, memoryview(found.buffers()[2] or b"")


class _State:
    __slots__ = ("final", "out", "count", "key")

    def __init__(self):
        self.final, self.out, self.count, self.key = False, {}, 0, None


def _automaton(words: list[bytes]) -> tuple[list[_State], _State]:
    """A minimal automaton of sorted, different words: after each word, the
    part of the last path that the next one leaves is merged into equal states."""
    root, register, order = _State(), {}, []
    path: list[tuple[_State, int, _State]] = []

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            key = (child.final, tuple((c, id(s)) for c, s in child.out.items()))
            if key in register:
                parent.out[label] = register[key]
            else:
                child.count = child.final + sum(s.count for s in child.out.values())
                register[key] = child
                order.append(child)

    last = b""
    for word in words:
        shared = len(os.path.commonprefix([last, word]))
        settle(shared)
        at = path[-1][2] if path else root
        for label in word[shared:]:
            new = _State()
            at.out[label] = new
            path.append((at, label, new))
            at = new
        at.final = True
        last = word
    settle(0)
    order.append(root)
    return order, root


_HEAD = struct.Struct("<8I")


def compile_file(path: str, vocabulary: Vocabulary, words: Iterable[bytes]) -> None:
    """Write the automaton, its words' ids and the vocabulary as one file."""
    ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(vocabulary.merges)}
    words = sorted(set(words) - {b""})
    states, root = _automaton(words)
    number = {id(s): i for i, s in enumerate(states)}
    first, final, labels, goto, before = [0], [], [], [], []
    for s in states:
        seen = int(s.final)
        for label, to in sorted(s.out.items()):
            labels.append(label)
            goto.append(number[id(to)])
            before.append(seen)
            seen += to.count
        first.append(len(labels))
        final.append(s.final)
    coded = [merge(w, vocabulary.byte_id, ranks) for w in words]
    ends = np.cumsum([0, *map(len, coded)], dtype="<u4")
    tokens = vocabulary.token
    token_ends = np.cumsum([0, *map(len, tokens)], dtype="<u4")
    special = json.dumps(vocabulary.special).encode()
    u4 = lambda x: np.asarray(x, dtype="<u4").tobytes()
    parts = [
        u4(first), u4(goto), u4(before), ends.tobytes(), u4([i for c in coded for i in c]),
        u4(vocabulary.byte_id), u4([x for m in vocabulary.merges for x in m]), token_ends.tobytes(),
        bytes(map(int, final)), bytes(labels), b"".join(tokens), special,
    ]
    with open(path, "wb") as f:
        f.write(_HEAD.pack(len(parts), len(states), len(labels), len(words), int(ends[-1]), len(vocabulary.merges), len(tokens), number[id(root)]))
        f.write(u4([len(p) for p in parts]))
        for p in parts:
            f.write(p)


class Coder:
    """Encoder and decoder over a memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, _, _, _, _, _, _, self.root = _HEAD.unpack_from(self.map)
        view, at = memoryview(self.map), _HEAD.size + 4 * n
        parts = []
        for size in memoryview(view[_HEAD.size : at]).cast("I"):
            parts.append(view[at : at + size])
            at += size
        self.first, self.goto, self.before, self.ends, self.ids, byte_id, merges, token_ends = (p.cast("I") for p in parts[:8])
        self.final, self.labels = parts[8], bytes(parts[9])
        self.byte_id = list(byte_id)
        m = list(merges)
        self.ranks = {(m[i], m[i + 1]): (i // 3, m[i + 2]) for i in range(0, len(m), 3)}
        joined, ends = bytes(parts[10]), list(token_ends)
        self.token = [joined[a:b] for a, b in zip(ends, ends[1:])]
        self.special = json.loads(bytes(parts[11]))
        self.split_special = regex.compile(b"|".join(map(regex.escape, sorted((s.encode() for s in self.special), key=len, reverse=True)))) if self.special else None
        self.bytes = pa.array(self.token, pa.large_binary())
        self.known: dict[bytes, bytes] = {}

    def lookup(self, word: bytes) -> list[int] | None:
        """Ids of a word of the automaton, by walking it."""
        at, index = self.root, 0
        first, labels = self.first, self.labels
        for byte in word:
            k = labels.find(byte, first[at], first[at + 1])
            if k < 0:
                return None
            index += self.before[k]
            at = self.goto[k]
        return self.ids[self.ends[index] : self.ends[index + 1]].tolist() if self.final[at] else None

    def _learn(self, piece: bytes) -> bytes:
        ids = self.lookup(piece)
        if ids is None:
            ids = merge(piece, self.byte_id, self.ranks)
        coded = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(piece) < 100:
            self.known[piece] = coded
        return coded

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """Ids of texts without special tokens, and where each text's begin:
        every different piece is looked up once."""
        edges = cut_pieces(data, offsets)
        if len(edges) < 2:
            return np.zeros(len(offsets), np.int64), memoryview(b"")
        pieces = _strings(data, edges).dictionary_encode()
        known, learn = self.known, self._learn
        coded = pa.array([known.get(p) or learn(p) for p in pieces.dictionary.to_pylist()], pa.large_binary())
        ends, ids = _content(coded.take(pieces.indices))
        return ends.take(np.searchsorted(edges, offsets)), ids

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, memoryview]]:
        """For runs of texts, their ids as little-endian unsigned 32-bit
        integers, and at which byte those of each text begin."""
        for _, data, offsets in chunks(texts, CUT):
            if not (self.split_special and self.split_special.search(held := data.tobytes())):
                yield self._plain(data, offsets)
                continue
            # Special tokens are parts of their own, and have one id each.
            special = {m.start(): m for a, b in zip(offsets.tolist(), offsets[1:].tolist()) for m in self.split_special.finditer(held, a, b)}
            parts = np.unique(np.concatenate([offsets, *(m.span() for m in special.values())]))
            begin, ids = self._plain(data, parts)
            runs = [struct.pack("<I", self.special[special[p][0].decode()]) if p in special else ids[a:b] for p, a, b in zip(parts.tolist(), begin.tolist(), begin[1:].tolist())]
            begin = np.append(0, np.cumsum(list(map(len, runs)), dtype=np.int64))
            yield begin[np.searchsorted(parts, offsets)], memoryview(b"".join(runs))

    def encode(self, text: str) -> Iterator[bytes]:
        """Runs of ids as little-endian unsigned 32-bit integers."""
        for _, ids in self.encode_all(pa.array([text], pa.large_string())):
            yield bytes(ids)

    def decode_bytes(self, ids: bytes) -> bytes:
        return bytes(_content(self.bytes.take(pa.array(np.frombuffer(ids, "<u4"))))[1])

    def digests_all(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, hash of the ids, hash of what they
        decode to."""
        for begin, ids in self.encode_all(texts):
            ends, decoded = _content(self.bytes.take(pa.array(np.frombuffer(ids, "<u4"))))
            places, begin = ends.take(begin // 4).tolist(), begin.tolist()
            for a, b, c, d in zip(begin, begin[1:], places, places[1:]):
                back = bytes(decoded[c:d]).decode("utf-8", "replace").encode()
                yield (b - a) // 4, hashlib.sha256(ids[a:b]).hexdigest(), hashlib.sha256(back).hexdigest()

    def digests(self, text: str) -> tuple[int, str, str]:
        return next(self.digests_all(pa.array([text], pa.large_string())))


_CODERS: dict[str, Coder] = {}
CACHES[__name__] = _CODERS.clear


def coder(name: str) -> Coder:
    """One coder for each file and worker process."""
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(SparkFiles.get(name))
    return _CODERS[name]


@released
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, many = [], 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("piece", use_threads=False).aggregate([("n", "sum")]).rename_columns(["piece", "n"])

    def out(counts: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from counts.select(["piece", "n"]).cast(pa.schema([("piece", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=100_000)

    for batch in batches:
        for _, data, offsets in chunks(batch.column(0), CUT):
            found = _strings(data, cut_pieces(data, offsets)).value_counts()
            held.append(pa.table({"piece": found.field(0).cast(pa.large_string()), "n": found.field(1)}))
            many += len(found)
        if many > REMEMBERED:
            held = [merged()]
            many = held[0].num_rows
            if 2 * many > REMEMBERED:
                yield from out(held[0])
                held, many = [], 0
    if held:
        yield from out(merged())


def frequent_pieces(docs: DataFrame, most: int = LEXICON) -> list[str]:
    """The pieces that occur most, counted over all whole texts; ties by the
    piece itself. ``most`` bounds what reaches the driver."""
    partial = docs.select(text_or_empty().alias("text")).mapInArrow(_count, "piece string, n long")
    counts = partial.where(F.length("piece") < 100).groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
    counts = written(counts.withColumn("size", F.floor(F.log2("n") * 16).cast("int")), "pieces")
    # A histogram of at most 1024 sizes tells where the most frequent begin, so
    # that little more than those is sorted.
    least, held = 0, 0
    for size, n in sorted(((r["size"], r["count"]) for r in counts.groupBy("size").count().collect()), reverse=True):
        least, held = size, held + n
        if held >= most:
            break
    top = counts.where(F.col("size") >= least).orderBy(F.desc("n"), "piece").limit(most)
    return [r["piece"] for r in top.collect()]


def build(docs: DataFrame, vocabulary: str | None = None, most: int = LEXICON) -> str:
    """Compile the frequent pieces of ``docs`` and hand the file to all
    executors, also those that start later; its name there."""
    words = [p.encode() for p in frequent_pieces(docs, most)]
    handle, path = tempfile.mkstemp(suffix=".fst")
    os.close(handle)
    compile_file(path, Vocabulary(vocabulary or default_vocabulary()), words)
    with open(path, "rb") as f:
        name = f"mizan-{hashlib.sha256(f.read()).hexdigest()[:24]}.fst"
    final = os.path.join(os.path.dirname(os.path.realpath(path)), name)
    os.replace(path, final)
    docs.sparkSession.sparkContext.addFile(final)
    return name


def encode_digests(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = coder(name).digests_all
        for batch in batches:
            n, a, b = zip(*digests(batch.column(1))) if batch.num_rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, name: str) -> DataFrame:
    """doc_id and the ids of each whole text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(name)
        for batch in batches:
            ids = [np.frombuffer(run[a:b], "<u4").astype(np.int32) for begin, run in c.encode_all(batch.column(1)) for a, b in zip(begin, begin[1:])]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def encode_rows(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, source, n_tokens and the ids of each row as little-endian
    unsigned 32-bit integers, with the hash of what they decode to."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(name)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = [bytes(run[a:b]) for begin, run in c.encode_all(part.column(2)) for a, b in zip(begin, begin[1:])]
                back = [hashlib.sha256(c.decode_bytes(x).decode("utf-8", "replace").encode()).hexdigest() for x in ids]
                yield pa.record_batch([part.column(0), part.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, ids binary, decoded_sha256 string")


def decode(encoded: DataFrame, name: str) -> DataFrame:
    """doc_id and the text that the ids stand for; null ids give empty texts."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = coder(name).token
        for batch in batches:
            texts = [b"".join(map(token.__getitem__, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return encode_digests(docs, build(docs))
