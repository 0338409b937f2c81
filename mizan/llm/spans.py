"""Removal of repeated passages by sliding spans of sentences.

A sentence ends with a word that ends in a mark of STOPS, or at a line break.
Every run of SEVERAL consecutive sentences with at least ``least`` words is
hashed; longer runs consist of these. So that passages cut in mid-sentence are
found as well, sentences consist of clauses, whose runs are hashed, too: a
clause ends with a word that ends in a mark of MARKS, between equal words, or
after a word whose hash is the least of any WINDOW words in a row. So every
WINDOW words hold an end, with or without punctuation, and those farther than
WINDOW from the edges of a passage are the same in all its copies, wherever they
stand. From each clause on, and back from each, the shortest run of two or more
clauses with MIN_WORDS words is hashed, and so is each clause of ALONE words or
more. With these numbers any 51 words hold a run that all copies share; up to
2 * WINDOW - 1 words at each edge of a passage may stay. All hashes meet in one
join over all documents. The first place of a hash, by doc_id and position,
keeps its clauses; clauses that any other place covers are removed.

With ``least`` 0 all repeated runs of two sentences go, down to two words. The
registered query and the pipeline take MIN_WORDS, because shorter ones are stock
phrases and chance: of 16,000 documents of check_s, 2,828 lose something with
MIN_WORDS, and 6,387 with 0.

Runs are equal if 96 bits of two independent hashes of their words are, so that
even of 10 ** 12 runs two different ones agree with a chance of about 10 ** -5.

Only one place of a hash in each batch goes to the task that owns the hash; its
later ones there are not the first wherever the first may be, and are dealt out
by document. So a passage that a third of all rows share brings one entry for
each batch to its owner.

Defined results: null and empty texts stay as they are; rows equal in doc_id
and text are the same document and treated alike; a text whose sentences are
all repeated becomes empty, and its row stays; an empty table gives an empty
result; columns besides doc_id and text are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import documents, even_keys, maybe_broadcast, scoped, written
from mizan.llm.textkit import _power_tables, chunks, mix, narrow, released, widened, word_hashes, words

MIN_WORDS, ALONE, WINDOW, MARKS, STOPS, SEVERAL = 24, 40, 7, b".!?,;:", b".!?", 2
TASK_RUNS = 2_000_000
_U = np.uint64
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_STOP = np.zeros(256, bool)
_STOP[list(STOPS)] = True


def sentences(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that begin a clause, in order, over all texts, and
    which of them begin a sentence. ``bounds``: number of each text's first word."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    full, stop = _STOP[data[end - 1]], _MARK[data[end - 1]]
    if n >= WINDOW:
        at = np.arange(n - WINDOW + 1)
        text = np.searchsorted(bounds, np.arange(n), "right")
        least = at + WINDOW - 1 - np.lib.stride_tricks.sliding_window_view(mix(hashes)[::-1], WINDOW)[::-1].argmin(1)
        stop[least[text[at] == text[at + WINDOW - 1]]] = True
    full[:-1] |= lines[start[1:]] != lines[end[:-1]]
    stop |= full
    stop[:-1] |= hashes[1:] == hashes[:-1]
    begins = np.zeros((2, n + 1), bool)
    begins[:, 1:] = stop, full
    begins[:, bounds] = True
    first = np.flatnonzero(begins[0, :n])
    return first, begins[1, first]


def runs(first: np.ndarray, full: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, first clause and the clause after the last of each run."""
    m, n = len(first), len(hashes)
    if not m:
        return np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.append(first, n)
    i = np.arange(m)
    text_end = bounds[np.searchsorted(bounds, first, "right")]  # the word after the text
    j = np.maximum(i + 2, np.searchsorted(edges, first + MIN_WORDS, "left"))
    ok = (j <= m) & (edges[np.minimum(j, m)] <= text_end)
    alone = np.diff(edges) >= ALONE
    # SEVERAL sentences, wherever they begin.
    begin = np.flatnonzero(full)
    after = np.append(begin, [m] * SEVERAL)[SEVERAL : len(begin) + SEVERAL]
    several = (edges[after] <= text_end[begin]) & (edges[after] - edges[begin] >= least)
    several[len(begin) - SEVERAL + 1 :] = False  # too few after it
    # Backwards, from each end of a clause.
    k = np.arange(1, m + 1)
    from_ = np.minimum(k - 2, np.searchsorted(edges, edges[k] - MIN_WORDS, "right") - 1)
    text_begin = bounds[np.searchsorted(bounds, edges[k] - 1, "right") - 1]
    back = (from_ >= 0) & (edges[np.maximum(from_, 0)] >= text_begin)
    if least >= MIN_WORDS:
        several[:] = False  # the clauses' runs cover these
    a = np.concatenate([i[ok], from_[back], i[alone], begin[several]])
    b = np.concatenate([j[ok], k[back], i[alone] + 1, after[several]])
    a, b = np.divmod(np.unique(a * (m + 1) + b), m + 1)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(hashes * power[:n], out=total[1:])
    h = (total[edges[b]] - total[edges[a]]) * inverse[edges[a]]
    np.cumsum(mix(hashes) * power[:n], out=total[1:])
    other = (total[edges[b]] - total[edges[a]]) * inverse[edges[a]]
    return mix(h + (edges[b] - edges[a]).astype(_U)), (mix(other) >> _U(32)).astype(np.uint32), a, b


def _layout(texts: pa.Array) -> Iterator[tuple]:
    """For each chunk of texts: first row, offsets, word starts, each text's
    first word, clause starts, which of them begin a sentence, word hashes."""
    for row, data, offsets in chunks(texts):
        start, end, bounds = words(data, offsets)
        h = word_hashes(data, start, end, lower=False)
        yield row, data, offsets, start, bounds, *sentences(data, start, end, h, bounds), h


_NAMES = ["p", "least", "n_docs", "code", "other", "doc", "mark", "count", "a", "length", "later"]


def _emit(keys: list[int], least: int, marked: bool = True):
    """Packs each batch's runs by part. Not ``marked``: no two different
    documents have one doc_id, so their texts' hashes stay behind."""
    parts = len(keys)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            held = []
            for row, _, _, _, bounds, first, full, h in _layout(batch.column(2)):
                code, other, a, b = runs(first, full, h, bounds, least)
                text = np.searchsorted(bounds, first[a], "right") - 1 if len(a) else a
                begin = np.searchsorted(first, bounds[text], "left") if len(a) else a
                held.append((code, other, ids[row + text], marks[row + text], (a - begin).astype(np.int32), (b - begin).astype(np.int32)))
            if not held:
                continue
            columns = [np.concatenate(x) for x in zip(*held)]
            if not len(columns[0]):
                continue
            columns = _sorted(columns)
            columns = _taken(columns, ~_same(columns[:5]))
            later = _same(columns[:2])
            code, doc = columns[0], columns[2]
            part = (mix(np.where(later, doc.view(_U), code)) % _U(parts)).astype(np.int64)
            order = np.lexsort((columns[4], columns[3], doc, part))  # by document, for compression
            code, other, doc, mark, a, b, later, part = _taken([*columns, later, part], order)
            # A document is named once for each part, with how many runs follow.
            fresh = ~_same([part, doc, mark])
            first, at = np.flatnonzero(fresh), np.flatnonzero(~_same([part]))
            count = np.diff(np.append(first, len(part)))
            for s, e in zip(at, np.append(at[1:], len(part))):
                x, y = np.searchsorted(first, [s, e])
                least_doc, own = int(doc[s:e].min()), first[x:y]
                blobs = [code[s:e].tobytes(), other[s:e].tobytes(), narrow(doc[own].view(_U) - _U(least_doc % 2**64)), mark[own].tobytes() if marked else b"", narrow(count[x:y]), narrow(a[s:e]), narrow(b[s:e] - a[s:e]), np.packbits(later[s:e]).tobytes()]
                yield pa.record_batch([pa.array([keys[part[s]]], pa.int32()), pa.array([least_doc], pa.int64()), pa.array([y - x], pa.int32()), *(pa.array([z], pa.binary()) for z in blobs)], _NAMES)

    return run


def _taken(columns: list[np.ndarray], which: np.ndarray) -> list[np.ndarray]:
    return [x[which] for x in columns]


def _sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
    """By the hashes, document, hash of its text and position."""
    return _taken(columns, np.lexsort(columns[4::-1]))


def _same(columns: list[np.ndarray]) -> np.ndarray:
    """Which of the sorted rows equal the one before."""
    return np.concatenate([[False], np.logical_and.reduce([x[1:] == x[:-1] for x in columns])])


def _unpacked(least: int, n_docs: int, code: bytes, other: bytes, doc: bytes, mark: bytes, count: bytes, a: bytes, length: bytes, later: bytes) -> list[np.ndarray]:
    """The two hashes, document, hash of its text (0 if not sent), first clause,
    the clause after the last, and ``later`` of each run."""
    code, count = np.frombuffer(code, _U), widened(count, n_docs)
    n = len(code)
    doc = (widened(doc, n_docs).view(_U) + _U(least % 2**64)).view(np.int64)
    mark = np.frombuffer(mark, np.int64) if mark else np.zeros(n_docs, np.int64)
    a, length = widened(a, n).astype(np.int32), widened(length, n).astype(np.int32)
    return [code, np.frombuffer(other, np.uint32), np.repeat(doc, count), np.repeat(mark, count), a, a + length, np.unpackbits(np.frombuffer(later, np.uint8), count=n).astype(bool)]


@released
def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of runs that are not the first of their hash."""

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in columns[2:6]], ["doc_id", "mark", "a", "b"])

    by_part: dict[int, list] = {}
    for batch in batches:
        for p, *packed in zip(*(c.to_pylist() for c in batch.columns)):
            *columns, later = _unpacked(*packed)
            if later.any():
                yield out(_taken(columns, later))
            by_part.setdefault(p, []).append(_taken(columns, ~later))
    while by_part:
        _, parts = by_part.popitem()
        columns = _sorted([np.concatenate(x) for x in zip(*parts)])
        columns = _taken(columns, ~_same(columns[:5]))
        again = _same(columns[:2])
        if again.any():
            yield out(_taken(columns, again))


@scoped
def repeated(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, mark (a hash of the text; null if no two texts share a doc_id) and
    spans (struct of clause numbers a, b) of each document that has clauses to
    remove."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    size = docs.select(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 40 // TASK_RUNS + 1)
    # One row for each doc_id unless different texts share one.
    marked = not base.groupBy("doc_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").isEmpty()
    if not marked:
        base = base.withColumn("mark", F.lit(0).cast("long"))
    blobs = ", ".join(f"{x} binary" for x in _NAMES[3:])
    packed = base.mapInArrow(_emit(even_keys(spark, parts), least, marked), f"p int, least long, n_docs int, {blobs}")
    found = packed.repartition(parts, "p").mapInArrow(_repeats, "doc_id long, mark long, a int, b int")
    kind = "array<struct<a:int,b:int>>"

    def joined(done, x):
        """Overlapping spans as one; ``x`` begins no earlier than those done."""
        end = F.get(done, F.size(done) - 1)
        over = (F.size(done) > 0) & (x["a"] <= end["b"])
        grown = F.struct(end["a"].alias("a"), F.greatest(end["b"], x["b"]).alias("b"))
        return F.when(over, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    if not marked:
        found = found.withColumn("mark", F.lit(None).cast("long"))
    spans = found.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    return spans.withColumn("spans", F.aggregate("spans", F.array().cast(kind), joined))


@released
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the sentences that the spans cover."""
    for batch in batches:
        spans = batch.column(1).to_pylist()
        texts, total, gone, lost = [], [], [], []
        for row, data, offsets, start, bounds, first, _, _ in _layout(batch.column(0)):
            from_ = np.searchsorted(first, bounds)
            for t in range(len(offsets) - 1):
                mine = first[from_[t] : from_[t + 1]]
                total.append(len(mine))
                cover = np.zeros(len(mine), bool)
                for s in spans[row + t] or ():
                    cover[s["a"] : s["b"]] = True
                gone.append(int(cover.sum()))
                raw = data[offsets[t] : offsets[t + 1]]
                if not gone[-1]:
                    texts.append(raw.tobytes())
                    lost.append(0)
                    continue
                # A sentence reaches to the next one's first word; what stands
                # before the first word stays.
                edges = np.append(start[mine], offsets[t + 1]) - offsets[t]
                keep = [raw[: edges[0]].tobytes(), *(raw[edges[i] : edges[i + 1]].tobytes() for i in np.flatnonzero(~cover))]
                texts.append(b"".join(keep))
                sizes = np.diff(np.append(mine, bounds[t + 1]))
                lost.append(int(sizes[cover].sum()))
        text = pa.array(texts, pa.binary()).cast(pa.string())
        rest = batch.columns[2:]
        yield pa.record_batch([text, pa.array(total, pa.int32()), pa.array(gone, pa.int32()), pa.array(lost, pa.int64()), *rest], ["text", "n_sentences", "n_removed", "words_removed", *batch.schema.names[2:]])


def remove_repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The documents, with ``text`` cut, and n_sentences, n_removed and
    words_removed. A null text stays null."""
    spans = maybe_broadcast(repeated(docs, least))
    names = [c for c in docs.columns if c != "text"]
    plain = docs.select(F.col("text").cast("string").alias("_t"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    at = names.index("doc_id")
    keyed = plain.withColumns({"_k": F.coalesce(F.col(f"_c{at}").cast("long"), F.lit(-(2**63))), "_m": F.xxhash64("_t")})
    marked = keyed.join(spans, (keyed["_k"] == spans["doc_id"]) & (spans["mark"].isNull() | (keyed["_m"] == spans["mark"])), "left")
    rest = [f"_c{i}" for i in range(len(names))]
    marked = marked.select("_t", "spans", F.col("_t").isNull().alias("_null"), *rest)
    kinds = ", ".join(f"{c} {marked.schema[c].dataType.simpleString()}" for c in rest)
    cut = marked.mapInArrow(_cut, f"text string, n_sentences int, n_removed int, words_removed long, _null boolean, {kinds}")
    text = F.when(~F.col("_null"), F.col("text")).alias("text")
    order = {c: F.col(r).alias(c) for c, r in zip(names, rest)} | {"text": text}
    return cut.select(*[order[c] for c in docs.columns], *[c for c in ("n_sentences", "n_removed", "words_removed") if c not in docs.columns])


def op7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeats(docs)
