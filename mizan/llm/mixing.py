"""Mixing sources to target weights by pivotal rounding.

Each document of a source may be taken ``rate = target / source size`` times,
at most 3. The whole part is certain; the fractional parts are rounded by the
pivotal method: of two documents with fractions, one passes word mass to the
other, in a random direction, until a fraction is 0 or 1. The expected copies
of each document stay at its rate, and the words that a source gives stay the
same up to the last, single fraction. Groups of rows are reduced in parallel;
what is left of each (one row) meets in the next level of a reduction tree.

Randomness comes from hashes of source, doc_id, text and a seed, and rows equal
in these three are interchangeable, so reruns agree, in whatever order the rows
come.

Defined results: null texts count as empty, and empty ones take nothing; a
null source is a source, the last one; a source without words has target 0;
repeated doc_ids are rounded as rows of their own; rows equal in source, doc_id
and text are counted first and numbered then; an empty table gives an empty
result; further input columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import documents, maybe_broadcast, scoped, slots, text_or_empty, word_count, written

#: Weights of the sources in code-point order, repeating, and the most copies.
WEIGHTS, MOST = (5, 2, 1), 3
#: Rows that one task reduces, and residuals that meet in one node of the tree.
GROUP_ROWS, FAN_IN = 2048, 64
#: Equal rows that are numbered at once.
RUN = 4096

_PAIR = "source string, doc_id long, mark long, nth long, size long, low long, p double, node long, top boolean"
_SAME = ["source", "doc_id", "mark"]


def targets(sizes: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Share all words by weight; what exceeds a source's limit goes to the
    others by weight, until none is above. One entry for each source."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(order)}
    limit = {s: MOST * n for s, n in order}
    open_, out, left = [s for s, _ in order], {}, sum(n for _, n in order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > limit[s]]
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            out[s] = float(limit[s])
            left -= limit[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _draw(seed: str) -> float:
    return int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=7).digest(), "big") / 2**56


def _resolve_large(rows: list[list], seed: str) -> None:
    """Round documents far larger than the usual one against all smaller ones
    together, which share the transfer evenly: a lone small document could not
    take it, and the large one would be left for the end."""
    usual = sorted(r[0] for r in rows)[len(rows) // 2] if rows else 0
    below, low, high, words = [], 2.0, -1.0, 0
    for row in reversed(rows):
        below.append((low, high, words))
        if 0 < row[1] < 1:
            low, high, words = min(low, row[1]), max(high, row[1]), words + row[0]
    shift = 0.0
    for row, (low, high, words) in zip(rows, reversed(below)):
        if not 0 < row[1] < 1:
            continue
        row[1] += shift
        if row[0] <= 4 * usual or not words:
            continue
        give, get = (1 - row[1]) * row[0] / words, row[1] * row[0] / words
        if low + shift - give <= 0.02 or high + shift + get >= 0.98:
            continue
        up = _draw(f"{seed}|{row[2]}") < row[1]
        shift += -give if up else get
        row[1] = 1.0 if up else 0.0


def pivot(rows: list[list], seed: str) -> None:
    """Round fractions ``row[1]`` (of sizes ``row[0]``, the largest first) in
    place, but for one at most, keeping the sum of size times fraction."""
    for row in rows:
        if not 1e-9 < row[1] < 1 - 1e-9:
            row[1] = float(round(row[1]))
    _resolve_large(rows, seed)
    held = None
    for row in rows:
        if not 0 < row[1] < 1:
            continue
        if held is None:
            held = row
            continue
        a, b = held, row
        # Words that can pass from b to a, and from a to b.
        up = min((1 - a[1]) * a[0], b[1] * b[0])
        down = min(a[1] * a[0], (1 - b[1]) * b[0])
        moved = up if _draw(f"{seed}|{a[2]}|{b[2]}") * (up + down) < down else -down
        a[1] += moved / a[0]
        b[1] -= moved / b[0]
        for x in (a, b):
            if x[1] < 1e-9 or x[1] > 1 - 1e-9:
                x[1] = float(round(x[1]))
        loose = [x for x in (a, b) if 0 < x[1] < 1]
        held = loose[0] if loose else None


def _reduce(pdf: pd.DataFrame) -> pd.DataFrame:
    # Large documents first: the last fraction is then a small one's.
    pdf = pdf.sort_values(["size", "doc_id", "mark", "nth"], ascending=[False, True, True, True], kind="stable", na_position="last")
    rows = [[s, p, f"{o}/{d}/{m}/{n}"] for o, s, p, d, m, n in zip(*(pdf[c] for c in ("source", "size", "p", "doc_id", "mark", "nth")))]
    pivot(rows, "mix")
    p = [r[1] for r in rows]
    if bool(pdf["top"].iloc[0]):
        p = [float(_draw(f"last|{r[2]}") < r[1]) if 0 < r[1] < 1 else r[1] for r in rows]
    return pdf.assign(p=p)


def _numbered(d: DataFrame) -> DataFrame:
    """A row for each document again, with its number ``nth`` among equal ones.
    ``d`` has each different document once and how many are equal, ``n``; a
    large group is dealt out in runs before it is unfolded."""
    runs = d.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    if (d.agg(F.max("n")).first()[0] or 0) > RUN:
        runs = runs.repartition("doc_id", "mark", "_run")
    first = F.col("_run") * RUN
    return runs.withColumn("nth", F.explode(F.sequence(first, F.least(first + RUN, F.col("n")) - 1))).drop("_run", "n")


@scoped
def rounded(docs: DataFrame) -> DataFrame:
    """source, doc_id, mark (a hash of the text), nth, size, source_size, target,
    copies and taken of each row."""
    d = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("mark"), word_count(text_or_empty()).alias("size"))
    # Equal rows merge before the shuffle.
    d = written(d.groupBy(*_SAME, "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # One row for each source; sources are names, not documents.
    by_source = {r["source"]: (r["size"], r["n"]) for r in d.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).collect()}
    if not by_source:
        return d.select(*_SAME, F.col("n").alias("nth"), "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("int").alias("copies"), F.lit(0).cast("long").alias("taken"))
    spark = docs.sparkSession
    goal = targets([(s, n) for s, (n, _) in by_source.items()])
    groups = {s: max(1, -(-n // GROUP_ROWS)) for s, (_, n) in by_source.items()}
    table = spark.createDataFrame(
        [(s, n, goal[s], groups[s]) for s, (n, _) in by_source.items()],
        "s string, source_size long, target double, groups long",
    )
    rows = _numbered(d).join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    rows = rows.withColumns({"low": whole.cast("long"), "p": F.when(F.col("size") > 0, F.greatest(rate - whole, F.lit(0.0))).otherwise(0.0)})
    rows = rows.withColumn("node", F.pmod(F.xxhash64(*_SAME, "nth"), F.col("groups")))
    level = rows.select(*_SAME, "nth", "size", "low", "p", "node", (F.col("groups") == 1).alias("top"))
    done, height = [], max(groups.values())
    while True:
        level = written(level.groupBy("source", "node").applyInPandas(_reduce, _PAIR), "pivots")
        loose = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(level.where(~loose))
        if height <= 1:
            break
        height = -(-height // FAN_IN)
        level = level.where(loose).withColumns({"node": F.floor(F.col("node") / FAN_IN).cast("long"), "top": F.lit(height <= 1)})
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.join(table, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", (F.col("low") + F.col("p")).cast("int"))
    return out.select(*_SAME, "nth", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """Per document: size, its source's size and target, copies and words taken."""
    return rounded(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


def take(docs: DataFrame) -> DataFrame:
    """The documents, each as many times as the mix takes it."""
    counts = rounded(docs).where("copies > 0").select(*[F.col(c).alias(f"_{c}") for c in (*_SAME, "nth", "copies")])
    own = [F.col("source").cast("string").alias("_s"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64(text_or_empty()).alias("_m")]
    rows = docs.select("*", *own)
    several = written(rows.groupBy("_s", "_d", "_m").count().where("count > 1").select(F.col("_s").alias("_s2"), F.col("_d").alias("_d2"), F.col("_m").alias("_m2")), "several")
    if several.isEmpty():
        rows = rows.withColumn("_i", F.lit(0).cast("long"))
    else:
        # Numbered without bringing a group of equal rows into one task.
        same = F.col("_s").eqNullSafe(F.col("_s2")) & F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_m") == F.col("_m2"))
        several = maybe_broadcast(several)
        alone = rows.join(several, same, "left_anti").withColumn("_i", F.lit(0).cast("long"))
        equal = rows.join(several, same, "left_semi").withColumns({"_g": F.xxhash64("_s", "_d", "_m"), "_row": F.monotonically_increasing_id()})
        rows = alone.unionByName(slots(equal, "_g", "_row", docs.count(), "_i").drop("_g", "_row"))
    counts = maybe_broadcast(written(counts, "copies"))
    on = F.col("_s").eqNullSafe(F.col("_source")) & F.col("_d").eqNullSafe(F.col("_doc_id")) & (F.col("_m") == F.col("_mark")) & (F.col("_i") == F.col("_nth"))
    return rows.join(counts, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
