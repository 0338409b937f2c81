"""The lemma language model: counts in a length-prefixed text, as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.plans.tables import materialized
from mizan.sources.lexicon import CORPUS_COUNTS, read_map

_ROW = "n long, j int, kind string, head string, head_freq double, tag string, freq double"


@dataclass
class LanguageModel:
    """start(lemma, total, freq), emission(unv, lemma, p), transition(l1, l2,
    p), backoff(lemma, p), stem_freq(stem, n), root_freq(root, n)."""

    start: DataFrame
    emission: DataFrame
    transition: DataFrame
    backoff: DataFrame
    stem_freq: DataFrame
    root_freq: DataFrame


def fields(line: str) -> list[tuple[str, float]]:
    """(name, count) items of a line: two digits and one digit give the sizes
    of the name and the count that follow."""
    out, at = [], 2
    while at + 4 <= len(line):
        name, count = int(line[at : at + 2]), int(line[at + 2])
        middle = at + 4 + name
        out.append((line[at + 4 : middle], float(line[middle + 1 : middle + 1 + count])))
        at = middle + 2 + count
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for at, line in zip(batch["n"], batch["value"]):
            if line.startswith("S0"):
                rows.append((at, 0, "S0", "", float(line[3:]), "", 0.0))
            elif line.startswith("S1"):
                size = int(line[3:5])
                rows.append((at, 0, "S1", "", 0.0, line[6 : 6 + size], float(line[7 + size :])))
            elif line[:1] in ("A", "B"):
                (head, count), *items = fields(line)
                rows += [(at, j, line[0], head, count, tag, n) for j, (tag, n) in enumerate(items)]
        yield pd.DataFrame(rows, columns=["n", "j", "kind", "head", "head_freq", "tag", "freq"])


def from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """start, emission and transition tables from a column ``value`` of lines.
    Lines are taken in their order in the file: a start count has the total
    before it, and of entries with one key the last counts."""
    numbered = lines.withColumn("n", F.monotonically_increasing_id()).where("value <> ''").select("n", "value")
    rows = materialized(numbered.mapInPandas(_parse, _ROW), "model")
    # A model has one total, or a few.
    totals = rows.where("kind = 'S0'").select(F.col("n").alias("n0"), F.col("head_freq").alias("total"))
    first = rows.where("kind = 'S1'").select("n", T.to_arabic(F.col("tag")).alias("lemma"), "freq")
    first = first.join(F.broadcast(totals), F.col("n0") < F.col("n"), "left").groupBy("n", "lemma", "freq").agg(F.coalesce(F.max_by("total", "n0"), F.lit(0.0)).alias("total"))
    start = first.groupBy("lemma").agg(F.max_by(F.struct("total", "freq"), "n").alias("x")).select("lemma", "x.total", "x.freq")

    def pair(kind: str, a: str, b: str) -> DataFrame:
        named = rows.where(F.col("kind") == kind).select("n", "j", T.to_arabic(F.col("head")).alias(a), T.to_arabic(F.col("tag")).alias(b), (F.col("freq") / F.col("head_freq")).alias("p"))
        return named.groupBy(a, b).agg(F.max_by("p", F.struct("n", "j")).alias("p"))

    return start, pair("B", "unv", "lemma"), pair("A", "l1", "l2")


def load(spark: SparkSession, folder: str, model: str) -> LanguageModel:
    """``model``: path of the text, which Spark reads line by line."""
    start, emission, transition = from_lines(spark.read.option("encoding", "cp1252").text(model))
    counts = {k: read_map(spark, folder, f, "double").withColumnsRenamed({"key": k, "value": "p" if k == "lemma" else "n"}) for k, f in CORPUS_COUNTS.items()}
    return LanguageModel(start, emission, transition, counts["lemma"], counts["stem"], counts["root"])
