"""Layer 1: every reading of each word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.operators import branches as B
from mizan.operators import collapse as C
from mizan.operators.segment import prepare, segments
from mizan.plans.tables import materialized
from mizan.sources.lexicon import Lexicon


def _hamza_kept(raw: DataFrame, words: DataFrame) -> DataFrame:
    """A word with a hamza on a seat keeps the readings whose stem has it."""
    rows = raw.join(words.select("word", T.first_hamza(F.col("norm")).alias("_h")), "word")
    return rows.where((F.col("_h") == "") | F.contains("stem", "_h")).drop("_h")


def raw_readings(words: DataFrame, lex: Lexicon, word: str = "word") -> DataFrame:
    """The bag of readings of all different words, before collapsing. Words,
    segments, vowelised stems and readings are written tables, so no step is
    planned on top of all others."""
    w = materialized(prepare(words.where(F.col(word).isNotNull()), word), "words")
    rest = w.join(F.broadcast(lex.exceptional.select(F.col("word").alias("unv"))), "unv", "left_anti")
    segs = materialized(segments(rest.select("word", "unv"), lex.proclitic, lex.enclitic).join(rest.select("word", "norm"), "word"), "segments")
    rows = B.derived(segs, lex)
    spelt = materialized(B.tool_words(segs, lex).unionByName(B.nouns(rows)).unionByName(B.verbs(rows)), "spelt")
    found = _hamza_kept(spelt, rest).unionByName(B.proper_nouns(segs, lex))
    found = materialized(C.finished(found.unionByName(B.exceptional(w, lex))), "readings")
    # Words with a bare tanween that found nothing are tried with a doubled letter.
    bare = rest.where(F.col("norm").endswith("ًا") & ~F.col("norm").endswith("ًّا"))
    missed = bare.join(found.select("word").distinct(), "word", "left_anti").select("word", F.concat(T.but_last(F.col("norm"), 2), F.lit("ًّا")).alias("norm"))
    again = materialized(segs.drop("norm").join(missed, "word"), "again")
    if again.isEmpty():
        return found
    more = B.proper_nouns(again, lex).unionByName(B.nouns(B.derived(again, lex, ("Nouns",))))
    return found.unionByName(materialized(C.finished(more), "more"))


def analyze_words(words: DataFrame, lex: Lexicon, word: str = "word") -> DataFrame:
    """Ranked analyses of each different word of a column; words without any
    have no row. Different words only are analysed, however often they occur."""
    return C.ranked(C.analyses(raw_readings(words, lex, word)))
