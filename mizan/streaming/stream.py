"""Analysis of streams: texts in, tokens with their best reading out.

Readings depend on the word alone, so a stream of texts is tokenised and joined
with a table of readings (a stream-static join), which is analysed beforehand
or refreshed for each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mizan.plans.analyze import analyze_words
from mizan.plans.disambiguate import tokens
from mizan.sources.lexicon import Lexicon


def best_readings(words: DataFrame, lex: Lexicon, word: str = "word") -> DataFrame:
    return analyze_words(words, lex, word).where("rank = 1").select("word", "diacritized", "lemma", "root", "pos", "score")


def annotate(stream: DataFrame, readings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of a stream with the best reading that ``readings`` has."""
    t = tokens(stream, id_col, text_col)
    return t.join(readings, F.col("token") == F.col("word"), "left").drop("word")


def write_analysed(stream: DataFrame, lex: Lexicon, path: str, checkpoint: str, text_col: str = "text", id_col: str = "doc_id"):
    """Each micro-batch's different words are analysed, then joined back."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        t = tokens(df, id_col, text_col)
        found = best_readings(t.withColumnRenamed("token", "word"), lex)
        annotate(df, found, id_col, text_col).write.mode("append").parquet(path)
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
