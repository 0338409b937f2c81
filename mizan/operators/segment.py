"""Segmentation of words into proclitic, stem and enclitic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.functions import text as T

CLITIC = ["unvoweledform", "voweledform", "desc", "classe"]


def prepare(words: DataFrame, word: str = "word") -> DataFrame:
    """word, unv (marks deleted) and norm (slips put right, marks kept)."""
    return words.select(F.col(word).alias("word")).distinct().withColumns({"unv": T.strip_diacritics(F.col("word")), "norm": T.normalize_word(F.col("word"))})


def _candidates(words: DataFrame, clitics: DataFrame, short: str, surface: Column) -> DataFrame:
    lengths = F.sequence(F.lit(0), F.least(F.lit(5), F.length("unv") - 1))
    at = words.where(F.length("unv") > 0).select("word", "unv", F.explode(lengths).alias(f"{short}_len"))
    at = at.withColumn("surface", surface(F.col("unv"), F.col(f"{short}_len")))
    named = clitics.select("surface", F.col("ord").alias(f"{short}_ord"), *[F.col(c).alias(f"{short}_{c}") for c in CLITIC])
    return at.join(F.broadcast(named), "surface").drop("surface")


def proclitic_candidates(words: DataFrame, proclitics: DataFrame) -> DataFrame:
    return _candidates(words, proclitics, "p", lambda w, n: F.left(w, n))


def enclitic_candidates(words: DataFrame, enclitics: DataFrame) -> DataFrame:
    return _candidates(words, enclitics, "e", lambda w, n: F.right(w, n))


def ending_alternative(stem: Column, enclitic: Column, only_short: bool = False) -> Column:
    """How the stem's last letter may be spelt without the enclitic."""
    end, cut = T.last(stem), T.but_last(stem)
    other = (
        F.when(end == "ت", F.concat(cut, F.lit("ة"))).when(end == "آ", F.concat(cut, F.lit("أى"))).when(end == "ا", F.concat(cut, F.lit("ى")))
        .when(end == "و", F.concat(stem, F.lit("ا"))).when(end.isin("ئ", "ؤ"), F.concat(cut, F.lit("ء"))).otherwise(F.lit(""))
    )
    return F.when(enclitic == "", F.lit("")).otherwise(other)


def stem_alternatives(stem: Column, p: Column, p_class: Column, e: Column) -> Column:
    """All stems that a cut may stand for, different and sorted."""
    doubled = p_class.isin("N4", "C3") & p.endswith("ل") & stem.startswith("ل")
    base = F.when(doubled, F.concat(F.lit("ا"), stem)).otherwise(stem)
    ending = F.when(F.length(base) > 1, ending_alternative(base, e)).otherwise(F.lit(""))
    madda = lambda s: F.replace(s, F.lit("آ"), F.lit("ءا"))
    given = F.array(
        stem,
        F.when(T.is_definite(p_class) & p.endswith("ل") & ~stem.startswith("ل"), F.concat(F.lit("ل"), stem)),
        F.when((e == "ي") & ~stem.startswith("ي"), F.concat(stem, F.lit("ي"))),
        F.when(doubled, ending_alternative(stem, e)),
        base,
        F.when(p.isin("أ", "ب"), F.concat(F.lit("ا"), base)),
        F.when(ending != "", ending),
        F.when(ending != "", madda(ending)),
        madda(base),
    )
    return F.array_sort(F.array_distinct(F.filter(given, lambda s: s.isNotNull())))


def valid_classes(p_class: Column, e_class: Column, enclitic: Column) -> Column:
    return (
        ~(e_class.startswith("V") & p_class.startswith("N")) & ~(p_class.startswith("V") & e_class.startswith("N"))
        & ~(T.is_definite(p_class) & (enclitic != ""))
    )


def segments(words: DataFrame, proclitics: DataFrame, enclitics: DataFrame) -> DataFrame:
    """Every segmentation, with its order: proclitic, enclitic, stem. Pairs are
    tried in order and end at the first one that is longer than the word."""
    p = proclitic_candidates(words, proclitics)
    e = enclitic_candidates(words, enclitics).drop("unv")
    order = F.struct("p_len", "p_ord", "e_len", "e_ord")
    pairs = p.join(e, "word").withColumn("over", F.length("unv") < F.col("p_len") + F.col("e_len"))
    stop = F.min(F.when(F.col("over"), order)).over(Window.partitionBy("word"))
    pairs = pairs.withColumn("stop", stop).where(F.col("stop").isNull() | (order < F.col("stop")))
    stem = F.substring(F.col("unv"), F.col("p_len") + 1, F.length("unv") - F.col("p_len") - F.col("e_len"))
    pairs = pairs.withColumn("cut", stem)
    rows = pairs.withColumn("stem", F.explode(stem_alternatives(F.col("cut"), F.col("p_unvoweledform"), F.col("p_classe"), F.col("e_unvoweledform"))))
    rows = rows.where(valid_classes(F.col("p_classe"), F.col("e_classe"), F.col("e_unvoweledform")))
    return rows.drop("over", "stop", "cut", "unv")
