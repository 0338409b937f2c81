"""From raw readings to ranked analyses with nested inflections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.operators.branches import FEATURES

AFFIXES = ["proclitics", "prefixes", "suffixes", "enclitics"]
READING = ["word", "diacritized", "lemma", "root", "stem", "pattern", "lemma_pattern", *FEATURES, "emphatic", *AFFIXES]


def finished(raw: DataFrame) -> DataFrame:
    """Raw readings with the ending of case or mood taken off the pattern; the
    stem is spelt from root and pattern in the lexicon's table of readings."""
    return raw.withColumn("diac_pattern", T.strip_last_diacritic(F.col("diac_pattern")))


def analyses(raw: DataFrame) -> DataFrame:
    """One row for each different reading of a word, best first by ``rank``:
    its score is its best inflection's; inflections are sorted by score."""
    cm = T.given(F.col("casemood"))
    bare = F.when(F.col("pattern").endswith("ًا"), T.but_last(F.col("pattern"))).otherwise(F.col("pattern"))
    ended = lambda c: F.when(cm.isNull(), c).otherwise(T.strip_case_ending(c))
    verb = F.col("pos") == "فعل"
    rows = raw.withColumns({
        "case": F.when(~F.coalesce(verb, F.lit(False)), cm), "mood": F.when(verb, cm), "diacritized": ended(F.col("voweled")), "score": F.col("priority").cast("double"),
        "pattern": T.given(F.when(cm.isNull(), F.col("pattern")).otherwise(T.strip_case_ending(bare))), "lemma_pattern": T.given(F.col("lemma_pattern")), "root": T.given(F.col("root")),
    }).withColumn("stem", F.when(F.col("case").isNull() & F.col("mood").isNull(), F.col("stem")).otherwise(T.strip_case_ending(F.col("stem"))))
    # Features that the lexicon leaves empty count as absent.
    rows = rows.withColumns({f: F.when(F.col(f) != "", F.col(f)) for f in FEATURES})
    one = rows.groupBy(*READING, "voweled", "case", "mood", "state").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))
    inflection = F.struct((-F.col("score")).alias("_s"), F.col("ord").alias("_o"), F.struct(F.col("voweled").alias("diacritized"), "case", "mood", "state", "score").alias("i"))
    out = one.groupBy(*READING).agg(F.max("score").alias("score"), F.min("ord").alias("ord"), F.transform(F.array_sort(F.collect_list(inflection)), lambda x: x["i"]).alias("inflections"))
    return out


def ranked(analyses: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("word").orderBy(F.desc("score"), "ord")
    return analyses.withColumn("rank", F.row_number().over(by))


def exploded(analyses: DataFrame) -> DataFrame:
    """One row for each inflection: the reading's fields, ``inflected`` (the
    inflection's form), its case, mood, state and score."""
    rows = analyses.select("*", F.posexplode("inflections").alias("inflection_ix", "i")).drop("inflections", "score")
    return rows.select("*", F.col("i.diacritized").alias("inflected"), "i.case", "i.mood", "i.state", "i.score").drop("i")
