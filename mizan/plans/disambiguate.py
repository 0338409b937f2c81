"""Layer 2: one lemma, stem and root for each token in its sentence.

Scores of a step do not depend on the path so far, so all neighbouring pairs
are scored at once by a join; only the walk back over the best predecessors is
sequential, inside one array of each sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.plans.analyze import raw_readings
from mizan.plans.tables import materialized
from mizan.operators import collapse as C
from mizan.sources.language_model import LanguageModel
from mizan.sources.lexicon import Lexicon

#: Fixed values of the decoder.
BACKOFF, DEFAULT_TOTAL, ALONE, DISCOUNT = 1e-5, 13336.0, 1e-6, 0.5
SENTENCE = ["doc_id", "sentence_ix"]


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ix, token_ix, token of every word of a text."""
    s = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.tokenize(F.coalesce(F.col(text_col), F.lit("")))).alias("sentence_ix", "s"))
    return s.select("doc_id", "sentence_ix", F.posexplode("s").alias("token_ix", "token"))


def start_row(candidates: Column) -> Column:
    """Start scores of an array of (total, freq) in order, nulls where the
    model has no count."""
    begin = F.struct(F.lit(1.0).alias("top"), F.lit(DEFAULT_TOTAL).alias("total"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"))

    def step(a, c):
        known, s = c["freq"].isNotNull(), c["freq"] - DISCOUNT
        top = F.when(known & ((a["i"] == 0) | (a["top"] < s)), s).otherwise(a["top"])
        x = F.when(known, c["freq"] / c["total"]).otherwise(0.0)
        return F.struct(top.alias("top"), F.when(known, c["total"]).otherwise(a["total"]).alias("total"), (a["sum"] + x).alias("sum"), (a["i"] + 1).alias("i"))

    def scores(a):
        floor = a["top"] / a["total"]
        each = lambda c: (floor + F.when(c["freq"].isNotNull(), c["freq"] / c["total"]).otherwise(0.0)) / (a["sum"] + floor * F.greatest(a["i"], F.lit(1)))
        return F.transform(candidates, each)

    return F.aggregate(candidates, begin, step, scores)


def disambiguate(tokens: DataFrame, lex: Lexicon, lm: LanguageModel) -> DataFrame:
    """The tokens with lemma, stem, root and whether they were analysed."""
    raw = raw_readings(tokens, lex, "token")
    best = materialized(C.ranked(C.analyses(raw)).select("word", "lemma", "rank"), "best")
    lemmas = best.groupBy(F.col("word").alias("token"), "lemma").agg(F.min("rank").alias("r"))
    lists = lemmas.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "lemma"))), lambda x: x["lemma"]).alias("lemmas"))
    kinds = tokens.select("token").distinct().join(lists, "token", "left").withColumn("analyzed", F.col("lemmas").isNotNull())
    kinds = kinds.select("token", "analyzed", T.strip_diacritics(F.col("token")).alias("unv"), F.posexplode(F.coalesce("lemmas", F.array("token"))).alias("k", "lemma"))
    kinds = kinds.join(lm.emission.withColumnRenamed("p", "b"), ["unv", "lemma"], "left").join(lm.backoff.withColumnRenamed("p", "bo"), "lemma", "left").join(lm.start, "lemma", "left")
    kinds = kinds.withColumn("bo", F.coalesce("bo", F.lit(BACKOFF))).withColumn("b", F.coalesce("b", "bo"))
    of = kinds.groupBy("token", "analyzed").agg(F.array_sort(F.collect_list(F.struct("k", "lemma", "b", "bo", "total", "freq"))).alias("c"))
    of = materialized(of.withColumn("start", start_row(F.col("c"))), "candidates")
    n = tokens.groupBy(*SENTENCE).agg(F.count(F.lit(1)).alias("n"))
    # Neighbouring pairs of different words and whether they open a sentence.
    one = tokens.select(*SENTENCE, (F.col("token_ix") + 1).alias("token_ix"), F.col("token").alias("t1"))
    pairs = tokens.join(one, [*SENTENCE, "token_ix"]).withColumn("opens", F.col("token_ix") == 1)
    distinct = pairs.select("t1", "token", "opens").distinct()
    left = of.select(F.col("token").alias("t1"), F.inline(F.arrays_zip("c", "start"))).select("t1", F.col("c.k").alias("k1"), F.col("c.lemma").alias("l1"), F.col("c.b").alias("b1"), F.col("c.bo").alias("bo1"), "start")
    right = of.select("token", F.inline("c")).select("token", F.col("k").alias("k2"), F.col("lemma").alias("l2"), F.col("b").alias("b2"))
    scored = distinct.join(left, "t1").join(right, "token").join(lm.transition, ["l1", "l2"], "left")
    value = F.coalesce("p", "bo1") + F.when(F.col("opens"), F.col("b1") + F.col("start")).otherwise(F.col("bo1"))
    step = scored.groupBy("t1", "token", "opens", "k2", "b2").agg(F.max(F.struct(value.alias("v"), (-F.col("k1")).alias("k"))).alias("m"))
    step = step.groupBy("t1", "token", "opens").agg(F.array_sort(F.collect_list(F.struct("k2", (-F.col("m.k")).alias("back"), (F.col("m.v") + F.col("b2")).alias("acc")))).alias("s"))
    step = materialized(step, "steps")
    walked = pairs.join(step, ["t1", "token", "opens"]).groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(F.struct("token_ix", "s"))).alias("steps"))
    top = lambda s: F.get(F.transform(F.slice(F.array_sort(F.transform(s, lambda x: F.struct((-x["acc"]).alias("v"), x["k2"].alias("k")))), 1, 1), lambda x: x["k"]), F.lit(0))
    last = top(F.element_at(F.col("steps"), -1)["s"])
    path = F.aggregate(F.reverse("steps"), F.array(last), lambda a, x: F.concat(F.array(F.get(x["s"], F.get(a, F.lit(0)))["back"]), a))
    alone = tokens.join(n.where("n = 1"), SENTENCE).join(of, "token").select(*SENTENCE, F.array(F.get(F.transform(F.slice(F.array_sort(F.transform("start", lambda v, i: F.struct((-(v + ALONE)).alias("v"), i.alias("k")))), 1, 1), lambda x: x["k"]), F.lit(0))).alias("path"))
    paths = walked.select(*SENTENCE, path.alias("path")).unionByName(alone).select(*SENTENCE, F.posexplode("path").alias("token_ix", "k"))
    paths = materialized(paths, "paths")
    chosen = tokens.join(paths, [*SENTENCE, "token_ix"]).join(of, "token")
    chosen = chosen.select(*SENTENCE, "token_ix", "token", F.get("c", "k")["lemma"].alias("lemma"), "analyzed")
    most = lambda value, counts: raw.select(F.col("word").alias("token"), "lemma", F.col(value).alias("x"), "ord").join(counts.withColumnRenamed(value, "x"), "x", "left").groupBy("token", "lemma").agg(F.min(F.struct((-F.coalesce("n", F.lit(0.0))).alias("n"), "ord", "x")).alias("m")).select("token", "lemma", F.col("m.x").alias(value))
    out = chosen.join(most("stem", lm.stem_freq), ["token", "lemma"], "left").join(most("root", lm.root_freq), ["token", "lemma"], "left")
    return out.select(*SENTENCE, "token_ix", "token", F.when(F.col("analyzed"), F.col("lemma")).otherwise(F.col("token")).alias("lemma"), F.when(F.col("analyzed"), F.col("stem")).otherwise(F.col("token")).alias("stem"), F.when(F.col("analyzed"), T.given(F.col("root"))).alias("root"), "analyzed")


def analyze_text(docs: DataFrame, lex: Lexicon, lm: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return disambiguate(materialized(tokens(docs, id_col, text_col), "tokens"), lex, lm)


def lemmatize(docs: DataFrame, lex: Lexicon, lm: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens with their lemmas alone."""
    return analyze_text(docs, lex, lm, id_col, text_col).select(*SENTENCE, "token_ix", "token", "lemma")
