"""Quality rules under weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document.
Expectation-maximisation estimates how often each rule votes each way on good
and on bad documents, without labels, from the counts of vote patterns over
all documents; the posterior probability of good quality then replaces the
usual demand that all rules pass.

Defined results: null and empty texts have no words, fail the base rules and
are not kept; an empty table gives an empty result; repeated rows are judged
alike; further input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import WORD, documents, text_or_empty, written

BLANKS = r"[\x20\x09-\x0D]+"
#: Frequent function words of the four languages.
STOPWORDS = "the of and to in is that it for on with as be at by an are or was this de la le et les des en un une du que qui est pour dans el los las y por con del se der die und das ist zu den von mit sich auf ein eine".split()
ROUNDS = 60
KEEP_AT = 0.5


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for all uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def _windows(hashes: str) -> Column:
    """Hashes of all 5-word windows, from the hashes of the words."""
    w = F.col(hashes)
    return F.when(
        F.size(w) >= 5,
        F.transform(F.slice(w, 1, F.size(w) - 4), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4))),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more."""
    ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def marked(s: Column) -> Column:
        twin = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        hit = F.filter(s, lambda x, i: twin(x, i + 1) | (F.when(i > 0, twin(x, i - 1)).otherwise(F.lit(False))))
        return F.array_sort(F.transform(hit, lambda x: x["p"]))

    start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(_let(ordered, marked), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])


def _left(pattern: str) -> Column:
    """Characters that stay when ``pattern`` is deleted."""
    return F.length(F.regexp_replace("t", pattern, "")).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """What the rules look at, one narrow row for each document. Columns that
    are used more than once are made first, so that none is computed twice."""
    d = docs.select("doc_id", text_or_empty().alias("t"))
    d = d.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)))
    d = d.withColumn("v", _windows("wh")).withColumn("kinds", F.array_distinct("w"))
    stop = F.array(*[F.lit(f(x)) for x in STOPWORDS for f in (str, str.capitalize, str.upper)])
    return d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        _left(BLANKS).alias("word_chars"),
        _left(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("v")) == F.size("v"), F.lit(0)).otherwise(_covered(F.col("v"))).cast("long").alias("n_repeat_words"),
        F.size("kinds").cast("long").alias("n_distinct"),
        _left(r"[^\p{Lu}]+").alias("n_upper"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        F.size(F.array_intersect("kinds", stop)).cast("long").alias("n_stop"),
    )


def rules() -> dict[str, Column]:
    """Name to vote. Each rule abstains where its measure says nothing. All can
    vote bad on documents that pass the base rules: their bounds are tighter."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_letter = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    length, mean = F.col("n_words"), per_word("word_chars")
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    variety = F.col("n_distinct") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    return {
        "length": vote(length < 20, length >= 40),
        "word_length": vote((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 10)),
        "symbols": vote(per_letter("n_symbols") > 0.02, per_letter("n_symbols") < 0.005),
        "line_copies": vote(dup > 0.3, (dup < 0.1) & (F.col("n_lines") > 3)),
        "repeats": vote(per_word("n_repeat_words") > 0.1, (per_word("n_repeat_words") < 0.02) & (length >= 40)),
        "capitals": vote(per_letter("n_upper") > 0.4, per_letter("n_upper") < 0.15),
        "shouting": vote(per_word("n_shouts") > 0.2, per_word("n_shouts") < 0.02),
        "function_words": vote((F.col("n_stop") == 0) & (length >= 20), F.col("n_stop") >= 2),
        "variety": vote((variety < 2) & (length >= 40), variety > 4),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[dict[int, float], dict[int, float]]]]:
    """The prior of good quality and, for each rule, the chances of each vote
    on good and on bad documents, given that it votes: to abstain says nothing. ``patterns``: votes and how many documents
    cast them, at most 3 ** rules rows whatever the number of documents."""
    if not patterns:
        return 0.5, []
    m = len(patterns[0][0])
    # At the start any bad vote makes a document suspect: rules vote good by
    # default on what they were not made for. Estimation then settles how far
    # each rule's bad votes go along with those of the others.
    posterior = [0.05 if -1 in votes else 0.95 for votes, _ in patterns]
    prior, chances = 0.5, []
    for _ in range(rounds):
        good = sum(q * n for q, (_, n) in zip(posterior, patterns))
        total = sum(n for _, n in patterns)
        prior = (good + 1) / (total + 2)
        chances = []
        for j in range(m):
            g, b = {-1: 0.5, 1: 0.5}, {-1: 0.5, 1: 0.5}
            for q, (votes, n) in zip(posterior, patterns):
                if votes[j]:
                    g[votes[j]] += q * n
                    b[votes[j]] += (1 - q) * n
            chances.append(tuple({k: x / sum(c.values()) for k, x in c.items()} | {0: 1.0} for c in (g, b)))
        posterior = [1.0 / (1.0 + math.exp(min(700.0, -_log_odds(prior, chances, votes)))) for votes, _ in patterns]
    return prior, chances


def _log_odds(prior, chances, votes) -> float:
    return math.log(prior / (1 - prior)) + sum(math.log(g[v] / b[v]) for v, (g, b) in zip(votes, chances))


def score_quality(docs: DataFrame) -> DataFrame:
    votes = rules()
    f = features(docs).withColumns({f"vote_{k}": v.cast("int") for k, v in votes.items()})
    f = written(f, "votes")
    names = [f"vote_{k}" for k in votes]
    # At most 3 ** 9 patterns. What the base rules fail needs no estimate.
    counted = f.where(~_base_failed()).groupBy(*names).count().collect()
    patterns = sorted((tuple(r[k] for k in names), r["count"]) for r in counted)
    prior, chances = estimate(patterns)
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, (g, b) in zip(names, chances):
        by = F.col(k)
        odds = odds + F.when(by == -1, math.log(g[-1] / b[-1])).when(by == 1, math.log(g[1] / b[1])).otherwise(0.0)
    f = f.withColumn("p_good", 1 / (1 + F.exp(-odds)))
    f = f.withColumn("base_failed", _base_failed())
    f = f.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))
    return f.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", *names)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir))
