"""Command line: ``analyze`` words or ``text``, from arguments or standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mizan import __version__, schemas
from mizan.operators.collapse import exploded
from mizan.plans.analyze import analyze_words
from mizan.plans.disambiguate import analyze_text
from mizan.plans.tables import scratch_path
from mizan.sources import demo, language_model, lexicon, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mizan")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "text"):
        c = sub.add_parser(name)
        c.add_argument("words", nargs="*")
        c.add_argument("--lexicon", help="folder of a full lexicon; the demo one if absent")
        c.add_argument("--model", help="language model text (for text)")
        how = c.add_mutually_exclusive_group()
        how.add_argument("-f", "--format", choices=sinks.FORMATS, default="raw")
        how.add_argument("--json", dest="format", action="store_const", const="json", help=argparse.SUPPRESS)
        if name == "analyze":
            c.add_argument("-i", "--inflections", action="store_true")
    return p


def _show(df, how: str) -> None:
    if how == "table":
        print(sinks.table(df))
        return
    if how == "csv":
        print(",".join(df.columns))  # names need no quotes
    lines = {"raw": sinks.raw_lines, "csv": sinks.csv_lines, "json": sinks.json_rows}[how](df)
    for r in lines.collect():
        print(r["value"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("mizan").getOrCreate()
    lex = lexicon.Lexicon.build(spark, args.lexicon, scratch_path(spark, "lexicon")) if args.lexicon else demo_lexicon(spark)
    if args.command == "analyze":
        words = args.words or sys.stdin.read().split()
        df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "word_ix int, word string")
        found = analyze_words(df, lex)
        columns = schemas.INFLECTED_COLUMNS if args.inflections else schemas.ANALYZE_COLUMNS
        rows = exploded(found) if args.inflections else found.withColumn("inflection_ix", F.lit(0))
        if args.format == "json":
            fields = [*columns[1:], *([] if args.inflections else ["inflections"])]
            for r in sinks.json_words(df, rows, fields, "word_ix").collect():
                print(r["value"])
            return 0
        _show(df.join(rows, "word").orderBy("word_ix", "rank", "inflection_ix").select(*columns), args.format)
        return 0
    text = " ".join(args.words) if args.words else sys.stdin.read()
    docs = spark.createDataFrame([(0, text)], "doc_id int, text string")
    lm = language_model.load(spark, args.lexicon, args.model) if args.lexicon else demo_model(spark)
    _show(analyze_text(docs, lex, lm).orderBy("sentence_ix", "token_ix").select(*schemas.TEXT_COLUMNS), args.format)
    return 0


_HELD: dict[tuple, object] = {}


def demo_lexicon(spark: SparkSession) -> lexicon.Lexicon:
    key = (spark.sparkContext.applicationId, "lexicon")
    if key not in _HELD:
        _HELD[key] = lexicon.Lexicon.build(spark, demo.tables(), scratch_path(spark, "demo"))
    return _HELD[key]  # type: ignore[return-value]


def demo_model(spark: SparkSession) -> language_model.LanguageModel:
    key = (spark.sparkContext.applicationId, "model")
    if key not in _HELD:
        start, emission, transition = language_model.from_lines(spark.createDataFrame([(x,) for x in demo.MODEL_LINES], "value string"))
        counts = {k: lexicon.read_map(spark, demo.tables(), f, "double") for k, f in lexicon.CORPUS_COUNTS.items()}
        named = [counts[k].withColumnsRenamed({"key": k, "value": "p" if k == "lemma" else "n"}) for k in ("lemma", "stem", "root")]
        tables = [spark.createDataFrame(d.collect(), d.schema) for d in (start, emission, transition, *named)]
        _HELD[key] = language_model.LanguageModel(*tables)
    return _HELD[key]  # type: ignore[return-value]


if __name__ == "__main__":
    raise SystemExit(main())
