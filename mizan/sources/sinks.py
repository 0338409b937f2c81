"""Outputs: raw lines, table, JSON lines, CSV, and the cells they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mizan.functions.letters import DIACRITICS

FORMATS = ("raw", "table", "json", "csv")


def cell(df: DataFrame, name: str) -> Column:
    """A column as text: null as nothing, affixes as ``form (description)``."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    if kind == "array<struct<form:string,description:string>>":
        one = lambda a: F.concat(a["form"], F.when(a["description"].isNull(), "").otherwise(F.concat(F.lit(" ("), a["description"], F.lit(")"))))
        c = F.array_join(F.transform(c, one), ", ")
    elif kind.startswith(("array", "struct")):
        c = F.to_json(c, {"ignoreNullFields": "false"})
    return F.coalesce(c.cast("string"), F.lit("")).alias(name)


def cells(df: DataFrame) -> DataFrame:
    return df.select(*[cell(df, c) for c in df.columns])


def raw_lines(df: DataFrame) -> DataFrame:
    """Tab-separated lines without a header."""
    return cells(df).select(F.concat_ws("\t", *df.columns).alias("value"))


def csv_lines(df: DataFrame) -> DataFrame:
    """Lines of RFC 4180, without the header."""
    quoted = lambda c: F.when(F.col(c).rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return cells(df).select(F.concat_ws(",", *[quoted(c) for c in df.columns]).alias("value"))


def json_words(words: DataFrame, rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """One object for each word, sorted by the column ``order`` of ``words``: its
    analyses with ``fields``, by rank, or an empty list where none was found.
    ``rows`` has rank and inflection_ix."""
    one = F.struct("rank", "inflection_ix", F.struct(*fields).alias("a"))
    lists = rows.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(one), lambda x, y: _by_place(x, y)), lambda x: x["a"]).alias("analyses"))
    kind = lists.schema["analyses"].dataType
    out = words.join(lists, "word", "left").withColumn("analyses", F.coalesce("analyses", F.array().cast(kind))).orderBy(order)
    return out.select(F.to_json(F.struct("word", "analyses"), {"ignoreNullFields": "false"}).alias("value"))


def _by_place(x: Column, y: Column) -> Column:
    place = lambda a: F.struct(a["rank"], a["inflection_ix"])
    return F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def width(text: str) -> int:
    """Columns on screen: marks take none."""
    return sum(c not in DIACRITICS for c in text)


def table(df: DataFrame) -> str:
    """A table for the screen, of rows few enough to be shown."""
    rows = [list(df.columns), *[list(r) for r in cells(df).collect()]]
    widths = [max(width(r[i]) for r in rows) for i in range(len(rows[0]))]
    lines = ["  ".join(x + " " * (w - width(x)) for x, w in zip(r, widths)).rstrip() for r in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.text(path)
