"""Schemas of the results, and the columns of the flat formats, in order."""

from __future__ import annotations

#: The fields of a reading and of an inflection, in order.
READING = ("diacritized", "lemma", "root", "stem", "pattern", "lemma_pattern", "pos", "type", "tense", "gender", "number", "person", "pronoun", "voice", "transitivity", "augmentation", "emphatic", "proclitics", "prefixes", "suffixes", "enclitics")
INFLECTED = ("inflected", "case", "mood", "state")

ANALYZE_COLUMNS = ("word", *READING, "score")
INFLECTED_COLUMNS = ("word", *READING, *INFLECTED, "score")
TEXT_COLUMNS = ("token", "lemma", "stem", "root", "analyzed")

AFFIX_SCHEMA = "struct<form:string,description:string>"
INFLECTION_SCHEMA = "struct<diacritized:string,case:string,mood:string,state:string,score:double>"
_KINDS = {"emphatic": "boolean"} | {c: f"array<{AFFIX_SCHEMA}>" for c in READING[-4:]}
ANALYSIS_SCHEMA = "word string, " + ", ".join(f"{c} {_KINDS.get(c, 'string')}" for c in READING) + f", score double, inflections array<{INFLECTION_SCHEMA}>"
TOKEN_SCHEMA = "token string, lemma string, stem string, root string, analyzed boolean"
