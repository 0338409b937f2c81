"""Lexicon tables: gzip JSON Lines in, Spark dimension tables out.

A lexicon is a folder of ``<file>.jsonl.gz``: maps hold ``{"key", "value"}``
lines (a later duplicate key wins), lists hold one record a line and number
them from 1. The dimension tables that the plans join are derived here once;
``build`` can write them as Parquet for reuse.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mizan.functions import text as T

#: File of each logical table.
FILES = {
    "proclitics": "DATA.Clitics.Proclitics.map",
    "enclitics": "DATA.Clitics.Enclitics.map",
    "exceptional": "DATA.Exceptional.map",
    "propernoun_unvoweled": "DATA.NonDerived.Propernoun.Unvoweled.map",
    "propernoun_voweled": "DATA.NonDerived.Propernoun.Voweled.list",
    "propernoun_pos": "DATA.NonDerived.Propernoun.PartOfSpeech.list",
    "propernoun_casemood": "DATA.NonDerived.Propernoun.CaseOrMood.list",
    "toolwords_unvoweled": "DATA.NonDerived.Toolwords.Unvoweled.map",
    "toolwords_voweled": "DATA.NonDerived.Toolwords.Voweled.list",
    "toolwords_pos": "DATA.NonDerived.Toolwords.PartOfSpeech.list",
}
DERIVED_FILES = {
    "unvoweled_stem": "DATA.Derived.{cat}.Patterns.Stems.Unvoweled.map",
    "diac_stem": "DATA.Derived.{cat}.Patterns.Stems.Voweled.Diac.map",
    "canonic_stem": "DATA.Derived.{cat}.Patterns.Stems.Voweled.Canonic.map",
    "diac_lemma": "DATA.Derived.{cat}.Patterns.Lemmas.Voweled.Diac.map",
    "canonic_lemma": "DATA.Derived.{cat}.Patterns.Lemmas.Voweled.Canonic.map",
    "roots_tri": "DATA.Derived.{cat}.Roots.Trilateral.map",
    "roots_quad": "DATA.Derived.{cat}.Roots.Quadriliteral.map",
    "roots_id_tri": "DATA.Derived.{cat}.Roots.id.Trilateral.map",
    "roots_id_quad": "DATA.Derived.{cat}.Roots.id.Quadriliteral.map",
    "formulas": "DATA.Derived.{cat}.Formulas.map",
    "pos": "DATA.Derived.{cat}.PartOfSpeech.list",
    "casemood": "DATA.Derived.{cat}.CaseOrMood.list",
}
FEATURES = {
    "Verbs": ["Main", "Type", "Emphasized", "Voice", "NbRoot", "Augmented", "Person", "Person2", "Transitivity"],
    "Nouns": ["Main", "Type", "NbRoot", "Definit", "Gender", "Number"],
}
FEATURE_FILE = "DATA.Derived.{cat}.PartOfSpeech.{feature}.list"
CORPUS_COUNTS = {"lemma": "MSA-LEMMA.ALL-train.map", "stem": "SHA.STEM.map", "root": "SHA.ROOT.map"}

_CLITIC = "array<struct<unvoweledform:string,voweledform:string,desc:string,classe:string>>"
_LENS = ",".join(f"len{i}:string" for i in range(1, 13))


class MissingTable(FileNotFoundError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _path(spark: SparkSession, folder: str, file: str) -> str:
    path = f"{folder}/{file}.jsonl.gz"
    if not _exists(spark, path):
        raise MissingTable(f"lexicon table {file} is not at {path}")
    return path


def _lines(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """(n, line): lines that are not blank, numbered from 0. The numbers come
    from the whole file's order, not from how it is split."""
    if isinstance(folder, dict):  # records at hand
        if file not in folder:
            raise MissingTable(f"lexicon table {file} is not among the records")
        return spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(folder[file])], "n int, line string")
    whole = spark.read.text(_path(spark, folder, file), wholetext=True)
    kept = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return whole.select(F.posexplode(kept).alias("n", "line"))


def read_map(spark: SparkSession, folder: str, file: str, value: str) -> DataFrame:
    """key string, value; the last line of a key counts."""
    rows = _lines(spark, folder, file).select("n", F.from_json("line", f"key string, value {value}").alias("r"))
    return rows.groupBy(F.col("r.key").alias("key")).agg(F.max_by("r.value", "n").alias("value"))


def read_list(spark: SparkSession, folder: str, file: str, record: str) -> DataFrame:
    """id (from 1) and the record's fields, or ``value`` for plain strings."""
    rows = _lines(spark, folder, file)
    if record == "string":
        return rows.select((F.col("n") + 1).alias("id"), F.from_json(F.concat(F.lit('{"v":'), "line", F.lit("}")), "v string")["v"].alias("value"))
    return rows.select((F.col("n") + 1).alias("id"), F.from_json("line", record).alias("r")).select("id", "r.*")


def ids(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, " "), lambda x: x != ""), lambda x: x.cast("int"))


@dataclass
class Lexicon:
    """The dimension tables of the plans."""

    proclitic: DataFrame
    enclitic: DataFrame
    exceptional: DataFrame
    tool: DataFrame
    propernoun: DataFrame
    pattern: DataFrame
    formula: DataFrame
    root_formula: DataFrame
    unvoweled: DataFrame
    pos: DataFrame
    casemood: DataFrame
    stem_index: DataFrame
    reading: DataFrame

    def save(self, folder: str) -> None:
        """Each table as Parquet. They are written side by side: small ones cost
        little but their planning."""
        one = lambda f: getattr(self, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(one, [f for f in fields(self) if getattr(self, f.name) is not None]))

    @classmethod
    def manifest(cls, spark: SparkSession, folder: str) -> DataFrame:
        """name, rows and bytes of each table of a built lexicon."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def size(name: str) -> int:
            at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            return at.getFileSystem(conf).getContentSummary(at).getLength()

        found = [(f.name, spark.read.parquet(f"{folder}/{f.name}").count(), size(f.name)) for f in fields(cls)]
        return spark.createDataFrame(found, "name string, rows long, bytes long")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Lexicon:
        return cls(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(cls)})

    @classmethod
    def build(cls, spark: SparkSession, source: str | dict[str, list], folder: str) -> Lexicon:
        """Read a lexicon (folder or records), keep its tables as Parquet in
        ``folder``, and open them. The derived tables are made from the written
        ones, so that they are planned on leaves."""
        base = load(spark, source, derive=False)
        base.save(folder)
        names = [f.name for f in fields(cls) if getattr(base, f.name) is not None]
        lex = cls(**{f.name: spark.read.parquet(f"{folder}/{f.name}") if f.name in names else None for f in fields(cls)})
        rest = cls(**{f.name: None for f in fields(cls)} | {"stem_index": stem_index(lex), "reading": readings(lex)})
        rest.save(folder)
        return cls.open(spark, folder)


def clitics(spark, folder, name) -> DataFrame:
    rows = read_map(spark, folder, FILES[name], _CLITIC).select("key", F.posexplode("value").alias("ord", "c"))
    empty = lambda c: F.coalesce(F.col(f"c.{c}"), F.lit("")).alias(c)
    return rows.select(F.col("key").alias("surface"), "ord", empty("unvoweledform"), empty("voweledform"), F.col("c.desc").alias("desc"), empty("classe"))


def _both(spark, folder, make) -> DataFrame:
    return make("Verbs").withColumn("cat", F.lit("Verbs")).unionByName(make("Nouns").withColumn("cat", F.lit("Nouns")), allowMissingColumns=True)


def _pair(c: str, name: str) -> list[Column]:
    parts = F.split(F.col(c), r"\.")
    return [parts[0].cast("int").alias(f"{name}_len"), parts[1].cast("int").alias(f"{name}_id")]


def load(spark: SparkSession, folder: str | dict[str, list], derive: bool = True) -> Lexicon:
    """Read a lexicon folder (or records by file) and derive the dimension tables."""
    m = lambda f, v: read_map(spark, folder, f, v)
    ls = lambda f, r: read_list(spark, folder, f, r)
    exceptional = m(FILES["exceptional"], "struct<voweledform:string,proclitic:string,stem:string,pos:string,enclitic:string>").select(F.col("key").alias("word"), "value.*")

    tool_pos = ls(FILES["toolwords_pos"], "string").select(F.col("id").cast("string").alias("pos"), F.col("value").alias("label"))
    tool_at = m(FILES["toolwords_unvoweled"], "string").select(F.col("key").alias("stem"), F.posexplode(ids(F.col("value"))).alias("ord", "id"))
    tool = tool_at.join(ls(FILES["toolwords_voweled"], "voweledform string, procClass string, encClass string, lemma string, root string, pos string"), "id").join(tool_pos, "pos")

    pn_pos = ls(FILES["propernoun_pos"], "main string, type string, gender string, number string, definit string").withColumnRenamed("id", "pos_id")
    pn_case = ls(FILES["propernoun_casemood"], "valAR string").select(F.col("id").alias("cas_id"), F.col("valAR").alias("casemood"))
    pn_at = m(FILES["propernoun_unvoweled"], "string").select(F.col("key").alias("stem"), F.posexplode(ids(F.col("value"))).alias("ord", "id"))
    pn = pn_at.join(ls(FILES["propernoun_voweled"], "vowform string, lemma string, root string, pos string, cas string"), "id")
    pn = pn.join(pn_pos, pn["pos"].cast("int") == pn_pos["pos_id"]).join(pn_case, pn["cas"].cast("int") == pn_case["cas_id"])
    pn = pn.drop("pos", "cas", "pos_id", "cas_id")

    file = lambda name, cat: DERIVED_FILES[name].format(cat=cat)

    def pattern_of(cat):
        out = None
        for kind in ("diac_stem", "canonic_stem", "diac_lemma", "canonic_lemma"):
            rows = m(file(kind, cat), "array<struct<val:string,freq:string>>").select(F.col("key").cast("int").alias("len"), F.posexplode("value").alias("p", "r"))
            rows = rows.select(F.lit(kind).alias("kind"), "len", (F.col("p") + 1).alias("id"), F.col("r.val").alias("val"), F.col("r.freq").cast("double").alias("freq"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def unvoweled_of(cat):
        rows = m(file("unvoweled_stem", cat), "array<struct<val:string,rules:string,ids:string>>").select(F.col("key").cast("int").alias("len"), F.posexplode("value").alias("ord", "r"))
        rows = rows.select("len", "ord", F.col("r.val").alias("val"), F.split("r.rules", " ").alias("rules"), ids(F.col("r.ids")).alias("ids"))
        # A value that occurs again in a length bucket replaces the earlier one.
        again = Window.partitionBy("len", "val").orderBy(F.desc("ord"))
        return rows.withColumn("_n", F.row_number().over(again)).where("_n = 1").drop("_n")

    def formula_of(cat):
        record = "struct<idDiacPatternStem:string,idCanonicPatternStem:string,idDiacPatternLemma:string,idCanonicPatternLemma:string,idPartOfSpeech:string,idCaseOrMood:string>"
        rows = m(file("formulas", cat), f"array<{record}>").select(F.col("key").cast("int").alias("len"), F.posexplode("value").alias("p", "r")).select("len", (F.col("p") + 1).alias("id"), "r.*")
        return rows.select("len", "id", F.col("idDiacPatternStem").cast("int").alias("ds_id"), *_pair("idCanonicPatternStem", "cs"), *_pair("idDiacPatternLemma", "dl"), *_pair("idCanonicPatternLemma", "cl"), F.col("idPartOfSpeech").cast("int").alias("pos_id"), F.col("idCaseOrMood").cast("int").alias("cm_id"))

    def roots_of(cat):
        out = None
        for kind in ("tri", "quad"):
            slots = m(file(f"roots_{kind}", cat), f"array<struct<{_LENS}>>").select(F.col("key").alias("letter"), F.posexplode("value").alias("place", "r"))
            names = m(file(f"roots_id_{kind}", cat), "int").select(F.col("key").alias("root"), F.col("value").alias("place"), F.substring("key", 1, 1).alias("letter"))
            rows = names.join(slots, ["letter", "place"])
            by_len = F.array(*[F.struct(F.lit(i).alias("stem_len"), F.col(f"r.len{i}").alias("f")) for i in range(1, 13)])
            rows = rows.select("root", F.inline(by_len)).where("f is not null").select("root", "stem_len", F.explode(ids(F.col("f"))).alias("formula_id"))
            out = rows if out is None else out.unionByName(rows)
        return out.distinct()

    def pos_of(cat):
        codes = ["main", "type", "emphasized", "voice", "nbroot", "augmented", "person", "person2", "transitivity", "definit", "gender", "number"]
        rows = ls(file("pos", cat), ", ".join(f"{c} string" for c in codes) + ", freq string")
        for feature in FEATURES[cat]:
            values = ls(FEATURE_FILE.format(cat=cat, feature=feature), "valAR string, valEN string").select(F.col("id").alias(f"_{feature}"), F.col("valAR").alias(f"f_{feature}"))
            rows = rows.join(F.broadcast(values), F.col(feature.lower()).cast("int") == F.col(f"_{feature}"), "left").withColumn(f"f_{feature}", F.coalesce(f"f_{feature}", F.lit("")))
        label = F.concat_ws("|", *[F.col(f"f_{x}") for x in FEATURES[cat]]) if cat == "Verbs" else F.lit(None).cast("string")
        keep = [F.col(f"f_{x}").alias(x.lower()) for x in FEATURES[cat]]
        return rows.select("id", *keep, label.alias("label"), F.col("freq").cast("double").alias("freq"))

    casemood = _both(spark, folder, lambda cat: ls(file("casemood", cat), "valAR string, valEN string").select("id", F.col("valAR").alias("casemood")))
    pattern, unvoweled = _both(spark, folder, pattern_of), _both(spark, folder, unvoweled_of)
    formula, roots, pos = _both(spark, folder, formula_of), _both(spark, folder, roots_of), _both(spark, folder, pos_of)
    lex = Lexicon(clitics(spark, folder, "proclitics"), clitics(spark, folder, "enclitics"), exceptional, tool, pn, pattern, formula, roots, unvoweled, pos, casemood, None, None)  # type: ignore[arg-type]
    if derive:
        lex.stem_index, lex.reading = stem_index(lex), readings(lex)
    return lex


def stem_key(stem: Column) -> Column:
    """The first letter as it is, the other hamza carriers folded."""
    return F.concat(T.first(stem), T.fold_hamza(F.substring(stem, 2, 1 << 20)))


def stem_index(lex: Lexicon) -> DataFrame:
    """Every stem that a root and a formula can make, by its folded spelling.

    The search for patterns that fit a stem is turned round at build time, so
    that analysis is an equi-join on (cat, key)."""
    f = lex.formula.select("cat", F.col("len").alias("stem_len"), F.col("id").alias("formula_id"), "ds_id")
    u = lex.unvoweled.select("cat", F.col("len").alias("stem_len"), "val", "rules", F.explode("ids").alias("ds_id"))
    rows = lex.root_formula.join(f, ["cat", "stem_len", "formula_id"]).join(u, ["cat", "stem_len", "ds_id"])
    made = T.fold_hamza(T.instantiate(F.col("root"), stem_key(F.col("val"))))
    return rows.select("cat", "root", "stem_len", "formula_id", "val", "rules", made.alias("key")).distinct()


def readings(lex: Lexicon) -> DataFrame:
    """All that a formula and a root say about a stem, whatever its clitics."""
    p = lex.pattern

    def of(kind: str, short: str) -> DataFrame:
        return p.where(F.col("kind") == kind).select("cat", F.col("len").alias(f"{short}_len"), F.col("id").alias(f"{short}_id"), F.col("val").alias(short), F.col("freq").alias(f"{short}_freq"))

    f = lex.formula.withColumn("ds_len", F.col("len"))
    for kind, short in (("diac_stem", "ds"), ("canonic_stem", "cs"), ("diac_lemma", "dl"), ("canonic_lemma", "cl")):
        f = f.join(of(kind, short), ["cat", f"{short}_len", f"{short}_id"])
    f = f.join(lex.pos.withColumnsRenamed({"id": "pos_id", "freq": "pos_freq"}), ["cat", "pos_id"]).join(lex.casemood.withColumnRenamed("id", "cm_id"), ["cat", "cm_id"])
    score = (F.col("ds_freq") + F.col("cs_freq") + F.col("dl_freq") + F.col("cl_freq") + F.col("pos_freq")) / 5.0
    f = f.withColumn("priority", T.as_score(score))
    used = lex.root_formula.select("cat", "root", F.col("stem_len").alias("len"), F.col("formula_id").alias("id")).distinct()
    rows = used.join(f, ["cat", "len", "id"])
    # The stem as it is shown: spelt here, once for each root and pattern.
    bare = T.strip_last_diacritic(F.col("ds"))
    names = ["main", "type", "voice", "person", "person2", "transitivity", "augmented", "emphasized", "definit", "gender", "number", "label"]
    return rows.select(
        "cat", "root", F.col("len").alias("stem_len"), F.col("id").alias("formula_id"), F.col("ds").alias("diac_pattern"), F.col("cs").alias("pattern"),
        T.instantiate(F.col("root"), F.col("dl")).alias("lemma"), F.col("cl").alias("lemma_pattern"), "casemood", "priority", *names,
        F.when(bare != "-", T.instantiate(F.col("root"), bare)).alias("made"),
    )
