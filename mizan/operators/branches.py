"""The branches of analysis: exceptional words, proper nouns, tool words, nouns
and verbs. Each is joins and filters from segments to raw readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.functions.hamza import spell_hamza
from mizan.functions.letters import GENDERS, NUMBERS, PERSONS, SINGLE_SLOT, SUKUN, TENSES
from mizan.plans.tables import materialized
from mizan.sources.lexicon import Lexicon

AFFIX = "array<struct<form:string,description:string>>"
FEATURES = ["pos", "type", "tense", "gender", "number", "person", "pronoun", "voice", "transitivity", "augmentation"]
RAW = ["word", "ord", "voweled", "proclitic", "stem", "part_of_speech", "diac_pattern", "pattern", "lemma", "lemma_pattern", "root", "casemood", "enclitic", "priority", *FEATURES, "emphatic", "state", "proclitics", "prefixes", "suffixes", "enclitics"]
TANWEEN = "[ًٌٍ]"


def label_slots(label: Column) -> dict[str, Column]:
    """The features that a label of slots names; the first of each kind counts."""
    slots = F.filter(F.slice(F.split(label, r"\|"), 2, 99), lambda s: ~s.isin("", "-"))
    single = lambda i: reduce(lambda acc, kv: acc.when(label == kv[0], kv[1][i]), SINGLE_SLOT.items(), F.when(F.lit(False), ""))
    one = lambda names: F.get(F.filter(slots, lambda s: s.isin(*names)), F.lit(0))
    person = one(list(PERSONS))
    # A second label of a kind falls through to the type.
    seen = lambda names: F.array_position(slots, one(names))
    taken = [F.coalesce(seen(n), F.lit(0)) for n in (list(TENSES), list(GENDERS), list(NUMBERS), list(PERSONS))]
    rest = F.filter(F.transform(slots, lambda s, i: F.when(reduce(lambda a, b: a | b, [(i + 1) == t for t in taken]), None).otherwise(s)), lambda s: s.isNotNull())
    return {
        "pos": F.coalesce(single(0), F.get(F.split(label, r"\|"), F.lit(0))),
        "type": F.coalesce(single(1), F.get(rest, F.lit(0))),
        "tense": one(TENSES), "gender": one(GENDERS), "number": one(NUMBERS),
        "person": reduce(lambda acc, kv: acc.when(person == kv[0], kv[1]), PERSONS.items(), F.when(F.lit(False), "")),
    }


def affixes(form: Column, description: Column) -> Column:
    some = F.array(F.struct(form.alias("form"), description.alias("description"))).cast(AFFIX)
    return F.when((form == "") | form.isNull(), F.array().cast(AFFIX)).otherwise(some)


def _raw(rows: DataFrame, branch: int, **columns: Column) -> DataFrame:
    """Rows in the layout of raw readings; what a branch lacks is null."""
    order = columns.pop("order")
    have = {"ord": F.struct(F.col("p_len"), F.col("p_ord"), F.col("e_len"), F.col("e_ord"), F.col("stem").alias("alt"), F.lit(branch).alias("branch"), order.cast("string").alias("at"))} | columns
    blank = {c: F.lit("-") for c in ("diac_pattern", "pattern", "lemma_pattern", "root", "casemood")}
    blank |= {c: F.array().cast(AFFIX) for c in ("prefixes", "suffixes")}
    blank |= {"proclitics": affixes(F.col("p_voweledform"), F.col("p_desc")), "enclitics": affixes(_enclitic_form(rows, columns), F.col("e_desc"))}
    blank |= {"emphatic": F.lit(None).cast("boolean"), "state": F.lit(None).cast("string"), "word": F.col("word")}
    return rows.select(*[(have.get(c) if c in have else blank.get(c, F.lit(None).cast("string"))).alias(c) for c in RAW])


def _enclitic_form(rows: DataFrame, columns: dict) -> Column:
    return F.col("enc") if "enc" in rows.columns else F.col("e_voweledform")


def harmonised(unvoweled: Column, voweled: Column, before: Column) -> Column:
    """The third-person enclitics take a kasra after i."""
    i = before.endswith("ي") | before.endswith("يْ") | before.endswith("ِ")
    pick = lambda a, b: F.when(i, a).otherwise(b)
    return (
        F.when(unvoweled == "ه", pick("هِ", "هُ")).when(unvoweled == "هما", pick("هِمَا", "هُمَا"))
        .when(unvoweled == "هم", pick("هِمْ", "هُمْ")).when(unvoweled == "هن", pick("هِنَّ", "هُنَّ")).otherwise(voweled)
    )


def _after_article(stem: Column) -> Column:
    """Sukun on the article; a sun letter is doubled."""
    return F.when(T.is_solar(T.first(stem)), F.concat(F.lit(SUKUN), T.first(stem), F.lit("ّ"), F.substring(stem, 2, 1 << 20))).otherwise(F.concat(F.lit(SUKUN), stem))


def _column(form: Column, description: Column, between: str) -> Column:
    return F.when(form == "", "#").otherwise(F.concat(form, F.lit(between), F.coalesce(description, F.lit(""))))


def exceptional(words: DataFrame, lex: Lexicon) -> DataFrame:
    """Words that the lexicon lists whole; no other branch sees them."""
    hit = words.select("word", "unv").join(F.broadcast(lex.exceptional.withColumnRenamed("word", "unv")), "unv")
    hit = hit.withColumns({"p_len": F.lit(0), "p_ord": F.lit(0), "e_len": F.lit(0), "e_ord": F.lit(0), "p_voweledform": F.coalesce(T.given(F.col("proclitic")), F.lit("")), "e_voweledform": F.coalesce(T.given(F.col("enclitic")), F.lit("")), "p_desc": F.lit(None).cast("string"), "e_desc": F.lit(None).cast("string")})
    return _raw(hit, 0, order=F.lit(0), voweled=F.col("voweledform"), proclitic=F.col("proclitic"), stem=F.col("stem"), part_of_speech=F.col("pos"), lemma=F.lit("الله"), enclitic=F.col("enclitic"), priority=F.lit("1"), **label_slots(F.col("pos")))


def tool_words(segs: DataFrame, lex: Lexicon) -> DataFrame:
    """Particles and pronouns, by the clitic classes that each allows."""
    t = lex.tool.select("stem", F.col("ord").alias("t_ord"), F.col("voweledform").alias("v"), F.coalesce("procClass", F.lit("")).alias("pc"), F.coalesce("encClass", F.lit("")).alias("ec"), "lemma", F.coalesce("root", F.lit("")).alias("r"), "label")
    rows = segs.join(F.broadcast(t), "stem").where(F.contains("pc", "p_classe") & F.contains("ec", "e_classe"))
    rows = rows.withColumn("enc", harmonised(F.col("e_unvoweledform"), F.col("e_voweledform"), F.col("v")))
    article = reduce(lambda a, b: a | b, [F.contains(F.col("pc"), F.lit(c)) for c in ("N1", "N2", "N3", "N5")])
    voweled = F.concat("p_voweledform", F.when(article, _after_article(F.col("v"))).otherwise(F.col("v")), "enc")
    for wrong, right in (("لَلْلّ", "لَلّ"), ("لِلْلّ", "لِلّ"), ("لِالّ", "لِلّ"), ("لَالّ", "لَلّ")):
        voweled = F.replace(voweled, F.lit(wrong), F.lit(right))
    rows = rows.withColumn("voweled", voweled).where(~T.incompatible(F.col("norm"), F.col("voweled")))
    root = F.when(F.col("r") == T.strip_diacritics(F.col("r")), F.col("r")).otherwise("-")
    return _raw(rows, 2, order=F.col("t_ord"), voweled=F.col("voweled"), proclitic=_column(F.col("p_voweledform"), F.col("p_desc"), " : "), stem=T.strip_last_diacritic(F.col("v")), part_of_speech=F.col("label"), lemma=F.col("lemma"), root=root, enclitic=_column(F.col("enc"), F.col("e_desc"), " : "), priority=F.lit("0.0001100101"), **label_slots(F.col("label")))


def _has(c: str, letter: str) -> Column:
    return F.contains(F.col(c), F.lit(letter))


def _clitics_allow(casemood: Column, voweled: Column, spared: Column | None = None) -> Column:
    """What a noun's case and tanween leave to its clitics."""
    tanween = voweled.rlike(TANWEEN) & ((F.col("e_unvoweledform") != "") | T.is_definite(F.col("p_classe")))
    genitive = F.col("p_classe").isin("N4", "N5") & (casemood != "مجرور")
    if spared is not None:
        genitive = genitive & ~spared
    return ~tanween & ~(F.col("p_classe").isin("N2", "C2", "C3") & (casemood == "مجرور")) & ~genitive


def proper_nouns(segs: DataFrame, lex: Lexicon) -> DataFrame:
    n = lex.propernoun.select("stem", F.col("ord").alias("n_ord"), F.col("vowform").alias("v"), "lemma", F.coalesce("root", F.lit("")).alias("r"), "main", F.col("type").alias("kind"), F.col("gender").alias("sex"), F.col("number").alias("count"), "definit", "casemood")
    rows = segs.where(~_has("p_classe", "V") & ~_has("e_classe", "V")).join(n, "stem")
    rows = rows.withColumn("enc", harmonised(F.col("e_unvoweledform"), F.col("e_voweledform"), F.col("v")))
    rows = rows.withColumn("base", F.when(F.col("e_unvoweledform") != "", F.replace("v", F.lit("ة"), F.lit("ت"))).otherwise(F.col("v")))
    drop = (F.col("p_classe") == "N4") & F.col("p_unvoweledform").endswith("ل") & F.col("v").startswith("ا")
    body = F.when(drop, F.substring("base", 2, 1 << 20)).when(T.is_definite(F.col("p_classe")), _after_article(F.col("base"))).otherwise(F.col("base"))
    rows = rows.withColumn("voweled", F.concat("p_voweledform", body, "enc"))
    rows = rows.where(~T.incompatible(F.col("norm"), F.col("voweled"), F.col("e_unvoweledform")) & _clitics_allow(F.col("casemood"), F.col("voweled")))
    root = F.when(F.col("r") == T.strip_diacritics(F.col("r")), F.col("r")).otherwise("-")
    label = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("main", "kind", "sex", "count")])
    return _raw(rows, 1, order=F.col("n_ord"), voweled=F.col("voweled"), proclitic=_column(F.col("p_voweledform"), F.col("p_desc"), " : "), stem=T.strip_last_diacritic(F.col("v")), part_of_speech=label, lemma=F.col("lemma"), root=root, casemood=F.col("casemood"), enclitic=_column(F.col("enc"), F.col("e_desc"), " : "), priority=F.lit("0.01100101"), pos=F.col("main"), type=T.given(F.col("kind")), gender=T.given(F.col("sex")), number=T.given(F.col("count")), state=T.given(F.col("definit")))


def solutions(segs: DataFrame, lex: Lexicon) -> DataFrame:
    """(cat, stem, root, formula) for each different stem: an equi-join with the
    index of stems, then the pattern's letters and the root's rule."""
    stems = segs.select("stem").distinct().withColumn("key", T.fold_hamza(F.col("stem")))
    hit = stems.join(lex.stem_index, "key").where(F.length("stem") == F.col("stem_len"))
    hit = hit.where(T.fits_pattern(F.concat(T.first(F.col("stem")), T.fold_hamza(F.substring("stem", 2, 1 << 20))), F.concat(T.first(F.col("val")), T.fold_hamza(F.substring("val", 2, 1 << 20)))))
    letter = lambda r: F.when(r.rlike("[1-9]"), F.substring(F.col("stem"), F.try_to_number(r, F.lit("9")).cast("int"), 1)).otherwise(r)
    made = F.transform("rules", lambda rule: T.fold_hamza(F.array_join(F.transform(T.chars(rule), letter), "")))
    return hit.where(F.array_contains(made, F.col("root"))).select("cat", "stem", "root", "stem_len", "formula_id").distinct()


def vowelize(rows: DataFrame) -> DataFrame:
    """``rows`` with ``voweled``, the stem in its pattern with both clitics,
    and ``enc``, the enclitic's form. Each step binds the one before it once."""
    p_class, e_class, e = F.col("p_classe"), F.col("e_classe"), F.col("e_unvoweledform")
    article, sun = T.is_definite(p_class), T.is_solar(T.first(F.col("stem")))
    joined = e != ""

    def enclitic(v):
        v = F.regexp_replace(F.replace(v, F.lit("ة"), F.lit("ت")), "(وْ|ُو)ا\\z", "$1")
        return T.let(v, lambda x: F.struct(x.alias("v"), harmonised(e, F.col("e_voweledform"), x).alias("enc")))

    def joint(s):
        v = F.when((e == "ي") & s["v"].rlike("[َُ]\\z"), F.concat(T.but_last(s["v"]), F.lit("ِ"))).otherwise(s["v"])
        return F.struct(F.replace(v, F.lit("ى"), F.lit("ا")).alias("v"), s["enc"].alias("enc"))

    def attach(s):
        v, enc = s["v"], s["enc"]
        long = ~(v.endswith("يْ") & (e_class == "N1")) & (v.endswith("ْ") | (F.length(enc) == 1) | ~T.is_diacritic(F.substring(enc, 2, 1)))
        return F.struct(F.when(long, T.join_enclitic(enc, v)).otherwise(F.concat(v, enc)).alias("v"), enc.alias("enc"))

    def front(v):
        wasl = (F.col("p_unvoweledform") == "أ") & (F.length(v) > 3) & v.startswith("ا") & (F.substring(v, 3, 1) == "ْ")
        v = F.when(wasl, F.substring(v, 2, 1 << 20)).otherwise(v)
        return F.concat(F.col("p_voweledform"), F.when(article & ~sun, F.lit("ْ")).otherwise(F.lit("")), v)

    double = lambda v: F.when((e_class == "N1") & v.endswith("يْي"), F.concat(T.but_last(v, 2), F.lit("\u0651\u064e"))).otherwise(v)
    pattern = F.when(e_class == "V4", F.regexp_replace("diac_pattern", "[ًٌٍَُِْ]\\z", "ُ")).otherwise(F.col("diac_pattern"))
    body = T.let(T.fill_letters(pattern, F.col("stem")), lambda v: F.when(article & sun, F.concat(T.first(v), F.lit("ّ"), F.substring(v, 2, 1 << 20))).otherwise(v))
    alone = F.struct(body.alias("v"), F.lit("").alias("enc"))
    rows = rows.withColumn("_s", F.when(joined, T.let(T.let(T.let(body, enclitic), joint), attach)).otherwise(alone))
    return rows.withColumns({"voweled": T.let(T.let(spell_hamza(F.col("_s.v")), front), double), "enc": F.col("_s.enc")}).drop("_s")


def derived(segs: DataFrame, lex: Lexicon, cats: tuple[str, ...] = ("Nouns", "Verbs")) -> DataFrame:
    """Segments with all that roots and formulas say of their stems, vowelised:
    a written table, that ``nouns`` and ``verbs`` filter."""
    found = solutions(segs, lex).join(lex.reading, ["cat", "root", "stem_len", "formula_id"])
    allowed = {
        "Verbs": F.length("stem").between(1, 9) & ~_has("p_classe", "N") & ~_has("e_classe", "N"),
        "Nouns": F.length("stem").between(2, 11) & ~_has("p_classe", "V") & ~_has("e_classe", "V"),
    }
    gate = reduce(lambda a, b: a | b, [(F.col("cat") == c) & allowed[c] for c in cats])
    return materialized(vowelize(materialized(segs.join(found, "stem").where(gate), "derived")), "vowelised")


#: Endings of the subject and their names, by tense and pronoun.
PAST = {
    "أنا": ("ت", "تاء المتكلم"), "نحن": ("نا", "نون المتكلمين"), "أنتَ": ("ت", "تاء المخاطب"), "أنتِ": ("ت", "تاء المخاطبة"),
    "أنتما": ("تما", "تاء المخاطبين"), "أنتم": ("تم", "تاء المخاطبين"), "أنتن": ("تن", "تاء المخاطبات"), "هي": ("ت", "تاء التأنيث الساكنة"),
    "هما": ("ا", "ألف الاثنين"), "هما(ة)": ("تا", "تاء التأنيت وألف الاثنين"), "هم": ("وا", "واو الجماعة"), "هن": ("ن", "نون النسوة"),
}
COMMAND = {"أنتِ": ("ي", "ياء المخاطبة"), "أنتما": ("ا", "ألف المثنى"), "أنتم": ("وا", "واو الجماعة"), "أنتن": ("ن", "نون النسوة")}
PRESENT = {"هن": ("ن", "نون النسوة"), "أنتن": ("ن", "نون النسوة"), "أنتِ": ("ي", "ياء المخاطبة"), "أنتما": ("ا", "ألف المثنى"), "هما(ة)": ("ا", "ألف المثنى"), "هما": ("ا", "ألف المثنى"), "أنتم": ("وا", "واو الجماعة"), "هم": ("وا", "واو الجماعة")}
INDICATIVE = {"أنتِ": ("ين", "ياء المخاطبة والنون علامة الرفع"), "أنتما": ("ان", "ألف المثنى والنون علامة الرفع"), "هما(ة)": ("ان", "ألف المثنى والنون علامة الرفع"), "هما": ("ان", "ألف المثنى والنون علامة الرفع"), "أنتم": ("ون", "واو الجماعة والنون علامة الرفع"), "هم": ("ون", "واو الجماعة والنون علامة الرفع")}


def _affix(form: str, description: str) -> Column:
    return F.struct(F.lit(form).alias("form"), F.lit(description).alias("description"))


def _lookup(key: str, table: dict) -> Column:
    return reduce(lambda acc, kv: acc.when(F.col(key) == kv[0], _affix(*kv[1])), table.items(), F.when(F.lit(False), _affix("", "")))


def subject_affixes() -> tuple[Column, Column]:
    """Prefix of the imperfect and suffix of the subject; null where none."""
    letter = "حرف المضارعة"
    prefix = F.when(F.col("type") == "مضارع", F.when(F.col("person") == "مخاطب", _affix("ت", letter)).when(F.col("person2") == "أنا", _affix("أ", letter)).when(F.col("person2") == "نحن", _affix("ن", letter)).when(F.col("person2") == "هي", _affix("ت", "تاء الغائبة")).when(F.col("person2") == "هما(ة)", _affix("ت", letter)).otherwise(_affix("ي", letter)))
    addressed = F.col("person") == "مخاطب"
    suffix = (
        F.when(F.col("emphasized") == "مؤكد", F.when(addressed, _affix("ن", "نون التوكيد")))
        .when(F.col("type") == "أمر", F.when(addressed, _lookup("person2", COMMAND)))
        .when(F.col("type") == "ماض", _lookup("person2", PAST))
        .when((F.col("type") == "مضارع") & (F.col("casemood") == "مرفوع"), F.coalesce(_lookup("person2", INDICATIVE), _lookup("person2", PRESENT)))
        .when(F.col("type") == "مضارع", _lookup("person2", PRESENT))
    )
    return prefix, suffix


def verbs(rows: DataFrame) -> DataFrame:
    """``rows``: of ``derived``."""
    rows = rows.where(F.col("cat") == "Verbs")
    tense, mood, p, e = F.col("type"), F.col("casemood"), F.col("p_classe"), F.col("e_classe")
    wrong_mood = reduce(lambda a, b: a | b, [(p == c) & (tense != "مضارع") & (mood != m) for c, m in (("V1", "مرفوع"), ("V2", "منصوب"), ("V3", "مجزوم"))])
    bad = ((F.col("transitivity") == "لازم") & (F.col("e_unvoweledform") != "")) | wrong_mood | ((p == "C2") & (tense == "أمر")) | (e.isin("V2", "V3") & (tense == "أمر")) | ((e == "V4") & (F.col("person2") != "أنتم"))
    rows = rows.where(~bad & ~T.incompatible(F.col("norm"), F.col("voweled"), F.col("e_unvoweledform")))
    prefix, suffix = subject_affixes()
    rows = rows.withColumns({"prefix": prefix, "suffix": suffix})
    text = lambda c: F.concat(F.col(f"{c}.form"), F.lit("|"), F.col(f"{c}.description"))
    pro, enc = _column(F.col("p_voweledform"), F.col("p_desc"), "|"), _column(F.col("enc"), F.col("e_desc"), "|")
    pro = F.when(F.col("prefix").isNull(), pro).when(F.col("p_voweledform") == "", text("prefix")).otherwise(F.concat(pro, F.lit("+"), text("prefix")))
    enc = F.when(F.col("suffix").isNull(), enc).when(F.col("enc") == "", text("suffix")).otherwise(F.concat(text("suffix"), F.lit("+"), enc))
    one = lambda c: F.when(F.col(c).isNull(), F.array().cast(AFFIX)).otherwise(F.array(F.col(c)).cast(AFFIX))
    return _raw(
        rows, 4, order=F.concat_ws("/", "root", F.lpad(F.col("formula_id").cast("string"), 9, "0")), voweled=F.col("voweled"), proclitic=pro, stem=F.coalesce("made", T.stem_hamza(F.col("stem"))), part_of_speech=F.col("label"),
        diac_pattern=F.col("diac_pattern"), pattern=F.col("pattern"), lemma=F.col("lemma"), lemma_pattern=F.col("lemma_pattern"), root=F.col("root"), casemood=F.col("casemood"), enclitic=enc, priority=F.col("priority"),
        pos=F.col("main"), tense=F.col("type"), voice=F.col("voice"), person=F.col("person"), pronoun=F.col("person2"), transitivity=F.col("transitivity"), augmentation=F.col("augmented"),
        emphatic=F.col("emphasized") == "مؤكد", prefixes=one("prefix"), suffixes=one("suffix"),
    )


def number_suffixes() -> tuple[Column, Column]:
    """Suffixes of gender and number that the stem shows, and whether its form
    is that of a construct, which the article excludes."""
    st, gender, number = F.col("stem"), F.col("gender"), F.col("number")
    ta, case = ("ة", "تاء التأنيث"), "علامة الإعراب"
    many = lambda *xs: F.array(*[_affix(*x) for x in xs]).cast(AFFIX)

    def pick(*options):
        out, construct = F.when(F.lit(False), F.array().cast(AFFIX)), F.when(F.lit(False), False)
        for end, xs, bound in options:
            out, construct = out.when(st.endswith(end), many(*xs)), construct.when(st.endswith(end), F.lit(bound))
        return out, construct

    fem, masc = gender == "مؤنث", gender == "مذكر"
    broken = (T.strip_diacritics(F.col("pattern")) == "مفاعل") | (F.col("pattern") == "فَعَالِي")
    table = [
        (fem & (number == "مفرد") & st.endswith("ة"), pick(("ة", [ta], False))),
        (fem & (number == "مثنى"), pick(("تان", [ta, ("ان", case)], False), ("تين", [ta, ("ين", case)], False), ("تا", [ta, ("ا", case)], True), ("تي", [ta, ("ي", case)], True))),
        (fem & (number == "جمع"), pick(("ات", [("ات", "تاء التأنيث")], False))),
        (masc & (number == "مثنى"), pick(("ان", [("ان", case)], False), ("ين", [("ين", case)], False), ("ا", [("ا", case)], True), ("ي", [("ي", case)], True))),
        (masc & (number == "جمع") & ~broken, pick(("ون", [("ون", case)], False), ("ين", [("ين", case)], False), ("و", [("و", case)], True), ("ي", [("ي", case)], True))),
    ]
    found, bound = F.when(F.lit(False), F.array().cast(AFFIX)), F.when(F.lit(False), False)
    for when, (xs, construct) in table:
        found, bound = found.when(when, xs), bound.when(when, construct)
    return F.coalesce(found, F.array().cast(AFFIX)), F.coalesce(bound, F.lit(False))


def nouns(rows: DataFrame) -> DataFrame:
    """``rows``: of ``derived``."""
    rows = rows.where(F.col("cat") == "Nouns")
    v = F.col("voweled")
    v = F.when((F.col("number") != "مثنى") & v.endswith("ءَانِ"), F.replace(v, F.lit("ءَانِ"), F.lit("آنِ"))).otherwise(v)
    rows = rows.withColumn("voweled", F.replace(F.replace(v, F.lit("لَلْلّ"), F.lit("لَلّ")), F.lit("لِلْلّ"), F.lit("لِلّ")))
    article = T.is_definite(F.col("p_classe"))
    rows = rows.where(~((F.col("definit") == "معرف بأل") & ~article) & ~(article & F.col("definit").isin("مضاف إلى معرفة", "مضاف إلى نكرة", "غير مضاف")))
    spared = F.col("voweled") == F.col("norm")
    rows = rows.where(_clitics_allow(F.col("casemood"), F.col("voweled"), spared) & ~T.incompatible(F.col("norm"), F.col("voweled"), F.col("e_unvoweledform")))
    found, bound = number_suffixes()
    rows = rows.withColumns({"found": found, "bound": bound}).where(~(article & F.col("bound")))
    state = F.when(article, "معرف").otherwise(F.col("definit"))
    text = F.array_join(F.transform("found", lambda a: F.concat(a["form"], F.lit(": "), a["description"])), " + ")
    enc = _column(F.col("enc"), F.col("e_desc"), ": ")
    enc = F.when(text == "", enc).when(enc == "#", text).otherwise(F.concat(text, F.lit(" + "), enc))
    case = F.when(F.col("p_classe").isin("N4", "N5") & (F.col("casemood") == "منصوب") & spared, "مجرور").otherwise(F.col("casemood"))
    return _raw(
        rows, 3, order=F.concat_ws("/", "root", F.lpad(F.col("formula_id").cast("string"), 9, "0")), voweled=F.col("voweled"), proclitic=_column(F.col("p_voweledform"), F.col("p_desc"), ": "), stem=F.coalesce("made", T.stem_hamza(F.col("stem"))),
        part_of_speech=F.concat_ws("|", "main", "type", "number", "gender", state), diac_pattern=F.col("diac_pattern"), pattern=F.col("pattern"), lemma=F.col("lemma"), lemma_pattern=F.col("lemma_pattern"), root=F.col("root"), casemood=case, enclitic=enc, priority=F.col("priority"),
        pos=F.col("main"), type=F.col("type"), gender=F.col("gender"), number=F.col("number"), state=T.given(state), suffixes=F.col("found"),
    )
