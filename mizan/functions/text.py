"""Column functions over Arabic words. All are built-in expressions; none
normalises Unicode, because the order of marks carries meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mizan.functions.letters import (
    ARABIC, CARRIERS, DEFINITE, DIACRITICS, FATHA, FATHATAN, HAMZA, LATIN, LETTERS, NOT_SHADDA, SHADDA, SOLAR,
)

D, N = f"[{DIACRITICS}]", f"[{NOT_SHADDA}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_diacritic(c: Column) -> Column:
    return (F.length(c) > 0) & (F.instr(F.lit(DIACRITICS), c) > 0)


def is_hamza(c: Column) -> Column:
    return (F.length(c) > 0) & (F.instr(F.lit(HAMZA + CARRIERS), c) > 0)


def is_solar(c: Column) -> Column:
    return (F.length(c) > 0) & (F.instr(F.lit(SOLAR), c) > 0)


def is_definite(classe: Column) -> Column:
    return classe.isin(*DEFINITE)


def first(w: Column) -> Column:
    return F.substring(w, 1, 1)


def last(w: Column, n: int = 1) -> Column:
    return F.right(w, F.lit(n))


def but_last(w: Column, n: int = 1) -> Column:
    return F.left(w, F.greatest(F.length(w) - n, F.lit(0)))


def strip_diacritics(w: Column) -> Column:
    return F.translate(w, DIACRITICS, "")


def strip_last_diacritic(w: Column) -> Column:
    """Without one final mark; a shadda stays."""
    return F.regexp_replace(w, N + r"\z", "")


def strip_case_ending(w: Column) -> Column:
    """Without the marks at the end, but for a shadda; a tanween before a final
    alif becomes the short vowel."""
    run = F.regexp_extract(w, f"({D}+)\\z", 1)
    tail = F.regexp_extract(w, f"({D}+)[اى]\\z", 1)
    keep = lambda x: F.when(F.instr(x, SHADDA) > 0, F.lit(SHADDA)).otherwise(F.lit(""))
    return F.when(run != "", F.concat(F.regexp_replace(w, f"{D}+\\z", ""), keep(run))).when(
        F.instr(tail, FATHATAN) > 0, F.concat(F.regexp_replace(w, f"{D}*[اى]\\z", ""), keep(tail), F.lit(FATHA), last(w))
    ).otherwise(w)


def fold_hamza(w: Column) -> Column:
    return F.translate(w, CARRIERS, HAMZA * len(CARRIERS))


def drop_hamza(w: Column) -> Column:
    return F.translate(w, CARRIERS, "")


def first_hamza(w: Column) -> Column:
    """The first carrier in the word, or the empty string."""
    return F.regexp_extract(w, f"[{CARRIERS}]", 0)


#: Ordered rewrites of spelling slips; ``\z`` marks the end.
REWRITES = (
    ("ٱ", "ا"), ("اُ", "ا"), ("اَّ", "َّا"), ("ىً\\z", "ًى"), ("اً\\z", "ًا"),
    ("اَ", "ا"), ("اِ", "ا"), ("ِا", "ا"), ("آَ", "آ"),
)


def normalize_word(w: Column) -> Column:
    """Common slips in the order of marks and alifs, put right."""
    w = F.when((F.length(w) >= 3) & (F.substring(w, 2, 1) == SHADDA), F.concat(first(w), F.substring(w, 3, 1 << 20))).otherwise(w)
    for wrong, right in REWRITES:
        w = F.regexp_replace(w, wrong, right) if wrong.endswith("\\z") else F.replace(w, F.lit(wrong), F.lit(right))
    return w


def to_arabic(w: Column) -> Column:
    return F.translate(w, LATIN, ARABIC)


def to_latin(w: Column) -> Column:
    return F.translate(w, ARABIC, LATIN)


def given(c: Column) -> Column:
    """Null for the placeholders of absent values."""
    return F.when(~c.isin("", "-", "#"), c)


def as_score(x: Column) -> Column:
    return F.format_string("%.10f", x)


def join_enclitic(enclitic: Column, word: Column) -> Column:
    """The enclitic's long vowel turns the word's last mark into its own."""
    head = first(enclitic)
    vowel = F.when(head == "و", "ُ").when(head == "ي", "ِ").when(head == "ا", "َ")
    return F.when(vowel.isNotNull(), F.concat(but_last(word), vowel, enclitic)).otherwise(F.concat(word, enclitic))


def fits_pattern(stem: Column, pattern: Column) -> Column:
    """Each letter of the pattern but its three slots is also the stem's."""
    n = F.least(F.length(stem), F.length(pattern))
    chars = F.filter(F.split(F.left(pattern, n), ""), lambda c: c != "")
    return F.forall(F.transform(chars, lambda c, i: c.isin("ف", "ع", "ل") | (c == F.substring(stem, i + 1, 1))), lambda ok: ok)


def tokenize(text: Column) -> Column:
    """Sentences as arrays of words; sentences without words drop out."""
    sentences = F.split(F.translate(text, "ـ", ""), "[.!:،؟؛\n]")
    word = f"[{LETTERS}][{LETTERS}{DIACRITICS}]*"
    words = F.transform(sentences, lambda s: F.transform(F.regexp_extract_all(s, F.lit(word), F.lit(0)), normalize_word))
    return F.filter(words, lambda s: F.size(s) > 0)


def chars(w: Column) -> Column:
    return F.filter(F.split(w, ""), lambda c: c != "")


def fill_letters(pattern: Column, stem: Column) -> Column:
    """The pattern's marks with the stem's letters in their order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(is_diacritic(c), F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))).otherwise(
        F.struct(F.concat(a["s"], F.substring(stem, a["k"], 1)).alias("s"), (a["k"] + 1).alias("k"))
    )
    return F.aggregate(chars(pattern), start, step, lambda a: a["s"])


def fill_root(root: Column, pattern: Column) -> Column:
    """The root's letters in the slots of the pattern, before hamza spelling.
    The third slot stands for the letters from the third on, the last repeating."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def step(a, c):
        put = F.when(c == "ف", F.substring(root, 1, 1)).when(c == "ع", F.substring(root, 2, 1)).when(
            c == "ل", F.substring(root, F.lit(3) + F.least(a["k"], F.length(root) - 3), 1)
        ).otherwise(c)
        return F.struct(F.concat(a["s"], put).alias("s"), (a["k"] + F.when(c == "ل", 1).otherwise(0)).alias("k"))

    return F.aggregate(chars(pattern), start, step, lambda a: a["s"])


def instantiate(root: Column, pattern: Column) -> Column:
    from mizan.functions.hamza import spell_hamza

    return spell_hamza(fill_root(root, pattern))


def stem_hamza(s: Column) -> Column:
    """A hamza before alif, but not after one, is written as one letter."""
    return F.regexp_replace(s, "(?<!ا)[ءأ]ا", "آ")


def incompatible(word: Column, voweled: Column, enclitic: Column | None = None) -> Column:
    """Whether ``voweled`` contradicts the letters or marks of the input word.
    With an enclitic column hamza carriers count as one letter."""
    fold = enclitic is not None
    nor, vow = word, voweled
    if fold:
        relax = ((enclitic != "") | (last(nor) == "ِ")) & (last(vow) == "ْ") & is_diacritic(last(nor))
        nor, vow = F.when(relax, but_last(nor)).otherwise(nor), F.when(relax, but_last(vow)).otherwise(vow)
    return let(F.struct(nor.alias("n"), vow.alias("v")), lambda x: _contradicts(x["n"], x["v"], fold))


def _contradicts(nor: Column, vow: Column, fold: bool) -> Column:
    start = F.struct(F.lit(1).alias("i"), F.lit(True).alias("ok"))

    def step(a, v):
        c = F.substring(nor, a["i"], 1)
        same = (c == v) | ((c == "ا") & (v == "ى"))
        if fold:
            same = same | (fold_hamza(c) == fold_hamza(v))
        ended = (c == "") | ~a["ok"]
        skip = ~is_diacritic(c) & is_diacritic(v)
        return F.when(ended, a).when(same, F.struct((a["i"] + 1).alias("i"), F.lit(True).alias("ok"))).when(skip, a).otherwise(
            F.struct(a["i"].alias("i"), F.lit(False).alias("ok"))
        )

    walk = F.aggregate(chars(vow), start, step, lambda a: ~a["ok"])
    return (vow.endswith("َا") & nor.endswith("اً")) | (F.length(strip_diacritics(nor)) != F.length(strip_diacritics(vow))) | walk
