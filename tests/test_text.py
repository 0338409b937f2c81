"""Column functions against fixed expectations."""

import pytest
from pyspark.sql import functions as F

from mizan.functions import text as T


def one(spark, f, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()[0]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (T.strip_diacritics, "مُسْتَوَى", "مستوى"), (T.strip_last_diacritic, "كَتَبَ", "كَتَب"), (T.strip_last_diacritic, "أَنّ", "أَنّ"),
        (T.strip_case_ending, "عَنْدَلِيبٌ", "عَنْدَلِيب"), (T.strip_case_ending, "قَالٌّ", "قَالّ"), (T.strip_case_ending, "كِتَابًا", "كِتَابَا"),
        (T.strip_case_ending, "فَتًى", "فَتَى"), (T.strip_case_ending, "يَكْتُبُوا", "يَكْتُبُوا"), (T.strip_case_ending, "", ""),
        (T.fold_hamza, "مؤمن", "مءمن"), (T.drop_hamza, "سأل", "سل"), (T.first_hamza, "مؤمن", "ؤ"), (T.first_hamza, "كتب", ""),
        (T.normalize_word, "ٱلكتاب", "الكتاب"), (T.stem_hamza, "قرءان", "قرآن"), (T.to_latin, "كتب", "ktb"), (T.to_arabic, "ktb", "كتب"),
    ],
)
def test_scalars(spark, f, given, want):
    assert one(spark, f, given) == want


@pytest.mark.parametrize("root, pattern, want", [("كتب", "مَفْعُول", "مَكْتُوب"), ("سءل", "فَعَلَ", "سَأَلَ"), ("ءكل", "فَاعِل", "آكِل"), ("سءل", "فُعِلَ", "سُئِلَ"), ("قرء", "فِعَالَة", "قِرَاءَة"), ("رءس", "فَعِيل", "رَئِيس"), ("سءل", "فُعَال", "سُؤَال"), ("عندلب", "فَعْلَلِيل", "عَنْدَلِيب")])
def test_roots_in_patterns(spark, root, pattern, want):
    assert one(spark, T.instantiate, root, pattern) == want


def test_compatibility(spark):
    assert not one(spark, T.incompatible, "كتب", "كَتَبَ", "")
    assert one(spark, T.incompatible, "كُتب", "كَتَبَ", "")
    assert one(spark, T.fits_pattern, "كتب", "فعل") and not one(spark, T.fits_pattern, "كتب", "فمل")


def test_tokenize(spark):
    assert one(spark, T.tokenize, "ذهب الولد. إلى المدرسة!abc") == [["ذهب", "الولد"], ["إلى", "المدرسة"]]
