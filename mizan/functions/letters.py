"""Letters, marks and label sets of the analysis."""

FATHATAN, DAMMATAN, KASRATAN = "ً", "ٌ", "ٍ"
FATHA, DAMMA, KASRA, SHADDA, SUKUN = "َ", "ُ", "ِ", "ّ", "ْ"
DIACRITICS = "ًٌٍَُِّْ"
NOT_SHADDA = DIACRITICS.replace(SHADDA, "")
HAMZA, CARRIERS = "ء", "أؤإئ"
SOLAR = "تثدذرزسشصضطظلن"
DEFINITE = ("N1", "N2", "N3", "N5")
LETTERS = "ٱ" + "".join(map(chr, [*range(0x0621, 0x063B), *range(0x0641, 0x064B)]))
#: Latin transliteration and the letters it stands for, in order.
LATIN = "'|>&<}AbptvjHxd*rzs$SDTZEg_fqklmnhwYyFNKaui~o`{PJVGR,;?"
ARABIC = "ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىيًٌٍَُِّْٰٱپچڤگژ،؛؟"
TENSES = ("ماض", "مضارع", "أمر")
GENDERS = ("مذكر", "مؤنث", "مذكر أو مؤنث")
NUMBERS = ("مفرد", "مثنى", "جمع")
PERSONS = {"الغائب": "غائب", "المتكلم": "متكلم", "المخاطب": "مخاطب"}
SINGLE_SLOT = {"اسم الجلالة": ("اسم", "اسم الجلالة"), "جار ومجرور": ("حرف", "جار ومجرور")}
