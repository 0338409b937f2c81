"""A small self-authored lexicon in the layout of a full one, for tests and
demonstrations. Frequencies are invented."""

from __future__ import annotations

import gzip
import json
import os

from mizan.functions.letters import DIACRITICS, LETTERS
from mizan.sources.lexicon import CORPUS_COUNTS, DERIVED_FILES, FEATURE_FILE, FEATURES, FILES

_BARE = str.maketrans("", "", DIACRITICS)


def _bare(s: str) -> str:
    return s.translate(_BARE)


def _clitic(unv, voweled, desc, classe):
    return {"unvoweledform": unv, "voweledform": voweled, "desc": desc, "classe": classe}


PROCLITICS = [
    _clitic("", "", None, "C1"), _clitic("و", "وَ", "حرف العطف", "C1"), _clitic("ف", "فَ", "حرف العطف", "C1"),
    _clitic("ال", "ال", "أداة التعريف", "N1"), _clitic("وال", "وَال", "حرف العطف وأداة التعريف", "N1"),
    _clitic("ب", "بِ", "حرف الجر", "N4"), _clitic("ل", "لِ", "حرف الجر", "N4"), _clitic("ل", "لِ", "لام التعليل", "V2"),
    _clitic("ل", "لَ", "لام التوكيد", "C2"), _clitic("ك", "كَ", "حرف الجر", "N4"), _clitic("بال", "بِال", "حرف الجر وأداة التعريف", "N5"),
    _clitic("لل", "لِل", "حرف الجر وأداة التعريف", "N5"), _clitic("س", "سَ", "سين الاستقبال", "V1"), _clitic("أ", "أَ", "همزة الاستفهام", "C1"),
]
ENCLITICS = [
    _clitic("", "", None, "C1"), _clitic("ه", "هُ", "ضمير الغائب", "C1"), _clitic("هم", "هُمْ", "ضمير الغائبين", "C1"), _clitic("هن", "هُنَّ", "ضمير الغائبات", "C1"),
    _clitic("هما", "هُمَا", "ضمير الغائبين", "C1"), _clitic("ها", "هَا", "ضمير الغائبة", "C1"), _clitic("ك", "كَ", "ضمير المخاطب", "C1"),
    _clitic("ي", "ي", "ضمير المتكلم", "N1"), _clitic("نا", "نَا", "ضمير المتكلمين", "C1"), _clitic("ني", "نِي", "ضمير المتكلم", "V2"),
]
EXCEPTIONAL = [
    (f"{p}{s}", {"voweledform": v, "proclitic": q, "stem": "اللَّه", "pos": "اسم الجلالة", "enclitic": "#"})
    for p, s, v, q in [("", "الله", "اللَّه", "#"), ("و", "الله", "وَاللَّه", "وَ"), ("ب", "الله", "بِاللَّه", "بِ"), ("ف", "الله", "فَاللَّه", "فَ")]
]
TOOL_POS = ["حرف|جر", "حرف|ناسخ", "اسم|ضمير|مذكر|مفرد|الغائب", "حرف|نفي", "حرف|عطف", "جار ومجرور"]
TOOLS = [("إِلَى", "C1", "C1", 1), ("مِنْ", "C1", "C1N1", 1), ("فِي", "C1", "C1", 1), ("لِأَنَّ", "C1", "C1N1", 2), ("هُوَ", "C1", "C1", 3), ("لَا", "C1", "C1", 4), ("ثُمَّ", "C1", "C1", 5), ("عَلَى", "C1", "C1", 1), ("إِنَّ", "C1", "C1N1", 2), ("مَنْ", "C1N4", "C1", 3)]
PN_POS = [{"main": "اسم", "type": "اسم علم", "gender": "مذكر", "number": "مفرد", "definit": "معرف"}, {"main": "اسم", "type": "اسم علم", "gender": "مؤنث", "number": "مفرد", "definit": "معرف"}]
PN_CASES = ["مرفوع", "منصوب", "مجرور"]
NAMES = [("مُحَمَّد", "حمد", 1), ("أَحْمَد", "حمد", 1), ("مِصْر", "مصر", 2), ("زَيْنَب", "-", 2), ("خَالِد", "خلد", 1), ("فَاطِمَة", "فطم", 2)]
_NOUN_CASES = [("ُ", "مرفوع", "مضاف إلى معرفة"), ("َ", "منصوب", "مضاف إلى معرفة"), ("ِ", "مجرور", "مضاف إلى معرفة"), ("ٌ", "مرفوع", "غير مضاف"), ("ٍ", "مجرور", "غير مضاف"), ("ًا", "منصوب", "غير مضاف"), ("ُ", "مرفوع", "معرف بأل"), ("َ", "منصوب", "معرف بأل"), ("ِ", "مجرور", "معرف بأل")]
_FEM = [c for c in _NOUN_CASES if c[0] != "ًا"] + [("ً", "منصوب", "غير مضاف")]
#: roots, pattern without ending, type, gender, number, pattern of the lemma.
_NOUNS = [
    ("كتب درس علم", "فِعَال", "مصدر", "مذكر", "مفرد", None),
    ("كتب درس علم ذهب عمل قرء سءل", "فَاعِل", "اسم فاعل", "مذكر", "مفرد", None),
    ("كتب علم ذهب عمل", "مَفْعُول", "اسم مفعول", "مذكر", "مفرد", None),
    ("درس كتب", "مَفْعَلَة", "اسم مكان", "مؤنث", "مفرد", None),
    ("درس علم", "مُفَعِّلَة", "اسم فاعل", "مؤنث", "مفرد", None),
    ("درس علم", "مُفَعِّل", "اسم فاعل", "مذكر", "مفرد", None),
    ("ولد عمل", "فَعَل", "اسم جامد", "مذكر", "مفرد", None),
    ("عندلب", "فَعْلَلِيل", "اسم جامد", "مذكر", "مفرد", None),
    ("سءل قرء", "فِعَالَة", "مصدر", "مؤنث", "مفرد", None),
]
_DUAL = [("تَانِ", "مرفوع", "غير مضاف"), ("تَيْنِ", "منصوب", "غير مضاف"), ("تَيْنِ", "مجرور", "غير مضاف"), ("تَا", "مرفوع", "مضاف إلى معرفة")]
_PLURAL = [("ُونَ", "مرفوع", "غير مضاف"), ("ِينَ", "منصوب", "غير مضاف"), ("ِينَ", "مجرور", "غير مضاف"), ("ُو", "مرفوع", "مضاف إلى معرفة")]
#: pattern, tense, mood, person, pronoun.
_VERB_FORMS = [
    ("فَعَلَ", "ماض", "مبني", "غائب", "هو"), ("فَعَلَتْ", "ماض", "مبني", "غائب", "هي"), ("فَعَلُوا", "ماض", "مبني", "غائب", "هم"), ("فَعَلْتُ", "ماض", "مبني", "متكلم", "أنا"),
    ("فَعَلْنَا", "ماض", "مبني", "متكلم", "نحن"), ("يَفْعُلُ", "مضارع", "مرفوع", "غائب", "هو"), ("يَفْعُلَ", "مضارع", "منصوب", "غائب", "هو"), ("يَفْعُلْ", "مضارع", "مجزوم", "غائب", "هو"),
    ("تَفْعُلُ", "مضارع", "مرفوع", "غائب", "هي"), ("يَفْعُلُونَ", "مضارع", "مرفوع", "غائب", "هم"), ("يَفْعُلُوا", "مضارع", "منصوب", "غائب", "هم"), ("يَفْعُلُوا", "مضارع", "مجزوم", "غائب", "هم"),
    ("نَفْعُلُ", "مضارع", "مرفوع", "متكلم", "نحن"), ("اُفْعُلْ", "أمر", "مبني", "مخاطب", "أنتَ"),
]
_VERBS = [("كتب درس ولد", "متعد", "َ"), ("علم عمل", "متعد", "َ"), ("ذهب", "لازم", "َ")]


def _entries():
    """(cat, root, diac pattern, canonic pattern, diac lemma, canonic lemma, features, case or mood)."""
    for roots, base, kind, gender, number, _ in _NOUNS:
        fem = base.endswith("ة")
        for root in roots.split():
            main = {"Main": "اسم", "Type": kind, "NbRoot": "ثلاثي" if len(root) == 3 else "خماسي", "Gender": gender, "Number": number}
            for end, case, state in _FEM if fem else _NOUN_CASES:
                yield "Nouns", root, base + end, base + end, base, base, main | {"Definit": state}, case
            if fem:
                for end, case, state in _DUAL:
                    yield "Nouns", root, base[:-1] + end, base[:-1] + end, base, base, main | {"Definit": state, "Number": "مثنى"}, case
            elif base == "مُفَعِّل":
                for end, case, state in _PLURAL:
                    yield "Nouns", root, base + end, base + end, base, base, main | {"Definit": state, "Number": "جمع"}, case
    for roots, trans, _ in _VERBS:
        for root in roots.split():
            for form, tense, mood, person, pronoun in _VERB_FORMS:
                main = {"Main": "فعل", "Type": tense, "Emphasized": "غير مؤكد", "Voice": "معلوم", "NbRoot": "ثلاثي", "Augmented": "مجرد", "Person": person, "Person2": pronoun, "Transitivity": trans}
                yield "Verbs", root, form, form, "فَعَلَ", "فَعَلَ", main, mood


def _freq(s: str) -> str:
    return f"{(sum(map(ord, s)) % 97 + 1) / 1000:.4f}"


def tables() -> dict[str, list]:
    """Records of each file, in order."""
    out: dict[str, list] = {}
    for name, rows in (("proclitics", PROCLITICS), ("enclitics", ENCLITICS)):
        by: dict[str, list] = {}
        for c in rows:
            by.setdefault(c["unvoweledform"], []).append(c)
        out[FILES[name]] = [{"key": k, "value": v} for k, v in by.items()]
    out[FILES["exceptional"]] = [{"key": k, "value": v} for k, v in EXCEPTIONAL]
    at: dict[str, list[int]] = {}
    for i, (v, *_) in enumerate(TOOLS, 1):
        at.setdefault(_bare(v), []).append(i)
    out[FILES["toolwords_unvoweled"]] = [{"key": k, "value": " ".join(map(str, v))} for k, v in at.items()]
    out[FILES["toolwords_voweled"]] = [{"voweledform": v, "procClass": p, "encClass": e, "lemma": v, "root": "-", "pos": str(k)} for v, p, e, k in TOOLS]
    out[FILES["toolwords_pos"]] = TOOL_POS
    at, voweled = {}, []
    for v, root, kind in NAMES:
        for c, end in enumerate(("ُ", "َ", "ِ"), 1):
            voweled.append({"vowform": v + end, "lemma": v, "root": root, "pos": str(kind), "cas": str(c)})
            at.setdefault(_bare(v), []).append(len(voweled))
    out[FILES["propernoun_unvoweled"]] = [{"key": k, "value": " ".join(map(str, v))} for k, v in at.items()]
    out[FILES["propernoun_voweled"]] = voweled
    out[FILES["propernoun_pos"]] = PN_POS
    out[FILES["propernoun_casemood"]] = [{"valAR": c} for c in PN_CASES]
    for cat in ("Verbs", "Nouns"):
        out |= _derived(cat)
    out[CORPUS_COUNTS["lemma"]] = [{"key": v, "value": 0.001 * (i + 1)} for i, (v, *_) in enumerate(TOOLS)]
    out[CORPUS_COUNTS["stem"]] = [{"key": "كتب", "value": 5}, {"key": "ذهب", "value": 4}]
    out[CORPUS_COUNTS["root"]] = [{"key": "كتب", "value": 50}, {"key": "درس", "value": 40}, {"key": "ذهب", "value": 30}]
    return out


def _derived(cat: str) -> dict[str, list]:
    kinds: dict[str, dict[int, list[str]]] = {k: {} for k in ("diac_stem", "canonic_stem", "diac_lemma", "canonic_lemma")}
    values: dict[str, list[str]] = {f: [] for f in FEATURES[cat]}
    cases: list[str] = []
    pos: list[tuple] = []
    formulas: dict[int, list[tuple]] = {}
    skeletons: dict[int, dict[str, tuple[str, list[int]]]] = {}
    roots: dict[str, dict[int, list[int]]] = {}

    def place(items: list, x) -> int:
        if x not in items:
            items.append(x)
        return items.index(x) + 1

    def pattern(kind: str, p: str) -> tuple[int, int]:
        n = len(_bare(p))
        return n, place(kinds[kind].setdefault(n, []), p)

    for c, root, ds, cs, dl, cl, feats, case in _entries():
        if c != cat:
            continue
        # Quinqueliteral patterns have a slot for each letter of the root.
        n, ds_id = pattern("diac_stem", ds)
        others = [pattern(k, p) for k, p in (("canonic_stem", cs), ("diac_lemma", dl), ("canonic_lemma", cl))]
        code = tuple(place(values[f], feats[f]) for f in FEATURES[cat])
        f = place(formulas.setdefault(n, []), (ds_id, *others, place(pos, code), place(cases, case)))
        bare = _bare(ds)
        rule = "".join(str(i + 1) for i, x in enumerate(bare) if x in "فعل")
        if len(rule) > len(root):  # letters that only look like slots
            rule = rule[: len(root)]
        kept, ids = skeletons.setdefault(n, {}).setdefault(bare, (rule, []))
        if ds_id not in ids:
            ids.append(ds_id)
        slot = roots.setdefault(root, {}).setdefault(n, [])
        if f not in slot:
            slot.append(f)
    out = {DERIVED_FILES[k].format(cat=cat): [{"key": n, "value": [{"val": p, "freq": _freq(k + p)} for p in ps]} for n, ps in by.items()] for k, by in kinds.items()}
    out[DERIVED_FILES["unvoweled_stem"].format(cat=cat)] = [{"key": n, "value": [{"val": b, "rules": r, "ids": " ".join(map(str, i))} for b, (r, i) in by.items()]} for n, by in skeletons.items()]
    dotted = lambda x: f"{x[0]}.{x[1]}"
    out[DERIVED_FILES["formulas"].format(cat=cat)] = [
        {"key": n, "value": [{"idDiacPatternStem": str(d), "idCanonicPatternStem": dotted(a), "idDiacPatternLemma": dotted(b), "idCanonicPatternLemma": dotted(c), "idPartOfSpeech": str(p), "idCaseOrMood": str(m)} for d, a, b, c, p, m in fs]}
        for n, fs in formulas.items()
    ]
    out[DERIVED_FILES["pos"].format(cat=cat)] = [dict(zip((f.lower() for f in FEATURES[cat]), map(str, code))) | {"freq": _freq(str(code))} for code in pos]
    out[DERIVED_FILES["casemood"].format(cat=cat)] = [{"valAR": c, "valEN": ""} for c in cases]
    for f in FEATURES[cat]:
        out[FEATURE_FILE.format(cat=cat, feature=f)] = [{"valAR": v, "valEN": ""} for v in values[f]]
    for kind, fits in (("tri", lambda r: len(r) == 3), ("quad", lambda r: len(r) > 3)):
        by: dict[str, list] = {}
        ids = []
        for root, slots in roots.items():
            if fits(root):
                ids.append({"key": root, "value": len(by.setdefault(root[0], []))})
                by[root[0]].append({f"len{n}": " ".join(map(str, fs)) for n, fs in slots.items()})
        out[DERIVED_FILES[f"roots_{kind}"].format(cat=cat)] = [{"key": k, "value": v} for k, v in by.items()]
        out[DERIVED_FILES[f"roots_id_{kind}"].format(cat=cat)] = ids
    return out


#: A model of a few counts, in the length-prefixed layout.
MODEL_LINES = ["S0 1000"] + [f"S1 {len(w):02d} {w} {n}" for w, n in (("*ahaba", 40), ("<ilaY", 9), ("kataba", 25))] + ["B 041 *hb 4 061 *ahaba 3 ".replace("041", "031"), "A 061 *ahaba 8 051 <ilaY 4 "]


def write(folder: str) -> str:
    """Write the demo lexicon as gzip JSON Lines; returns the folder."""
    os.makedirs(folder, exist_ok=True)
    for name, records in tables().items():
        with gzip.open(f"{folder}/{name}.jsonl.gz", "wt", encoding="utf-8") as f:
            f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in records)
    return folder


assert set("".join(_bare(r) for r, *_ in TOOLS)) <= set(LETTERS)
