"""SQL for DuckDB of the word functions and branches: the same rules, written as
expressions and folds over lists, for comparison with the column functions."""

from __future__ import annotations

from mizan.functions.letters import CARRIERS, DIACRITICS, HAMZA, NOT_SHADDA, SOLAR

KASRA, FATHA, DAMMA, SHADDA, SUKUN, FATHATAN = "ِ", "َ", "ُ", "ّ", "ْ", "ً"


def fold(x: str) -> str:
    return f"translate({x}, '{CARRIERS}', '{HAMZA * len(CARRIERS)}')"


def bare(x: str) -> str:
    return f"translate({x}, '{DIACRITICS}', '')"


def is_mark(x: str) -> str:
    return f"({x} <> '' AND contains('{DIACRITICS}', {x}))"


def strip_last(x: str) -> str:
    return f"regexp_replace({x}, '[{NOT_SHADDA}]$', '')"


def fill_letters(pattern: str, stem: str) -> str:
    step = f"CASE WHEN {is_mark('x.c')} THEN {{'c': '', 's': a.s || x.c, 'k': a.k}} ELSE {{'c': '', 's': a.s || substr({stem}, a.k, 1), 'k': a.k + 1}} END"
    return f"list_reduce(list_transform(string_split({pattern}, ''), lambda x: {{'c': x, 's': '', 'k': 1}}), lambda a, x: {step}, {{'c': '', 's': '', 'k': 1}}).s"


def join_enclitic(enclitic: str, word: str) -> str:
    vowel = f"CASE left({enclitic}, 1) WHEN 'و' THEN '{DAMMA}' WHEN 'ي' THEN '{KASRA}' WHEN 'ا' THEN '{FATHA}' END"
    return f"CASE WHEN left({enclitic}, 1) IN ('و', 'ي', 'ا') THEN left({word}, -1) || ({vowel}) || {enclitic} ELSE {word} || {enclitic} END"


def stem_hamza(s: str) -> str:
    return f"regexp_replace({s}, '(^|[^ا])[ءأ]ا', '\\1آ', 'g')"


def incompatible(word: str, voweled: str, enclitic: str | None = None) -> str:
    """Whether a vowelised form contradicts the letters or marks of a word."""
    folded = enclitic is not None
    last = lambda x: f"right({x}, 1)"
    relax = f"(({enclitic} <> '' OR {last(word)} = '{KASRA}') AND {last(voweled)} = '{SUKUN}' AND {is_mark(last(word))})"
    n = f"CASE WHEN {relax} THEN left({word}, -1) ELSE {word} END" if folded else word
    v = f"CASE WHEN {relax} THEN left({voweled}, -1) ELSE {voweled} END" if folded else voweled
    c = "substr(z.n, a.i::INT, 1)"
    same = f"({c} = x.c OR ({c} = 'ا' AND x.c = 'ى')" + (f" OR {fold(c)} = {fold('x.c')})" if folded else ")")
    step = (
        f"CASE WHEN {c} = '' OR NOT a.ok THEN a WHEN {same} THEN {{'c': '', 'i': a.i + 1, 'ok': true}} "
        f"WHEN NOT {is_mark(c)} AND {is_mark('x.c')} THEN a ELSE {{'c': '', 'i': a.i, 'ok': false}} END"
    )
    walk = f"list_reduce(list_transform(string_split(z.v, ''), lambda x: {{'c': x, 'i': 1, 'ok': true}}), lambda a, x: {step}, {{'c': '', 'i': 1, 'ok': true}}).ok"
    body = f"((z.v LIKE '%{FATHA}ا' AND z.n LIKE '%ا{FATHATAN}') OR length({bare('z.n')}) <> length({bare('z.v')}) OR NOT {walk})"
    return f"list_transform([{{'n': {n}, 'v': {v}}}], lambda z: {body})[1]"


def spell_hamza(word: str) -> str:
    """Every hamza of a word on its seat, from the letters and marks around it."""
    first = f"list_transform([{fold(word)}], lambda u: CASE WHEN length(u) > 1 AND u LIKE '{HAMZA}%' THEN (CASE WHEN substr(u, 2, 1) = '{KASRA}' THEN 'إ' ELSE 'أ' END) || substr(u, 2) ELSE u END)"
    start = f"list_transform({first}, lambda u: CASE WHEN u LIKE 'أ{FATHA}ا%' THEN 'آ' || substr(u, 4) WHEN u LIKE 'ا{HAMZA}{SUKUN}%' THEN 'ائ' || substr(u, 3) ELSE u END)"

    def at(k: int) -> str:
        return f"(CASE WHEN x.p + ({k}) >= 1 THEN substr(w, (x.p + ({k}))::INT, 1) ELSE '' END)"

    b3, b2, b1, f1, f2, f3 = at(-3), at(-2), at(-1), at(1), at(2), at(3)
    letters = f"length({bare('w')})"
    end = (
        f"(CASE WHEN x.p > 2 AND {b1} = '{KASRA}' THEN 'ئ' WHEN x.p > 2 AND {b1} = '{FATHA}' THEN 'أ' "
        f"WHEN x.p > 4 AND {b3} = 'و' AND {b2} = '{SHADDA}' AND {b1} = '{DAMMA}' THEN '{HAMZA}' WHEN x.p > 2 AND {b1} = '{DAMMA}' THEN 'ؤ' ELSE '{HAMZA}' END)"
    )
    yeh = (
        f"({b1} IN ('{KASRA}', 'ي') OR ({b2} = 'ي' AND {b1} = '{SUKUN}') "
        f"OR ({b1} = '{SUKUN}' AND {b2} NOT IN ('د', 'ذ', 'ر', 'ز', 'و') AND {f1} IN ('{FATHA}', '{FATHATAN}') AND {f2} = 'ا') "
        f"OR ({b1} IN ('ا', 'ي', 'و', '{SUKUN}', '{FATHA}', '{DAMMA}') AND ({f1} = '{KASRA}' OR ({f1} = '{SHADDA}' AND {f2} = '{KASRA}'))))"
    )
    waw = (
        f"(CASE WHEN {b1} IN ('ا', '{SUKUN}') AND {f1} = '{DAMMA}' THEN {f2} <> '' "
        f"WHEN {b1} IN ('ا', '{SUKUN}') AND {f1} = '{SHADDA}' AND {f2} = '{DAMMA}' THEN {f3} <> '' AND {f3} <> 'و' "
        f"WHEN {b1} = '{FATHA}' AND ({f1} = '{DAMMA}' OR ({f1} = '{SHADDA}' AND {f2} = '{DAMMA}')) THEN true "
        f"WHEN {b1} = '{DAMMA}' AND (({f1} <> '' AND {f1} <> '{KASRA}') OR ({f1} = '{SHADDA}' AND {f2} <> '' AND {f2} <> '{KASRA}')) THEN x.p <= 3 OR {b2} <> '{SHADDA}' OR {b3} <> 'و' ELSE false END)"
    )
    opened = f"({f1} = '{FATHA}' OR ({f1} = '{SHADDA}' AND {f2} = '{FATHA}'))"
    alif = (
        f"(CASE WHEN {b1} = '{FATHA}' AND ({f1} = '{SUKUN}' OR {opened}) THEN true WHEN {b2} = 'و' AND {b1} = '{SUKUN}' AND {f1} = '{FATHA}' THEN false "
        f"WHEN {b1} = '{SUKUN}' AND {f1} = '{FATHATAN}' AND {f2} = 'ا' THEN false WHEN {b1} = '{SUKUN}' AND {f1} = '{FATHA}' AND {f2} = 'ا' AND {f3} = 'ن' AND {at(4)} = '{KASRA}' THEN false "
        f"WHEN {b1} = '{SUKUN}' AND {opened} THEN true ELSE false END)"
    )
    kinds = [(f"{f1} = '{FATHA}' AND {f2} = 'ا'", "آ", 2), (f"{f1} = '{SHADDA}' AND {f2} = '{FATHA}' AND {f3} = 'ا'", f"آ{FATHA}{SHADDA}", 3), (f"{f1} = '{FATHA}' AND {f2} = '{HAMZA}' AND {f3} = '{SUKUN}'", "آ", 3)]
    madda = "(CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in kinds) + " ELSE 'أ' END)"
    skip = "(CASE " + " ".join(f"WHEN {c} THEN {n}" for c, _, n in kinds) + " ELSE 0 END)"
    terminal = f"a.seen + 1 = {letters}"
    seat = f"(CASE WHEN {terminal} THEN {end} WHEN {yeh} THEN 'ئ' WHEN {waw} THEN 'ؤ' WHEN {alif} THEN {madda} ELSE '{HAMZA}' END)"
    jump = f"(CASE WHEN NOT ({terminal}) AND NOT {yeh} AND NOT {waw} AND {alif} THEN {skip} ELSE 0 END)"
    grown = lambda c: f"(CASE WHEN {c} <> '' AND NOT {is_mark(c)} THEN 1 ELSE 0 END)"
    made = lambda out, more, seen: f"{{'p': x.p, 'out': {out}, 'skip': {more}, 'seen': {seen}}}"
    here = "substr(w, x.p::INT, 1)"
    # The count follows the last character that a step takes.
    on_hamza = f"list_transform([{{'s': {seat}, 'j': {jump}}}], lambda d: {made('a.out || d.s', 'd.j', 'a.seen + ' + grown('substr(w, (x.p + d.j)::INT, 1)'))})[1]"
    step = f"CASE WHEN a.skip > 0 THEN {made('a.out', 'a.skip - 1', 'a.seen')} WHEN {here} = '{HAMZA}' THEN {on_hamza} ELSE {made('a.out || ' + here, '0', 'a.seen + ' + grown(here))} END"
    zero = "{'p': 0, 'out': '', 'skip': 0, 'seen': 0}"
    return f"list_transform({start}, lambda w: list_reduce(list_transform(range(1, length(w) + 1), lambda i: {{'p': i::INT, 'out': '', 'skip': 0, 'seen': 0}}), lambda a, x: {step}, {zero}).out)[1]"


def harmonised(unvoweled: str, voweled: str, before: str) -> str:
    low = f"({before} LIKE '%ي' OR {before} LIKE '%يْ' OR {before} LIKE '%ِ')"
    pick = lambda u, a, b: f"WHEN {unvoweled} = '{u}' THEN CASE WHEN {low} THEN '{a}' ELSE '{b}' END"
    rows = [("ه", "هِ", "هُ"), ("هما", "هِمَا", "هُمَا"), ("هم", "هِمْ", "هُمْ"), ("هن", "هِنَّ", "هُنَّ")]
    return "CASE " + " ".join(pick(*r) for r in rows) + f" ELSE {voweled} END"


def after_article(stem: str) -> str:
    return f"CASE WHEN contains('{SOLAR}', left({stem}, 1)) THEN '{SUKUN}' || left({stem}, 1) || '{SHADDA}' || substr({stem}, 2) ELSE '{SUKUN}' || {stem} END"


def column(form: str, description: str, between: str) -> str:
    return f"CASE WHEN {form} = '' THEN '#' ELSE {form} || '{between}' || coalesce({description}, '') END"
