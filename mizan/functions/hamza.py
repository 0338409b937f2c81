"""Spelling of the hamza as one fold over the positions of a word.

At each bare hamza the letters and marks around it decide, in this order of
rules: end of the word, yeh seat, waw seat, alif seat, none. Decisions look at
the rewritten input, never at the output being built.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mizan.functions.letters import DAMMA, DIACRITICS, FATHA, FATHATAN, HAMZA, KASRA, SHADDA, SUKUN
from mizan.functions.text import chars, fold_hamza, is_diacritic, let


def _first_seat(w: Column) -> Column:
    head = F.when(F.substring(w, 2, 1) == KASRA, "إ").otherwise("أ")
    return F.when((F.length(w) > 1) & w.startswith(HAMZA), F.concat(head, F.substring(w, 2, 1 << 20))).otherwise(w)


def _long_start(w: Column) -> Column:
    madda, quiet = w.startswith("أ" + FATHA + "ا"), w.startswith("ا" + HAMZA + SUKUN)
    return F.when(madda, F.concat(F.lit("آ"), F.substring(w, 4, 1 << 20))).when(quiet, F.concat(F.lit("ائ"), F.substring(w, 3, 1 << 20))).otherwise(w)


def spell_hamza(word: Column) -> Column:
    """The word with every hamza on its seat; the empty word stays empty."""
    return let(let(let(fold_hamza(word), _first_seat), _long_start), _seat_all)


def _seat_all(w: Column) -> Column:
    letters = F.size(F.filter(chars(w), lambda c: ~is_diacritic(c)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("skip"), F.lit(0).alias("seen"))

    def step(a, p):
        c = F.substring(w, p, 1)
        at = lambda k: F.when(p + k >= 1, F.substring(w, p + k, 1)).otherwise(F.lit(""))
        seat, jump = _decide(at, p, F.length(w), a["seen"] + 1 == letters)
        hamza = c == HAMZA
        put, more = F.when(hamza, seat).otherwise(c), F.when(hamza, jump).otherwise(0)
        # The count follows the last character consumed in this step.
        over = F.substring(w, p + more, 1)
        grown = F.when((over != "") & (F.instr(F.lit(DIACRITICS), over) == 0), 1).otherwise(0)
        going = F.struct(F.concat(a["out"], put).alias("out"), more.alias("skip"), (a["seen"] + grown).alias("seen"))
        skipped = F.struct(a["out"].alias("out"), (a["skip"] - 1).alias("skip"), a["seen"].alias("seen"))
        return F.when(a["skip"] > 0, skipped).otherwise(going)

    return F.when(F.length(w) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), start, step, lambda a: a["out"])).otherwise(w)


def _decide(at, p: Column, n: Column, terminal: Column) -> tuple[Column, Column]:
    b3, b2, b1, f1, f2, f3 = at(-3), at(-2), at(-1), at(1), at(2), at(3)
    # Positions count from 0 in the rules, from 1 here.
    end = (
        F.when((p > 2) & (b1 == KASRA), "ئ").when((p > 2) & (b1 == FATHA), "أ")
        .when((p > 4) & (b3 == "و") & (b2 == SHADDA) & (b1 == DAMMA), HAMZA)
        .when((p > 2) & (b1 == DAMMA), "ؤ").otherwise(HAMZA)
    )
    yeh = (
        (b1 == KASRA) | (b1 == "ي") | ((b2 == "ي") & (b1 == SUKUN))
        | ((b1 == SUKUN) & ~b2.isin("د", "ذ", "ر", "ز", "و") & f1.isin(FATHA, FATHATAN) & (f2 == "ا"))
        | (b1.isin("ا", "ي", "و", SUKUN, FATHA, DAMMA) & ((f1 == KASRA) | ((f1 == SHADDA) & (f2 == KASRA))))
    )
    after_long = b1.isin("ا", SUKUN)
    waw = (
        F.when(after_long & (f1 == DAMMA), f2 != "")
        .when(after_long & (f1 == SHADDA) & (f2 == DAMMA), (f3 != "") & (f3 != "و"))
        .when((b1 == FATHA) & ((f1 == DAMMA) | ((f1 == SHADDA) & (f2 == DAMMA))), True)
        .when((b1 == DAMMA) & (((f1 != "") & (f1 != KASRA)) | ((f1 == SHADDA) & (f2 != "") & (f2 != KASRA))), (p <= 3) | (b2 != SHADDA) | (b3 != "و"))
        .otherwise(False)
    )
    open_ = (f1 == FATHA) | ((f1 == SHADDA) & (f2 == FATHA))
    alif = (
        F.when((b1 == FATHA) & ((f1 == SUKUN) | open_), True)
        .when((b2 == "و") & (b1 == SUKUN) & (f1 == FATHA), False)
        .when((b1 == SUKUN) & (f1 == FATHATAN) & (f2 == "ا"), False)
        .when((b1 == SUKUN) & (f1 == FATHA) & (f2 == "ا") & (f3 == "ن") & (at(4) == KASRA), False)
        .when((b1 == SUKUN) & open_, True)
        .otherwise(False)
    )
    madda = F.when((f1 == FATHA) & (f2 == "ا"), "آ").when((f1 == SHADDA) & (f2 == FATHA) & (f3 == "ا"), "آ" + FATHA + SHADDA).when(
        (f1 == FATHA) & (f2 == HAMZA) & (f3 == SUKUN), "آ"
    ).otherwise("أ")
    skip = F.when((f1 == FATHA) & (f2 == "ا"), 2).when((f1 == SHADDA) & (f2 == FATHA) & (f3 == "ا"), 3).when((f1 == FATHA) & (f2 == HAMZA) & (f3 == SUKUN), 3).otherwise(0)
    seat = F.when(terminal, end).when(yeh, "ئ").when(waw, "ؤ").when(alif, madda).otherwise(HAMZA)
    return seat, F.when(~terminal & ~yeh & ~waw & alif, skip).otherwise(0)
