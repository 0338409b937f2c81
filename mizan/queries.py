"""Registered queries of the morphology engine and their SQL for DuckDB.

The tables hold no Arabic, so words come from transliterating the
conversations, and lexicon words from a list that order keys index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.functions.letters import ARABIC, CARRIERS, DIACRITICS, HAMZA, LATIN, LETTERS, NOT_SHADDA
from mizan.operators import branches as B
from mizan.operators import segment as S
from mizan.operators.collapse import exploded
from mizan import word_sql as Z

LEXICAL = "كتاب والكتاب كتبوا يكتبوا بالمدرسة الله والله محمد إلى لأنهم معلمتان عندليب كتابهم ذهب الولد عمل قرء سيكتب من هو".split()
LABELS = ["حرف|جر", "اسم|ضمير|مذكر|مفرد|الغائب", "اسم الجلالة", "جار ومجرور", "فعل|ماض|-|مذكر أو مؤنث|جمع|المتكلم", "حرف", "اسم|نكرة|ضمير|مؤنث"]
PATTERNS = ["فَعَلَ", "مَفْعُول", "فَعْلَلِيل", "يَفْعُلُونَ"]


def _lat(s: str) -> str:
    return s.replace("'", "''")


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different words of the transliterated conversations."""
    text = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(T.to_arabic(F.col("text")).alias("t"))
    return text.select(F.explode(F.split("t", " ")).alias("word")).where("word <> ''").distinct()


WORDS_SQL = f"w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(translate(text, '{_lat(LATIN)}', '{ARABIC}'), ' ')) AS word FROM conversations) WHERE word <> '')"


def generated_parts() -> tuple[list[str], list[str], list[str]]:
    """Proclitics, stems and enclitics of the demo lexicon, without marks."""
    from mizan.sources import demo

    side = lambda rows: sorted({c["unvoweledform"] for c in rows})
    stems = {demo._bare(v) for v, *_ in (*demo.TOOLS, *demo.NAMES)}
    for _, root, pattern, *_ in demo._entries():
        letters = dict(zip("فعل", root)) if len(root) == 3 else {}
        if letters:
            stems.add("".join(letters.get(c, c) for c in demo._bare(pattern)))
    return side(demo.PROCLITICS), sorted(stems), side(demo.ENCLITICS)


def generated_words() -> list[str]:
    p, s, e = generated_parts()
    return sorted({a + b + c for a in p for b in s for c in e})


def lexical_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of words, chosen by order key: for each fourth order one of
    LEXICAL, for the others one made of the lexicon's parts."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    made, n = generated_words(), len(LEXICAL)
    table = spark.createDataFrame(list(enumerate([*LEXICAL, *made])), "ix int, word string")
    key = F.col("o_orderkey")
    ix = F.when(key % 4 == 0, F.floor(key / 4) % n).otherwise(n + key % len(made)).cast("int")
    return orders.withColumn("ix", ix).join(F.broadcast(table), "ix").select("o_orderkey", "word")


def lexicon(spark: SparkSession):
    from mizan.cli import demo_lexicon

    return demo_lexicon(spark)


def clitics(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    from mizan.sources import demo, lexicon

    records = demo.tables()
    return lexicon.clitics(spark, records, "proclitics"), lexicon.clitics(spark, records, "enclitics")


def _per_word(**columns):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus_words(spark, sf_dir).select("word", *[f(F.col("word")).alias(n) for n, f in columns.items()])

    return run


def _sql(**columns: str) -> str:
    return f"WITH {WORDS_SQL} SELECT word, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM w"


def normalize_sql(w: str) -> str:
    out = f"CASE WHEN length({w}) >= 3 AND substr({w}, 2, 1) = 'ّ' THEN substr({w}, 1, 1) || substr({w}, 3) ELSE {w} END"
    for wrong, right in T.REWRITES:
        out = f"regexp_replace({out}, '{wrong[:-2]}$', '{right}')" if wrong.endswith("\\z") else f"replace({out}, '{wrong}', '{right}')"
    return out


def tokenize_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", T.to_arabic(F.col("text")).alias("t"))
    s = c.select("conv_id", "turn", F.posexplode(T.tokenize(F.col("t"))).alias("sentence_ix", "s"))
    return s.select("conv_id", "turn", "sentence_ix", F.posexplode("s").alias("token_ix", "token"))


TOKENIZE_SQL = f"""WITH c AS (SELECT conv_id, turn, regexp_split_to_array(replace(translate(text, '{_lat(LATIN)}', '{ARABIC}'), 'ـ', ''), '[.!:،؟؛\n]') AS s FROM conversations),
p AS (SELECT conv_id, turn, unnest(s) AS s, generate_subscripts(s, 1) AS n FROM c),
a AS (SELECT conv_id, turn, n, regexp_extract_all(s, '[{LETTERS}][{LETTERS}{DIACRITICS}]*') AS t FROM p),
k AS (SELECT conv_id, turn, t, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) - 1)::INT AS sentence_ix FROM a WHERE len(t) > 0),
e AS (SELECT conv_id, turn, sentence_ix, unnest(t) AS raw, (generate_subscripts(t, 1) - 1)::INT AS token_ix FROM k)
SELECT conv_id, turn, sentence_ix, token_ix, {normalize_sql('raw')} AS token FROM e"""


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _clitic_values(rows: list[dict]) -> str:
    seen: dict[str, int] = {}
    out = []
    for c in rows:
        k = c["unvoweledform"]
        out.append((k, seen.get(k, 0), c["classe"]))
        seen[k] = seen.get(k, 0) + 1
    return _values(out)


def _dims_sql() -> str:
    from mizan.sources import demo

    return f"pc(surface, ord, classe) AS (VALUES {_clitic_values(demo.PROCLITICS)}), ec(surface, ord, classe) AS (VALUES {_clitic_values(demo.ENCLITICS)})"


def clitic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pro, enc), w = clitics(spark), S.prepare(corpus_words(spark, sf_dir))
    p = S.proclitic_candidates(w, pro).select("word", F.lit("p").alias("side"), F.col("p_len").alias("n"), F.col("p_ord").alias("ord"), F.col("p_classe").alias("classe"))
    e = S.enclitic_candidates(w, enc).select("word", F.lit("e").alias("side"), F.col("e_len").alias("n"), F.col("e_ord").alias("ord"), F.col("e_classe").alias("classe"))
    return p.unionByName(e)


def _clitic_sql() -> str:
    return f"""WITH {WORDS_SQL}, {_dims_sql()}, u AS (SELECT word, translate(word, '{DIACRITICS}', '') AS unv FROM w),
l AS (SELECT word, unv, unnest(range(0, least(5, length(unv) - 1)::INT + 1)) AS n FROM u WHERE length(unv) > 0)
SELECT word, 'p' AS side, n::INT AS n, ord::INT AS ord, classe FROM l JOIN pc ON surface = left(unv, n)
UNION ALL SELECT word, 'e', n::INT, ord::INT, classe FROM l JOIN ec ON surface = CASE WHEN n = 0 THEN '' ELSE right(unv, n) END"""


def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different cuts of every word: proclitic, stem, enclitic."""
    w = S.prepare(corpus_words(spark, sf_dir))
    rows = S.segments(w.select("word", "unv"), *clitics(spark))
    return rows.select("word", F.col("p_unvoweledform").alias("proclitic"), F.col("p_classe").alias("p_class"), "stem", F.col("e_unvoweledform").alias("enclitic"), F.col("e_classe").alias("e_class"))


def _segment_sql() -> str:
    end = lambda s: f"CASE WHEN e = '' THEN '' WHEN right({s}, 1) = 'ت' THEN left({s}, -1) || 'ة' WHEN right({s}, 1) = 'آ' THEN left({s}, -1) || 'أى' WHEN right({s}, 1) = 'ا' THEN left({s}, -1) || 'ى' WHEN right({s}, 1) = 'و' THEN {s} || 'ا' WHEN right({s}, 1) IN ('ئ', 'ؤ') THEN left({s}, -1) || 'ء' ELSE '' END"
    return f"""WITH {WORDS_SQL}, {_dims_sql()}, u AS (SELECT word, translate(word, '{DIACRITICS}', '') AS unv FROM w),
l AS (SELECT word, unv, unnest(range(0, least(5, length(unv) - 1)::INT + 1)) AS n FROM u WHERE length(unv) > 0),
p AS (SELECT word, unv, n AS pn, ord AS po, surface AS p, classe AS pk FROM l JOIN pc ON surface = left(unv, n)),
q AS (SELECT word, n AS en, ord AS eo, surface AS e, classe AS ek FROM l JOIN ec ON surface = CASE WHEN n = 0 THEN '' ELSE right(unv, n) END),
x AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY pn, po, en, eo) AS r, length(unv) < pn + en AS over FROM p JOIN q USING (word)),
y AS (SELECT *, min(CASE WHEN over THEN r END) OVER (PARTITION BY word) AS stop FROM x),
c AS (SELECT word, p, pk, e, ek, substr(unv, pn + 1, length(unv) - pn - en) AS s FROM y WHERE stop IS NULL OR r < stop),
d AS (SELECT *, (pk IN ('N4', 'C3') AND p LIKE '%ل' AND s LIKE 'ل%') AS dbl FROM c),
b AS (SELECT *, CASE WHEN dbl THEN 'ا' || s ELSE s END AS base FROM d),
f AS (SELECT *, CASE WHEN length(base) > 1 THEN {end('base')} ELSE '' END AS fin FROM b),
g AS (SELECT word, p, pk, e, ek, unnest(list_distinct(list_filter([s, CASE WHEN pk IN ('N1', 'N2', 'N3', 'N5') AND p LIKE '%ل' AND NOT s LIKE 'ل%' THEN 'ل' || s END,
 CASE WHEN e = 'ي' AND NOT s LIKE 'ي%' THEN s || 'ي' END, CASE WHEN dbl THEN {end('s')} END, base, CASE WHEN p IN ('أ', 'ب') THEN 'ا' || base END,
 CASE WHEN fin <> '' THEN fin END, CASE WHEN fin <> '' THEN replace(fin, 'آ', 'ءا') END, replace(base, 'آ', 'ءا')], lambda z: z IS NOT NULL))) AS stem FROM f)
SELECT word, p AS proclitic, pk AS p_class, stem, e AS enclitic, ek AS e_class FROM g
WHERE NOT (ek LIKE 'V%' AND pk LIKE 'N%') AND NOT (pk LIKE 'V%' AND ek LIKE 'N%') AND NOT (pk IN ('N1', 'N2', 'N3', 'N5') AND e <> '')"""


def exceptional_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the exceptional words among the different words."""
    words = S.prepare(lexical_words(spark, sf_dir))
    return B.exceptional(words, lexicon(spark)).select("word", "voweled", "proclitic", "stem", "lemma", "enclitic", F.col("priority").cast("double").alias("priority"), "pos", "type")


def _lexical_sql() -> str:
    p, st, e = ("(" + "), (".join(f"'{x}'" for x in xs) + ")" for xs in generated_parts())
    return f"""gp(p) AS (VALUES {p}), gs(s) AS (VALUES {st}), ge(e) AS (VALUES {e}),
gw AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS ix FROM (SELECT DISTINCT p || s || e AS word FROM gp, gs, ge)),
lw AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN list_extract([{', '.join(repr(w) for w in LEXICAL)}], ((o_orderkey // 4) % {len(LEXICAL)} + 1)::INT) ELSE word END AS word
 FROM orders LEFT JOIN gw ON ix = o_orderkey % (SELECT count(*) FROM gw))"""


def _exceptional_sql() -> str:
    from mizan.sources import demo

    rows = _values([(k, v["voweledform"], v["proclitic"], v["stem"], v["enclitic"]) for k, v in demo.EXCEPTIONAL])
    return f"""WITH {_lexical_sql()}, ex(unv, voweled, proclitic, stem, enclitic) AS (VALUES {rows}), w AS (SELECT DISTINCT word FROM lw)
SELECT word, voweled, proclitic, stem, 'الله' AS lemma, enclitic, 1.0::DOUBLE AS priority, 'اسم' AS pos, 'اسم الجلالة' AS type FROM w JOIN ex ON unv = {Z.bare('word')}"""


#: Letters that stand for hamza in the queries on its spelling.
HAMZA_FROM, HAMZA_TO = "تنه", "ءءا"


def correct_hamza(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words rich in hamza, with each on its seat."""
    from mizan.functions.hamza import spell_hamza

    rows = corpus_words(spark, sf_dir).withColumn("made", F.translate("word", HAMZA_FROM, HAMZA_TO))
    return rows.select("word", spell_hamza(F.col("made")).alias("spelt"), T.stem_hamza(F.col("made")).alias("stem"))


def _hamza_sql() -> str:
    return f"WITH {WORDS_SQL}, m AS (SELECT word, translate(word, '{HAMZA_FROM}', '{HAMZA_TO}') AS made FROM w) SELECT word, {Z.spell_hamza('made')} AS spelt, {Z.stem_hamza('made')} AS stem FROM m"


def instantiate_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots with hamza in patterns, spelt; and stems under the patterns' marks."""
    w = corpus_words(spark, sf_dir).withColumn("root", F.left(T.strip_diacritics(F.translate("word", HAMZA_FROM, HAMZA_TO)), F.lit(4))).where("length(root) >= 3")
    w = w.select("word", "root", F.explode(F.array(*[F.lit(p) for p in PATTERNS])).alias("pattern"))
    return w.select("word", "pattern", T.instantiate(F.col("root"), F.col("pattern")).alias("made"), T.fill_letters(F.col("pattern"), F.col("root")).alias("marked"))


def _instantiate_sql() -> str:
    filled = FILL_SQL[FILL_SQL.index("list_aggregate") : FILL_SQL.index(" AS filled")]
    return f"""WITH {WORDS_SQL}, r AS (SELECT word, left(translate(translate(word, '{HAMZA_FROM}', '{HAMZA_TO}'), '{DIACRITICS}', ''), 4) AS root FROM w),
p AS (SELECT word, root, unnest([{', '.join(repr(p) for p in PATTERNS)}]) AS pattern FROM r WHERE length(root) >= 3),
k AS (SELECT *, string_split(pattern, '') AS c FROM p), f AS (SELECT word, root, pattern, {filled} AS filled FROM k)
SELECT word, pattern, {Z.spell_hamza('filled')} AS made, {Z.fill_letters('pattern', 'root')} AS marked FROM f"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a word and a form that may or may not agree with it."""
    w = corpus_words(spark, sf_dir).withColumn("norm", T.normalize_word(F.col("word")))
    n, b = F.col("norm"), T.strip_diacritics(F.col("norm"))
    forms = [n, F.concat(n, F.lit("ْ")), F.replace(n, F.lit("ا"), F.lit("ى")), F.concat(b, F.lit("َا")), F.concat(F.left(n, F.lit(1)), F.lit("َ"), F.substring(n, 2, 1 << 20)), F.translate(n, "ءأ", "أؤ"), F.concat(T.but_last(n), F.lit("ْ"))]
    return w.select("word", F.explode(F.array(n, b)).alias("norm"), F.array(*forms).alias("f")).select("word", "norm", F.posexplode("f").alias("k", "voweled")).withColumn("enclitic", F.when(F.length("word") % 2 == 0, "هم").otherwise(""))


_FORMS_SQL = f"""n AS (SELECT word, {normalize_sql('word')} AS n FROM w), b AS (SELECT word, n, {Z.bare('n')} AS b FROM n),
f AS (SELECT word, n, b, [n, n || 'ْ', replace(n, 'ا', 'ى'), b || 'َا', left(n, 1) || 'َ' || substr(n, 2), translate(n, 'ءأ', 'أؤ'), (CASE WHEN n = '' THEN '' ELSE left(n, -1) END) || 'ْ'] AS f FROM b),
g AS (SELECT word, unnest([n, b]) AS norm, f FROM f), v AS (SELECT word, norm, unnest(f) AS voweled, (generate_subscripts(f, 1) - 1)::INT AS k, CASE WHEN length(word) % 2 = 0 THEN 'هم' ELSE '' END AS enclitic FROM g)"""


def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forms(spark, sf_dir)
    n, v, e = F.col("norm"), F.col("voweled"), F.col("enclitic")
    return rows.select("word", "norm", "k", T.incompatible(n, v).cast("int").alias("exact"), T.incompatible(n, v, e).cast("int").alias("folded"), T.join_enclitic(e, v).alias("joined"), B.harmonised(e, e, v).alias("enclitic"))


def _compatibility_sql() -> str:
    return f"WITH {WORDS_SQL}, {_FORMS_SQL} SELECT word, norm, k, {Z.incompatible('norm', 'voweled')}::INT AS exact, {Z.incompatible('norm', 'voweled', 'enclitic')}::INT AS folded, {Z.join_enclitic('enclitic', 'voweled')} AS joined, {Z.harmonised('enclitic', 'enclitic', 'voweled')} AS enclitic FROM v"


def _cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    """Segments of the lexical words that are not exceptional."""
    lex = lexicon(spark)
    w = S.prepare(lexical_words(spark, sf_dir)).join(lex.exceptional.select(F.col("word").alias("unv")), "unv", "left_anti")
    return S.segments(w.select("word", "unv"), lex.proclitic, lex.enclitic).join(w.select("word", "norm"), "word"), lex


def _cut_sql() -> str:
    """Segments ``g``: the statement of ``segment_words`` over the lexical words,
    with the forms and names of the clitics."""
    from mizan.sources import demo

    def rows(cs):
        seen, out = {}, []
        for c in cs:
            k = c["unvoweledform"]
            out.append((k, seen.get(k, 0), c["classe"], c["voweledform"], c["desc"]))
            seen[k] = seen.get(k, 0) + 1
        return _values(out)

    s = _segment_sql()
    body = s[s.index("l AS (SELECT word, unv") : s.index("SELECT word, p AS proclitic")].rstrip()
    body = body.replace("classe AS pk FROM l", "classe AS pk, vf AS pv, dsc AS pd FROM l").replace("classe AS ek FROM l", "classe AS ek, vf AS ev, dsc AS ed FROM l")
    body = body.replace("SELECT word, p, pk, e, ek,", "SELECT word, p, pk, pv, pd, e, ek, ev, ed,")
    exceptional = ", ".join(f"'{k}'" for k, _ in demo.EXCEPTIONAL)
    return f"""WITH {_lexical_sql()}, pc(surface, ord, classe, vf, dsc) AS (VALUES {rows(demo.PROCLITICS)}), ec(surface, ord, classe, vf, dsc) AS (VALUES {rows(demo.ENCLITICS)}),
u AS (SELECT word, {Z.bare('word')} AS unv, {normalize_sql('word')} AS norm FROM (SELECT DISTINCT word FROM lw) WHERE {Z.bare('word')} NOT IN ({exceptional})),
{body},
seg AS (SELECT g.*, u.norm FROM g JOIN u USING (word) WHERE NOT (ek LIKE 'V%' AND pk LIKE 'N%') AND NOT (pk LIKE 'V%' AND ek LIKE 'N%') AND NOT (pk IN ('N1', 'N2', 'N3', 'N5') AND e <> ''))"""


_READ = ["word", "voweled", "proclitic", "stem", "part_of_speech", "lemma", "root", "enclitic"]


def toolword_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tool_words(*_cut(spark, sf_dir)).select(*_READ, F.coalesce("pos", F.lit("-")).alias("pos"), F.coalesce("type", F.lit("-")).alias("type"))


def _toolword_sql() -> str:
    from mizan.sources import demo

    t = _values([(demo._bare(v), v, p, e, demo.TOOL_POS[k - 1]) for v, p, e, k in demo.TOOLS])
    article = "(" + " OR ".join(f"contains(pc, '{c}')" for c in ("N1", "N2", "N3", "N5")) + ")"
    voweled = f"pv || (CASE WHEN {article} THEN {Z.after_article('v')} ELSE v END) || enc"
    for wrong, right in (("لَلْلّ", "لَلّ"), ("لِلْلّ", "لِلّ"), ("لِالّ", "لِلّ"), ("لَالّ", "لَلّ")):
        voweled = f"replace({voweled}, '{wrong}', '{right}')"
    pos = "CASE label WHEN 'جار ومجرور' THEN 'حرف' ELSE string_split(label, '|')[1] END"
    kind = "CASE label WHEN 'جار ومجرور' THEN label WHEN 'اسم|ضمير|مذكر|مفرد|الغائب' THEN 'ضمير' ELSE coalesce(string_split(label, '|')[2], '-') END"
    return f"""{_cut_sql()}, tw(stem, v, pc, ec, label) AS (VALUES {t}),
j AS (SELECT seg.*, v, tw.pc, label, {Z.harmonised('e', 'ev', 'v')} AS enc FROM seg JOIN tw USING (stem) WHERE contains(tw.pc, pk) AND contains(ec, ek)),
o AS (SELECT *, {voweled} AS voweled FROM j)
SELECT word, voweled, {Z.column('pv', 'pd', ' : ')} AS proclitic, {Z.strip_last('v')} AS stem, label AS part_of_speech, v AS lemma, '-' AS root, {Z.column('enc', 'ed', ' : ')} AS enclitic, {pos} AS pos, {kind} AS type
FROM o WHERE NOT {Z.incompatible('norm', 'voweled')}"""


def propernoun_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.proper_nouns(*_cut(spark, sf_dir)).select(*_READ, "casemood", "gender")


def _propernoun_sql() -> str:
    from mizan.sources import demo

    ends = list(zip(("ُ", "َ", "ِ"), demo.PN_CASES))
    t = _values([(demo._bare(v), v + end, v, root, case, demo.PN_POS[kind - 1]["gender"]) for v, root, kind in demo.NAMES for end, case in ends])
    body = f"CASE WHEN pk = 'N4' AND p LIKE '%ل' AND v LIKE 'ا%' THEN substr(base, 2) WHEN pk IN ('N1', 'N2', 'N3', 'N5') THEN {Z.after_article('base')} ELSE base END"
    return f"""{_cut_sql()}, pn(stem, v, lemma, root, casemood, gender) AS (VALUES {t}),
j AS (SELECT seg.*, v, lemma, pn.root, casemood, gender, {Z.harmonised('e', 'ev', 'v')} AS enc, CASE WHEN e <> '' THEN replace(v, 'ة', 'ت') ELSE v END AS base
 FROM seg JOIN pn USING (stem) WHERE NOT contains(pk, 'V') AND NOT contains(ek, 'V')), o AS (SELECT *, pv || ({body}) || enc AS voweled FROM j)
SELECT word, voweled, {Z.column('pv', 'pd', ' : ')} AS proclitic, {Z.strip_last('v')} AS stem, 'اسم|اسم علم|' || gender || '|مفرد' AS part_of_speech, lemma, root, {Z.column('enc', 'ed', ' : ')} AS enclitic, casemood, gender
FROM o WHERE NOT {Z.incompatible('norm', 'voweled', 'e')} AND NOT (regexp_matches(voweled, '[ًٌٍ]') AND (e <> '' OR pk IN ('N1', 'N2', 'N3', 'N5')))
AND NOT (pk IN ('N2', 'C2', 'C3') AND casemood = 'مجرور') AND NOT (pk IN ('N4', 'N5') AND casemood <> 'مجرور')"""


def start_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start scores of candidates: the lines of an order stand for the lemmas of
    a word, some of them without a count."""
    from mizan.plans.disambiguate import start_row

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    known = F.col("l_linenumber") % 3 != 0
    one = F.struct(F.col("l_linenumber").alias("k"), F.when(known, F.lit(1000.0)).alias("total"), F.when(known, F.col("l_quantity").cast("double")).alias("freq"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("c")).select("l_orderkey", F.posexplode(start_row(F.col("c"))).alias("k", "score"))
    return rows.select("l_orderkey", "k", F.round(F.col("score"), 9).alias("score"))


def _start_sql() -> str:
    from mizan.plans.disambiguate import DEFAULT_TOTAL, DISCOUNT

    known = "CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity::DOUBLE END"
    return f"""WITH c AS (SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1)::INT AS k, {known} AS f FROM lineitem),
a AS (SELECT l_orderkey, greatest(count(*), 1) AS n, max(CASE WHEN f IS NOT NULL THEN f - {DISCOUNT} END) AS most, arg_min(f, k) AS known_first, bool_or(k = 0 AND f IS NOT NULL) AS first, coalesce(sum(f / 1000.0), 0) AS s, count(f) AS m FROM c GROUP BY 1),
b AS (SELECT *, (CASE WHEN m = 0 THEN 1.0 WHEN first THEN most ELSE greatest(1.0, most) END) / (CASE WHEN m = 0 THEN {DEFAULT_TOTAL} ELSE 1000.0 END) AS floor FROM a)
SELECT l_orderkey, k, round((floor + coalesce(f / 1000.0, 0)) / (s + floor * n), 9) AS score FROM c JOIN b USING (l_orderkey)"""


def parse_pos_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.pmod(F.col("o_orderkey"), F.lit(len(LABELS))) + 1).cast("int"))
    df = o.select("o_orderkey", label.alias("label"))
    return df.select("o_orderkey", *[F.coalesce(c, F.lit("-")).alias(n) for n, c in B.label_slots(F.col("label")).items()])


def _label_sql() -> str:
    one = lambda names: "list_extract(list_filter(s, lambda x: x IN (" + ", ".join(f"'{n}'" for n in names) + ")), 1)"
    persons = "('الغائب', 'المتكلم', 'المخاطب')"
    kinds = [("'ماض', 'مضارع', 'أمر'"), ("'مذكر', 'مؤنث', 'مذكر أو مؤنث'"), ("'مفرد', 'مثنى', 'جمع'"), persons[1:-1]]
    firsts = [f"coalesce(list_position(s, list_extract(list_filter(s, lambda x: x IN ({k})), 1)), 0)" for k in kinds]
    rest = f"list_extract(list_filter(list_transform(s, lambda x, i: CASE WHEN i IN ({', '.join(firsts)}) THEN NULL ELSE x END), lambda x: x IS NOT NULL), 1)"
    labels = ", ".join(f"'{x}'" for x in LABELS)
    return f"""WITH l AS (SELECT o_orderkey, list_extract([{labels}], (o_orderkey % {len(LABELS)} + 1)::INT) AS label FROM orders),
s AS (SELECT *, list_filter(list_slice(string_split(label, '|'), 2, 99), lambda x: x NOT IN ('', '-')) AS s FROM l)
SELECT o_orderkey, CASE label WHEN 'اسم الجلالة' THEN 'اسم' WHEN 'جار ومجرور' THEN 'حرف' ELSE string_split(label, '|')[1] END AS pos,
coalesce(CASE label WHEN 'اسم الجلالة' THEN label WHEN 'جار ومجرور' THEN label ELSE {rest} END, '-') AS type,
coalesce({one(['ماض', 'مضارع', 'أمر'])}, '-') AS tense, coalesce({one(['مذكر', 'مؤنث', 'مذكر أو مؤنث'])}, '-') AS gender, coalesce({one(['مفرد', 'مثنى', 'جمع'])}, '-') AS number,
coalesce(replace({one(['الغائب', 'المتكلم', 'المخاطب'])}, 'ال', ''), '-') AS person FROM s"""


def fill_root_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three or four letters of each word as a root in patterns."""
    w = corpus_words(spark, sf_dir).withColumn("root", F.left(T.strip_diacritics(F.col("word")), F.lit(4))).where("length(root) >= 3")
    w = w.select("word", "root", F.explode(F.array(*[F.lit(p) for p in PATTERNS])).alias("pattern"))
    return w.select("word", "pattern", T.fill_root(F.col("root"), F.col("pattern")).alias("filled"), T.fits_pattern(F.col("root"), T.strip_diacritics(F.col("pattern"))).cast("int").alias("fits"))


FILL_SQL = f"""WITH {WORDS_SQL}, r AS (SELECT word, left(translate(word, '{DIACRITICS}', ''), 4) AS root FROM w),
p AS (SELECT word, root, unnest([{', '.join(repr(p) for p in PATTERNS)}]) AS pattern FROM r WHERE length(root) >= 3),
k AS (SELECT *, string_split(pattern, '') AS c, translate(pattern, '{DIACRITICS}', '') AS bare FROM p)
SELECT word, pattern, list_aggregate(list_transform(c, lambda x, i: CASE x WHEN 'ف' THEN substr(root, 1, 1) WHEN 'ع' THEN substr(root, 2, 1)
 WHEN 'ل' THEN substr(root, (3 + least(len(list_filter(c[1:i], lambda y: y = 'ل')) - 1, length(root) - 3))::INT, 1) ELSE x END), 'string_agg', '') AS filled,
len(list_filter(range(1, least(length(root), length(bare)) + 1), lambda i: NOT (substr(bare, i::INT, 1) IN ('ف', 'ع', 'ل') OR substr(bare, i::INT, 1) = substr(root, i::INT, 1)))) = 0)::INT AS fits FROM k"""
FILL_SQL = FILL_SQL.replace("len(list_filter(range", "(len(list_filter(range")


def word_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings of the lexical words of the orders."""
    from mizan.plans.analyze import analyze_words

    found = analyze_words(lexical_words(spark, sf_dir), lexicon(spark))
    return found.select("word", "rank", "diacritized", "lemma", "root", "stem", "pos", "type", "score", F.size("inflections").alias("n_inflections"))


def top_reading_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mizan.plans.analyze import analyze_words

    occurrences = lexical_words(spark, sf_dir)
    best = analyze_words(occurrences, lexicon(spark)).where("rank = 1").select("word", "diacritized", "lemma", "pos")
    return occurrences.join(F.broadcast(best), "word", "left").select("o_orderkey", "word", "diacritized", "lemma", "pos")


def explode_inflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mizan.plans.analyze import analyze_words

    return exploded(analyze_words(lexical_words(spark, sf_dir), lexicon(spark))).select("word", "rank", "inflection_ix", "inflected", "case", "mood", "state", "score")


def text_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemma, stem and root of each token in texts: the words of a customer's
    orders, by order key."""
    from mizan.cli import demo_model
    from mizan.plans.disambiguate import analyze_text

    words = lexical_words(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "word"))), lambda x: x["word"]), " ")
    docs = words.groupBy(F.col("o_custkey").alias("doc_id")).agg(line.alias("text"))
    return analyze_text(docs, lexicon(spark), demo_model(spark))


_RUN = f"regexp_extract(word, '([{DIACRITICS}]+)$', 1)"
_TAIL = f"regexp_extract(word, '([{DIACRITICS}]+)[اى]$', 1)"
_KEEP = "CASE WHEN contains({0}, 'ّ') THEN 'ّ' ELSE '' END"
_STRIP_CASE = (
    f"CASE WHEN {_RUN} <> '' THEN regexp_replace(word, '[{DIACRITICS}]+$', '') || {_KEEP.format(_RUN)} "
    f"WHEN contains({_TAIL}, 'ً') THEN regexp_replace(word, '[{DIACRITICS}]*[اى]$', '') || {_KEEP.format(_TAIL)} || 'َ' || right(word, 1) ELSE word END"
)

QUERIES = {
    "translit_bw": (_per_word(latin=T.to_latin), _sql(latin=f"translate(word, '{ARABIC}', '{_lat(LATIN)}')")),
    "strip_diacritics": (_per_word(bare=T.strip_diacritics), _sql(bare=f"translate(word, '{DIACRITICS}', '')")),
    "strip_last_diacritic": (_per_word(cut=T.strip_last_diacritic), _sql(cut=f"regexp_replace(word, '[{NOT_SHADDA}]$', '')")),
    "strip_case_ending": (_per_word(cut=T.strip_case_ending), _sql(cut=_STRIP_CASE)),
    "hamza_forms": (
        _per_word(folded=T.fold_hamza, dropped=T.drop_hamza, first=T.first_hamza),
        _sql(folded=f"translate(word, '{CARRIERS}', '{HAMZA * len(CARRIERS)}')", dropped=f"translate(word, '{CARRIERS}', '')", first=f"regexp_extract(word, '[{CARRIERS}]')"),
    ),
    "normalize_word": (_per_word(normal=T.normalize_word), _sql(normal=normalize_sql("word"))),
    "tokenize_sentences": (tokenize_sentences, TOKENIZE_SQL),
    "clitic_candidates": (clitic_candidates, _clitic_sql),
    "segment_words": (segment_words, _segment_sql),
    "exceptional_lookup": (exceptional_lookup, _exceptional_sql),
    "correct_hamza": (correct_hamza, _hamza_sql),
    "instantiate_pattern": (instantiate_pattern, lambda: _instantiate_sql()),
    "compatibility": (compatibility, _compatibility_sql),
    "toolword_readings": (toolword_readings, _toolword_sql),
    "propernoun_readings": (propernoun_readings, _propernoun_sql),
    "start_scores": (start_scores, _start_sql),
    "parse_pos_label": (parse_pos_label, _label_sql),
    "fill_root_pattern": (fill_root_pattern, FILL_SQL),
    "word_readings": (word_readings, None),
    "top_reading_per_order": (top_reading_per_order, None),
    "explode_inflections": (explode_inflections, None),
    "text_lemmas": (text_lemmas, None),
}


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql():
    return {k: q if isinstance(q, str) else q() for k, (_, q) in QUERIES.items() if q is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_reading_per_order(spark, sf_dir)
