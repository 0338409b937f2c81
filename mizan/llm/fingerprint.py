"""Canonical exact digests of documents.

The canonical form of a text is NFKC, full case folding, NFKC again, then
every run of white space as one space and none at the ends (ICU and Java do
this inside the JVM through SQL's ``reflect``). The digest is 128 bits wide:
two xxhash64 lanes with different seeds. Rows with equal digests form a
bucket; the bytes of their canonical forms are compared, and so are those of a
text and its edited text. If a bucket holds different forms (never seen, but
possible), all digests are made anew with two lanes more, until none does, so
equal fingerprints mean equal forms.

Defined results: a null text counts as empty, and empty texts share one
fingerprint; a null doc_id sorts last in descending order; repeated doc_ids
are ordered by a hash of their text; an empty table gives an empty result;
a single document is its own next one; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mizan.llm.common import documents, scoped, text_or_empty, written

#: Stands for a missing doc_id in joins; not a doc_id itself.
_NO_ID = -(2**63)
#: Seeds of the lanes of a digest, and how many it has unless forms clash.
SEEDS, LANES = (11, 29, 47, 71, 97, 113, 131, 151), 2


def _nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form; ``text`` must not be null."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(text), F.lit(True))
    # Cased ASCII needs no normaliser: lower() gives the same form.
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(folded)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(plain, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def lane(form: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), form)


def digest(form: Column, lanes: int = LANES) -> Column:
    """64 bits of each lane as 16 hexadecimal digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(lane(form, seed))), 16, "0") for seed in SEEDS[:lanes]])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row's whole text, without the comparison
    with other rows: for joins on content."""
    return docs.select("doc_id", digest(canonical(text_or_empty())).alias("fingerprint"))


def _neighbours(docs: DataFrame, lanes: int) -> DataFrame:
    """For each row its key (k, o), length, digest, whether the digest occurs
    more than once, and the key of the next row in descending order. Only
    these narrow columns are shuffled and ranked."""
    spark = docs.sparkSession
    by_id = Window.partitionBy("k").orderBy("h")
    narrow = docs.select("k", "h", F.length("t").alias("n"), digest(canonical(F.col("t")), lanes).alias("fp")).withColumn("o", F.row_number().over(by_id)).drop("h")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = narrow.repartitionByRange(parts, F.desc("k"), F.desc("o")).withColumn("p", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    # One row for each partition: as many as the shuffle has, whatever the input.
    first = ranged.groupBy("p").agg(F.max(F.struct("k", "o")).alias("at"))
    ends = first.select("p", F.lead("at").over(Window.orderBy("p")).alias("after"), F.max("at").over(Window.partitionBy(F.lit(1))).alias("top"))
    ends = ends.select("p", F.coalesce("after", "top").alias("edge"))
    step = Window.partitionBy("p").orderBy(F.desc("k"), F.desc("o"))
    nexts = ranged.withColumn("nx", F.lead(F.struct("k", "o")).over(step)).join(F.broadcast(ends), "p")
    many = ranged.groupBy("fp").count().where("count > 1").select("fp", F.lit(True).alias("dup"))
    return nexts.join(many, "fp", "left").select("k", "o", "n", "fp", F.coalesce("dup", F.lit(False)).alias("dup"), F.coalesce("nx", "edge").alias("nx"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, without clashes."""
    for lanes in range(LANES, len(SEEDS) + 1, 2):
        rows = _prints(docs, lanes)
        if not _clash(rows):
            break
    like = lambda a: F.when(F.col("fingerprint") == F.col(a), F.lit(1.0)).otherwise(F.lit(0.0))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fp").alias("near_next"))


@scoped
def _prints(docs: DataFrame, lanes: int) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last third of its
    code points replaced by as many of the next document's first.

    Texts move once, by doc_id; the digests, lengths and order are found on
    narrow rows before. A likeness is 1.0 for equal fingerprints, else 0.0.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k"), text_or_empty().alias("t")).withColumn("h", F.xxhash64("t"))
    near = written(_neighbours(base, lanes), "order")
    texts = base.withColumn("o", F.row_number().over(Window.partitionBy("k").orderBy("h"))).drop("h")
    # The second key is a residual condition, so that all joins keep the
    # partitioning by the first and the texts are exchanged once.
    same = lambda a, b: (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b))
    heads = near.select(F.col("nx.k").alias("nk"), F.col("nx.o").alias("no"), F.col("k").alias("ok"), F.col("o").alias("oo"), F.expr("n div 3").alias("m"))
    fps = near.select(F.col("k").alias("fk"), F.col("o").alias("fo"), F.col("fp").alias("next_fp"))
    patches = (
        heads.join(texts.select(F.col("k").alias("nk2"), F.col("o").alias("no2"), "t"), (F.col("nk") == F.col("nk2")) & same("no", "no2"))
        .select("ok", "oo", "m", F.expr("left(t, cast(m as int))").alias("patch"), "nk", "no")
        .join(fps, (F.col("nk") == F.col("fk")) & same("no", "fo"))
        .select("ok", "oo", "m", "patch", "next_fp")
    )
    own = near.select(F.col("k").alias("wk"), F.col("o").alias("wo"), "n", "fp", "dup")
    whole = texts.join(own, (F.col("k") == F.col("wk")) & same("o", "wo")).join(patches, (F.col("k") == F.col("ok")) & same("o", "oo"))
    edited = F.concat(F.expr("left(t, cast(n - m as int))"), F.col("patch"))
    rows = whole.select("k", "n", "fp", "next_fp", "dup", F.when(F.col("dup"), F.col("t")).alias("t"), F.col("t").alias("t0"), edited.alias("e"), (F.col("t") == edited).alias("unchanged"))
    print_ = F.when(F.col("unchanged"), F.col("fp")).otherwise(digest(canonical(F.col("e")), lanes))
    rows = rows.withColumn("efp", print_)
    return rows.select(
        F.when(F.col("k") != _NO_ID, F.col("k")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("e", 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.col("efp").alias("edited_fingerprint"),
        "next_fp",
        F.when(F.col("dup"), canonical(F.col("t"))).alias("form"),
        # Equal digests of a text and its edited text: their forms must be equal.
        F.when((F.col("efp") == F.col("fp")) & ~F.col("unchanged"), canonical(F.col("t0")) != canonical(F.col("e"))).otherwise(F.lit(False)).alias("differs"),
    )


def _clash(rows: DataFrame) -> bool:
    """Compare bytes inside equal buckets. Copies merge before the shuffle, so
    a bucket brings one row for each different form."""
    forms = rows.where("form is not null").select("fingerprint", "form").distinct()
    several = forms.groupBy("fingerprint").count().where("count > 1")
    return not several.isEmpty() or not rows.where("differs").isEmpty()


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(documents(spark, sf_dir))
