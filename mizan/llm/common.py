"""Helpers shared by the training-data operators: shared-folder tables,
distributed ranking and text column guards."""

from __future__ import annotations

import atexit
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: A word, as every contract of this subpackage takes it.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one task of a rank bucket should hold, and the most buckets.
RANK_ROWS, RANK_BUCKETS = 1024, 65536

_FALLBACK: list[str] = []
#: Scratch tables of the operators that run now, the innermost last.
_SCOPES: list[list[str]] = []

#: Rows and bytes of an Arrow batch, so that long texts keep the Python workers'
#: memory small. A session that sets them itself keeps its own.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    conf = spark._jsparkSession.sessionState().conf()
    for key, value in ARROW.items():
        if not conf.contains(key):
            spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, read from the
    session; a temporary one only where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="mizan-"))
    return _FALLBACK[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs only the reading of the
    table; the table goes when the innermost ``scoped`` operator returns, and
    outside of any when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mizan-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    else:
        atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def scoped(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written before it returns, and whose scratch
    tables go then. A later job reads the written result, so lost executors
    still cost no more than the reading."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _SCOPES.append([])
        spark, result, paths = None, None, []
        try:
            result = operator(*args, **kwargs)
            spark = result.sparkSession
            paths = _SCOPES.pop()
            return written(result, operator.__name__.strip("_"))
        finally:
            if result is None:
                paths = _SCOPES.pop()
                spark = SparkSession.getActiveSession()
            for path in paths if spark is not None else []:
                _forget(spark, path)
            if spark is not None:
                # Spark drops shuffle files when the driver collects its garbage.
                gc.collect()
                spark.sparkContext._jvm.System.gc()

    return run


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is over; nothing of value is lost
        return


def rank_buckets(n_rows: int) -> int:
    return max(1, min(RANK_BUCKETS, n_rows // RANK_ROWS))


def slots(df: DataFrame, group: str, key: str, n_rows: int, out: str) -> DataFrame:
    """Number the rows of each ``group`` gaplessly from 0, without putting a
    group into one task: rows are ranked within hash buckets of ``key`` (ties
    by nothing, so ``key`` must be unique) and shifted by the sizes of the
    buckets before. Order within a group: bucket, then key."""
    b = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(rank_buckets(n_rows))))
    counts = b.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(group, "_b").orderBy(key)
    return (
        b.withColumn("_r", F.row_number().over(within) - 1)
        .join(shift, [group, "_b"])
        .withColumn(out, (F.col("_r") + F.col("_shift")).cast("long"))
        .drop("_b", "_r", "_shift")
    )


def even_keys(spark: SparkSession, parts: int) -> list[int]:
    """Numbers, one for each of ``parts`` tasks, that repartition(parts, key)
    deals to different tasks; so no task gets the keys of several."""
    ids = spark.range(parts * 24).select(F.col("id").cast("int").alias("k")).withColumn("b", F.pmod(F.hash("k"), F.lit(parts)))
    found = {r["b"]: r["k"] for r in ids.groupBy("b").agg(F.min("k").alias("k")).collect()}
    return [found.get(b, b) for b in range(parts)]


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text that is not null: each shrinks to one character."""
    blanks = " \t\n\x0b\x0c\r"
    return F.length(F.regexp_replace(F.trim(text, F.lit(blanks)), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")).cast("long")


#: Rows of a written table that may be broadcast, and bytes of its files.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20


def maybe_broadcast(table: DataFrame) -> DataFrame:
    """``table`` (written) marked for broadcast if its counted rows and the bytes
    of its files are within limits; else as it is, for a join by shuffle."""
    size = int(str(table._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return F.broadcast(table) if size <= BROADCAST_BYTES and table.count() <= BROADCAST_ROWS else table
