"""Sharding by balanced label propagation.

Documents with equal texts are linked with each other. Every document starts
in a shard chosen by a hash. In each round, a linked document looks where its
neighbours are and asks for the open shard that most of them are in; requests
are admitted, by hash, up to the shard's free capacity. A last repair moves
unlinked documents first, until the counts of the shards are at most one
apart (the law ``rows``).

A group of equal texts is kept as one histogram over shards, so its links are
never listed, and a group of any size costs one row for each shard it is in.

Defined results: a null text counts as no bytes, size 1; null and empty texts
are equal; repeated rows each get a slot of their own; fewer documents than
shards leave shards empty; an empty table gives an empty result; further
input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import documents, slots, text_or_empty, written

SHARDS, ROUNDS, SLACK = 8, 8, 0.02


def quotas(n: int, shards: int) -> list[int]:
    """Counts at most one apart."""
    return [n // shards + (j < n % shards) for j in range(shards)]


def _by_shard(values: list, shard: str = "shard") -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(shard) + 1)


def _round(linked: DataFrame, room: list[int], turn: int) -> DataFrame:
    """One round of propagation: where neighbours are, asked for and admitted."""
    shards = len(room)
    # Free shards only; of equally favoured ones the same for the whole group.
    hist = linked.groupBy("g", "g2", "shard").count()
    open_ = hist.where(_by_shard([r > 0 for r in room]))
    best = open_.groupBy("g", "g2").agg(F.max(F.struct("count", F.xxhash64("g", "shard").alias("tie"), "shard")).alias("to"))
    here = hist.withColumnsRenamed({"count": "here"})
    move = here.join(best, ["g", "g2"]).where((F.col("to.shard") != F.col("shard")) & (F.struct(F.col("to.count"), F.col("to.tie")) > F.struct(F.col("here"), F.xxhash64("g", "shard"))))
    move = written(move.select("g", "g2", "shard", "here", F.col("to.shard").alias("asked")), "asked")
    asked = dict.fromkeys(range(shards), 0) | {r["asked"]: r["n"] for r in move.groupBy("asked").agg(F.sum("here").alias("n")).collect()}
    share = [min(1.0, room[j] / asked[j]) if asked[j] else 0.0 for j in range(shards)]
    luck = F.pmod(F.xxhash64(F.lit(turn), F.col("doc_id"), F.col("g")), F.lit(1 << 20)) / float(1 << 20)
    moved = linked.join(move.drop("here"), ["g", "g2", "shard"], "left")
    to = F.when(F.col("asked").isNotNull() & (luck < _by_shard(share, "asked")), F.col("asked")).otherwise(F.col("shard"))
    return moved.withColumn("shard", to).drop("asked")


def _counts(df: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    return [found.get(j, 0) for j in range(shards)]


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    t = text_or_empty()
    d = docs.select(
        "doc_id",
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(F.encode(t, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(F.lit(3), t).alias("g"),
        F.xxhash64(F.lit(7), t).alias("g2"),
    )
    d = written(d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int")), "nodes")
    n = d.count()
    groups = d.groupBy("g", "g2").count().where("count > 1").select("g", "g2", F.lit(True).alias("linked"))
    d = written(d.join(groups, ["g", "g2"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "linked")
    single, linked = d.where("not linked"), d.where("linked")
    most = [int(q * (1 + SLACK)) for q in quotas(n, shards)]
    alone = _counts(single, shards)
    for turn in range(rounds):
        # Unlinked documents give way later: only half of them take up room.
        full = _counts(linked, shards)
        room = [max(0, m - f - a // 2) for m, f, a in zip(most, full, alone)]
        linked = written(_round(linked, room, turn), "round")
        if _counts(linked, shards) == full:
            break
    d = single.unionByName(linked)
    d = slots(_levelled(d, n, shards), "shard", "doc_id", n, "slot")
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _levelled(d: DataFrame, n: int, shards: int) -> DataFrame:
    """Move as few documents as needed, unlinked ones first, to meet the quotas."""
    want = quotas(n, shards)
    have = _counts(d, shards)
    alone = _counts(d.where("not linked"), shards)
    over = [max(0, h - w) for h, w in zip(have, want)]
    need = [max(0, w - h) for h, w in zip(have, want)]
    d = d.withColumn("class", F.concat_ws("/", F.col("shard"), F.col("linked").cast("int")))
    d = slots(d, "class", "doc_id", n, "place").drop("class")
    first = [sum(over[:j]) for j in range(shards)]
    order = F.col("place") + F.when(F.col("linked"), _by_shard(alone)).otherwise(0)
    leaves = order < _by_shard(over)
    seat = _by_shard(first) + order
    to = F.lit(0)
    for j in range(shards - 1):
        to = to + F.when(seat >= sum(need[: j + 1]), 1).otherwise(0)
    return written(d.withColumn("shard", F.when(leaves, to).otherwise(F.col("shard")).cast("int")).drop("place"), "levelled")


def cut_links(sharded: DataFrame) -> DataFrame:
    """Groups of equal texts and the shards each is spread over: the cut."""
    return sharded.groupBy("text_crc32", "size").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shard").alias("spread")).where("n > 1")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
