"""Shards by jump consistent hashing, as column expressions only.

The key's stream of random numbers is xxhash64(key, 1), xxhash64(key, 2), ...; jumping through it needs no
ring table, and with one shard more a key either stays or moves into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

SHARDS = 16
#: A key jumps about ln(shards) times; more than this many jumps have a probability below 1e-80 for up to
#: a million shards, and a key that reached it would still get one fixed valid shard.
MAX_JUMPS = 256


def jump_hash(key: Column, shards: int) -> Column:
    """int in 0 .. shards - 1.  `key`: a long column; a null key counts as one fixed key."""
    steps = F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS)))

    def jump(s: Column, i: Column) -> Column:
        r = F.shiftrightunsigned(F.xxhash64(key, i), 33) + F.lit(1)
        there = F.floor((s.j + F.lit(1)) * (F.lit(2147483648.0) / r)).cast("long")
        return F.when(s.j < shards, F.struct(s.j.alias("b"), there.alias("j"))).otherwise(s)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(steps, start, jump, lambda s: s.b.cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the id and the number of shards decide.  size is the UTF-8 length of the text plus 1
    and text_crc32 its unsigned CRC-32 (a null text counts as no bytes: size 1, CRC 0).  slot numbers the
    rows of a shard from 0 without gaps.  Null ids share one shard; repeated rows get a slot each.

    Slots come from a two-level count (rows within a shard's chunk, then chunks within the shard), so no
    task ever holds a whole shard; texts are read once and never shuffled.
    """
    spark = docs.sparkSession
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    chunk = F.pmod(F.xxhash64(key, F.lit("chunk")), F.lit(partitions(spark))).cast("int")
    thin = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        chunk.alias("chunk"),
    )
    thin = materialize(thin, "shards")
    sums = thin.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    sums = sums.select("shard", "chunk", (F.expr("sum(n) over (partition by shard order by chunk)") - F.col("n")).alias("before"))
    rank = F.expr("row_number() over (partition by shard, chunk order by doc_id, size, text_crc32)")
    out = thin.withColumn("rank", rank).join(sums, ["shard", "chunk"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), "grown_shard"
    )
