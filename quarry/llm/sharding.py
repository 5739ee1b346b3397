"""Sharding by jump consistent hashing, in SQL expressions alone.

A key's 64-bit state drives the published generator; the shard is the last jump below the number of
shards. No ring or table of shards exists, and when shards are appended a key either stays or moves
to a new one, so only the necessary fraction of rows moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import gapless_rank, materialize, without

#: Fixed value: the multiplier of the generator in the paper on jump consistent hashing.
MULTIPLIER = 2862933555777941757
_LIMB = 0xFFFF


def _next_state(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64. Long products may overflow, which is an error in ANSI
    mode, so the product is summed up from 16-bit limbs."""
    a = [MULTIPLIER >> 16 * i & _LIMB for i in range(4)]
    k = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(_LIMB).cast("long")) for i in range(4)]
    columns = [sum((k[i] * F.lit(a[n - i]).cast("long") for i in range(n + 1)), F.lit(1 if n == 0 else 0).cast("long")) for n in range(4)]
    carry, limbs = F.lit(0).cast("long"), []
    for c in columns:
        total = c + carry
        limbs.append(total.bitwiseAND(F.lit(_LIMB).cast("long")))
        carry = F.shiftrightunsigned(total, 16)
    out = limbs[0]
    for i in range(1, 4):
        out = out.bitwiseOR(F.shiftleft(limbs[i], 16 * i))
    return out


def jump(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit key among a number of shards."""
    start = F.struct(key.cast("long").alias("key"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        state = _next_state(s["key"])
        reach = (F.lit(float(1 << 31)) / (F.shiftrightunsigned(state, 33) + 1).cast("double")) * (s["j"] + 1).cast("double")
        moved = F.struct(state.alias("key"), s["j"].alias("b"), F.floor(reach).cast("long").alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    # every jump goes up by one at least, so `shards` steps always reach the end
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def assign(df: DataFrame, key: Column, shards: int, name: str = "shard") -> DataFrame:
    """Add the shard of each row. Keys are hashed first, so that any type and any run of ids is
    spread evenly; null keys share a shard. A narrow projection: no shuffle."""
    return df.withColumn(name, jump(F.xxhash64(key), shards))


def shard_documents(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, law, shard, slot and grown_shard of each row.

    Shards depend on the id and the number of shards alone. Slots are gapless from 0 within a shard
    and depend on the ids and texts in it; the rows of a shard are ranked in many small buckets, so
    no task takes a whole shard. Null texts count as empty; rows with equal ids share a shard and
    take one slot each. Texts are read once and not shuffled."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = F.xxhash64("doc_id")
    placed = slim.withColumn("shard", jump(key, shards)).withColumn("grown_shard", jump(key, shards + 1))
    kept = materialize(placed, "shards")
    ranked = gapless_rank(kept, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", kept.count())
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, key: Column, shards: int = 24) -> None:
    """Write rows as Parquet, one folder a shard."""
    assign(without(df, "shard"), key, shards).write.partitionBy("shard").parquet(path)
