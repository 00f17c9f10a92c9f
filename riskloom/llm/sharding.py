"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size. The shards take turns and claim the first free slot of their order until
the table is full, so each owns an equal share of slots (one more or less), and
a changed list of shards moves few slots beyond those that must move. A row's
key hashes to a slot; the table, whose size is a parameter, is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.llm import store

TABLE_SIZE = 2039
SHARDS = [f"shard-{i:02d}" for i in range(16)]


def _preferences(shard: str, size: int) -> tuple[int, int]:
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % size, int(digest[8:16], 16) % (size - 1) + 1


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The position in `shards` of each slot's owner.

    `size` must be prime and no smaller than the number of shards, `shards` not
    empty and without repeats (ValueError otherwise). Work and memory depend on
    the parameters only, never on the data.
    """
    if not shards or len(set(shards)) != len(shards) or size < len(shards):
        raise ValueError("shards must be distinct, not empty and no more than the slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be prime")
    orders = [_preferences(s, size) for s in shards]
    tried = [0] * len(shards)
    owner = [-1] * size
    for turn in range(size):
        shard = turn % len(shards)
        offset, skip = orders[shard]
        while owner[slot := (offset + tried[shard] * skip) % size] >= 0:
            tried[shard] += 1
        owner[slot] = shard
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 60 bits of its md5, modulo the size; null as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """One row per slot: slot, shard (its name)."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    names = F.from_json(F.lit("[" + ",".join(f'"{s}"' for s in shards) + "]"), "array<string>")
    return (
        spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
        .select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("owner").cast("int")).alias("shard"))
    )


def place(
    df: DataFrame, key: str, shards: list[str] = SHARDS, size: int = TABLE_SIZE,
    slot_col: str = "slot", shard_col: str = "shard",
) -> DataFrame:
    """The rows with their slot and shard; equal keys always go together.

    A null key is placed as empty text. Repeated rows stay, an empty table stays
    empty, and columns already named like the two results are replaced. No
    shuffle: one broadcast of `size` rows.
    """
    slot, shard, own = store.new_names(df, "slot", "shard", "key_slot")
    table = table_frame(df.sparkSession, shards, size).toDF(slot, shard)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot_col, shard_col)]
    return (
        df.withColumn(own, slot_of(F.col(f"`{key}`"), size))
        .join(F.broadcast(table), F.col(own) == F.col(slot), "left")
        .select(*kept, F.col(slot).alias(slot_col), F.col(shard).alias(shard_col))
    )


def moved_slots(spark: SparkSession, before: list[str], after: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """slot, old_shard, new_shard of the slots whose owner another list of shards changes."""
    old = table_frame(spark, before, size).withColumnRenamed("shard", "old_shard")
    new = table_frame(spark, after, size).withColumnRenamed("shard", "new_shard")
    return old.join(F.broadcast(new), "slot").where("old_shard != new_shard")
