"""Sharding by a permutation-filled lookup table, with DataFrame operations only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = 65_537


def _preference(shard: str, size: int) -> tuple[int, int]:
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % size, int(digest[8:16], 16) % (size - 1) + 1


def lookup_table(shards: list[str], size: int = PRIME) -> list[int]:
    """slot -> position in shards.  Shards take turns; each claims the next free slot in its order of
    preference, offset + j * skip modulo the prime size, until all slots are taken.

    Slots a shard differ by one at most, and a shard that goes or comes moves few other slots.  The
    table's size is a parameter, whatever the data: `size` entries.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, one at least and no more than slots")
    if size < 3 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime over 2")
    table, steps, claimed = [-1] * size, [_preference(s, size) for s in shards], 0
    at = [offset for offset, _ in steps]
    while True:
        for k, (_, skip) in enumerate(steps):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + skip) % size
            table[slot], at[k] = k, (slot + skip) % size
            claimed += 1
            if claimed == size:
                return table


def slot_of(key: str | Column, size: int = PRIME) -> Column:
    """A key's slot: the first 32 bits of its text's MD5, modulo the size.  A null key counts as ''."""
    column = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def slots(spark: SparkSession, shards: list[str], size: int = PRIME) -> DataFrame:
    """The lookup table as (slot, shard): `size` rows, made of one literal."""
    packed = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    rows = spark.range(1).select(F.posexplode(packed).alias("slot", "k"))
    return rows.select("slot", F.element_at(F.array(*[F.lit(s) for s in shards]), F.col("k").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], size: int = PRIME) -> DataFrame:
    """df with slot and shard added, by a hash lookup in the broadcast table; nothing is shuffled.

    Equal keys share a shard however many they are; null keys go where '' goes, very long ones where
    their hash says.  Columns named slot or shard in df are replaced, unless one of them is the key: its
    values are read first.  Every row is kept, repeated ones too; an empty table stays empty.
    """
    kept = df.withColumn("_slot", slot_of(key, size)).drop("slot", "shard").withColumnRenamed("_slot", "slot")
    return kept.join(F.broadcast(slots(df.sparkSession, shards, size)), "slot").select(*[c for c in kept.columns if c != "slot"], "slot", "shard")


def write_sharded(df: DataFrame, key: str, shards: list[str], path: str, files: int, size: int = PRIME) -> None:
    """Write df as Parquet under shard=<name>; a shard's rows are dealt over `files` tasks by a hash of
    all their columns, so a hot shard, source or key range is written by many tasks and a retried task
    deals alike.  Rows equal in every column go to one task."""
    placed = place(df, key, shards, size)
    flat = [F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in placed.dtypes]
    placed = placed.withColumn("_deal", F.pmod(F.xxhash64(*flat), F.lit(files)))
    placed.repartition("shard", "_deal").drop("_deal").write.partitionBy("shard").parquet(path)


def move_share(before: list[str], after: list[str], size: int = PRIME) -> float:
    """Share of slots whose shard differs between two lists of shards."""
    a, b = lookup_table(before, size), lookup_table(after, size)
    return sum(before[x] != after[y] for x, y in zip(a, b)) / size
