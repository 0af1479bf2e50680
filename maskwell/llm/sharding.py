"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm._shared import free_name

SHARDS = 64
SLOTS = 65_537


def _number(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: int | list[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of each slot. Shards take turns; at its turn a shard claims the
    first free slot of its own permutation (offset + j * skip) mod slots. Every
    slot is claimed and shares differ by at most one slot. Removing a shard
    moves few slots of the others."""
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    if not names or not _is_prime(slots) or slots < len(names):
        raise ValueError("slots must be a prime of at least the number of shards, which is at least 1")
    place = [_number(f"{name}/offset") % slots for name in names]
    skip = [_number(f"{name}/skip") % (slots - 1) + 1 for name in names]
    owner, free = [-1] * slots, slots
    while True:
        for i in range(len(names)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            owner[place[i]] = i
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of its text's md5, modulo the table size. A null key is the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def assign(df: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with columns slot and shard (underscores are appended if those names are taken).

    Each row is placed by its key alone, by one lookup in a broadcast table of
    ``slots`` rows: a parameter, so its size doesn't grow with the data. Equal
    keys share a shard, null keys that of the empty text; an empty table gives
    an empty result. No shuffle.
    """
    spark: SparkSession = df.sparkSession
    slot, shard = free_name(df, "slot"), free_name(df, "shard")
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), f"`{slot}` long, `{shard}` int")
    return df.withColumn(slot, slot_of(df[key], slots)).join(F.broadcast(table), slot).select(*df.columns, slot, shard)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS) -> None:
    """Write one folder of Parquet files for each shard. Tasks write what they
    read, so a large shard is never gathered in one place."""
    placed = assign(df, key, shards, slots)
    placed.write.partitionBy(placed.columns[-1]).parquet(path)
