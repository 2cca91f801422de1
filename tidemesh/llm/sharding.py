"""Sharding through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_struct

SHARDS = 64
#: Prime, and over a hundred slots a shard; the broadcast table has this many rows whatever the input.
SLOTS = 65_537


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard index of each slot.

    A shard's preference order is the permutation offset + j * skip of the
    slots, both from a hash of its name. Shards take turns; each claims the
    first slot of its order that is still free, until none is.
    """
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names must differ")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)) or slots < len(shards):
        raise ValueError("slots must be a prime and at least the number of shards")
    orders = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        orders.append((int.from_bytes(digest[:8], "little") % slots, int.from_bytes(digest[8:16], "little") % (slots - 1) + 1))
    owner, turn, claimed = [-1] * slots, [0] * len(shards), 0
    while True:
        for k, (offset, skip) in enumerate(orders):
            slot = (offset + turn[k] * skip) % slots
            while owner[slot] >= 0:
                turn[k] += 1
                slot = (offset + turn[k] * skip) % slots
            owner[slot] = k
            turn[k] += 1
            claimed += 1
            if claimed == slots:
                return owner


def table_rows(spark: SparkSession, owner: Sequence[int]) -> DataFrame:
    """The table as rows (slot, shard), made by one generator row on the JVM."""
    listed = F.split(F.lit(",".join(map(str, owner))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("_slot", "_shard")).select("_slot", F.col("_shard").cast("int").alias("_shard"))


def place(df: DataFrame, key_cols: Sequence[str] = ("doc_id",), shards: int | Sequence[str] = SHARDS, slots: int = SLOTS, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``df`` with the shard and slot of each row, by one hash and one lookup.

    The lookup is a broadcast join with a table of exactly ``slots`` rows, so
    rows never move; equal keys share a shard, and adding or removing a shard
    moves few other keys. Defined cases: null keys hash like any other value;
    repeated rows go together; an empty table stays empty; a column of ``df``
    that has one of the two result names is replaced, all others stay under
    any name.
    """
    names = [f"shard-{k:05d}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    owner = F.broadcast(table_rows(df.sparkSession, lookup_table(names, slots)))
    keys = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in key_cols]
    packed, unpacked = row_struct(df.drop(shard_col, slot_col))
    keyed = df.select(packed.alias("_row"), F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int").alias("_at"))
    return keyed.join(owner, F.col("_at") == F.col("_slot")).select(*unpacked, F.col("_at").alias(slot_col), F.col("_shard").alias(shard_col))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write ``df`` as one folder per shard; a shard may have many files, so a large one isn't one task's work."""
    placed = place(df, **options)
    placed.write.partitionBy(options.get("shard_col", "shard")).mode("overwrite").parquet(path)
