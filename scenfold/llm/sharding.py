"""Sharding by a permutation-filled lookup table, in DataFrame operations alone.

A table with a prime number of slots is filled once: every shard has an order of preference over
all slots (an offset and a step, from hashes of its name), and the shards take turns in claiming
their next free slot. A row's key is hashed to a slot, and a broadcast join reads its shard.
Shares differ by at most one slot, and adding or removing a shard moves few other keys.

Scale: the table has ``SLOTS`` rows whatever the data; rows are placed where they are read, without
a shuffle, so a hot key costs nothing. Filling is a driver loop over the slots of that fixed table.

Edge cases: a null key is placed like the text ``null``; equal keys share a shard; no rows give no
rows; existing columns stay, the added ones are named by the caller.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 8191  # prime
SHARDS = 64


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's order of preference."""
    digest = hashlib.sha256(shard.encode()).digest()
    offset = int.from_bytes(digest[:8], "big") % slots
    step = int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
    return offset, step


def filled_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or len(shards) > slots:
        raise ValueError("there must be between one shard and as many as slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    wanted = [preference(s, slots) for s in shards]
    tried = [0] * len(shards)
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        offset, step = wanted[shard]
        while owner[slot := (offset + tried[shard] * step) % slots] >= 0:
            tried[shard] += 1
        owner[slot] = shard
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def place(docs: DataFrame, key: str, tables: dict[str, list[int]], slot: str = "slot") -> DataFrame:
    """Add the slot of every row's key, and a column per lookup table with the slot's shard."""
    sizes = {len(t) for t in tables.values()}
    if len(sizes) != 1:
        raise ValueError("the tables must have the same number of slots")
    fixed = [
        F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>").alias(name)
        for name, table in tables.items()
    ]
    lookup = docs.sparkSession.range(1).select(F.posexplode(F.arrays_zip(*fixed))).select(
        F.col("pos").cast("long").alias(slot), *[F.col("col")[n].alias(n) for n in tables]
    )
    keyed = docs.withColumn(slot, slot_of(F.col(key), sizes.pop()))
    return keyed.join(F.broadcast(lookup), slot, "left")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i}" for i in range(n)]
