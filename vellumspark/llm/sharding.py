"""Operator 1, sharding: a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (an offset and a skip from its name).
Shards take turns claiming their most preferred free slot until none is free.  A row's key hashes to a slot and the slot names
the shard: one broadcast of a table whose size is a parameter, no shuffle, and few moves when a shard joins or leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Upper bound on the table that is broadcast, in slots.
MOST_SLOTS = 2_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int) -> list[int]:
    """For each slot the index of the shard that claimed it.  ``slots`` is a prime above the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards: at least one name, no name twice")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError("slots: a prime, as many as shards at least")
    digest = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digest]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            if not free:
                break
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
    return table


def slot_of(keys: Sequence[Column], slots: int) -> Column:
    """Slot of a key: 60 bits of the MD5 of its parts; a null part differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("~")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long") % slots


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = 65537) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (string).

    Equal keys, null ones included, share a shard; repeated rows stay; an empty table gives an empty result.  Input
    columns named slot or shard are replaced.  Keys may be of any type that casts to a string.
    """
    lookup = [(i, shards[s]) for i, s in enumerate(fill_table(shards, slots))]
    slot, shard = fresh(df, "__slot", "__shard")
    small = df.sparkSession.createDataFrame(lookup, f"{slot} long, {shard} string").coalesce(1)
    rows = df.withColumn(slot, slot_of([F.col(f"`{k}`") for k in keys], slots)).drop("slot", "shard")
    return rows.join(F.broadcast(small), slot).withColumnsRenamed({slot: "slot", shard: "shard"})


def write_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], path: str, slots: int = 65537) -> None:
    """Write one folder a shard; a task writes its part of every shard, so a shard's rows never meet in one task."""
    assign_shards(df, keys, shards, slots).drop("slot").write.partitionBy("shard").mode("errorifexists").parquet(path)
