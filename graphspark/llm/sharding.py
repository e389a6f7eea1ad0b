"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size: offset + j * skip, both from a hash of
its name. The shards take turns, each claiming the first slot on its list that is still free, until the table is full;
so every shard has nearly the same number of slots, and adding or removing one moves few of them. A row's slot is a hash
of its id modulo the table's size; the table, whose size is a parameter, is broadcast, so placing needs no shuffle.

Defined cases: a null id goes to slot 0; equal ids, and so repeated rows, share a shard; an empty table
gives no rows; extra columns are kept, and one named like an output column is replaced by it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots: a prime well above 100 times the usual number of shards.
SLOTS = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position of its shard in `shards`."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    order = sorted(range(len(shards)), key=lambda i: shards[i])  # the result doesn't depend on the list's order
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in order:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def place(df: DataFrame, shards: list[str], slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """df with its slot, the shard's position in `shards` (shard) and its name (shard_name)."""
    spark = df.sparkSession
    table = [(slot, i, shards[i]) for slot, i in enumerate(lookup_table(shards, slots))]
    lookup = F.broadcast(spark.createDataFrame(table, "slot int, shard int, shard_name string"))
    key = F.conv(F.substring(F.md5(F.col(f"`{id_col}`").cast("string").cast("binary")), 1, 12), 16, 10).cast("long")
    rest = [c for c in df.columns if c not in ("slot", "shard", "shard_name")]
    return df.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.pmod(key, F.lit(slots)), F.lit(0)).cast("int").alias("slot")).join(lookup, "slot").select(*[F.col(f"`{c}`") for c in rest], "slot", "shard", "shard_name")


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]
