"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order of the slots of a prime-sized table: an offset and a step from hashes of its
name. The shards take turns; in its turn a shard claims the first free slot of its order. Slots are shared out as evenly
as can be, and few of them change hands when a shard comes or goes. A row's place is the table at the hash of its key.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime. The table has so many rows whatever the size of the data.
SLOTS = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """For each slot, the number of its shard in shards. The names must differ, and be no more than the slots."""
    if not _prime(slots) or not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("a prime number of slots, and different shards, no more than slots")
    marks = [hashlib.md5(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(m[:8], "big") % slots for m in marks]
    step = [int.from_bytes(m[8:], "big") % (slots - 1) + 1 for m in marks]
    table, turn, free = np.full(slots, -1, np.int32), 0, slots
    at = offset[:]
    while free:
        k = turn % len(shards)
        while table[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % slots
        table[at[k]] = k
        free, turn = free - 1, turn + 1
    return table


def slot(keys: list[Column], slots: int = SLOTS) -> Column:
    """The slot of a row: the first 52 bits of the MD5 of its keys, joined by colons (null: empty), modulo slots."""
    text = F.concat_ws(":", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def place(df: DataFrame, shards: list[str], keys: list[str], slots: int = SLOTS) -> DataFrame:
    """df with slot and shard. Rows with equal keys get one shard, nulls as empty text; columns so called are replaced, all others
    kept; names that begin with __tess are the operator's own.

    The table of slots rows is broadcast: its size is a parameter and doesn't grow with the data. No row moves.
    """
    table = df.sparkSession.createDataFrame([(k, shards[s]) for k, s in enumerate(lookup(shards, slots).tolist())], "__tess_slot int, shard string")
    met = df.drop("slot", "shard").withColumn("slot", slot([F.col(k) for k in keys], slots)).join(F.broadcast(table), F.col("slot") == F.col("__tess_slot"), "left")
    return met.drop("__tess_slot")


def write(df: DataFrame, path: str, files: int = 1, key: str = "doc_id") -> None:
    """Writes placed rows into a folder for each shard, each from files tasks, so that a large shard is not one task's."""
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(files))
    df.repartition("shard", salt).write.mode("overwrite").partitionBy("shard").parquet(path)
