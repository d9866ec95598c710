"""Sharding by a permutation-filled lookup table.

Every shard ranks the slots of a prime-sized table by a permutation of its own (offset and skip from two hashes of its
name). Shards take turns claiming their best free slot, so each gets an equal share to within one slot, and adding or
removing a shard moves few slots. A document's slot is a hash of its id modulo the table's size; the table is broadcast
(its size is a parameter, not the data's), so placement is one look-up and nothing is shuffled.

A null id has slot 0. Equal ids share a shard; repeated rows stay. Texts, null or long, play no part. An empty table gives an
empty result. Columns named slot and shard are replaced, others untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = 65537) -> np.ndarray:
    """slot -> index of its shard. slots must be prime (so that every skip reaches all slots) and exceed the shards' number."""
    if not is_prime(slots) or not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("slots must be a prime of at least the number of shards, whose names must differ")
    at = np.array([_hash(s, "offset") % slots for s in shards])
    skip = np.array([_hash(s, "skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards])
    table, filled = np.full(slots, -1), 0
    at, skip = at.tolist(), skip.tolist()
    while filled < slots:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]], filled = k, filled + 1
            if filled == slots:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    """The first 60 bits of the id's SHA-256 digest, modulo the table's size."""
    return F.coalesce(F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 15), 16, 10).cast("long"), F.lit(slots)), F.lit(0)).cast("int")


def place(docs: DataFrame, shards: list[str], slots: int = 65537, id_col: str = "doc_id") -> DataFrame:
    """docs with the columns slot (int) and shard (string); columns of these names are replaced."""
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(fill_table(shards, slots).tolist())], "slot int, shard string")
    return docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(id_col), slots)).join(F.broadcast(names), "slot", "left")


def write_shards(docs: DataFrame, path: str, shards: list[str], slots: int = 65537, files_per_shard: int | None = None, id_col: str = "doc_id") -> None:
    """One folder per shard. Each shard's rows are dealt to several tasks, in all some four times the shuffle partitions unless
    files_per_shard is given, by a hash of the whole row: those of one id, or none, are dealt too."""
    files = files_per_shard or max(8, -(-4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // len(shards)))
    placed = place(docs, shards, slots, id_col).drop("slot")
    deal = F.pmod(F.xxhash64(*[F.col(c) for c, kind in placed.dtypes if "map<" not in kind]), F.lit(files))
    placed.repartition("shard", deal).write.partitionBy("shard").parquet(path)
