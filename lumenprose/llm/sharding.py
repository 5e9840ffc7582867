"""Operator 5: sharding by a permutation-filled lookup table.

Every shard has a preference order of the slots of a prime-sized table: (offset + i * skip) mod size. The shards take
turns; each claims the first slot of its order that is still free, until all are taken. A document goes to the shard that
owns slot hash(doc_id) mod size: constant time, no shuffle, and the table (``SLOTS`` small numbers) is the only thing
that is sent along. Slots differ by one at most between shards, and losing a shard moves few other documents.

The key is the id, so hot sources or copies are spread evenly. Null ids have the hash of the empty text; repeated rows go
to the same shard.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHARDS, SLOTS = 32, 4099


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the owning shard for each slot."""
    if not shards or not is_prime(slots) or slots < len(shards):
        raise ValueError("at least one shard and a prime number of slots, no fewer than the shards, are needed")
    offset = [zlib.crc32(f"offset:{s}".encode()) % slots for s in shards]
    skip = [zlib.crc32(f"skip:{s}".encode()) % (slots - 1) + 1 for s in shards]
    at = [0] * len(shards)
    owner = [-1] * slots
    left = slots
    while True:
        for k in range(len(shards)):
            slot = (offset[k] + at[k] * skip[k]) % slots
            while owner[slot] >= 0:
                at[k] += 1
                slot = (offset[k] + at[k] * skip[k]) % slots
            owner[slot] = k
            at[k] += 1
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of md5 of its text, modulo the slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """``docs`` with the columns ``slot`` and ``shard`` (in place of columns of these names)."""
    owner = F.array(*(F.lit(x) for x in lookup_table(shards, slots)))
    return docs.withColumn("slot", slot_of(F.col(key), slots)).withColumn("shard", F.get(owner, F.col("slot")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), [f"shard-{k}" for k in range(SHARDS)]).select("doc_id", "slot", "shard")


def sql() -> str:
    owner = lookup_table([f"shard-{k}" for k in range(SHARDS)])
    return f"""SELECT doc_id, slot, list_extract([{", ".join(map(str, owner))}], slot + 1) AS shard FROM (
      SELECT doc_id, (('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents)"""
