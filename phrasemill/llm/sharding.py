"""Sharding by a permutation-filled lookup table (prime-sized; shards take turns claiming slots).

Defined results: a null key is placed like the empty string; repeated rows land on one shard; an
empty table gives an empty result; a very long key is hashed whole; only the key decides. The result is a column of
its own, ``out``: a column of that name (but the key) gives way to it, so name another where one is to be kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.session import table

SHARDS = tuple(f"shard-{i:02d}" for i in range(64))
SLOTS = 6421  # a prime of about a hundred slots a shard bounds the imbalance near one per cent


def _digest(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Slot -> index of its shard. Each shard's preference order is the permutation offset + j * skip
    of the prime-sized table; the shards take turns, each claiming its next free slot."""
    if not shards or not is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime, no smaller than the number of shards")
    at = [_digest(s, "offset") % slots for s in shards]
    skip = [_digest(s, "skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table_, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table_[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table_[at[i]] = i
            free -= 1
            if not free:
                break
    return table_


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The key's slot: the first 60 bits of its MD5, modulo the size of the table."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("long")


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, out: str = "placement") -> DataFrame:
    """rows with a struct column ``out`` (slot, shard); the table travels as a constant array of
    ``slots`` small integers, so placement is one array access and no shuffle."""
    if key.lower() == out.lower():
        raise ValueError("the result may not take the key's name")
    lookup = F.lit([int(x) for x in lookup_table(shards, slots)])
    names = F.lit(list(shards))
    kept = rows.drop(out) if out in rows.columns else rows
    slotted = kept.withColumn(out, slot_of(F.col(f"`{key}`"), slots))
    return slotted.withColumn(out, F.struct(F.col(f"`{out}`").alias("slot"), F.get(names, F.get(lookup, F.col(f"`{out}`").cast("int"))).alias("shard")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(table(spark, sf_dir, "documents"), "doc_id")
    return placed.select("doc_id", "source", "placement.slot", "placement.shard")


ORACLE_SQL = {
    "op8_sharding": f"""
WITH slots AS (SELECT doc_id, source, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::BIGINT slot FROM documents)
SELECT doc_id, source, slot, {list(SHARDS)}[{lookup_table()}[slot + 1] + 1] AS shard FROM slots"""
}
QUERIES = {"op8_sharding": op8_sharding}
