"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, given by an offset
and a step from the hash of its name. Shards take turns, each claiming the first slot of its
order that is still free, until the table is full: shares differ by a slot at most, and when a
shard goes, few slots of the others move. A document's slot is a hash of its key, so placement
is one lookup in a table of fixed size, which is broadcast.

Placement depends on the key alone. A null key has a place of its own like any other; repeated
keys share one. The table holds no rows of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import free_name

# Production size: slots (a prime) and shards.
SLOTS, SHARDS = 8191, 64


def _hash(text: str) -> int:
    """First 52 bits of the MD5, which Spark and SQL compute alike."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Shard number of every slot. ``slots`` must be a prime, not smaller than the shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must have different names")
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, not below the number of shards")
    offset = [_hash(f"{s}/offset") % slots for s in shards]
    step = [_hash(f"{s}/step") % (slots - 1) + 1 for s in shards]
    turn, table, left = [0] * len(shards), [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while table[(offset[i] + turn[i] * step[i]) % slots] >= 0:
                turn[i] += 1
            table[(offset[i] + turn[i] * step[i]) % slots] = i
            left -= 1
            if not left:
                break
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key; null counts as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key_col: str, shards: Sequence[str], slots: int = SLOTS, out_col: str = "shard") -> DataFrame:
    """``df`` with the shard number of ``key_col``, by a broadcast lookup without a shuffle."""
    df = df.drop(out_col) if out_col in df.columns else df
    table = lookup_table(shards, slots)
    names = df.columns
    at, number = free_name(names, "_slot"), free_name(names, "_shard")
    rows = df.sparkSession.createDataFrame(list(enumerate(table)), f"`{at}` int, `{number}` int")
    # ``slots`` rows of two integers, whatever the corpus.
    found = df.withColumn(at, slot(F.col(key_col), slots)).join(F.broadcast(rows), at, "left")
    return found.select(*names, F.col(number).alias(out_col))


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def write_shards(df: DataFrame, path: str, key_col: str, shards: Sequence[str], slots: int = SLOTS, parts: int = 8) -> None:
    """Write ``df`` into one folder per shard, each spread over ``parts`` tasks by its rows' keys."""
    salt = free_name(df.columns, "_salt")
    placed = place(df, key_col, shards, slots, "shard").withColumn(salt, F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    placed.repartition("shard", salt).drop(salt).write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame) -> DataFrame:
    """(doc_id, slot, shard) of every document."""
    keyed = docs.select("doc_id", slot(F.col("doc_id")).alias("slot"))
    return place(keyed, "doc_id", shard_names())


SQL = f"""
SELECT doc_id, CAST(s AS INTEGER) AS slot, CAST(list_extract({lookup_table(shard_names())}, s + 1) AS INTEGER) AS shard
FROM (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) % {SLOTS} AS s FROM documents)
"""
