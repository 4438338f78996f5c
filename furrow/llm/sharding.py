"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table (offset and skip from hashes of its name;
any skip walks the whole prime-sized table). Shards take turns and claim the next slot of their order that is free, until the
table is full. Shards of weight w claim w slots a turn. A row's slot is its key's hash modulo the table size, so placement is one
array lookup, shares differ by at most one turn, and adding or dropping a shard moves few other rows.

The table has ``TABLE_SIZE`` small integers whatever the data, so broadcasting it is safe. Placement needs no shuffle and hot
sources spread, because the key, not the source, is hashed.

Defined edge cases: a null key takes the slot of the text ``null``; equal keys share a shard; extra columns pass through and
columns named like the outputs are replaced; an empty table gives an empty result; no shard or a repeated name is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> list[int]:
    """Index of the owning shard for every slot."""
    if not _is_prime(size):
        raise ValueError("the table size must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, at least one and at most one per slot")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one positive weight per shard")
    nxt = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for i, w in enumerate(weights):
            for _ in range(min(w, free)):
                while table[nxt[i]] >= 0:
                    nxt[i] = (nxt[i] + skip[i]) % size
                table[nxt[i]] = i
                free -= 1
    return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of its text's md5, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(rows: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE,
          weights: list[int] | None = None) -> DataFrame:
    """The rows with their `slot` and `shard` (name)."""
    table = lookup_table(shards, size, weights)
    spark = rows.sparkSession
    lookup = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], "slot int, shard string")
    return rows.drop("slot", "shard").withColumn("slot", slot(F.col(f"`{key}`"), size)).join(F.broadcast(lookup), "slot")


def write_shards(rows: DataFrame, path: str, shards: list[str], key: str = "doc_id", files_per_shard: int = 1, **kwargs) -> None:
    """Parquet files by shard. A shard's rows go to `files_per_shard` tasks by slot, so no single task holds a shard."""
    placed = place(rows, shards, key, **kwargs)
    (placed.withColumn("__part", F.pmod("slot", F.lit(files_per_shard)))
     .repartition(max(1, len(shards) * files_per_shard), "shard", "__part").drop("__part")
     .write.mode("errorifexists").partitionBy("shard").parquet(path))
