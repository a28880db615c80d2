"""Consistent sharding through a permutation-filled look-up table.

Each shard has a preference order over the slots of a prime-sized table,
``(offset + j * skip) mod size``; shards take turns claiming their next free
slot until the table is full. A row's key is hashed to a slot and the shard is
read from the table, which is broadcast: its size is the constant ``slots``, no
matter how many rows there are. Adding or removing a shard moves few keys.

Defined cases: a null key has the slot of an empty text; repeated keys share a
shard; an empty table gives an empty result; other columns pass through, except
that existing ``slot`` and ``shard`` columns are replaced.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
#: a prime over 100 times the number of shards, which keeps their loads within about one percent
SLOTS = 6553
#: largest table that is broadcast: 64 MB of slots
MOST_SLOTS = 1 << 23


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...], slots: int) -> list[int]:
    """Slot -> number of the shard that claimed it."""
    if not is_prime(slots) or len(shards) > slots or slots > MOST_SLOTS or not shards:
        raise ValueError(f"slots must be a prime from {len(shards)} to {MOST_SLOTS}, and there must be a shard")
    step = [(_number(s, "offset") % slots, _number(s, "skip") % (slots - 1) + 1 if slots > 2 else 1) for s in shards]
    table, turn, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i, (offset, skip) in enumerate(step):
            while table[slot := (offset + turn[i] * skip) % slots] >= 0:
                turn[i] += 1
            table[slot] = i
            left -= 1
            if not left:
                break
    return table


def assign_shards(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with ``slot`` and ``shard``."""
    spark = rows.sparkSession
    table = json.dumps(lookup_table(shards, slots))
    claimed = spark.range(1).select(F.posexplode(F.from_json(F.lit(table), "array<int>")).alias("slot", "claimed"))
    names = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(list(shards))), "array<string>")).alias("claimed", "shard"))
    lookup = claimed.join(F.broadcast(names), "claimed").select("slot", "shard")
    digest = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8)
    slot = F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)).cast("int")
    kept = rows.drop("slot", "shard")
    placed = kept.withColumn("slot", slot).alias("r").join(F.broadcast(lookup).alias("l"), F.col("r.slot") == F.col("l.slot"))
    return placed.select(*[F.col(f"r.{quoted(c)}") for c in kept.columns], F.col("r.slot").alias("slot"), F.col("l.shard").alias("shard"))
