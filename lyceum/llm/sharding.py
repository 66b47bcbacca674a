"""Shard placement by a permutation-filled lookup table (operator 4, native).

Every shard has an order of preference over the slots of a table of prime size, given
by an offset and a skip that a hash of its name sets. The shards take turns; each claims
the first slot of its order that is still free, until no slot is. A row's key hashes to
a slot, and a join with the broadcast table, whose size is fixed by ``size``, gives its
shard in constant time. When a shard goes, few rows of other shards move.

The table is filled on the driver (``size`` steps, no data). Keys that are null share
the slot of the text U+0000 followed by "null" (and so of a key of that very text). Equal keys share a shard unless
``spread`` > 1, which deals one key over that many slots by a hash of ``spread_by``.
Repeated rows and empty tables need no care; columns ``slot`` and ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without

SIZE = 65537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard, from the MD5 of its name."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1


def fill(names: list[str], size: int = SIZE) -> list[int]:
    """The shard number of each slot. Names must differ and number at most ``size``."""
    if not is_prime(size) or not 0 < len(names) <= size or len(set(names)) < len(names):
        raise ValueError("size must be prime, shard names distinct, between 1 and size of them")
    orders = [preference(n, size) for n in names]
    at, skips = [o for o, _ in orders], [s for _, s in orders]
    table, left = [-1] * size, size
    while left:
        for i in range(len(names)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skips[i]) % size
            table[slot] = i
            at[i] = (slot + skips[i]) % size
            left -= 1
            if not left:
                break
    return table


def lookup(spark: SparkSession, table: list[int]) -> DataFrame:
    """``table`` as rows (slot, shard), made from one literal."""
    text = F.lit(",".join(map(str, table)))
    return spark.range(1, numPartitions=1).select(F.posexplode(F.split(text, ",")).alias("slot", "_s")).select("slot", F.col("_s").cast("int").alias("shard"))


def slot_of(key: Column, size: int = SIZE) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key_col: str, names: list[str], size: int = SIZE, spread: int = 1, spread_by: str | None = None) -> DataFrame:
    """``df`` with each row's ``slot`` and ``shard``."""
    key = F.col(f"`{key_col}`").cast("string")
    if spread > 1:
        part = F.pmod(F.xxhash64(F.col(f"`{spread_by or key_col}`")), F.lit(spread)).cast("string")
        key = F.concat_ws("\x1f", F.coalesce(key, F.lit("\x00null")), part)
    keep = without(df, ["slot", "shard"])
    rows = df.select(*[F.col(f"`{c}`") for c in keep], slot_of(key, size).alias("slot"))
    return rows.join(F.broadcast(lookup(df.sparkSession, fill(names, size))), "slot").select(*keep, "slot", "shard")
