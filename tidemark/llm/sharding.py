"""Placement of rows on shards through a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in an order of its own. Shards take turns; at its turn a
shard claims the first slot of its walk that is still free. Losing a shard moves few rows of the others.
The table depends on the shard names alone, so it is filled once on the driver and broadcast: its size is
about ``SLOTS_PER_SHARD`` entries for each shard, whatever the data.

Defined results: a null key is a key of its own; equal keys go to one slot unless hot keys are split; empty
tables give empty results; columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS_PER_SHARD = 100
HASH_DIGITS = 15  # hexadecimal digits of md5 that fit a signed 64-bit integer


def name_hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HASH_DIGITS], 16)


def next_prime(n: int) -> int:
    while n < 2 or any(n % k == 0 for k in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """Index of the shard that owns each slot; ``size`` is prime, so every walk visits every slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if size != next_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime that gives every shard a slot")
    place = [name_hash(s + "|first") % size for s in shards]
    stride = [name_hash(s + "|stride") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while owner[place[i]] >= 0:
            place[i] = (place[i] + stride[i]) % size
        owner[place[i]] = i
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """(slot, shard) rows of the filled table, from one literal."""
    owners = F.lit(",".join(map(str, fill_table(shards, size))))
    return spark.range(1).select(F.posexplode(F.split(owners, ",")).alias("slot", "shard")) \
        .select("slot", F.col("shard").cast("int").alias("shard"))


def key_hash(*keys: str | Column) -> Column:
    """Non-negative hash that other engines can repeat; null differs from every text."""
    text = [F.coalesce(F.concat(F.lit("k"), F.col(k) if isinstance(k, str) else k), F.lit("n")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, HASH_DIGITS), 16, 10).cast("bigint")


def split_hot_keys(df: DataFrame, key: str, shards: int, spread: Column, name: str = "part_of_key") -> DataFrame:
    """Number the pieces of keys that hold more rows than a shard's fair share; 0 for the others.

    Fewer than ``shards`` keys can exceed the share, so the table of hot keys may be broadcast. ``spread`` deals
    the rows of a key to its pieces; it should differ between rows.
    """
    fair = max(-(-df.count() // shards), 1)
    hot = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > fair) \
        .select("_key", F.ceil(F.col("_n") / F.lit(fair)).alias("_pieces"))
    return df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key")), "left") \
        .withColumn(name, F.coalesce(F.pmod(spread, F.col("_pieces")), F.lit(0)).cast("int")) \
        .drop("_key", "_pieces")


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (index into ``shards``): one hash and one broadcast lookup a row."""
    size = size or next_prime(SLOTS_PER_SHARD * len(shards))
    table = lookup_table(df.sparkSession, shards, size)
    base = df.drop("slot", "shard")
    placed = base.withColumn("slot", F.pmod(key_hash(*keys), F.lit(size)).cast("int"))
    return placed.join(F.broadcast(table), "slot").select(*base.columns, "slot", "shard")
