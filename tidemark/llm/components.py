"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.lineage import settle


def _links(df: DataFrame, a, b) -> DataFrame:
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every linked id; the component is the smallest id reachable.

    Each round hangs larger neighbours, then smaller ones, on the smallest neighbour; a hub is met by its
    minimum, never by the list of its neighbours. Each round ends in a written table, so lost executors
    repeat one round. Rounds grow with the logarithm of the longest chain. No links give an empty result.
    """
    stars, mark = settle(_links(links, F.col(a), F.col(b)).distinct()), None
    while True:
        both = stars.select("u", "v").unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u")
        stars = settle(_links(small, F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")), F.col("low")).distinct())
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    return stars.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component") \
        .unionAll(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
