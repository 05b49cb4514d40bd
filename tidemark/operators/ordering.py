"""Row numbers and running positions over a total order, without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.lineage import settle

LOW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in these bits


def ordered_rank(df: DataFrame, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with its 0-based place in the order of ``order``; the result is a written table.

    Rows are dealt by range and sorted in their partitions. Each partition's first place is the sum of the
    sizes of those before it: one number for each partition, so it may be broadcast. Rows that tie on every
    column of ``order`` get places in any order and may share a partition: end ``order`` with a spreading hash.
    """
    cols = [c for c in order]
    dealt = df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)
    placed = settle(dealt.sortWithinPartitions(*cols).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("_mid"), LOW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    within = F.col("_mid").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    return (placed.withColumn("_part", part).join(F.broadcast(first), "_part")
            .withColumn(name, F.col("_first") + within).drop("_mid", "_part", "_first"))
