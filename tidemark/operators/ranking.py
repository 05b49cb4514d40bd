"""Top-k and capped selection with unique tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, metric: str, n: int, tie: str,
          min_count: tuple[str, int] | None = None) -> DataFrame:
    """Best n rows by a metric: a distributed take-ordered, never a global sort."""
    out = df.where(F.col(metric).isNotNull())
    if min_count is not None:
        out = out.where(F.col(min_count[0]) >= min_count[1])
    return out.orderBy(F.col(metric).desc(), F.col(tie)).limit(n)


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int,
                    rank: str = "rnk") -> DataFrame:
    """Best n rows per group with their rank.  Spark cuts each input task to n rows per group
    before the shuffle (window group limit), so a dominant group stays small."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def cap_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return top_n_per_group(df, by, order, k, "_rn").drop("_rn")
