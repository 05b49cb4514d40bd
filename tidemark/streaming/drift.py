"""Drift of arriving feature rows against a static baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.drift import drift_columns


def drift_on_stream(arrivals: DataFrame, baseline: DataFrame, cols: Sequence[str], key: str = "key",
                    threshold: float = 0.25) -> DataFrame:
    """Stateless stream-static join on the key; append mode, one drift row per arrival."""
    left = arrivals.select(key, *[F.col(c).alias(f"{c}_a") for c in cols])
    right = baseline.select(key, *[F.col(c).alias(f"{c}_b") for c in cols])
    return drift_columns(left.join(right, key), key, cols, threshold)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> str:
    """Drain what is available now into a parquet table, exactly once."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(path))
    q.awaitTermination()
    return path
