"""Spark session defaults used by tests, bench and the command-line helpers.

On a cluster the session normally comes from ``spark-submit``; nothing in the
library depends on the values set here.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from threading import Lock

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.parquet.aggregatePushdown", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; a cluster that got it by
    ``--py-files`` or an installed wheel needs nothing of this."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    return spark


_ENVIRONMENT = Lock()  # fits run in several threads


@contextmanager
def one_thread(spark: SparkSession) -> Iterator[None]:
    """Python functions handed to Spark in here multiply matrices in one thread: a task has one core."""
    env = importable(spark).sparkContext.environment
    with _ENVIRONMENT:
        before = env.get("OPENBLAS_NUM_THREADS")
        env["OPENBLAS_NUM_THREADS"] = "1"
        try:
            yield
        finally:
            env.pop("OPENBLAS_NUM_THREADS")
            if before is not None:
                env["OPENBLAS_NUM_THREADS"] = before
