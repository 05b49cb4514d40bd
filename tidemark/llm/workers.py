"""Let Python workers import this package from where the driver has it.

Clusters ship the package with the job (``--py-files`` or an installed wheel); then this adds nothing they need.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> SparkSession:
    """Add the package's folder to the workers' module path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark
