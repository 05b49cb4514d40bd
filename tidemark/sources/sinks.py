"""Writers and cached materialisation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_metrics(report: DataFrame, path: str) -> str:
    """Metric report (a tidy, bounded table) as JSON lines."""
    report.write.mode("overwrite").json(path)
    return path


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when a finished write is present under ``path``."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                force: bool = False) -> DataFrame:
    """Return the stored table, computing and storing it first when missing or forced."""
    if force or not table_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


__all__ = ["write_table", "write_metrics", "materialise", "table_exists", "save_model",
           "load_model", "Pipeline"]
