"""Cut a long lineage at a written table in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def setting(spark: SparkSession, key: str) -> str | None:
    """A setting of the session, else of its context."""
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where it is unset, one beside the warehouse tables.

    Raises on a cluster whose warehouse lies on a local disk: executors would not see each other's files.
    """
    folder = setting(spark, "spark.checkpoint.dir")
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
        single = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
        if not single and (folder.startswith("file:") or "://" not in folder):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def stage_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet and read it back, so later fits rescan only the columns they use
    and a lost executor costs no recomputation of the work before this point."""
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
