"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate data goes: ``spark.checkpoint.dir``, else a folder beside the warehouse tables.

    Both lie on the file system that the cluster shares; no machine-local
    temporary folder is chosen under any master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def write_stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it.

    Cuts the lineage, so that a lost executor costs only the tasks of the later
    step; later readers prune columns and push filters. The files go with
    ``drop_stages``, or else when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _place(spark, path)
    files.deleteOnExit(target)
    written = spark.read.schema(df.schema).parquet(path)
    written.stage_path = path
    return written


def drop_stages(*written: DataFrame) -> None:
    """Delete the files of tables that ``write_stage`` returned, once all that is made of them is written too."""
    for df in written:
        drop_path(df.sparkSession, df.stage_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what was written below ``path`` in the shared folder."""
    target, files = _place(spark, path)
    files.delete(target, True)


def _place(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
