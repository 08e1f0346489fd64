"""Session settings and lineage cutting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .stages import write_stage


def build_session(app: str = "swardshift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library relies on.

    On a cluster leave ``master`` and the partition counts to spark-submit.
    Extra settings are given with dots written as double underscores, e.g.
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Recording the Python call site of every expression makes wide plans slow to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there afterwards.

    Used where a result is read several times. Parquet keeps column pruning for
    the later readers.
    """
    return write_stage(df, "cut")
