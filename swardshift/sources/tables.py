"""Tabular inputs, stage tables and versioned dictionaries."""

from __future__ import annotations

import re
import time
from collections.abc import Mapping, Sequence

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def repair_names(names: Sequence[str], filler: str = ".") -> list[str]:
    """Syntactic, unique names: odd characters -> ``filler``, duplicates numbered.

    Use ``filler="_"`` for names that need no back-ticks in Spark.
    """
    out = []
    for i, name in enumerate(names, 1):
        fixed = re.sub(r"[^0-9A-Za-z_.]", filler, name) if name else f"...{i}".replace(".", filler)
        if filler != ".":
            fixed = fixed.replace(".", filler)
        if re.match(r"^(\d|\.\d|_)", fixed) and filler == ".":
            fixed = ("..." if fixed[0].isdigit() else "..") + fixed
        elif fixed[:1].isdigit():
            fixed = filler + fixed
        out.append(fixed)
    twice = {n for n in out if out.count(n) > 1}
    return [f"{n}{filler * 3}{i}" if n in twice else n for i, n in enumerate(out, 1)]


def with_repaired_names(df: DataFrame, filler: str = "_") -> DataFrame:
    return df.toDF(*repair_names(df.columns, filler))


def read_sheet(
    spark: SparkSession, path: str, schema: StructType | str, filler: str | None = "_"
) -> DataFrame:
    """A survey sheet landed as CSV (with header) or Parquet, types stated by the caller."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.schema(schema).parquet(path)
    else:
        df = spark.read.csv(path, header=True, schema=schema, nanValue="NaN", mode="PERMISSIVE")
    return with_repaired_names(df, filler) if filler else df


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write a stage table; stages can then be re-run one by one."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_dictionary(df: DataFrame, root: str, version: int | None = None) -> str:
    """Write a new version of the variable dictionary beside the earlier ones.

    The study rewrites the file it has just read; Spark must not, so each
    version has its own folder and readers take the newest.
    """
    version = time.time_ns() if version is None else version
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_dictionary(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of the dictionary."""
    every = spark.read.parquet(root)
    newest = every.agg(F.max("version").alias("version"))
    return every.join(newest, "version", "left_semi").drop("version")


def save_model(model: RandomForestRegressionModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> RandomForestRegressionModel:
    return RandomForestRegressionModel.load(path)


def read_cube(
    spark: SparkSession,
    path: str,
    dataset: str,
    filters: Mapping[str, Sequence[str] | str] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """One data set of a long statistics cube, restricted by its dimensions.

    The cube is stored partitioned by ``dataset``, so naming it prunes folders;
    dimension filters reach the Parquet scan. Dimensions held to one value
    carry nothing and are dropped, like those in ``drop``.
    """
    cube = spark.read.parquet(path).where(F.col("dataset") == dataset)
    return restrict_cube(cube, filters, drop).drop("dataset")


def restrict_cube(
    cube: DataFrame, filters: Mapping[str, Sequence[str] | str] | None = None, drop: Sequence[str] = ()
) -> DataFrame:
    fixed = list(drop)
    for dim, wanted in (filters or {}).items():
        values = [wanted] if isinstance(wanted, str) else list(wanted)
        cube = cube.where(F.col(dim).isin(*values))
        if len(values) == 1:
            fixed.append(dim)
    return cube.drop(*fixed)
