"""Long <-> wide, one-hot coding and lumping of rare levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import repair_names


def spread(
    df: DataFrame, ids: Sequence[str], key: str, value: str, names: Sequence, prefix: str = "", suffix: str = ""
) -> DataFrame:
    """One column per listed key; an unlisted or missing key makes no column.

    (ids, key) must be unique, see :func:`assert_unique`.
    """
    picks = [
        F.max(F.when(F.col(key) == n, F.col(value))).alias(f"{prefix}{n}{suffix}") for n in names
    ]
    return df.groupBy(*ids).agg(*picks)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if a key occurs twice; looks at one offending key at most."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {keys} is not unique: {twice[0].asDict()}")
    return df


def gather(df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str) -> DataFrame:
    """Wide -> long; missing values keep their rows."""
    return df.unpivot(list(ids), list(columns), key, value)


def assemble_features(
    parts: Sequence[DataFrame], ids: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Wide table with every id and feature of several wide tables (a full outer join of all).

    Instead of joining table by table, the parts are stacked and aggregated
    once: one shuffle whatever the number of parts.
    """
    every = [c for p in parts for c in p.columns if c not in ids]
    clash = {c for c in every if every.count(c) > 1}
    if clash:
        raise ValueError(f"features given twice: {sorted(clash)}")
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.groupBy(*ids).agg(*[F.max(f"`{c}`").alias(c) for c in (names or every)])


def named_values(spark: SparkSession, values: Mapping[str, float]) -> DataFrame:
    """A named vector (one entry per model variable) as a table."""
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, value double")


def level_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level, n) for several text columns in one pass; missing values are left out."""
    return (
        df.unpivot([], list(columns), "column", "level")
        .where(F.col("level").isNotNull())
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def frequent_levels(df: DataFrame, columns: Sequence[str], share: float = 0.05) -> dict[str, list[str]]:
    """Levels with more than ``share`` of a column's present values.

    There are fewer than 1/share of them per column, so they fit the driver.
    """
    counts = level_table(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "column").where(F.col("n") / F.col("total") > share)
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in kept.select("column", "level").orderBy("column", "level").collect():
        out[r["column"]].append(r["level"])
    return out


def lump_rare(
    df: DataFrame,
    columns: Sequence[str],
    share: float = 0.05,
    other: str = "Other",
    kept: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Levels at or below ``share`` become 'Other'; missing stays missing.

    The few frequent levels are looked up once and the rest is a row-wise test.
    """
    kept = kept or frequent_levels(df, columns, share)
    return df.withColumns(
        {
            c: F.when(F.col(c).isNull() | F.col(c).isin(*kept[c]), F.col(c)).otherwise(other)
            for c in columns
        }
    )


def one_hot_columns(
    df: DataFrame, levels: Mapping[str, Sequence[str]]
) -> tuple[DataFrame, dict[str, str]]:
    """0/1 column per level, no level left out, source columns removed.

    Also returns new column -> source column, so nobody needs to parse names.
    """
    raw = [(c, lv) for c, lvs in levels.items() for lv in lvs]
    names = repair_names([f"{c}_{lv}" for c, lv in raw], "_")
    new = {
        n: F.when(F.col(c) == lv, 1).when(F.col(c).isNotNull(), 0).cast("int") for n, (c, lv) in zip(names, raw)
    }
    return df.withColumns(new).drop(*levels), {n: c for n, (c, _) in zip(names, raw)}
