"""Joins with explicit keys, and duplicate handling built on aggregates.

Where the study tags every row with a statistic of its group, these operators
aggregate first (partial sums before the shuffle) and join the small result
back, so a group that holds a large part of the table is never sorted or held
by one task; the join back is one Spark can split when a key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def natural_join(left: DataFrame, right: DataFrame, expect: Sequence[str], how: str = "left") -> DataFrame:
    """Join on all common columns, which must be exactly the ones expected."""
    common = [c for c in left.columns if c in right.columns]
    if set(common) != set(expect):
        raise ValueError(f"common columns are {common}, expected {list(expect)}")
    return left.join(right, list(common), how)


def null_safe_anti(left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``left`` without a match in ``right``; missing keys match missing keys."""
    keys = list(keys) if keys else [c for c in left.columns if c in right.columns]
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys]).distinct()
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = eq if cond is None else cond & eq
    return left.join(r, cond, "left_anti")


def null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which missing keys match missing keys."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = eq if cond is None else cond & eq
    return left.join(r, cond, "left").drop(*[f"__r_{k}" for k in keys])


def null_safe_inner(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which missing keys match missing keys."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = eq if cond is None else cond & eq
    return left.join(r, cond).drop(*[f"__r_{k}" for k in keys])


def null_safe_semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with a match in ``right``; missing keys match missing keys."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys]).distinct()
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = eq if cond is None else cond & eq
    return left.join(r, cond, "left_semi")


def beside_each(left: DataFrame, catalogue: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each row of ``left`` beside each row of a catalogue (grids, classes), whose rows ``order`` tells apart.

    The catalogue stays a table: its rows are numbered, the rows of ``left``
    fan out over the numbers and meet it by number, an equi-join that Spark
    broadcasts if the catalogue is small enough.
    """
    from .ordering import number_rows

    numbered = cut_lineage(number_rows(catalogue, list(order), "__each"))
    n = numbered.count()
    fanned = left.select("*", F.explode(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("__each"))
    return fanned.join(numbered, "__each").drop("__each")


def union_by_name(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns a part lacks are missing."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_group_count(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add the size of each row's group."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return null_safe_left(df, sizes, keys)


def keep_extreme_ties(
    df: DataFrame, keys: Sequence[str], value: str, largest: bool = True
) -> DataFrame:
    """Rows that attain their group's largest (or smallest) value; all ties are kept."""
    best = df.groupBy(*keys).agg((F.max if largest else F.min)(value).alias("__best"))
    return null_safe_left(df, best, keys).where(F.col(value) == F.col("__best")).drop("__best")


def resolve_ambiguous_regions(
    key: DataFrame, point: str, year: str, level: str, region: str
) -> DataFrame:
    """Drop the odd one out of conflicting region assignments.

    A (point, year, level) with several regions is a conflict. Within the rows
    of points that have a conflict, at levels that have one among those points,
    an assignment seen in a single row loses against its rivals.
    """
    # Looked at from several sides below, so worked out once.
    distinct = cut_lineage(key.distinct())
    place = [point, year, level]
    sizes = distinct.groupBy(*place).agg(F.count(F.lit(1)).alias("n0"))
    conflicts = sizes.where("n0 > 1")
    affected = null_safe_semi(null_safe_semi(distinct, conflicts, [point]), conflicts, [level])
    seen = affected.groupBy(point, region).agg(F.count(F.lit(1)).alias("n1"))
    losers = null_safe_semi(null_safe_semi(affected, conflicts, place), seen.where("n1 = 1"), [point, region])
    return null_safe_anti(distinct, losers, distinct.columns)
