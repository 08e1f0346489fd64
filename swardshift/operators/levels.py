"""Means over a region hierarchy in which the finest level available wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strict import nan_to_null, strict_sum
from .joins import null_safe_left

REGION_LEVELS = (0, 1, 2, 3)


def _pick_finest(levels: Sequence[int], present: str, value: str) -> tuple[Column, Column]:
    """The value and number of the finest level that has rows, even if its value is missing."""
    ordered = sorted(levels, reverse=True)
    v = lv = None
    for l in ordered:
        here = F.col(f"{present}{l}") > 0
        v = F.when(here, F.col(f"{value}{l}")) if v is None else v.when(here, F.col(f"{value}{l}"))
        lv = F.when(here, F.lit(l)) if lv is None else lv.when(here, F.lit(l))
    return v, lv


def finest_level_mean(
    df: DataFrame,
    ids: Sequence[str],
    level: str,
    groups: Sequence[str],
    value: str,
    levels: Sequence[int] | None = REGION_LEVELS,
    out: str = "values",
    keep_level: bool = False,
) -> DataFrame:
    """Mean per (ids, groups) over the rows of the finest level that occurs there.

    With the few possible levels stated, all level means come out of one
    aggregation and one shuffle; with ``levels=None`` any level is allowed and
    the means are taken in two steps. The finest level wins even where its mean
    is missing. Dimensions not listed in ``groups`` are averaged away.
    """
    keys = [*ids, *groups]
    v = nan_to_null(F.col(value).cast("double"))
    if levels is None:
        means = df.groupBy(*keys, level).agg(F.avg(v).alias("__m"))
        best = means.groupBy(*keys).agg(
            F.max_by(F.struct("__m"), F.col(level)).alias("__b"), F.max(level).alias("__level")
        )
        res = best.select(*keys, F.col("__b.__m").alias(out), "__level")
    else:
        aggs = []
        for l in levels:
            at = F.col(level) == l
            aggs += [F.avg(F.when(at, v)).alias(f"__m{l}"), F.count(F.when(at, 1)).alias(f"__n{l}")]
        wide = df.groupBy(*keys).agg(*aggs)
        val, lev = _pick_finest(levels, "__n", "__m")
        res = wide.select(*keys, val.alias(out), lev.alias("__level")).where("__level is not null")
    return res.withColumnRenamed("__level", level) if keep_level else res.drop("__level")


def region_means(
    cube: DataFrame,
    key: DataFrame,
    groups: Sequence[str],
    geo: str = "geo",
    region: str = "region_id",
    ids: Sequence[str] = ("point_id",),
    level: str = "level",
    value: str = "values",
    area: str | None = None,
    area_cube: DataFrame | None = None,
    factor: float = 1.0,
    levels: Sequence[int] = REGION_LEVELS,
    out: str = "values",
    keep_level: bool = False,
) -> DataFrame:
    """Statistics joined to points through a region key, finest level winning.

    Gives what joining every cube row to every key row and then calling
    :func:`finest_level_mean` gives, but sums the cube over its remaining
    dimensions (time above all) *before* the join: a mean only needs sums and
    counts. The join then carries one row per region and group, not one per
    observation. A region that the key lists with several areas weighs in once
    per area, as in the full join.

    ``area`` names a key column to divide each value by; ``area_cube`` holds a
    reference amount ``(ids, level, area)`` to divide the level means by.
    """
    v = nan_to_null(F.col(value).cast("double"))
    cube_sums = cube.groupBy(F.col(geo).alias("__geo"), *groups).agg(
        F.sum(v).alias("__s"), F.count(v).alias("__c")
    )
    versions = [*ids, level, region]
    weight = F.sum(F.try_divide(F.lit(1.0), F.col(area))) if area else F.count(F.lit(1)).cast("double")
    valid = F.count(F.try_divide(F.lit(1.0), F.col(area))) if area else F.count(F.lit(1))
    key_sums = key.groupBy(*versions).agg(weight.alias("__w"), valid.alias("__v"))
    joined = key_sums.join(cube_sums, F.col(region) == F.col("__geo"))
    return _finest_from_sums(
        joined, ids, level, groups, levels, area_cube, factor, out, keep_level
    )


def _finest_from_sums(joined, ids, level, groups, levels, area_cube, factor, out, keep_level):
    keys = [*ids, *groups]
    aggs = []
    for l in levels:
        at = F.col(level) == l
        aggs += [
            F.sum(F.when(at, F.col("__s") * F.col("__w"))).alias(f"__s{l}"),
            F.sum(F.when(at, F.col("__c") * F.col("__v"))).alias(f"__c{l}"),
            F.count(F.when(at, 1)).alias(f"__n{l}"),
        ]
    wide = joined.groupBy(*keys).agg(*aggs)
    for l in levels:
        wide = wide.withColumn(f"__m{l}", F.try_divide(f"__s{l}", F.col(f"__c{l}").cast("double")))
    val, lev = _pick_finest(levels, "__n", "__m")
    res = wide.select(*keys, val.alias(out), lev.alias(level)).where(F.col(level).isNotNull())
    if area_cube is not None:
        ref = area_cube.select(*ids, level, F.col("area").alias("__area"))
        res = res.join(ref, [*ids, level], "left").withColumn(
            out, F.try_divide(F.col(out), F.col("__area"))
        ).drop("__area")
    if factor != 1.0:
        res = res.withColumn(out, F.col(out) * factor)
    res = res.select(*keys, out, level)
    return res if keep_level else res.drop(level)


def level_area(
    cube: DataFrame,
    key: DataFrame,
    category: str,
    geo: str = "geo",
    region: str = "region_id",
    ids: Sequence[str] = ("point_id",),
    level: str = "level",
    value: str = "values",
) -> DataFrame:
    """Mean amount per (ids, level, category), all levels kept: the reference areas."""
    v = nan_to_null(F.col(value).cast("double"))
    sums = cube.groupBy(F.col(geo).alias("__geo"), category).agg(
        F.sum(v).alias("__s"), F.count(v).alias("__c")
    )
    versions = key.groupBy(*ids, level, region).agg(F.count(F.lit(1)).alias("__w"))
    joined = versions.join(sums, F.col(region) == F.col("__geo"))
    return (
        joined.groupBy(*ids, level, F.col(category).alias("class"))
        .agg(
            F.try_divide(
                F.sum(F.col("__s") * F.col("__w")), F.sum(F.col("__c") * F.col("__w")).cast("double")
            ).alias("area")
        )
    )


def mean_retained_level(df: DataFrame, level: str = "level") -> DataFrame:
    """Mean level over the rows that :func:`finest_level_mean` kept."""
    return df.agg(F.round(F.avg(level), 2).alias("mean_level"))


def rollup_codes(
    df: DataFrame, geo: str, others: Sequence[str], value: str, from_len: int = 4, to_len: int = 3
) -> DataFrame:
    """Add the sums of finer regions one level up; published coarse rows stay beside them."""
    up = (
        df.where(F.length(geo) == from_len)
        .groupBy(F.substring(geo, 1, to_len).alias(geo), *others)
        .agg(strict_sum(value).alias(value))
    )
    return df.select(geo, *others, value).unionByName(up)


def latest_period_share(
    df: DataFrame, units: Sequence[str], period: str, category: str, value: str, ref: str
) -> DataFrame:
    """Totals of each unit's latest period by category, and their ratio to one category."""
    latest = df.groupBy(*units, category).agg(F.max(period).alias(period))
    rows = df.join(latest, [*units, category, period], "left_semi")
    totals = rows.groupBy(category).agg(strict_sum(value).alias(value))
    base = totals.where(F.col(category) == ref).agg(F.max(value)).scalar()
    return totals.withColumn("ref", base).withColumn("rel", F.try_divide(value, "ref"))


def share_of_total(
    df: DataFrame,
    ids: Sequence[str],
    category: str,
    ref: str,
    value: str,
    out: str = "share",
    factor: float = 100.0,
) -> DataFrame:
    """Each row's share of its group's reference row; NULL without such a row."""
    totals = df.where(F.col(category) == ref).groupBy(*ids).agg(F.max(value).alias("total"))
    return null_safe_left(df, totals, list(ids)).withColumn(
        out, F.try_divide(F.col(value), F.col("total")) * factor
    )


def share_table(
    df: DataFrame,
    ids: Sequence[str],
    category: str,
    categories: Sequence[str],
    ref: str,
    value: str,
    suffix: str = "",
    keep_ref: bool = False,
    factor: float = 100.0,
) -> DataFrame:
    """Shares of a reference category, one column per category, in one aggregation."""
    wanted = list(categories)
    picks = [
        F.max(F.when(F.col(category) == c, F.col(value))).alias(f"__v{i}") for i, c in enumerate(wanted)
    ]
    wide = df.groupBy(*ids).agg(
        *picks, F.max(F.when(F.col(category) == ref, F.col(value))).alias("__ref")
    )
    shown = [(i, c) for i, c in enumerate(wanted) if keep_ref or c != ref]
    return wide.select(
        *ids,
        *[(F.try_divide(F.col(f"__v{i}"), F.col("__ref")) * factor).alias(c + suffix) for i, c in shown],
    )
