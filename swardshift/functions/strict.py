"""Aggregates in which one missing value makes the whole result missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: Column | str) -> Column:
    """NaN counts as missing everywhere in this library, so turn it into NULL."""
    c = as_col(x)
    return F.when(~F.isnan(c), c)


def strict(aggregate: Column, over: Column | str) -> Column:
    """``aggregate`` when no row of the group misses ``over``, else NULL."""
    return F.when(F.count(nan_to_null(over)) == F.count(F.lit(1)), aggregate)


def strict_sum(x: Column | str) -> Column:
    return strict(F.sum(as_col(x)), x)


def strict_mean(x: Column | str) -> Column:
    return strict(F.avg(as_col(x)), x)


def strict_min(x: Column | str) -> Column:
    return strict(F.min(as_col(x)), x)


def strict_max(x: Column | str) -> Column:
    return strict(F.max(as_col(x)), x)


def strict_median(x: Column | str) -> Column:
    """Exact interpolated median; for groups of any size use operators.quantiles."""
    return strict(F.percentile(as_col(x), F.lit(0.5)), x)
