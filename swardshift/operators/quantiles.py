"""Exact interpolated quantiles for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strict import nan_to_null
from ..session import cut_lineage
from .joins import null_safe_inner, null_safe_left
from .ordering import running_total


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str] | None = None
) -> DataFrame:
    """Quantiles (linear between order statistics) per group, missing values left out.

    Each quantile lies between two order statistics, which are found by running
    counts of the group's distinct values. Rows only pass through partial value
    counts and a distributed running total, so no task holds a group, whatever
    its size. A missing key is a group of its own; between two equal order
    statistics (infinities, say) the quantile is that value.
    """
    groups = list(groups)
    counts = _value_counts(df, groups, value).where(F.col(value).isNotNull())
    return _quantiles_of_counts(counts, groups, value, probs, names)


def _value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, __n): rows of each distinct value, missing ones as NULL."""
    clean = df.select(*groups, nan_to_null(F.col(value).cast("double")).alias(value))
    return clean.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__n"))


def _quantiles_of_counts(
    counts: DataFrame, groups: list[str], value: str, probs: Sequence[float], names: Sequence[str] | None
) -> DataFrame:
    """Quantiles from the counts of a group's distinct values."""
    ranked = running_total(counts, groups, [value], F.col("__n"), "__upto")
    # The running count ends at the group's size.
    totals = ranked.groupBy(*groups).agg(F.max("__upto").alias("__total"))
    if groups:
        ranked = null_safe_inner(ranked, totals, groups)
    else:
        ranked = ranked.withColumn("__total", F.lit(totals.first()["__total"]))
    aggs = []
    for i, p in enumerate(probs):
        at = (F.col("__total") - 1) * float(p)
        low, high = F.floor(at) + 1, F.ceil(at) + 1
        first = F.col("__upto") - F.col("__n")
        aggs += [
            F.max(F.when((first < low) & (F.col("__upto") >= low), F.col(value))).alias(f"__lo{i}"),
            F.max(F.when((first < high) & (F.col("__upto") >= high), F.col(value))).alias(f"__hi{i}"),
            F.max(at - F.floor(at)).alias(f"__f{i}"),
        ]
    picked = ranked.groupBy(*groups).agg(*aggs)
    names = names or [f"q{i}" for i in range(len(probs))]
    between = [
        F.when(F.col(f"__lo{i}") == F.col(f"__hi{i}"), F.col(f"__lo{i}"))
        .otherwise(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}"))
        for i in range(len(probs))
    ]
    return picked.select(*groups, *[b.alias(n) for b, n in zip(between, names, strict=True)])


def strict_medians(
    df: DataFrame, groups: Sequence[str], columns: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Median per group and column; NULL where any value of the group is missing.

    For groups known to be small (one point's observations) this is one
    aggregation.
    """
    from ..functions.strict import strict_median

    names = names or columns
    return df.groupBy(*groups).agg(*[strict_median(c).alias(n) for c, n in zip(columns, names)])


def strict_quantile(df: DataFrame, groups: Sequence[str], value: str, prob: float, name: str) -> DataFrame:
    """As :func:`exact_quantiles`, but NULL for a group with any missing value.

    The rows are read once: both which groups are complete and the quantiles
    follow from the counts of the distinct values.
    """
    groups = list(groups)
    counts = cut_lineage(_value_counts(df, groups, value))
    complete = counts.groupBy(*groups).agg((F.count(value) == F.count(F.lit(1))).alias("__complete"))
    q = _quantiles_of_counts(counts.where(F.col(value).isNotNull()), groups, value, [prob], ["__q"])
    if not groups:
        return q.select(F.when(complete.scalar(), F.col("__q")).alias(name))
    return null_safe_left(complete, q, groups).select(*groups, F.when(F.col("__complete"), F.col("__q")).alias(name))
