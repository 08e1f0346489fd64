"""Projection, renaming and row filters over whole tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField

from ..functions.measures import sentinel_to_null


def rename_where(df: DataFrame, pick: Callable[[str], bool], to: Callable[[str], str]) -> DataFrame:
    """Rename the columns a predicate picks; the others keep name and place."""
    return df.withColumnsRenamed({c: to(c) for c in df.columns if pick(c)})


def add_prefix(df: DataFrame, containing: str, prefix: str) -> DataFrame:
    return rename_where(df, lambda c: containing in c, lambda c: prefix + c)


def select_where(df: DataFrame, pick: Callable[[StructField], bool]) -> DataFrame:
    """Keep the columns whose schema field satisfies a predicate."""
    return df.select(*[f"`{f.name}`" for f in df.schema.fields if pick(f)])


def is_numeric(field: StructField) -> bool:
    return isinstance(field.dataType, NumericType)


def is_text(field: StructField) -> bool:
    return isinstance(field.dataType, StringType)


def select_known(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Select by name; unknown names are skipped with a warning."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        warnings.warn(f"unknown columns skipped: {unknown}", stacklevel=2)
    return df.select(*[f"`{n}`" for n in names if n in df.columns])


def dictionary_names(dictionary: DataFrame, condition: Column | str) -> list[str]:
    """Variable names a dictionary condition picks (one row per column of a table: small)."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return [r["name"] for r in dictionary.where(cond).select("name").collect()]


def select_by_dictionary(
    df: DataFrame, dictionary: DataFrame, condition: Column | str, also: Sequence[str] = ()
) -> DataFrame:
    names = dictionary_names(dictionary, condition)
    return select_known(df, [n for n in names if n not in also] + list(also))


def null_sentinels(df: DataFrame, values: Mapping[str, Sequence] | Sequence) -> DataFrame:
    """Replace sentinel values by NULL: per column (mapping) or in every column (list)."""
    if not isinstance(values, Mapping):
        numeric = [f.name for f in df.schema.fields if is_numeric(f)]
        values = {c: list(values) for c in numeric}
    return df.withColumns({c: sentinel_to_null(c, v) for c, v in values.items()})


def all_of(conditions: Sequence[Column]) -> Column:
    """Conjunction; rows for which it is NULL are dropped by ``where``."""
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def filter_bbox(
    df: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Points inside a box, borders included."""
    return df.where(F.col(lon).between(xmin, xmax) & F.col(lat).between(ymin, ymax))


def filter_polygons_bbox(
    edges: DataFrame, polygon: Sequence[str], xmin: float, xmax: float, ymin: float, ymax: float
) -> DataFrame:
    """Whole polygons whose own bounding box overlaps a box."""
    box = edges.groupBy(*polygon).agg(
        F.min(F.least("x1", "x2")).alias("bx0"),
        F.max(F.greatest("x1", "x2")).alias("bx1"),
        F.min(F.least("y1", "y2")).alias("by0"),
        F.max(F.greatest("y1", "y2")).alias("by1"),
    )
    kept = box.where(
        (F.col("bx0") <= xmax) & (F.col("bx1") >= xmin) & (F.col("by0") <= ymax) & (F.col("by1") >= ymin)
    )
    return edges.join(kept.select(*polygon), list(polygon), "left_semi")
