"""Vegetation-index features from sampled raster layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import ALL_MONTHS, MONTH_FEATURES, scaled_ndvi
from ..functions.strict import nan_to_null
from ..functions.text import layer_month, layer_year
from ..operators.neighbours import neighbour_features


def layer_values(sampled: DataFrame, id: str = "point_id") -> DataFrame:
    """Sampled layers ``(id, layer, value)`` -> ``(id, year, month, ndvi)``."""
    return sampled.select(
        id,
        layer_year("layer").alias("year"),
        layer_month("layer").alias("month"),
        scaled_ndvi("value").alias("ndvi"),
    )


def monthly_medians(
    df: DataFrame, id: str = "point_id", month: str = "month", value: str = "ndvi",
    features: dict[int, str] = MONTH_FEATURES,
) -> DataFrame:
    """Median per point for each listed month and over all rows, as columns.

    A month with a missing observation has no median; a point without an
    observation in any listed month keeps its row. A point has at most one
    observation per raster layer, so all its medians come out of one
    aggregation, whose partial buffers count distinct values.
    """
    v = nan_to_null(F.col(value))
    aggs = []
    for m, name in features.items():
        here = F.lit(True) if m == ALL_MONTHS else F.col(month) == m
        complete = F.count(F.when(here, v)) == F.count(F.when(here, 1))
        aggs.append(F.when(complete, F.percentile(F.when(here, v), F.lit(0.5))).alias(name))
    return df.groupBy(id).agg(*aggs)


def vegetation_features(
    sites: DataFrame, medians: DataFrame, k: int = 5, id: str = "point_id", cls: str = "LC0_Desc"
) -> DataFrame:
    """Own medians, medians of the nearest other-class sites, and their differences."""
    own = sites.select(id, "lon", "lat", cls).join(medians, id, "left")
    return neighbour_features(own, list(MONTH_FEATURES.values()), k, id, "lon", "lat", cls)
