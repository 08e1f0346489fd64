"""From raw survey waves to the table of usable sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as m
from ..functions.text import remove_first, to_number
from ..operators.columns import all_of, null_sentinels
from ..operators.joins import union_by_name

# Fixed values of the survey files.
TEXTURE = ["Clay", "Silt", "Sand", "Coarse"]
MISSING_CODE = -999
REGION_SUFFIX = " Bio-geographical Region"
USED_CLASSES = ["Cropland", "Grassland"]


def wave(df: DataFrame, suffix: str, id: str = "POINT_ID", sentinel: int | None = None) -> DataFrame:
    """Texture of one earlier wave, suffixed, keyed by a numeric ``Point_ID``.

    Ids and contents that do not parse as numbers are missing; so are cells
    holding the wave's missing code.
    """
    cols = [to_number(c.lower()).alias(c + suffix) for c in TEXTURE]
    out = df.select(to_number(id).cast("long").alias("Point_ID"), *cols)
    return null_sentinels(out, [sentinel]) if sentinel is not None else out


def combine_waves(base: DataFrame, first: DataFrame, second: Sequence[DataFrame]) -> DataFrame:
    """Latest wave with texture gaps filled from 2009, or from the country files of 2012."""
    w09 = wave(first, "09")
    w12 = wave(union_by_name(*second), "12", sentinel=MISSING_CODE)
    joined = base.join(w09, "Point_ID", "left").join(w12, "Point_ID", "left")
    return joined.withColumns({c: m.exclusive_fill(c, c + "09", c + "12") for c in TEXTURE})


def attach_site_data(
    soil: DataFrame, ancillary: DataFrame, points: DataFrame, management: DataFrame
) -> DataFrame:
    """Ancillary covariates, coordinates with land use, and water management by site."""
    extra = (
        ancillary.withColumnRenamed("POI", "Point_ID")
        .drop("Elevation")
        .withColumn("Aspect", F.coalesce("Aspect", F.lit(0.0)))
    )
    water = management.select(
        F.col("POINT_ID").alias("Point_ID"),
        m.recode("WM", m.WATER_MANAGEMENT, m.WATER_MANAGEMENT_DEFAULT).alias("WM"),
    )
    located = points.select("Point_ID", "lon", "lat", "LC", "LU", "LC0_Desc")
    return (
        soil.join(extra, "Point_ID", "left")
        .join(located, "Point_ID", "left")
        .join(water, "Point_ID", "left")
    )


def derive_measures(df: DataFrame) -> DataFrame:
    """Units, detection limits, bulk density, stocks and ratios, in dependency order."""
    percent = df.withColumns(
        {
            "OC": m.censor_below(F.col("OC") / 10, m.OC_DETECTION_LIMIT),
            "N": m.censor_below(F.col("N") / 10, m.N_DETECTION_LIMIT),
            "P": F.col("P") / 10_000,
            "K": F.col("K") / 10_000,
            "CaCO3": F.col("CaCO3") / 10,
        }
    )
    dense = percent.withColumns(
        {"BD": m.bulk_density("OC", "Sand", "Clay"), "CN": m.ratio_if_both("OC", "N")}
    )
    stocks = dense.withColumns({f"{x}stock": m.stock(x, "BD", "Coarse") for x in ("OC", "N", "P", "K")})
    return stocks.withColumns(
        {
            "natura": m.presence_flag("Natura2000_sitecode1", "Natura2000_sitecode2"),
            "BioGeo": remove_first("BioGeo", REGION_SUFFIX),
        }
    ).withColumnsRenamed({"pH_CaCl2_": "pH_CaCl2", "pH_H2O_": "pH_H2O"})


def site_conditions() -> dict[str, Column]:
    """The conditions a site must meet, by name."""
    return {
        "land_use": F.col("LC0_Desc").isin(*USED_CLASSES),
        "oc_present": F.col("OC").isNotNull(),
        "mineral_soil": F.col("OC") <= m.OC_MINERAL_LIMIT,
        "low_carbonate": F.col("CaCO3") < m.CACO3_LIMIT,
    }


def usable_sites(df: DataFrame) -> DataFrame:
    return df.where(all_of(list(site_conditions().values())))
