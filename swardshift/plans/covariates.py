"""Region statistics as point covariates: one declarative recipe per data set."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.levels import level_area, region_means, share_table
from ..operators.reshape import assemble_features, spread
from ..sources.tables import repair_names, restrict_cube


@dataclass(frozen=True)
class Recipe:
    """How one data set of the cube becomes columns.

    ``shape``: 'share' (percent of the category ``ref``), 'per_area' (divided by
    the reference area at the same level, times ``factor``), 'per_region'
    (divided by the region's own area), 'plain', or 'ratio' (``ref`` holds
    numerator and denominator among the values of ``over``).
    """

    name: str
    dataset: str
    category: str
    shape: str
    filters: dict[str, str | list[str]] = field(default_factory=dict)
    ref: str | tuple[str, str] | None = None
    over: str | None = None
    pattern: str | None = None
    keep_ref: bool = False
    factor: float = 1.0
    suffix: str = ""
    only: tuple[str, ...] = ()
    without: str | None = None
    rename: dict[str, str] = field(default_factory=dict)
    used: bool = True


# Data sets, dimension codes and units of the statistics office,
# as the study requests them.
_TOTAL = "TOTAL"
AREA_DATASET = "ef_lus_main"
AREA_FILTERS: dict[str, str | list[str]] = {
    "agrarea": _TOTAL,
    "farmtype": _TOTAL,
    "unit": "HA",
    "crops": ["UAA", "ARA", "J0000", "PECR", "WA"],
    "so_eur": _TOTAL,
}
REFERENCE_AREA = "UAA"
RECIPES = [
    Recipe("livestock_density", "ef_m_farmleg", "farmtype", "ratio",
           {"agrarea": _TOTAL, "indic_agr": ["UAA_HA", "FARM_LSU_LS"], "leg_form": _TOTAL,
            "so_eur": _TOTAL, "farmtype": [_TOTAL]},
           ref=("FARM_LSU_LS", "UAA_HA"), over="indic_agr", rename={"ratio": "animalDens"}),
    Recipe("farm_types", "ef_m_farmleg", "farmtype", "share",
           {"agrarea": _TOTAL, "indic_agr": "UAA_HA", "leg_form": _TOTAL, "so_eur": _TOTAL}, ref=_TOTAL),
    Recipe("land_use", "ef_lus_main", "crops", "share",
           {**AREA_FILTERS, "crops": ["UAA", "ARA", "J0000", "PECR", "WA", "FCONV_UCONV"]},
           ref="UAA", suffix="relUAA"),
    Recipe("arable_crops", "ef_lus_allcrops", "crops", "share", {"agrarea": _TOTAL, "unit": "HA"},
           ref="ARA", pattern="ARA|^C|^P0|^P1|^P9|^R|^I|^G|^V|^N|^Q"),
    Recipe("grassland", "ef_lus_allcrops", "crops", "share", {"agrarea": _TOTAL, "unit": "HA"},
           ref="J0000", pattern="^J"),
    Recipe("permanent_crops", "ef_lus_allcrops", "crops", "share", {"agrarea": _TOTAL, "unit": "HA"},
           ref="PECR", pattern="^PECR|^F|^T|^W|^O", keep_ref=True),
    Recipe("livestock", "ef_lsk_main", "animals", "per_area",
           {"agrarea": _TOTAL, "farmtype": _TOTAL, "lsu": _TOTAL, "unit": "LSU", "so_eur": _TOTAL},
           without="^A6|^A0010$"),
    Recipe("irrigation", "ef_mp_irri", "irr_area", "per_area",
           {"agrarea": _TOTAL, "so_eur": _TOTAL, "unit": "HA"}, factor=100.0),
    Recipe("crop_rotation", "ef_mp_soil", "crop_rot", "share",
           {"agrarea": _TOTAL, "farmtype": _TOTAL, "soil_cov": "ARA", "unit": "HA"}, ref=_TOTAL,
           only=("PC0", "PC1-24", "PC25-49", "PC50-74", "PC_GE75")),
    Recipe("soil_cover", "ef_mp_soil", "soil_cov", "share",
           {"agrarea": _TOTAL, "farmtype": _TOTAL, "crop_rot": _TOTAL, "unit": "HA"}, ref="ARA"),
    Recipe("tillage", "ef_mp_prac", "tillage", "share",
           {"agrarea": _TOTAL, "crop_rot": _TOTAL, "farmtype": _TOTAL, "unit": "HA"}, ref="ARA"),
    Recipe("crop_yield", "apro_cpshr", "crops", "plain", {"strucpro": "YI_HU_EU"}, suffix="yield", used=False),
    Recipe("nutrient_balance", "aei_pr_gnb", "nutrient", "plain", {"indic_ag": "BAL_UAA"},
           suffix="_balance", used=False),
    Recipe("pesticides", "aei_fm_salpest09", "pesticid", "per_area",
           {"pesticid": ["F", "H", "I", "M", "PGR", "ZR03"]},
           rename={"F": "Fungicide", "H": "Herbicide", "I": "Insecticide", "M": "Molluscicide",
                   "PGR": "PlantGrowthRegulator", "ZR03": "Sterilant"}, used=False),
    Recipe("fertilizer_use", "aei_fm_usefert", "nutrient", "per_area", factor=1000.0,
           rename={"N": "Nfert", "P": "Pfert"}),
    Recipe("fertilizer_sale", "aei_fm_manfert", "nutrient", "per_area", factor=1000.0,
           only=("N", "P", "K"), rename={"N": "NfertSale", "P": "PfertSale", "K": "KfertSale"}, used=False),
    Recipe("input_intensity", "aei_ps_inp", "indic_ag", "plain", {"unit": "PC_AREA"}),
    Recipe("manure_storage", "aei_fm_ms", "indic_ag", "per_region", {"unit": "NR"}),
]


def point_regions(key: DataFrame, id: str = "point_id") -> DataFrame:
    """The region key without its years: one row per area version of a region."""
    return key.select(id, "level", "region_id", "area_km2").distinct()


def reference_area(cube_of: Callable[[str], DataFrame], regions: DataFrame, id: str = "point_id") -> DataFrame:
    """Land-use areas per point and level, finer regions also summed up one level."""
    from ..operators.levels import rollup_codes

    main = restrict_cube(cube_of(AREA_DATASET), AREA_FILTERS)
    summed = rollup_codes(main, "geo", ["crops", "time"], "values")
    return level_area(summed, regions, "crops", ids=[id])


def categories(cube: DataFrame, recipe: Recipe) -> list[str]:
    """Category codes of a data set that become columns (a short code list)."""
    if recipe.only:
        return list(recipe.only)
    codes = cube.select(recipe.category).where(F.col(recipe.category).isNotNull()).distinct()
    if recipe.pattern:
        codes = codes.where(F.col(recipe.category).rlike(recipe.pattern))
    if recipe.without:
        codes = codes.where(~F.col(recipe.category).rlike(recipe.without))
    return sorted(r[0] for r in codes.collect())


def recipe_means(
    recipe: Recipe, cube: DataFrame, regions: DataFrame, area: DataFrame | None, id: str = "point_id",
    keep_level: bool = False,
) -> DataFrame:
    """Long table ``(id, category..., values)`` of a recipe, before it is reshaped."""
    groups = [recipe.category] + ([recipe.over] if recipe.over else [])
    args = {"ids": [id], "keep_level": keep_level}
    if recipe.shape == "per_area":
        base = area.where(F.col("class") == REFERENCE_AREA)
        args |= {"area_cube": base, "factor": recipe.factor}
    elif recipe.shape == "per_region":
        args |= {"area": "area_km2"}
    return region_means(cube, regions, groups, **args)


def recipe_columns(
    recipe: Recipe, cube: DataFrame, regions: DataFrame, area: DataFrame | None = None, id: str = "point_id"
) -> DataFrame:
    """One row per point with the recipe's columns."""
    cube = restrict_cube(cube, {d: v for d, v in recipe.filters.items() if d != recipe.category},
                         drop=[]).where(_category_filter(recipe))
    means = recipe_means(recipe, cube, regions, area, id)
    if recipe.shape == "ratio":
        top, bottom = recipe.ref
        wide = spread(means, [id], recipe.over, "values", [top, bottom])
        out = wide.select(id, F.try_divide(F.col(top), F.col(bottom)).alias("ratio"))
    elif recipe.shape == "share":
        names = categories(cube, recipe)
        out = share_table(
            means, [id], recipe.category, names, recipe.ref, "values", recipe.suffix, recipe.keep_ref
        )
    else:
        out = spread(means, [id], recipe.category, "values", categories(cube, recipe), suffix=recipe.suffix)
    renamed = out.withColumnsRenamed(recipe.rename)
    return renamed.toDF(*repair_names(renamed.columns, "_"))


def _category_filter(recipe: Recipe) -> Column:
    wanted = recipe.filters.get(recipe.category)
    if wanted is None:
        return F.lit(True)
    return F.col(recipe.category).isin(*([wanted] if isinstance(wanted, str) else wanted))


def build_covariates(
    cube_of: Callable[[str], DataFrame],
    key: DataFrame,
    id: str = "point_id",
    recipes: Sequence[Recipe] = RECIPES,
    with_unused: bool = False,
) -> DataFrame:
    """All covariates of all points in one wide table.

    ``cube_of`` gives a data set of the cube by name (e.g. ``read_cube`` with
    the cube's path). Code lists come from the cube; the rest is one plan.
    """
    regions = point_regions(key, id)
    area = reference_area(cube_of, regions, id)
    parts = [
        recipe_columns(r, cube_of(r.dataset), regions, area, id) for r in recipes if r.used or with_unused
    ]
    return assemble_features(parts, [id])
