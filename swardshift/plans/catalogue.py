"""The variable dictionary: screening flags, selection, and the tables printed from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate
from ..operators.columns import select_by_dictionary
from ..operators.ordering import grid_cells, number_rows, paginate, top_n_with_ties

# Fixed values of the study: climate variables kept as representatives of their
# components, and variables dropped by hand for collinearity.
CLIMATE_KEYWORD = "BIO"
CLIMATE_KEPT = ["BIO5", "BIO6", "BIO13", "BIO14"]
DROPPED_BY_HAND = [
    "P1000", "F1000", "F2000", "FT48_SO", "A2000", "I07A1_EQ_Y", "I07A2_EQ_YC", "I07A31_EQ_Y",
    "ARArelUAA", "N0000T", "R1000", "V0000_S0000T", "V0000_S0000TO", "J2000", "F1000_2000",
    "O1100", "O1910", "RENT", "UAAIB", "CLC2_321", "CLC2_3X331_332_335", "CLC23_321", "Nstock",
]
INFO_CLASS = "0info"
# Variable with a stated number of levels although it is stored as a number.
STATED_TYPES = {"Soil_Stones": "F(4)"}
DICTIONARY_COLUMNS = [
    "name", "type", "na", "mean", "min", "max", "nlevs", "nameFull", "unit", "class0", "class1",
    "class2", "source", "modelSOC", "modelEffect",
]


def drop_flags(
    screened: DataFrame,
    keyword: str = CLIMATE_KEYWORD,
    kept: Sequence[str] = CLIMATE_KEPT,
    by_hand: Sequence[str] = DROPPED_BY_HAND,
) -> DataFrame:
    """Adds ``drop_clim``, ``drop_manual`` and their maximum with ``drop_na``, ``drop``."""
    clim = F.col("name").contains(keyword) & ~F.col("name").isin(*kept)
    flagged = screened.withColumns(
        {
            "drop_clim": F.when(clim, 1).otherwise(0),
            "drop_manual": F.when(F.col("name").isin(*by_hand), 1).otherwise(0),
        }
    )
    return flagged.withColumn("drop", F.greatest("drop_na", "drop_clim", "drop_manual"))


def update_dictionary(flagged: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Fresh profile beside the hand-kept columns, and which variables the effect model uses.

    In order: a variable of the first model stays; information columns do not;
    flagged variables do not; the rest keeps its earlier setting.
    """
    hand = dictionary.select("name", *[c for c in dictionary.columns if c in DICTIONARY_COLUMNS[7:]])
    joined = flagged.join(hand, "name", "left")
    use = (
        F.when(F.col("modelSOC") == 1, 1)
        .when(F.col("class0") == INFO_CLASS, 0)
        .when(F.col("drop") == 1, 0)
        .otherwise(F.col("modelEffect"))
    )
    return joined.withColumn("modelEffect", use.cast("int")).select(*DICTIONARY_COLUMNS)


def model_table(df: DataFrame, dictionary: DataFrame, target: str) -> DataFrame:
    """Complete rows of the selected variables and the target."""
    return select_by_dictionary(df, dictionary, F.col("modelEffect") == 1, [target]).dropna()


def variable_table(dictionary: DataFrame, width: int = 50) -> DataFrame:
    """Printed catalogue: type codes, marks for model membership, row numbers by class (descending)."""
    used = dictionary.where((F.col("class0") != INFO_CLASS) & (F.col("modelEffect") == 1))
    code = None
    for name, text in STATED_TYPES.items():
        code = F.when(F.col("name") == name, text) if code is None else code.when(F.col("name") == name, text)
    code = code.when(F.col("type") == "numeric", "C").otherwise(
        F.concat(F.lit("F("), F.col("nlevs").cast("string"), F.lit(")"))
    )

    def mark(c: str):
        return F.when(F.col(c) == 1, "x").when(F.col(c).isNotNull(), "")

    shown = used.withColumns(
        {
            "type": code,
            "nameFull": truncate("nameFull", width),
            "modelSOC": mark("modelSOC"),
            "modelEffect": mark("modelEffect"),
        }
    )
    return number_rows(shown, [F.desc_nulls_last("class0"), F.asc("name")])


def section_ranges(table: DataFrame) -> DataFrame:
    """First and last row of each section; the target stands with the soil variables."""
    section = F.when(F.col("class0") == "target", "soil").otherwise(F.col("class0"))
    return table.groupBy(section.alias("section")).agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row")
    )


def panel_pages(table: DataFrame, rows: int = 4, columns: int = 4) -> DataFrame:
    """Continuous variables dealt to pages of rows x columns panels."""
    continuous = table.where("type = 'C'").select("name", "nameFull", "unit", F.col("row").alias("__order"))
    paged = paginate(continuous, ["__order"], rows * columns).drop("__order")
    return grid_cells(paged, "pos", columns)


def importance_table(
    importance: DataFrame, dictionary: DataFrame, n: int = 7, overrides: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """The n most important variables (ties kept) with display name and unit.

    ``overrides`` gives name and unit of variables the dictionary lacks.
    """
    named = top_n_with_ties(importance, "value", n).join(
        dictionary.select("name", "nameFull", "unit"), "name", "left"
    )
    for name, (full, unit) in (overrides or {}).items():
        is_it = F.col("name") == name
        named = named.withColumns(
            {
                "nameFull": F.when(is_it, full).otherwise(F.col("nameFull")),
                "unit": F.when(is_it, unit).otherwise(F.col("unit")),
            }
        )
    return named
