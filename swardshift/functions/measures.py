"""Cleaning, recoding and derivation of measured columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strict import as_col

# These must equal the published study's to give its results.
# Water-management codes and the label for every other code.
WATER_MANAGEMENT = {
    1: "Irrigation",
    2: "Potential irrigation",
    3: "Drainage",
    4: "Irrigation and drainage",
    5: "not visible",
}
WATER_MANAGEMENT_DEFAULT = "not relevant"
# Bulk density (Hollis, Hannam and Bellamy 2012, Eur. J. Soil Sci. 63, 96-109).
BULK_DENSITY = {
    "intercept": 0.80806,
    "scale": 0.823844,
    "decay": -0.27993,
    "sand": 0.0014065,
    "clay": -0.0010299,
}
SAMPLING_DEPTH_CM = 20
OC_DETECTION_LIMIT = 0.2
N_DETECTION_LIMIT = 0.02
OC_MINERAL_LIMIT = 15 / 1.72
CACO3_LIMIT = 5
# Upper cuts and labels of the effect classes; the last label is open-ended.
EFFECT_CUTS = [-5.0, 5.0, 15.0, 25.0]
EFFECT_LABELS = ["Less than -5", "-5 to  5", "5 to 15", "15 to 25", "More than 25"]
# Month of the vegetation layers -> feature name; 17 stands for all months.
MONTH_FEATURES = {3: "ndvi13", 6: "ndvi14", 9: "ndvi15", 12: "ndvi16", 17: "ndvi17"}
ALL_MONTHS = 17
# Length of a region code -> level of the region hierarchy.
CODE_LENGTH_LEVELS = {2: 0, 3: 1, 4: 2, 5: 3}


def sentinel_to_null(x: Column | str, values: Sequence) -> Column:
    """NULL for every value that stands for 'missing'."""
    c = as_col(x)
    return F.when(~c.isin(*values), c)


def exclusive_fill(base: Column | str, first: Column | str, second: Column | str) -> Column:
    """Fill a missing base from whichever one of two fallbacks is present.

    Two present fallbacks contradict each other, so they fill nothing.
    """
    base, first, second = as_col(base), as_col(first), as_col(second)
    lone_fallback = F.when(first.isNull() | second.isNull(), F.coalesce(first, second))
    return F.coalesce(base, lone_fallback)


def recode(x: Column | str, labels: Mapping, default: str | None = None) -> Column:
    """Code -> label; anything unlisted, NULL included, gets the default."""
    c = as_col(x)
    out = None
    for code, label in labels.items():
        out = F.when(c == code, label) if out is None else out.when(c == code, label)
    return out.otherwise(F.lit(default))


def censor_below(x: Column | str, limit: float) -> Column:
    """NULL below the detection limit."""
    c = as_col(x)
    return F.when(c >= limit, c)


def bulk_density(oc: Column | str, sand: Column | str, clay: Column | str) -> Column:
    k = BULK_DENSITY
    return (
        F.lit(k["intercept"])
        + k["scale"] * F.exp(k["decay"] * as_col(oc))
        + k["sand"] * as_col(sand)
        + k["clay"] * as_col(clay)
    )


def stock(content: Column | str, density: Column | str, coarse: Column | str) -> Column:
    """Content (mass-%) -> stock (Mg/ha) in the sampled depth, less the stones."""
    fine_share = 1 - as_col(coarse) / 100
    return as_col(content) * as_col(density) * SAMPLING_DEPTH_CM * fine_share


def ratio_if_both(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(as_col(a), as_col(b))


def presence_flag(a: Column | str, b: Column | str) -> Column:
    """'yes' when at least one of two columns is present."""
    return F.when(as_col(a).isNull() & as_col(b).isNull(), "no").otherwise("yes")


def effect_size(pred: Column | str, obs: Column | str, kind: str = "Abs") -> Column:
    """Predicted minus observed ('Abs'), or the log of their ratio ('Rel').

    Ratios the logarithm is not defined for, and division by zero, give NULL.
    """
    pred, obs = as_col(pred), as_col(obs)
    if kind == "Abs":
        return pred - obs
    if kind == "Rel":
        return F.ln(F.try_divide(pred, obs))
    raise ValueError("kind must be 'Abs' or 'Rel'")


def label_bins(
    x: Column | str, cuts: Sequence[float], labels: Sequence[str], null_label: str | None = None
) -> Column:
    """Label by the first cut above the value; the last label takes the rest."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one label more than cuts")
    c = as_col(x)
    out = F.when(c.isNull(), F.lit(null_label))
    for cut, label in zip(cuts, labels):
        out = out.when(c < cut, label)
    return out.otherwise(labels[-1])


def bin_effect(x: Column | str, missing_as_last: bool = True) -> Column:
    """The five effect classes of the maps.

    A missing effect falls in the last class, as it does in the study; pass
    ``missing_as_last=False`` to keep it NULL.
    """
    null_label = EFFECT_LABELS[-1] if missing_as_last else None
    return label_bins(x, EFFECT_CUTS, EFFECT_LABELS, null_label)


def ordinal(x: Column | str, order: Sequence[str]) -> Column:
    """Position of a label in a stated order (0-based), NULL if not listed."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), as_col(x)), F.lit(0)) - 1


def interval_index(x: Column | str, breaks: Sequence[float]) -> Column:
    """0-based interval: left-closed, the last one closed on both sides, NULL outside."""
    c = as_col(x)
    out = F.when((c < breaks[0]) | (c > breaks[-1]) | c.isNull(), F.lit(None).cast("int"))
    for i, upper in enumerate(breaks[1:-1]):
        out = out.when(c < upper, F.lit(i))
    return out.otherwise(F.lit(len(breaks) - 2))


def interval_label(x: Column | str, breaks: Sequence[float]) -> Column:
    """'[a,b)' labels for :func:`interval_index`."""
    idx = interval_index(x, breaks)
    last = len(breaks) - 2
    labels = [
        f"[{a:g},{b:g}{']' if i == last else ')'}" for i, (a, b) in enumerate(zip(breaks, breaks[1:]))
    ]
    return F.element_at(F.array(*[F.lit(v) for v in labels]), idx + 1)


def round_breaks(breaks: Sequence[float]) -> list[float]:
    """Axis labels for a handful of breaks: fewer decimals the larger their median."""
    ordered = sorted(breaks)
    mid = len(ordered) // 2
    median = ordered[mid] if len(ordered) % 2 else (ordered[mid - 1] + ordered[mid]) / 2
    if median <= 0.001:
        return list(breaks)
    # 4 decimals for medians up to 0.01, one fewer per factor of ten, never below 0.
    digits = max(0, 4 - sum(median > t for t in (0.01, 0.1, 1.0, 10.0)))
    return [float(round(b, digits)) if math.isfinite(b) else b for b in breaks]


def log10_ratio(a: Column | str, b: Column | str) -> Column:
    return F.log10(F.try_divide(as_col(a), as_col(b)))


def scaled_ndvi(x: Column | str) -> Column:
    """Byte-coded vegetation index -> its -1..1 scale."""
    return (as_col(x) - 100) / 100


def difference(own: Column | str, partner: Column | str) -> Column:
    """Own minus partner value, both shifted by one as in the study."""
    return (as_col(own) + 1) - (as_col(partner) + 1)


def region_level(code: Column | str) -> Column:
    """Hierarchy level from the length of a region code; NULL for other lengths."""
    n = F.length(as_col(code))
    out = None
    for length, level in CODE_LENGTH_LEVELS.items():
        out = F.when(n == length, level) if out is None else out.when(n == length, level)
    return out.otherwise(F.lit(None).cast("int"))
