"""Column profiles, missingness flags, frequency tables, metrics, standardizing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strict import nan_to_null
from .columns import is_numeric, is_text
from .quantiles import exact_quantiles
from .reshape import level_table


def profile_columns(df: DataFrame, robust: bool = False) -> DataFrame:
    """One row per numeric or text column: type, na, mean, disp, min, max, nlevs.

    Numeric columns need one aggregation together; text columns one count of
    their levels, whose smallest and largest count are their min and max.
    ``disp`` is the standard deviation, for text the share outside the most
    frequent level. ``robust`` adds exact median and median absolute deviation,
    each a distributed selection.
    """
    numeric = [f.name for f in df.schema.fields if is_numeric(f)]
    text = [f.name for f in df.schema.fields if is_text(f)]
    n_rows = F.count(F.lit(1))
    structs = []
    for c in numeric:
        v = nan_to_null(F.col(c).cast("double"))
        structs.append(
            F.struct(
                F.lit(c).alias("name"),
                F.lit("numeric").alias("type"),
                (n_rows - F.count(v)).alias("na"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("disp"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.lit(0).cast("long").alias("nlevs"),
            )
        )
    parts = []
    if numeric:
        parts.append(df.agg(F.array(*structs).alias("s")).select(F.inline("s")))
    if text:
        nulls = df.agg(
            F.array(
                *[
                    F.struct(F.lit(c).alias("name"), (n_rows - F.count(c)).alias("na"), n_rows.alias("n"))
                    for c in text
                ]
            ).alias("s")
        ).select(F.inline("s"))
        levels = level_table(df, text).groupBy(F.col("column").alias("name")).agg(
            F.min("n").cast("double").alias("min"),
            F.max("n").cast("double").alias("max"),
            F.count(F.lit(1)).alias("nlevs"),
        )
        parts.append(
            nulls.join(levels, "name", "left").select(
                "name",
                F.lit("character").alias("type"),
                "na",
                F.lit(None).cast("double").alias("mean"),
                (1 - F.try_divide(F.col("max"), (F.col("n") - F.col("na")).cast("double"))).alias("disp"),
                "min",
                "max",
                F.coalesce("nlevs", F.lit(0).cast("long")).alias("nlevs"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if robust and numeric:
        out = out.join(_robust(df, numeric), "name", "left")
    return out


def _robust(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        [], list(numeric), "name", "v"
    )
    medians = exact_quantiles(long, ["name"], "v", [0.5], ["median"])
    deviations = long.join(medians, "name").select("name", F.abs(F.col("v") - F.col("median")).alias("d"))
    mad = exact_quantiles(deviations, ["name"], "d", [0.5], ["mad"])
    # Fixed value: makes the deviation comparable to a normal standard deviation.
    return medians.join(mad.withColumn("mad", F.col("mad") * 1.4826), "name")


def missing_screen(profile: DataFrame, n_rows: Column | int, share: float = 0.01) -> DataFrame:
    """Flag columns missing in more than ``share`` of the rows."""
    total = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    return profile.withColumn("drop_na", F.when(F.col("na") > share * total, 1).otherwise(0))


def condition_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Rows by outcome (true, false, missing) of several conditions, one scan for all."""
    aggs = []
    for name, cond in conditions.items():
        aggs += [
            F.struct(F.lit(name).alias("condition"), F.lit(True).alias("outcome"), F.count_if(cond).alias("n")),
            F.struct(F.lit(name).alias("condition"), F.lit(False).alias("outcome"), F.count_if(~cond).alias("n")),
            F.struct(
                F.lit(name).alias("condition"),
                F.lit(None).cast("boolean").alias("outcome"),
                F.count_if(cond.isNull()).alias("n"),
            ),
        ]
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s")).where("n > 0")


def tally_share(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group sizes and their share of all rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("rel", F.col("n") / sizes.agg(F.sum("n")).scalar())


def regression_metrics(df: DataFrame, obs: str, pred: str, groups: Sequence[str] = ()) -> DataFrame:
    """RMSE, R2 and bias in one aggregation."""
    o, p = F.col(obs).cast("double"), F.col(pred).cast("double")
    sse = F.sum((p - o) * (p - o))
    sst = F.var_pop(o) * F.count(o)
    return df.groupBy(*groups).agg(
        F.sqrt(F.avg((p - o) * (p - o))).alias("rmse"),
        (1 - F.try_divide(sse, sst)).alias("r2"),
        (F.avg(o) - F.avg(p)).alias("bias"),
    )


def scale_parameters(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and sample standard deviation per column, one aggregation."""
    aggs = []
    for i, c in enumerate(columns):
        v = nan_to_null(F.col(c).cast("double"))
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def scaled(column: str, mean: float | None, sd: float | None, weight: float = 1.0) -> Column:
    """(x - mean) / sd * weight; missing, undefined and infinite results are 0."""
    if mean is None or sd is None or sd != sd or sd == 0:
        return F.lit(0.0)
    z = (F.col(column).cast("double") - F.lit(float(mean))) / F.lit(float(sd))
    # Spark orders NaN above infinity, so this holds for finite values only.
    return F.when(F.abs(z) < float("inf"), z * float(weight)).otherwise(0.0)


def standardize(
    df: DataFrame, columns: Sequence[str], parameters: Mapping[str, tuple] | None = None
) -> DataFrame:
    """Columns scaled by stored parameters (their own if none are given)."""
    parameters = parameters or scale_parameters(df, columns)
    return df.withColumns({c: scaled(c, *parameters[c]) for c in columns})
