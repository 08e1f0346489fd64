"""Transfer between classes: train on one class, apply to the other, explain the difference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import effect_size
from ..operators.applicability import area_of_applicability, importance_weights
from ..operators.forests import (
    Forest,
    default_mtry,
    fit_forest,
    held_out_importance,
    out_of_bag_predictions,
)
from ..operators.profile import tally_share
from ..operators.reshape import frequent_levels, lump_rare, one_hot_columns
from ..session import cut_lineage

# Which class the model is trained on in each direction.
REFERENCE_OF_DIRECTION = {"grassToCrop": "Cropland", "cropToGrass": "Grassland"}


@dataclass
class Transfer:
    """Results of :func:`transfer_effects`."""

    pred: DataFrame
    forest: Forest
    importance: DataFrame | None
    inside: DataFrame


def with_split(df: DataFrame, cls: str, ref: str, classes: Sequence[str]) -> DataFrame:
    """Rows of the two classes, marked 'ref' or 'treat'."""
    return df.where(F.col(cls).isin(*classes)).withColumn(
        "split", F.when(F.col(cls) == ref, "ref").otherwise("treat")
    )


def coded_for_distance(
    df: DataFrame, numeric: Sequence[str], text: Sequence[str], id: str, share: float = 0.05
) -> tuple[DataFrame, dict[str, str]]:
    """Rare levels lumped, text one-hot coded; also new column -> source column."""
    rows = df.select(id, "split", *numeric, *text)
    if not text:
        return rows.dropna(), {}
    kept = frequent_levels(rows, text, share)
    lumped = lump_rare(rows, text, share, kept=kept).dropna()
    levels = {c: [*kept[c], "Other"] for c in text}
    present = lumped.agg(
        *[F.max(F.when(F.col(c) == "Other", 1)).alias(f"o{i}") for i, c in enumerate(text)]
    ).first()
    levels = {
        c: lv if present[f"o{i}"] or "Other" in kept[c] else lv[:-1] for i, (c, lv) in enumerate(levels.items())
    }
    levels = {c: sorted(set(lv)) for c, lv in levels.items()}
    return one_hot_columns(lumped, levels)


def transfer_effects(
    df: DataFrame,
    target: str,
    cls: str,
    ref: str,
    treat: str,
    numeric: Sequence[str],
    text: Sequence[str] = (),
    id: str = "point_id",
    effect: str = "Abs",
    also: Sequence[str] = (),
    trees: int = 1000,
    depth: int = 20,
    mtry: int | None = None,
    threshold: float = 0.95,
    seed: int = 123,
    importance: Mapping[str, float] | None = None,
    min_leaf: int = 5,
    bags: int = 5,
    bootstrap: bool = True,
) -> Transfer:
    """Model ``target`` on class ``ref``, predict class ``treat``, and take the difference.

    ``pred`` holds id, split, obs, pred, effect and, for treated rows, DI and
    AOA. Distances are weighted by permutation importance on reference rows that
    the scored trees have not seen, unless weights are given.
    """
    features = [*numeric, *text]
    rows = with_split(df, cls, ref, [ref, treat]).select(
        id, "split", F.col(target).cast("double").alias("obs"), *features, *[c for c in also if c not in features]
    )
    rows = cut_lineage(rows.dropna(subset=["obs", *features]).distinct())
    reference = rows.where("split = 'ref'")
    # The study's first model counts the target among its columns when it sets mtry.
    forest = fit_forest(
        reference, "obs", numeric, text, trees, mtry or default_mtry(len(features) + 1), depth, min_leaf, seed,
        bootstrap=bootstrap,
    )
    scores = None if importance is not None else cut_lineage(
        held_out_importance(
            reference, "obs", numeric, text, id, bags, trees, seed, mtry=mtry or default_mtry(len(features) + 1),
            depth=depth, min_leaf=min_leaf,
        )
    )
    if importance is None:
        # One number per model variable.
        importance = {r["name"]: r["value"] for r in scores.collect()}

    coded, source_of = coded_for_distance(rows, numeric, text, id)
    columns = [c for c in coded.columns if c not in (id, "split")]
    weights = importance_weights(importance, columns, source_of)
    aoa = cut_lineage(
        area_of_applicability(
            coded.where("split = 'treat'").drop("split"),
            coded.where("split = 'ref'").drop("split"),
            weights,
            id,
            threshold,
        )
    )
    predicted = forest.predict(rows).withColumn("effect", effect_size("pred", "obs", effect))
    pred = predicted.select(id, "split", "obs", "pred", "effect", *also).join(aoa, id, "left")
    return Transfer(pred, forest, scores, tally_share(aoa, ["aoa"]))


def transfer_direction(df: DataFrame, target: str, cls: str, direction: str, *args, **options) -> Transfer:
    """:func:`transfer_effects` between the two classes of a named direction.

    The direction names the class that the model is trained on; the other one
    is treated.
    """
    ref = REFERENCE_OF_DIRECTION[direction]
    (treat,) = set(REFERENCE_OF_DIRECTION.values()) - {ref}
    return transfer_effects(df, target, cls, ref, treat, *args, **options)


def explain_effects(
    pred: DataFrame,
    df: DataFrame,
    numeric: Sequence[str],
    text: Sequence[str] = (),
    id: str = "point_id",
    trees: int = 1000,
    depth: int = 20,
    min_leaf: int = 5,
    seed: int = 123,
) -> tuple[Forest, DataFrame]:
    """Second model: the effect on treated rows inside the area of applicability.

    Returns the forest and its training rows.
    """
    inside = pred.where("aoa = 1").select(id, "effect")
    train = cut_lineage(inside.join(df.select(id, *numeric, *text), id).dropna())
    mtry = default_mtry(len(numeric) + len(text))
    return fit_forest(train, "effect", numeric, text, trees, mtry, depth, min_leaf, seed), train


def effect_rows(pred: DataFrame) -> DataFrame:
    """Treated rows whose effect counts: inside the area, or not judged."""
    return pred.where("split = 'treat' and (aoa is null or aoa = 1)")


def out_of_bag_r2(df: DataFrame, target: str, numeric, text, id: str, **args) -> DataFrame:
    from ..operators.profile import regression_metrics

    return regression_metrics(out_of_bag_predictions(df, target, numeric, text, id, **args), "obs", "pred")
