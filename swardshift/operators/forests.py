"""Random forests on MLlib: fit, predict, validate, explain."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..stages import drop_path, shared_folder
from .ordering import number_rows
from .profile import regression_metrics


def _draw(id: str, salt: str):
    """Text that orders rows at random but the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{salt}:"), F.col(id).cast("string")).cast("binary"))


@dataclass
class Forest:
    """A fitted forest with the coding of its inputs."""

    model: RandomForestRegressionModel
    numeric: list[str]
    text: list[str]
    indexer: StringIndexerModel | None = None
    target: str = "obs"
    features: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.features = [*self.numeric, *self.text]

    def coded(self, df: DataFrame) -> DataFrame:
        """Adds ``__x``, the inputs as one array; text levels unknown to the fit get a level of their own."""
        if self.indexer is not None:
            df = self.indexer.transform(df)
        cols = [F.col(c).cast("double") for c in self.numeric] + [F.col(_ix(c)) for c in self.text]
        return df.withColumn("__x", F.array(*cols)).drop(*[_ix(c) for c in self.text])

    def score(self, coded: DataFrame, out: str = "pred") -> DataFrame:
        vec = coded.withColumn("__features", array_to_vector(F.col("__x")))
        scored = self.model.setFeaturesCol("__features").setPredictionCol(out).transform(vec)
        return scored.drop("__features")

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return self.score(self.coded(df), out).drop("__x")

    def save(self, path: str) -> str:
        """Write trees, level coding and the names of inputs and target below ``path``."""
        self.model.write().overwrite().save(f"{path}/trees")
        if self.indexer is not None:
            self.indexer.write().overwrite().save(f"{path}/levels")
        spark = SparkSession.active()
        names = [("numeric", k, c) for k, c in enumerate(self.numeric)] + [("text", k, c) for k, c in enumerate(self.text)]
        spark.createDataFrame([*names, ("target", 0, self.target)], "role string, place int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")
        return path

    @staticmethod
    def load(path: str) -> Forest:
        """What :meth:`save` wrote, ready to predict, rank and explain."""
        rows = SparkSession.active().read.parquet(f"{path}/names").orderBy("place").collect()
        names = {role: [r["name"] for r in rows if r["role"] == role] for role in ("numeric", "text", "target")}
        indexer = StringIndexerModel.load(f"{path}/levels") if names["text"] else None
        return Forest(RandomForestRegressionModel.load(f"{path}/trees"), names["numeric"], names["text"], indexer, names["target"][0])

    def levels(self, column: str) -> list[str]:
        return list(self.indexer.labelsArray[self.text.index(column)])


def _ix(c: str) -> str:
    return f"__ix_{c}"


def default_mtry(n_columns: int) -> int:
    return max(1, math.floor(math.sqrt(n_columns)))


def fit_forest(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    text: Sequence[str] = (),
    trees: int = 1000,
    mtry: int | None = None,
    depth: int = 20,
    min_leaf: int = 5,
    seed: int = 123,
    weight: str | None = None,
    bootstrap: bool = True,
    max_bins: int = 256,
) -> Forest:
    """Fit on complete rows; ``mtry`` defaults to the root of the number of inputs.

    A leaf keeps at least ``min_leaf`` rows. (The study's learner stops splitting
    nodes under 5 rows instead, so its leaves can be smaller.) A number with
    more than ``max_bins`` distinct values is split between ``max_bins`` of its
    quantiles; text levels always have a bin each.
    """
    numeric, text = list(numeric), list(text)
    keep = [target, *numeric, *text] + ([weight] if weight else [])
    rows = df.select(*keep).dropna()
    indexer = None
    if text:
        indexer = StringIndexer(
            inputCols=text, outputCols=[_ix(c) for c in text], handleInvalid="keep"
        ).fit(rows)
        max_bins = max(max_bins, *(len(l) + 2 for l in indexer.labelsArray))
        rows = indexer.transform(rows)
    assembler = VectorAssembler(
        inputCols=numeric + [_ix(c) for c in text], outputCol="__features", handleInvalid="error"
    )
    forest = RandomForestRegressor(
        featuresCol="__features",
        labelCol=target,
        predictionCol="pred",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        maxBins=max_bins,
        featureSubsetStrategy=str(mtry or default_mtry(len(numeric) + len(text))),
        seed=seed,
        bootstrap=bootstrap,
        # Rows keep the node they are in, so a level does not walk them down from the root again.
        cacheNodeIds=True,
        maxMemoryInMB=1024,
    )
    if weight:
        forest = forest.setWeightCol(weight)
    data = assembler.transform(rows).select(target, "__features", *([weight] if weight else []))
    # Each tree level scans the rows again: written once, they are not derived anew for it.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = cut_lineage(data.repartition(partitions))
    return Forest(forest.fit(data), numeric, text, indexer, target)


def _fold(id: str, folds: int, seed: int):
    number = F.conv(F.substring(_draw(id, f"fold {seed}"), 1, 8), 16, 10).cast("long")
    return F.pmod(number, F.lit(folds)).cast("int")


def kfold_predictions(
    df: DataFrame, target: str, numeric: Sequence[str], text: Sequence[str], id: str,
    folds: int = 5, seed: int = 123, **fit_args,
) -> DataFrame:
    """``(id, fold, obs, pred)``: each row predicted by the forest that has not seen it."""
    marked = cut_lineage(df.withColumn("fold", _fold(id, folds, seed)))
    parts = []
    for i in range(folds):
        forest = fit_forest(marked.where(F.col("fold") != i), target, numeric, text, seed=seed, **fit_args)
        held_out = marked.where(F.col("fold") == i).dropna(subset=[target, *numeric, *text])
        parts.append(forest.predict(held_out).select(id, "fold", F.col(target).alias("obs"), "pred"))
    return reduce(DataFrame.unionByName, parts)


def kfold_metrics(df: DataFrame, target: str, numeric, text, id: str, **args) -> DataFrame:
    return regression_metrics(kfold_predictions(df, target, numeric, text, id, **args), "obs", "pred")


def out_of_bag_predictions(
    df: DataFrame, target: str, numeric: Sequence[str], text: Sequence[str], id: str,
    bags: int = 10, trees: int = 100, seed: int = 123, **fit_args,
) -> DataFrame:
    """``(id, obs, pred, n_bags)``: mean prediction of the bags a row was left out of.

    MLlib keeps no record of its bootstrap samples, so the bags are ours: row
    weights Poisson(1) drawn from the id, one forest without further sampling
    per bag.
    """
    fitted = _bagged_forests(df, target, numeric, text, id, bags, trees, seed, **fit_args)
    parts = [forest.predict(left_out).select(id, F.col(target).alias("obs"), "pred") for forest, left_out in fitted]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(id).agg(
        F.first("obs").alias("obs"), F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("n_bags")
    )


def _bagged_forests(df, target, numeric, text, id, bags, trees, seed, **fit_args) -> list[tuple[Forest, DataFrame]]:
    """A forest for each bag, and the rows that the bag left out.

    Draws above 12 count as 12; they are rarer than one in ten billion.
    """
    u = (F.pmod(F.xxhash64(F.col(id), F.lit(seed), F.col("bag")), F.lit(2**40)) + 0.5) / 2.0**40
    p, cdf, w = math.exp(-1), 0.0, None
    for k in range(12):
        cdf += p
        p /= k + 1
        w = F.when(u < cdf, k) if w is None else w.when(u < cdf, k)
    draw = w.otherwise(12).cast("double")
    rows = cut_lineage(df.dropna(subset=[target, *numeric, *text]))
    out = []
    for b in range(bags):
        bagged = rows.withColumn("bag", F.lit(b)).withColumn("__w", draw)
        forest = fit_forest(
            bagged.where("__w > 0"), target, numeric, text, trees=max(1, trees // bags),
            seed=seed + b, weight="__w", bootstrap=False, **fit_args,
        )
        out.append((forest, bagged.where("__w = 0").drop("bag", "__w")))
    return out


def held_out_importance(
    df: DataFrame, target: str, numeric: Sequence[str], text: Sequence[str], id: str,
    bags: int = 10, trees: int = 1000, seed: int = 123, **fit_args,
) -> DataFrame:
    """``(name, value)``: permutation importance on rows that the scored trees have not seen.

    Each bag's forest is scored on the rows that its bag left out; the bags'
    values are averaged. Bags that leave out fewer than two rows say nothing.
    """
    fitted = _bagged_forests(df, target, numeric, text, id, bags, trees, seed, **fit_args)
    parts = [permutation_importance(forest, left_out, id, seed) for forest, left_out in fitted]
    return reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.avg("value").alias("value"))


def permutation_importance(forest: Forest, df: DataFrame, id: str, seed: int = 123) -> DataFrame:
    """``(name, value)``: rise of the squared error when a feature's values are dealt to other rows.

    Rows are put in a random order and each takes the value of the next one,
    the last that of the first. All features are scored in one pass.
    """
    rows = forest.coded(df.dropna(subset=[forest.target, *forest.features])).select(
        F.col(id).alias("id"), F.col(forest.target).cast("double").alias("obs"), "__x"
    )
    numbered = cut_lineage(
        number_rows(rows.withColumn("__h", _draw("id", f"deal {seed}")), ["__h", "id"])
    )
    n = numbered.count()
    donors = numbered.select(
        F.when(F.col("row") == 1, n).otherwise(F.col("row") - 1).cast("long").alias("row"), F.col("__x").alias("__p")
    )
    which = F.explode(F.sequence(F.lit(-1), F.lit(len(forest.features) - 1))).alias("f")
    dealt = numbered.join(donors, "row").select("obs", "__x", "__p", which)
    swapped = dealt.withColumn(
        "__x", F.transform("__x", lambda v, j: F.when(j == F.col("f"), F.col("__p")[j]).otherwise(v))
    )
    scored = forest.score(swapped)
    err = F.avg((F.col("pred") - F.col("obs")) ** 2)
    mse = cut_lineage(scored.groupBy("f").agg(err.alias("mse")))
    base = mse.where("f = -1").select("mse").scalar()
    names = F.element_at(F.array(*[F.lit(c) for c in forest.features]), F.col("f") + 1)
    return mse.where("f >= 0").select(names.alias("name"), (F.col("mse") - base).alias("value"))


#: Rows that a task walks through the trees at once.
WALK_ROWS = 65_536


def _node_tables(forest: Forest) -> list[tuple[list, ...]]:
    """Each tree's nodes, numbered from the root: (feature or -1, threshold or left levels, left, right, prediction).

    Read from the model's own files; the model itself lives on the driver already.
    """
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    forest.model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories",
    ).toPandas()
    drop_path(spark, path)
    out = []
    for _, tree in nodes.sort_values(["tree", "id"]).groupby("tree"):
        inner = (tree.leftChild >= 0).to_numpy()
        test = [
            None if not i else (float(at[0]) if levels < 0 else frozenset(float(x) for x in at))
            for i, at, levels in zip(inner, tree.leftCategoriesOrThreshold, tree.numCategories)
        ]
        feature = np.where(inner, tree.featureIndex.to_numpy(), -1)
        out.append((feature.tolist(), test, tree.leftChild.tolist(), tree.rightChild.tolist(), tree.prediction.tolist()))
    return out


def _left(values: np.ndarray, test: float | frozenset) -> np.ndarray:
    return values <= test if isinstance(test, float) else np.isin(values, list(test))


def _walk(tree: tuple[list, ...], x: np.ndarray, grids: dict[int, np.ndarray], total: dict[int, np.ndarray]) -> None:
    """Add the tree's predictions for all rows (columns of ``x``) to each grid point of each feature.

    A path that has not met a split on a feature predicts the same at all points
    of its grid. At such a split all rows go both ways, each way with the
    points that lead there, so a row meets a node once, not once per point.
    """
    feature, test, left, right, prediction = tree
    stack = [(0, np.arange(x.shape[1]), tuple(grids), None)]
    while stack:
        node, rows, free, points = stack.pop()
        j = feature[node]
        if j < 0:
            for f in free:
                if points is None:
                    total[f] += prediction[node] * len(rows)
                else:
                    total[f][points] += prediction[node] * len(rows)
            continue
        if j in free:
            way = _left(grids[j], test[node])
            here = np.ones(len(way), dtype=bool) if points is None else points
            for child, mask in ((left[node], here & way), (right[node], here & ~way)):
                if mask.any():
                    stack.append((child, rows, (j,), mask))
            free = tuple(f for f in free if f != j)
            if not free:
                continue
        way = _left(x[j, rows], test[node])
        for child, some in ((left[node], rows[way]), (right[node], rows[~way])):
            if len(some):
                stack.append((child, some, free, points))


def partial_dependence(
    forest: Forest, df: DataFrame, features: Sequence[str], points: int = 51
) -> DataFrame:
    """``(name, point, value, level, yhat)``: mean prediction with one feature set to a grid of values.

    Numeric features take an even grid over their range, text features their
    levels (in ``level``). Rows are not copied per grid point: a task walks its
    rows once through each tree, following both branches at splits on a feature,
    and hands on one sum per point. No complete row or no feature gives no rows.
    """
    rows = df.dropna(subset=forest.features)
    numeric = [f for f in dict.fromkeys(features) if f in forest.numeric]
    ranges = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.col(f).cast("double")).alias(f"lo{i}") for i, f in enumerate(numeric)],
        *[F.max(F.col(f).cast("double")).alias(f"hi{i}") for i, f in enumerate(numeric)],
    ).first()
    cells, grids = [], {}
    for f in dict.fromkeys(features) if ranges["n"] else ():
        j = forest.features.index(f)
        if f in numeric:
            lo, hi = ranges[f"lo{numeric.index(f)}"], ranges[f"hi{numeric.index(f)}"]
            values = [(lo + (hi - lo) * p / (points - 1), None) for p in range(points)]
        else:
            values = [(float(p), level) for p, level in enumerate(forest.levels(f))]
        grids[j] = np.array([v for v, _ in values])
        cells += [(len(cells) + p, f, p, None if level is not None else v, level) for p, (v, level) in enumerate(values)]
    labels = df.sparkSession.createDataFrame(cells, "cell long, name string, point int, value double, level string")
    if not cells:
        return labels.select("name", "point", "value", "level", F.lit(None).cast("double").alias("yhat"))
    trees = _node_tables(forest)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {j: np.zeros(len(g)) for j, g in grids.items()}
        held, n = [], 0

        def through() -> None:
            x = np.ascontiguousarray(np.concatenate(held).T)
            for tree in trees:
                _walk(tree, x, grids, total)

        for batch in batches:
            width = len(forest_features)
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            n += batch.num_rows
            if n >= WALK_ROWS:
                through()
                held, n = [], 0
        if n:
            through()
        sums = np.concatenate(list(total.values()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["cell", "total"])

    forest_features = list(forest.features)
    # Walking costs far more than moving the rows: an even share of them for each task.
    spread = forest.coded(rows).select("__x").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = spread.mapInArrow(walk, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    yhat = F.col("total") / F.lit(float(ranges["n"] * len(trees)))
    return sums.join(labels, "cell").select("name", "point", "value", "level", yhat.alias("yhat"))
