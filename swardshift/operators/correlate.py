"""Spearman screening of column pairs, principal components and rotation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strict import nan_to_null
from ..session import cut_lineage
from .ordering import running_total

SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def average_ranks(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value) -> average rank of the value within its group; ties share it.

    Equal values are counted first, so a value that fills a third of a column
    is one row here.
    """
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_total(counts, [group], [value], F.col("__n"), "__upto")
    return ranked.select(group, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias("rank"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows x columns of a batch of doubles, missing ones NaN."""
    return np.column_stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns])


def _presence(clean: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Columns x columns: rows in which both are present. Tasks send a matrix each, summed by cell on the way."""
    p = len(cols)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            here = (~np.isnan(_matrix(batch))).astype(np.float64)
            total += here.T @ here
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * p)), pa.array(total.reshape(-1))], names=["cell", "n"])

    cells = clean.select(*cols).mapInArrow(count, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(p * p)
    for r in cells.collect():  # columns x columns numbers
        out[r["cell"]] = r["n"]
    return out.reshape(p, p)


def spearman_pairs(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Spearman correlation of every column pair over its complete rows.

    Ranks must be taken among the rows where *both* columns are present. A
    column whose partner is present wherever it is itself can use its own
    ranks, and partners that are present in the same rows share theirs, so
    rankings grow with the patterns of presence, not with the pairs: one per
    column without missing values, and one per column and source where columns
    that come from one source are missing together.
    The ranks travel back to their rows once, as one list per row, and tasks
    sum the products of all pairs. Rows are told apart by number: ``ids`` only
    says which columns are no measures, and may repeat.
    """
    cols = [c for c in columns if c not in ids]
    clean = cut_lineage(
        df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols]).withColumn("__row", F.monotonically_increasing_id())
    )
    pairs = list(combinations(range(len(cols)), 2))
    both = _presence(clean, cols)
    sets: dict[tuple[int, int | None], int] = {}

    # The first column that is present in just the same rows stands for all of them.
    pattern = [next(k for k in range(len(cols)) if both[k, k] == both[c, c] == both[k, c]) for c in range(len(cols))]

    def rank_set(a: int, b: int) -> int:
        return sets.setdefault((a, None if both[a, b] == both[a, a] else pattern[b]), len(sets))

    used = np.array([(rank_set(a, b), rank_set(b, a)) for a, b in pairs]).reshape(-1, 2)
    entries = [
        F.struct(
            F.lit(s).alias("set"),
            (F.col(cols[c]) if partner is None else F.when(F.col(cols[partner]).isNotNull(), F.col(cols[c]))).alias("v"),
        )
        for (c, partner), s in sets.items()
    ]
    long = clean.select("__row", F.inline(F.array(*entries))).where("v is not null")
    ranks = average_ranks(long.select("set", "v"), "set", "v")
    # A row's list has an entry for each rank set at most.
    by_row = long.join(ranks, ["set", "v"]).groupBy("__row").agg(F.collect_list(F.struct("set", "rank")).alias("ranks"))
    n_sets, size = len(sets), max(1.0, float(both.max(initial=1.0)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(used), 6))
        for batch in batches:
            lists = batch.column(0)
            inner = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            r = np.full((len(lists), n_sets), np.nan)
            r[row, inner.field("set").to_numpy()] = inner.field("rank").to_numpy() / size - 0.5
            for k in range(0, len(used), 512):
                x, y = r[:, used[k : k + 512, 0]], r[:, used[k : k + 512, 1]]
                here = ~np.isnan(x) & ~np.isnan(y)
                x, y = np.where(here, x, 0.0), np.where(here, y, 0.0)
                total[k : k + 512] += np.stack([here.sum(0), x.sum(0), y.sum(0), (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(used))), *map(pa.array, np.ascontiguousarray(total.T))], names=["pair", *SUMS])

    sums = by_row.select("ranks").mapInArrow(products, "pair bigint, " + ", ".join(f"{c} double" for c in SUMS))
    one = sums.groupBy("pair").agg(*[F.sum(c).alias(c) for c in SUMS])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    # Constant ranks leave rounding dust in place of a variance.
    rho = F.when(var > 1e-18 * F.col("n") * F.col("n"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(var))))
    names = df.sparkSession.createDataFrame([(k, cols[a], cols[b]) for k, (a, b) in enumerate(pairs)], "pair bigint, var1 string, var2 string")
    return names.join(one, "pair", "left").select("var1", "var2", F.coalesce("n", F.lit(0.0)).cast("long").alias("n"), F.when(F.col("n") > 0, rho).alias("rho"))


def collinear_pairs(pairs: DataFrame, limit: float = 0.8, digits: int = 2) -> DataFrame:
    """Pairs beyond the limit after rounding, so 0.804 is not reported."""
    return pairs.withColumn("rho", F.round("rho", digits)).where(F.abs("rho") > limit)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlations over complete rows, columns x columns numbers.

    Tasks multiply their rows' matrix with itself, about the columns' means, and
    send the products, which are summed by cell on the way to the driver.
    """
    cols = list(columns)
    p = len(cols)
    complete = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols]).dropna()
    means = np.array([x or 0.0 for x in complete.agg(*[F.avg(c) for c in cols]).first()])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, p + 1))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), _matrix(batch) - means])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((p + 1) ** 2)), pa.array(total.reshape(-1))], names=["cell", "s"])

    g = np.zeros((p + 1) ** 2)
    for r in complete.mapInArrow(multiply, "cell bigint, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        g[r["cell"]] = r["s"]
    g = g.reshape(p + 1, p + 1)
    n, s = g[0, 0], g[0, 1:]
    cov = g[1:, 1:] - np.outer(s, s) / max(n, 1)
    sd = np.sqrt(np.diag(cov))
    with np.errstate(invalid="ignore", divide="ignore"):
        m = cov / np.outer(sd, sd)
    np.fill_diagonal(m, 1.0)
    return m


def correlation_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(var1, var2, rho) of every column pair over complete rows."""
    cols, m = list(columns), correlation_matrix(df, columns)
    rows = [(cols[i], cols[j], float(m[i, j])) for i, j in combinations(range(len(cols)), 2)]
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, rho double")


def principal_components(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and eigenvectors of the standardized columns."""
    values, vectors = np.linalg.eigh(correlation_matrix(df, columns))
    order = np.argsort(values)[::-1]
    return np.clip(values[order], 0, None), vectors[:, order]


def component_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Eigenvalue, variance share and cumulative share per component."""
    values, _ = principal_components(df, columns)
    share = values / values.sum()
    rows = [
        (i + 1, float(v), float(s), float(c), bool(v > 1))
        for i, (v, s, c) in enumerate(zip(values, share, np.cumsum(share)))
    ]
    return df.sparkSession.createDataFrame(
        rows, "component int, eigenvalue double, share double, cumulative double, kept boolean"
    )


def varimax(loadings: np.ndarray, tol: float = 1e-10, sweeps: int = 500) -> np.ndarray:
    """Orthogonal rotation maximising the variance of squared loadings, rows normalised.

    Pairs of components are turned by their best angle in closed form (Kaiser
    1958) until no pair moves. Works on the variables x components matrix only.
    """
    norms = np.sqrt((loadings**2).sum(axis=1, keepdims=True))
    norms[norms == 0] = 1.0
    z = loadings / norms
    p, k = z.shape
    for _ in range(sweeps):
        turned = 0.0
        for i, j in combinations(range(k), 2):
            x, y = z[:, i].copy(), z[:, j].copy()
            u, v = x * x - y * y, 2 * x * y
            num = 2 * (u @ v) - 2 * u.sum() * v.sum() / p
            den = u @ u - v @ v - (u.sum() ** 2 - v.sum() ** 2) / p
            angle = np.arctan2(num, den) / 4
            z[:, i] = x * np.cos(angle) + y * np.sin(angle)
            z[:, j] = y * np.cos(angle) - x * np.sin(angle)
            turned = max(turned, abs(angle))
        if turned < tol:
            break
    return z * norms


def rotated_loadings(
    df: DataFrame, columns: Sequence[str], components: int, cutoff: float = 0.65
) -> DataFrame:
    """(variable, component, loading) after rotation; small loadings are NULL, with their row sum."""
    values, vectors = principal_components(df, columns)
    raw = vectors[:, :components] * np.sqrt(values[:components])
    rotated = varimax(raw)
    rows = []
    for name, line in zip(columns, rotated):
        shown = [float(v) if abs(v) >= cutoff else None for v in line]
        total = float(sum(v for v in shown if v is not None))
        rows += [(name, i + 1, v, total) for i, v in enumerate(shown)]
    return df.sparkSession.createDataFrame(
        rows, "variable string, component int, loading double, row_sum double"
    )
