"""Density curves, histograms and natural breaks: the tables behind the figures."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import interval_index
from ..functions.strict import nan_to_null
from ..session import cut_lineage
from .joins import null_safe_inner
from .quantiles import exact_quantiles


def _group_shape(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Size, range and rule-of-thumb bandwidth per group (Silverman 1986, eq. 3.31)."""
    basic = df.groupBy(*groups).agg(
        F.count(value).alias("n"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )
    q = exact_quantiles(df, groups, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    if groups:
        shape = null_safe_inner(basic, q, list(groups))
    else:
        one = q.first()
        shape = basic.withColumns({c: F.lit(one[c]).cast("double") for c in ("q1", "median", "q3")})
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    spread = F.when(iqr > 0, F.least(F.col("sd"), iqr)).otherwise(F.col("sd"))
    return shape.withColumn("bw", 0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2)))


def _beside_shape(rows: DataFrame, shape: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with their group's numbers: joined by group (a missing key is one), or the one row's values without groups."""
    if keys:
        return null_safe_inner(rows, shape.select(*keys, *columns), list(keys))
    one = shape.first()
    return rows.withColumns({c: F.lit(one[c]) for c in columns})


def kde_table(
    df: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    points: int = 512,
    bandwidth: float | None = None,
    bins: int | None = 1024,
) -> DataFrame:
    """Gaussian density on an even grid from smallest to largest value, per group, with the median.

    With ``bins`` each value is first shared between its two nearest bin
    centres, so the kernel is applied to at most ``bins`` points per group
    however long the table is; a group's bins are one list, which a task works
    through in place, so nothing is copied per grid point before the result.
    ``bins=None`` applies the kernel to every distinct value.
    """
    keys = list(groups)
    rows = df.select(*keys, nan_to_null(F.col(value).cast("double")).alias("v")).where("v is not null")
    shape = _group_shape(rows, keys, "v")
    if bandwidth is not None:
        shape = shape.withColumn("bw", F.lit(float(bandwidth)))
    if bins is None:
        mass = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    else:
        width = (F.col("hi") - F.col("lo")) / (bins - 1)
        at = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), width), F.lit(0.0))
        left = F.least(F.floor(at), F.lit(bins - 2)).cast("int")
        halves = F.array(
            F.struct(left.alias("bin"), (1 - (at - left)).alias("w")),
            F.struct((left + 1).alias("bin"), (at - left).alias("w")),
        )
        mass = (
            _beside_shape(rows, shape, keys, ["lo", "hi"])
            .select(*keys, F.inline(halves))
            .groupBy(*keys, "bin")
            .agg(F.sum("w").alias("w"))
            .groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("bin", "w"))).alias("__mass"))  # at most ``bins`` entries
        )
        return _curves(_beside_shape(mass, shape, keys, ["n", "lo", "hi", "bw", "median"]), keys, points, bins)
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    on_grid = (
        _beside_shape(mass, shape, keys, ["n", "lo", "hi", "bw", "median"])
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .withColumn("x", F.col("lo") + F.col("point") * step)
    )
    z = (F.col("x") - F.col("v")) / F.col("bw")
    kernel = F.exp(-0.5 * z * z) * F.col("w") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    out = on_grid.groupBy(*keys, "point", "x", "median").agg(F.sum(kernel).alias("density"))
    return out.select(*keys, "point", "x", "density", "median")


def _curves(shaped: DataFrame, keys: Sequence[str], points: int, bins: int) -> DataFrame:
    """The density of each group, a row per group with its binned values, at each grid point."""
    read = shaped.select(*keys, "median", "n", "lo", "hi", "bw", "__mass")
    out = [*[read.schema[k] for k in [*keys, "median"]], T.StructField("__x", T.ArrayType(T.DoubleType())), T.StructField("__y", T.ArrayType(T.DoubleType()))]
    schema = T.StructType(out)
    own = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n, lo, hi, bw = (c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns[own : own + 4])
            mass = batch.column(own + 4)
            at, inner = mass.offsets.to_numpy() - mass.offsets[0].as_py(), mass.flatten()
            bin, w = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("bin", "w"))
            x, y = np.empty((rows, points)), np.empty((rows, points))
            for k in range(rows):
                here = slice(at[k], at[k + 1])
                x[k] = lo[k] + np.arange(points) * ((hi[k] - lo[k]) / (points - 1))
                centres = lo[k] + bin[here] * ((hi[k] - lo[k]) / (bins - 1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    z = (x[k][:, None] - centres[None, :]) / bw[k]
                    y[k] = np.exp(-0.5 * z * z) @ w[here] / (n[k] * bw[k] * math.sqrt(2 * math.pi))
            ends = pa.array(np.arange(rows + 1) * points, pa.int32())
            missing = np.isnan(y).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:own], pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))), pa.ListArray.from_arrays(ends, pa.array(y.reshape(-1), mask=missing))],
                names=schema.names,
            )

    curves = read.mapInArrow(run, schema).select(*keys, "median", F.posexplode(F.arrays_zip("__x", "__y")).alias("point", "__at"))
    return curves.select(*keys, "point", F.col("__at.__x").alias("x"), F.col("__at.__y").alias("density"), "median")


def histogram_by_breaks(
    df: DataFrame, value: str, breaks: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Rows per interval (left-closed, last one closed); values outside are left out."""
    return (
        df.withColumn("bin", interval_index(value, breaks))
        .where(F.col("bin").isNotNull())
        .groupBy(*groups, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: Intervals of values that a round asks the scan for; the rounds drop what lies between by themselves.
PUSHED_RANGES = 40


class _Bins:
    """Neighbouring bins of sorted values: sums about a common centre, range, number of distinct values.

    ``whole`` bins hold no cut: they have one value, or an earlier round ruled it out.
    """

    names = ("n", "s", "q", "lo", "hi", "m")

    def __init__(self, columns: dict[str, np.ndarray], whole: np.ndarray) -> None:
        self.columns, self.whole = columns, whole

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.whole)


def _joined(bins: _Bins, starts: np.ndarray) -> _Bins:
    """Runs of whole bins, each from one of ``starts`` to before the next, as one bin."""
    put = {"n": np.add, "s": np.add, "q": np.add, "m": np.add, "lo": np.minimum, "hi": np.maximum}
    return _Bins({c: put[c].reduceat(bins[c], starts) for c in _Bins.names}, np.logical_and.reduceat(bins.whole, starts))


class _CutPlaces:
    """Places where a cut may be: between two bins, or somewhere inside one, for whose rows a bound is charged.

    Rows inside a cut bin go to the class before or after. Adding rows x to a
    class of n rows with mean c raises its squared deviation by at least
    n / (n + added) * sum((x - c) ** 2), so the bin costs at least its rows times
    the smallest such square of the one class or of the other: two places a bin.
    Several cuts inside a bin charge nothing for it.
    """

    def __init__(self, bins: _Bins, cuts: int) -> None:
        size = len(bins)
        rows = [(0, 0, -1, 0, 0)] + [(e, e, -1, 0, 1) for e in range(1, size)] + [(size, size, -1, 0, 1)]
        for b in np.flatnonzero(~bins.whole):
            rows += [(b, b + 1, b, side, 1) for side in (-1, 1)]
            rows += [(b, b + 1, b, 0, c) for c in range(2, min(cuts, int(bins["m"][b]) - 1) + 1)]
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] + rows[i][1], i))
        self.before, self.after, self.bin, self.side, self.takes = np.array([rows[i] for i in order], dtype=int).T
        self.size = size
        self.start, self.end = int(np.flatnonzero((self.after == 0) & (self.bin < 0))[0]), int(np.flatnonzero((self.before == size) & (self.bin < 0))[0])
        inside = self.bin >= 0
        self.free = np.where(inside, bins["n"][self.bin], 0.0)
        self.lo, self.hi = bins["lo"][self.bin], bins["hi"][self.bin]
        self.sums = [np.concatenate([[0.0], np.cumsum(bins[c])]) for c in ("n", "s", "q")]

    def costs(self, centre: float) -> np.ndarray:
        """Least squared deviation of a class from one place (row) to another (column)."""
        lo, hi = self.lo - centre, self.hi - centre
        out = np.full((len(self.before), len(self.before)), np.inf)
        for r in range(0, len(out), 256):  # the matrix is filled a strip at a time
            own = slice(r, r + 256)
            n, s, q = (c[self.before][None, :] - c[self.after[own]][:, None] for c in self.sums)
            some = n > 0
            mean = np.divide(s, n, out=np.zeros_like(s), where=some)
            cost = np.where(some, np.maximum(q - s * mean, 0.0), 0.0)
            share = np.where(some, n / np.maximum(n + self.free[own][:, None] + self.free[None, :], 1.0), 0.0)
            ahead = np.where(self.side[own] > 0, self.free[own], 0.0)[:, None] * np.maximum(mean - hi[own][:, None], 0.0) ** 2
            behind = np.where(self.side < 0, self.free, 0.0)[None, :] * np.maximum(lo[None, :] - mean, 0.0) ** 2
            gap = self.before[None, :] - self.after[own][:, None]
            # Between two edges there must be a bin; a class inside cut bins may be without whole ones.
            allowed = (gap > 0) | ((gap == 0) & ((self.bin[own][:, None] >= 0) | (self.bin[None, :] >= 0)))
            out[own] = np.where(allowed, cost + share * (ahead + behind), np.inf)
        return out


def _least(costs: np.ndarray, places: _CutPlaces, cuts: int) -> tuple[np.ndarray, np.ndarray]:
    """Least cost up to, and from, each place for every number of cuts on the way (itself included before it)."""
    ahead = np.full((cuts + 1, len(costs)), np.inf)
    ahead[0, places.start] = 0.0
    back = np.full((cuts + 1, len(costs)), np.inf)
    back[0] = costs[:, places.end]
    for j in range(1, cuts + 1):
        for c in range(1, j + 1):
            own = (places.takes == c) & (np.arange(len(costs)) != places.end)
            if own.any():
                ahead[j, own] = (ahead[j - c][:, None] + costs[:, own]).min(axis=0)
                back[j] = np.minimum(back[j], (costs[:, own] + back[j - c, own][None, :]).min(axis=1))
    return ahead, back


def _edge_cuts(costs: np.ndarray, places: _CutPlaces, cuts: int) -> tuple[float, list[int]]:
    """The best cuts between bins: their squared deviation, and the first bin of each class (Fisher 1958)."""
    edges = np.flatnonzero(places.bin < 0)
    inner = costs[np.ix_(edges, edges)]
    best, came = np.full(len(edges), np.inf), []
    best[0] = 0.0
    for _ in range(cuts + 1):
        reach = best[:, None] + inner
        came.append(reach.argmin(axis=0))
        best = reach.min(axis=0)
    at, starts = len(edges) - 1, []
    for back in came[::-1]:
        at = int(back[at])
        starts.append(int(places.before[edges[at]]))
    return float(best[-1]), starts[::-1]


def natural_breaks(df: DataFrame, value: str, classes: int = 5, bins: int = 600) -> list[float]:
    """Break points (smallest value, class starts, largest value) of the classes with least squared deviation.

    Exact for any number of distinct values. Spark sums the values in bins; a
    dynamic program over bins finds the best cuts between them, and a second one
    bounds from below what a cut inside each bin could reach. Bins that cannot
    hold a cut of a better solution stay whole, and merge where no cut can lie
    between them either; the others are split and summed again, until each of
    them is one value. The region that is split shrinks with the bins' width, so
    a few rounds do, and only sums of some ``bins`` bins reach the driver. Their
    number changes the work, not the breaks.
    """
    v = nan_to_null(F.col(value).cast("double"))
    counts = cut_lineage(
        df.select(v.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("n"))
        .repartitionByRange("v").sortWithinPartitions("v")  # so that the rounds skip files without bins to split
    )
    head = counts.agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("c")).first()
    if not head["m"]:
        return []
    cuts, centre = min(classes, head["m"]) - 1, head["c"]
    table = _bin_sums(counts, [(head["lo"], head["hi"], head["m"])], bins, centre)
    total = float(table["q"].sum())
    while True:
        places = _CutPlaces(table, cuts)
        costs = places.costs(centre)
        reached, starts = _edge_cuts(costs, places, cuts)
        # Before there are enough bins for the classes no solution is known; rounding must not rule out the best one.
        limit = reached + 1e-9 * reached + 1e-12 * total if np.isfinite(reached) else np.inf
        ahead, back = _least(costs, places, cuts)
        through = (ahead + back[::-1]).min(axis=0)
        hopeful = set(places.bin[(places.bin >= 0) & (through <= limit)].tolist())
        if not hopeful:
            return [float(table["lo"][b]) for b in starts] + [float(head["hi"])]
        whole = np.array([b not in hopeful for b in range(len(table))])
        cut_here = set(places.before[(places.bin < 0) & (through <= limit)].tolist()) | set(starts)
        firsts = [b for b in range(len(table)) if b == 0 or b in cut_here or not (whole[b] and whole[b - 1])]
        table = _joined(_Bins(table.columns, whole), np.array(firsts))
        split = np.flatnonzero(~table.whole)
        ranges = [(table["lo"][b], table["hi"][b], table["m"][b]) for b in split]
        finer = _bin_sums(counts, ranges, max(4, bins // len(split)), centre)
        kept = {c: np.concatenate([table[c][table.whole], finer[c]]) for c in _Bins.names}
        order = np.argsort(kept["lo"])
        table = _Bins({c: x[order] for c, x in kept.items()}, np.concatenate([table.whole[table.whole], finer.whole])[order])


def _bucket(rows: DataFrame, starts: Sequence[float], out: str) -> DataFrame:
    """Number of the last of the ascending ``starts`` that is not above ``v``."""
    splits = [*starts, math.inf]
    if len(splits) < 3:
        return rows.withColumn(out, F.lit(0))
    return Bucketizer(splits=splits, inputCol="v", outputCol=out).transform(rows).withColumn(out, F.col(out).cast("int"))


def _bin_sums(counts: DataFrame, ranges: Sequence[tuple[float, float, float]], parts: int, centre: float) -> _Bins:
    """Sums of about ``parts`` bins of each range of values (of every value, if there are no more), in order."""
    lows, highs = (np.array([float(r[i]) for r in ranges]) for i in (0, 1))
    # Few intervals to push down to the scan: the widest gaps between ranges stay out.
    gaps = np.sort(np.argsort(highs[:-1] - lows[1:], kind="stable")[:PUSHED_RANGES])
    ends = zip(lows[np.r_[0, gaps + 1]], highs[np.r_[gaps, len(highs) - 1]], strict=True)
    rows = counts.where(reduce(or_, [F.col("v").between(float(a), float(b)) for a, b in ends]))

    def inside(x: np.ndarray) -> np.ndarray:
        """Number of the range that holds each value, -1 for none."""
        at = np.searchsorted(lows, x, side="right") - 1
        return np.where((at >= 0) & (x <= highs[at]), at, -1)

    edges = set(lows.tolist()) | {float(np.nextafter(h, math.inf)) for h in highs}
    limits = sorted(edges)
    many = np.array([m > parts for _, _, m in ranges])
    holder = inside(np.array(limits))
    large = [b for b, r in enumerate(holder.tolist()) if r >= 0 and many[r]]
    small = [b for b, r in enumerate(holder.tolist()) if r >= 0 and not many[r]]
    ranged = _bucket(rows, limits, "r")
    if large:
        half = parts // 2
        probs = [i / half for i in range(1, half)]
        cut = ranged.where(F.col("r").isin(large)).groupBy("r").agg(F.percentile_approx("v", probs, 20 * parts).alias("e"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for row in cut.collect():
            # Half of the bins by rank, half by even width, for values far out. The first value stands alone, so every round gets ahead.
            even = np.linspace(row["lo"], row["hi"], half + 1).tolist()
            edges |= {float(e) for e in [*row["e"], *even] if row["lo"] < e <= row["hi"]} | {float(np.nextafter(row["lo"], math.inf))}
    if small:
        edges |= {float(row["v"]) for row in ranged.where(F.col("r").isin(small)).select("v").collect()}
    x = F.col("v") - F.lit(centre)
    found = (
        _bucket(rows, sorted(edges), "b")
        .groupBy("b")
        .agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * x).alias("s"), F.sum(F.col("n") * x * x).alias("q"),
            F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("m"),
        )
        .toPandas()
        .sort_values("lo")
    )
    found = found[inside(found["lo"].to_numpy(dtype=float)) >= 0]
    columns = {c: found[c].to_numpy(dtype=float) for c in _Bins.names}
    return _Bins(columns, columns["m"] <= 1)
