"""Bootstrap intervals of a mean, by replicate weights instead of resampled copies."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strict import nan_to_null

NORMAL = NormalDist()
# P(X <= k) of a Poisson(1) count; beyond 18 the probability is below 1e-17.
POISSON_ONE = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))
# Three draws share one 64-bit hash; the table turns 21 random bits into a count.
LANES, LANE_BITS = 3, 21
COUNT_OF_BITS = np.searchsorted(POISSON_ONE, (np.arange(2**LANE_BITS) + 0.5) / 2**LANE_BITS).astype(np.int8)
# Replicates held at once per batch, and groups held per task before handing sums on.
CHUNK = 126
HELD_GROUPS = 64
# Rows whose draws are made at once, and mean rows of a group from which on its rows are summed by products.
SUM_ROWS, LONG_GROUP = 1024, 64


def _counts(row_hash: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """Poisson(1) counts for rows x replicates [first, last), fixed by (row, replicate, seed).

    The mixing is the SplitMix64 finalizer (Steele et al. 2014); ``first`` is a multiple of the lanes.
    """
    words = np.arange(first // LANES, -(-last // LANES), dtype=np.uint64)
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        x = row_hash[:, None] ^ ((words + np.uint64(1)) * step + np.uint64(seed) * step)[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    out = np.empty((len(row_hash), len(words), LANES), dtype=np.int8)
    mask = np.uint64(2**LANE_BITS - 1)
    for lane in range(LANES):
        out[:, :, lane] = COUNT_OF_BITS[(x >> np.uint64(lane * LANE_BITS)) & mask]
    return out.reshape(len(row_hash), -1)[:, : last - first]


def _replicate_sums(row_hash: np.ndarray, x: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Sums of the weights and of weight times value for each replicate, over a group's rows, with the weights of :func:`_counts`.

    Few rows at a time stay in the processor's cache; a product sums them.
    """
    words = np.arange(-(-replicates // LANES), dtype=np.uint64)
    step, mask = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**LANE_BITS - 1)
    with np.errstate(over="ignore"):
        salt = (words + np.uint64(1)) * step + np.uint64(seed) * step
    sums = np.zeros((2, len(words), LANES))
    for lo in range(0, len(x), SUM_ROWS):
        own = np.stack([np.ones(len(x[lo : lo + SUM_ROWS])), x[lo : lo + SUM_ROWS]])
        for w0 in range(0, len(words), CHUNK // LANES):
            mixed = row_hash[lo : lo + SUM_ROWS, None] ^ salt[None, w0 : w0 + CHUNK // LANES]
            bits = mixed >> np.uint64(30)
            with np.errstate(over="ignore"):
                mixed ^= bits
                mixed *= np.uint64(0xBF58476D1CE4E5B9)
                np.right_shift(mixed, np.uint64(27), out=bits)
                mixed ^= bits
                mixed *= np.uint64(0x94D049BB133111EB)
            np.right_shift(mixed, np.uint64(31), out=bits)
            mixed ^= bits
            for lane in range(LANES):
                np.right_shift(mixed, np.uint64(lane * LANE_BITS), out=bits)
                bits &= mask
                counts = COUNT_OF_BITS.take(bits.view(np.int64), mode="clip").astype(float)
                sums[:, w0 : w0 + CHUNK // LANES, lane] += own @ counts
    return sums.reshape(2, -1)[:, :replicates]


def _short_group_sums(row_hash: np.ndarray, x: np.ndarray, starts: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """:func:`_replicate_sums` of several groups of few rows, which begin at ``starts``: groups x 2 x replicates."""
    sums = np.empty((len(starts), 2, replicates))
    for lo in range(0, replicates, CHUNK):
        hi = min(lo + CHUNK, replicates)
        w = _counts(row_hash, lo, hi, seed).astype(float)
        sums[:, 0, lo:hi] = np.add.reduceat(w, starts, axis=0)
        sums[:, 1, lo:hi] = np.add.reduceat(w * x[:, None], starts, axis=0)
    return sums


def _accumulator(replicates: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(
                {
                    "grp": list(held),
                    "w": [v[0] for v in held.values()],
                    "wx": [v[1] for v in held.values()],
                }
            )
            held.clear()
            return out

        for batch in batches:
            if batch.empty:
                continue
            batch = batch.sort_values("grp", kind="stable")
            labels = batch["grp"].to_numpy()
            starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
            x = batch["x"].to_numpy(dtype=float)
            h = batch["h"].to_numpy().astype(np.int64).view(np.uint64)
            ends = np.r_[starts[1:], len(labels)]
            # A few groups at a time, so that the sums held follow the replicates alone.
            for g0 in range(0, len(starts), HELD_GROUPS):
                first, last = starts[g0 : g0 + HELD_GROUPS], ends[g0 : g0 + HELD_GROUPS]
                if last[-1] - first[0] >= LONG_GROUP * len(first):
                    sums = [_replicate_sums(h[lo:hi], x[lo:hi], replicates, seed) for lo, hi in zip(first, last, strict=True)]
                else:
                    sums = _short_group_sums(h[first[0] : last[-1]], x[first[0] : last[-1]], first - first[0], replicates, seed)
                for g, own in zip(labels[first], sums, strict=True):
                    held[g] = held[g] + own if g in held else own
                    if len(held) >= HELD_GROUPS:
                        yield flush()
        if held:
            yield flush()

    return run


def _order_statistic(sorted_t: np.ndarray, alpha: float) -> float:
    """Quantile between order statistics, interpolated on the normal scale (Davison and Hinkley 1997)."""
    r = len(sorted_t)
    rank = (r + 1) * alpha
    k = int(np.floor(rank))
    if k < 1:
        return float(sorted_t[0])
    if k >= r:
        return float(sorted_t[-1])
    if rank == k:
        return float(sorted_t[k - 1])
    low, high = NORMAL.inv_cdf(k / (r + 1)), NORMAL.inv_cdf((k + 1) / (r + 1))
    share = (NORMAL.inv_cdf(alpha) - low) / (high - low)
    return float(sorted_t[k - 1] + share * (sorted_t[k] - sorted_t[k - 1]))


def bca_limits(t: np.ndarray, estimate: float, acceleration: float, conf: float) -> tuple[float, float]:
    """Bias-corrected, accelerated limits (Efron 1987)."""
    t = np.sort(t)
    below = float(np.mean(t < estimate))
    z0 = NORMAL.inv_cdf(min(max(below, 0.5 / len(t)), 1 - 0.5 / len(t)))
    out = []
    for tail in ((1 - conf) / 2, (1 + conf) / 2):
        z = z0 + NORMAL.inv_cdf(tail)
        out.append(_order_statistic(t, NORMAL.cdf(z0 + z / (1 - acceleration * z))))
    return out[0], out[1]


def _group_key(group: str | None) -> Column:
    """The group as text that keeps a missing key apart from an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")) if group else F.lit("=all")


def replicate_means(
    df: DataFrame, value: str, id: str, group: str | None, replicates: int, seed: int
) -> DataFrame:
    """``(grp, rep, t)``: mean of each replicate. Each row weighs Poisson(1), drawn from its id.

    A lost task redraws the same weights. Tasks keep replicate sums, not rows.
    """
    rows = df.select(
        _group_key(group).alias("grp"), F.xxhash64(F.col(id)).alias("h"), nan_to_null(F.col(value).cast("double")).alias("x")
    ).where("x is not null")
    # Thousands of draws per row outweigh moving its three numbers: use every core.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = rows.mapInPandas(
        _accumulator(replicates, seed), "grp string, w array<double>, wx array<double>"
    )
    each = sums.select("grp", F.posexplode(F.arrays_zip("w", "wx")).alias("rep", "s"))
    return (
        each.groupBy("grp", "rep")
        .agg(F.sum("s.w").alias("w"), F.sum("s.wx").alias("wx"))
        .select("grp", "rep", F.try_divide("wx", "w").alias("t"))
        .where("t is not null")
    )


def bootstrap_mean_ci(
    df: DataFrame,
    value: str,
    id: str,
    group: str | None = None,
    replicates: int = 10_000,
    conf: float = 0.95,
    seed: int = 123,
) -> DataFrame:
    """Mean with bias, standard error and BCa limits, overall or per group.

    The acceleration of a mean follows from its third moment, so no jackknife
    pass is needed. The last step holds one group's replicates, a fixed number.
    """
    name = group or "grp"
    x = nan_to_null(F.col(value).cast("double"))
    stats = df.select(_group_key(group).alias("grp"), x.alias("x")).where("x is not null").groupBy("grp").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("statistic"),
        F.coalesce(F.skewness("x"), F.lit(0.0)).alias("skew"),
    )
    reps = replicate_means(df, value, id, group, replicates, seed)

    def limits(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        t = pdf["t"].to_numpy()
        skew = 0.0 if np.isnan(one["skew"]) else one["skew"]
        low, high = bca_limits(t, one["statistic"], skew / (6 * np.sqrt(one["n"])), conf)
        return pd.DataFrame(
            {
                "grp": [one["grp"]],
                "n": [int(one["n"])],
                "statistic": [one["statistic"]],
                "bias": [t.mean() - one["statistic"]],
                "std_error": [t.std(ddof=1)],
                "conf_low": [low],
                "conf_high": [high],
            }
        )

    out = (
        reps.join(stats, "grp")
        .groupBy("grp")
        .applyInPandas(
            limits,
            "grp string, n bigint, statistic double, bias double, std_error double, "
            "conf_low double, conf_high double",
        )
    )
    label = F.substring("grp", 2, 2**31 - 1) if group else F.lit("all")
    return out.select(F.when(F.col("grp") != "-", label).alias(name), *out.columns[1:])
