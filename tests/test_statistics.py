import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from swardshift.operators import applicability as aoa
from swardshift.operators import bootstrap as bs
from swardshift.operators import correlate as co
from swardshift.operators import density as de
from swardshift.operators import profile as pr
from swardshift.operators import quantiles as qu


def test_quantiles_both_ways(spark):
    rng = random.Random(1)
    data = [("hot", 7.0)] * 500 + [("hot", rng.gauss(0, 1)) for _ in range(700)] + [("cold", v) for v in (1.0, 2.0, 3.0, 10.0)]
    data += [("cold", None), ("cold", float("nan"))]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {r["g"]: (r["a"], r["b"]) for r in qu.exact_quantiles(df, ["g"], "x", [0.5, 0.95], ["a", "b"]).collect()}
    hot = [v for g, v in data if g == "hot"]
    assert got["hot"] == (pytest.approx(np.quantile(hot, 0.5)), pytest.approx(np.quantile(hot, 0.95)))
    assert got["cold"] == (2.5, pytest.approx(8.95))
    whole = qu.exact_quantiles(df, [], "x", [0.3], ["a"]).first()["a"]
    assert whole == pytest.approx(np.quantile(hot + [1, 2, 3, 10], 0.3))
    strict = rows(qu.strict_quantile(df, ["g"], "x", 0.5, "m"))
    assert strict[0] == ("cold", None) and strict[1][1] == pytest.approx(np.median(hot))


def test_strict_quantiles_read_rows_once(spark):
    """What lies before the rows, a join of neighbours say, is worked out once."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    data = [("a", float(k % 7)) for k in range(200)] + [("b", None), ("b", 1.0), (None, 2.0), (None, 4.0), ("c", float("nan"))]
    df = spark.createDataFrame(data, "g string, x double").mapInArrow(passed, "g string, x double")
    assert rows(qu.strict_quantile(df, ["g"], "x", 0.5, "m")) == [("a", 3.0), ("b", None), ("c", None), (None, 3.0)]
    assert seen.value == len(data)
    assert qu.strict_quantile(df.where("g = 'a'"), [], "x", 0.5, "m").first()["m"] == 3.0
    assert qu.strict_quantile(df, [], "x", 0.5, "m").first()["m"] is None
    assert qu.strict_quantile(df.where("g = 'z'"), [], "x", 0.5, "m").first()["m"] is None


def test_profile_counts_missing_and_levels(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, "b"), (4.0, None)], "x double, s string")
    p = {r["name"]: r for r in pr.profile_columns(df, robust=True).collect()}
    assert (p["x"]["na"], p["x"]["mean"], p["x"]["min"], p["x"]["max"], p["x"]["median"]) == (2, 2.5, 1.0, 4.0, 2.5)
    assert p["x"]["mad"] == pytest.approx(1.5 * 1.4826)
    assert (p["s"]["na"], p["s"]["nlevs"], p["s"]["min"], p["s"]["max"]) == (1, 2, 1.0, 2.0)
    assert p["s"]["disp"] == pytest.approx(1 / 3)


def test_spearman_with_ties_and_holes(spark):
    rng = np.random.default_rng(4)
    n = 300
    pdf = pd.DataFrame({"a": rng.integers(0, 5, n).astype(float), "b": rng.normal(size=n), "d": rng.normal(size=n)})
    pdf["c"] = pdf["a"] + rng.normal(size=n) * 0.3
    pdf.loc[rng.random(n) < 0.2, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "c"] = np.nan
    want = pdf.corr(method="spearman")
    pdf["id"] = range(n)
    got = co.spearman_pairs(spark.createDataFrame(pdf), ["id"], ["a", "b", "c", "d"]).collect()
    assert len(got) == 6
    for r in got:
        assert r["rho"] == pytest.approx(want.loc[r["var1"], r["var2"]], abs=1e-12)
        assert r["n"] == pdf[[r["var1"], r["var2"]]].dropna().shape[0]


def test_rounding_comes_before_the_limit(spark):
    pairs = spark.createDataFrame([("a", "b", 0.804), ("a", "c", 0.806), ("b", "c", -0.91)], "var1 string, var2 string, rho double")
    assert rows(co.collinear_pairs(pairs).select("var1", "var2", "rho")) == [("a", "c", 0.81), ("b", "c", -0.91)]


def test_components_and_rotation(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(size=(400, 2))
    x = np.column_stack([f[:, 0] + 0.2 * rng.normal(size=400) for _ in range(3)] + [f[:, 1] + 0.2 * rng.normal(size=400) for _ in range(2)])
    cols = list("abcde")
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols))
    t = co.component_table(df, cols).orderBy("component").collect()
    assert sum(r["eigenvalue"] for r in t) == pytest.approx(5) and t[-1]["cumulative"] == pytest.approx(1)
    assert [r["kept"] for r in t] == [True, True, False, False, False]
    load = co.rotated_loadings(df, cols, 2, cutoff=0.65).collect()
    shown = {(r["variable"], r["component"]) for r in load if r["loading"] is not None}
    first = {c for v, c in shown if v in "abc"}
    assert len(shown) == 5 and len(first) == 1 and {c for v, c in shown if v in "de"} == {1, 2} - first
    values, vectors = co.principal_components(df, cols)
    raw = vectors[:, :2] * np.sqrt(values[:2])
    rotated = co.varimax(raw)
    assert (rotated**2).sum(axis=1) == pytest.approx((raw**2).sum(axis=1))
    spread = lambda m: ((m / np.sqrt((raw**2).sum(axis=1))[:, None]) ** 2).var(axis=0).sum()
    best = max(spread(raw @ [[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]) for a in np.linspace(0, math.pi, 721))
    assert spread(rotated) == pytest.approx(best, rel=1e-4)


def _sse(values, breaks):
    v = np.sort(np.asarray(values))
    cls = np.clip(np.searchsorted(breaks, v, side="right") - 1, 0, len(breaks) - 2)
    return sum(((v[cls == c] - v[cls == c].mean()) ** 2).sum() for c in np.unique(cls))


def test_natural_breaks_against_every_split(spark):
    rng = np.random.default_rng(3)
    values = np.round(np.concatenate([rng.normal(m, 1, 6) for m in (0, 8, 20)] + [[5.0, 5.0]]), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = de.natural_breaks(df, "x", 3)
    distinct = np.unique(values)
    best = min(_sse(values, [distinct[0], distinct[i], distinct[j], distinct[-1]])
               for i, j in itertools.combinations(range(1, len(distinct)), 2))
    assert got[0] == values.min() and got[-1] == values.max()
    assert _sse(values, got) == pytest.approx(best)
    assert de.natural_breaks(df.limit(0), "x") == []


def _fisher(values, classes):
    """The dynamic program over all distinct values, each layer by divide and conquer over monotone cut points."""
    x, n = np.unique(values, return_counts=True)
    x0 = x - values.mean()
    cn, cs, cq = (np.concatenate([[0.0], np.cumsum(a)]) for a in (n, n * x0, n * x0 * x0))
    cost = lambda a, b: (cq[b] - cq[a]) - (cs[b] - cs[a]) ** 2 / (cn[b] - cn[a])
    best = np.array([np.inf] + [cost(0, b) for b in range(1, len(x) + 1)])
    for _ in range(classes - 1):
        new = np.full(len(x) + 1, np.inf)
        todo = [(1, len(x), 0, len(x) - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            cand = np.arange(a, min(mid - 1, b) + 1)
            total = best[cand] + cost(cand, mid)
            k = int(np.argmin(total))
            new[mid] = total[k]
            todo += [(lo, mid - 1, a, int(cand[k])), (mid + 1, hi, int(cand[k]), b)]
        best = new
    return best[-1]


@pytest.mark.parametrize(("classes", "bins"), [(2, 16), (3, 40), (5, 30), (5, 600)])
def test_natural_breaks_of_many_values(spark, classes, bins):
    """20,000 distinct values: the optimum, whatever the number of bins."""
    rng = np.random.default_rng(classes * 1000 + bins)
    values = np.concatenate([rng.normal(m, s, 5000) for m, s in ((0, 1.0), (4, 0.5), (15, 3.0), (16, 8.0))])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = de.natural_breaks(df, "x", classes, bins=bins)
    assert len(got) == classes + 1 and got[0] == values.min() and got[-1] == values.max()
    assert _sse(values, got) == pytest.approx(_fisher(values, classes), rel=1e-9)


def test_natural_breaks_of_awkward_values(spark):
    """Even steps, few values with many copies, outliers, as many classes as values and more."""
    rng = np.random.default_rng(8)
    cases = [np.arange(3000.0), np.repeat([1.0, 2.0, 9.0], [5000, 1, 3]), np.concatenate([rng.exponential(1, 3000) ** 3, [1e6]]), np.array([4.0]), np.array([1.0, 2.0])]
    for values in cases:
        df = spark.createDataFrame(pd.DataFrame({"x": values}))
        for classes in (1, 2, 4):
            got = de.natural_breaks(df, "x", classes, bins=24)
            k = min(classes, len(np.unique(values)))
            assert len(got) == k + 1
            assert _sse(values, got) == pytest.approx(_fisher(values, k), rel=1e-9, abs=1e-9)
    with_gaps = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (5.0,)], "x double")
    assert de.natural_breaks(with_gaps, "x", 2) == [1.0, 5.0, 5.0]


def test_density_integrates_to_one(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("a", rng.gauss(0, 1)) for _ in range(400)] + [("b", rng.gauss(5, 2)) for _ in range(300)], "g string, x double")
    exact = de.kde_table(df, "x", ["g"], 200, bins=None).toPandas()
    binned = de.kde_table(df, "x", ["g"], 200, bins=2048).toPandas()
    for g in "ab":
        e, b = (t[t.g == g].sort_values("point") for t in (exact, binned))
        assert np.trapezoid(e.density, e.x) == pytest.approx(1, abs=0.03)
        assert np.allclose(e.density, b.density, atol=1e-4)
    flat = de.kde_table(df, "x", points=50, bandwidth=0.5).toPandas()
    assert list(flat.columns) == ["point", "x", "density", "median"] and len(flat) == 50


def _brute_aoa(new, train, w, clusters=None, q=0.95):
    mean, sd = np.nanmean(train, axis=0), np.nanstd(train, axis=0, ddof=1)

    def z(m):
        with np.errstate(all="ignore"):
            s = (m - mean) / sd
        s[~np.isfinite(s)] = 0
        return s * w

    t, n = z(train), z(new)
    d = np.sqrt(((t[:, None] - t[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.nan)
    if clusters is not None:
        d[clusters[:, None] == clusters[None]] = np.nan
    scale = np.nanmean(d, axis=1).mean()
    limit = np.quantile(np.nanmin(d, axis=1) / scale, q)
    di = np.sqrt(((n[:, None] - t[None]) ** 2).sum(-1)).min(axis=1) / scale
    return di, (di <= limit).astype(int)


@pytest.mark.parametrize("rows,clustered", [(7, False), (512, False), (16, True)])
def test_area_of_applicability_equals_brute_force(spark, rows, clustered, monkeypatch):
    for size, value in (("TILE_ROWS", 5), ("FRAGMENT_ROWS", rows), ("LEAF_ROWS", rows)):
        monkeypatch.setattr(aoa, size, value)
    rng = np.random.default_rng(8)
    cols = ["a", "b", "c", "flat"]
    train = np.column_stack([rng.normal(size=(90, 3)), np.full(90, 2.0)])
    train[40:70] = train[40]  # a third are copies of one row
    train[3, 1] = np.nan
    new = np.column_stack([rng.normal(size=(60, 3)) * 2, rng.normal(size=60)])
    new[0] = train[10]
    new[1, 2] = np.nan
    new[20:40, 0] = 0.5  # a third share the heaviest variable
    w = np.array([3.0, 1.0, 0.5, 1.0])
    clusters = np.arange(90) % 4
    tdf = pd.DataFrame(train, columns=cols).assign(id=range(90), cl=clusters)
    ndf = pd.DataFrame(new, columns=cols).assign(id=range(1000, 1060))
    got = aoa.area_of_applicability(
        spark.createDataFrame(ndf), spark.createDataFrame(tdf), dict(zip(cols, w)), "id",
        cluster="cl" if clustered else None,
    ).toPandas().sort_values("id")
    di, inside = _brute_aoa(new, train, w, clusters if clustered else None)
    assert got.di.to_numpy() == pytest.approx(di, abs=1e-9)
    assert got.di.iloc[0] == 0.0
    assert (got.aoa.to_numpy() == inside).all()


def test_box_tree_descends_by_best_bounds(spark, monkeypatch):
    """0/1 columns, groups of copies and far rows: exact distances, and each new row visits a bounded share of the leaves."""
    monkeypatch.setattr(aoa, "LEAF_ROWS", 40)
    monkeypatch.setattr(aoa, "FRAGMENT_ROWS", 64)
    rng = np.random.default_rng(12)

    def rows(n):
        hot = np.eye(12)[rng.integers(0, 12, n)] * 0.7
        return np.column_stack([rng.normal(size=(n, 3)) * [2.0, 1.0, 0.3], hot, np.eye(5)[rng.integers(0, 5, n)] * 1.5])

    train, new = rows(3000), rows(700)
    train[1000:2000] = train[0]
    new[:250] = new[0]
    new[250] += 50
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, vec array<double>").repartition(4)
    visits = []
    got = aoa.nearest_train_distance(frame(new), frame(train), len(train), visits).toPandas().sort_values("id")
    want = np.sqrt(((new[:, None] - train[None]) ** 2).sum(-1)).min(axis=1)
    assert got.min_dist.to_numpy() == pytest.approx(want, abs=1e-9)
    leaves = -(-len(train) // 40)
    assert visits[0] == len(new) and sum(visits) < 0.5 * leaves * len(new)


def test_distances_copy_rows_by_the_grids_side(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(130, 4))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vec array<double>")
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.nan)
    for side in (1, 2, 5, 30):
        got = aoa.train_distances(df, 130, side).toPandas().sort_values("id")
        assert got.mean_dist.to_numpy() == pytest.approx(np.nanmean(d, axis=1)) and got.min_dist.to_numpy() == pytest.approx(np.nanmin(d, axis=1))
    assert aoa.grid_side(10**6, 200) == 62 and aoa.grid_side(10**7, 200) == 611 and aoa.grid_side(100, 200) == 1
    one = aoa.train_distances(df.limit(1), 1).collect()
    assert [(r.mean_dist, r.min_dist) for r in one] == [(None, None)]


@pytest.mark.parametrize("block", [1 << 24, 600])
def test_mean_distance_of_rows_that_repeat(spark, block, monkeypatch):
    """Every pair counts, equal rows and far ones too; what the blocks write does not grow with the pairs."""
    monkeypatch.setattr(aoa, "BLOCK_BYTES", block)
    monkeypatch.setattr(aoa, "TILE_ROWS", 7)
    rng = np.random.default_rng(14)
    rows = rng.normal(size=(120, 3))
    rows[30:80] = rows[2]
    rows[100] = rows[5] + 1e-9
    rows[119] *= 1e5
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vec array<double>")
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
    assert aoa.mean_train_distance(df) == pytest.approx(d.sum() / (120 * 119), rel=1e-12)
    np.fill_diagonal(d, np.inf)
    got = aoa._own_distances(df, 120).toPandas().sort_values("id")
    assert got.min_dist.to_numpy() == pytest.approx(d.min(axis=1), rel=1e-9, abs=0)
    assert aoa.mean_train_distance(df.limit(1)) is None


def test_train_against_itself_is_inside(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(50, 3)), columns=list("xyz")).assign(id=range(50)))
    got = aoa.area_of_applicability(df, df, {"x": 1.0, "y": 2.0, "z": 0.1}, "id").toPandas()
    assert (got.di == 0).all() and (got.aoa == 1).all()


def test_far_pieces_are_not_worked_out_pair_by_pair(monkeypatch):
    """Most pairs of rows lie far apart: their distances come from few terms, and the sum is that of all pairs."""
    rng = np.random.default_rng(5)
    rows = np.column_stack([rng.normal(size=24_000), 1e-4 * rng.random(24_000), 1e-4 * rng.integers(0, 2, 24_000)])
    rows = rows[aoa._piece_order(rows)]
    shares, copies = rng.random(len(rows)), rng.integers(1, 4, len(rows)).astype(float)
    direct, pairs = aoa._block_sum, []
    whole = direct(rows, rows, shares, shares, copies, copies) / 2
    monkeypatch.setattr(aoa, "_block_sum", lambda a, b, *rest: pairs.append(len(a) * len(b)) or direct(a, b, *rest))
    block = aoa._Block(rows, shares, copies)
    assert aoa._pieces_sum(block, block, True) == pytest.approx(whole, rel=1e-10)
    assert sum(pairs) < len(rows) ** 2 / 4
    cut = [aoa._Block(rows[s], shares[s], copies[s]) for s in (slice(0, 9_000), slice(9_000, None))]
    parts = [aoa._pieces_sum(cut[i], cut[j], i == j) for i, j in ((0, 0), (0, 1), (1, 1))]
    assert sum(parts) == pytest.approx(whole, rel=1e-10)


def test_pieces_whose_distances_need_many_terms_are_worked_out_in_full():
    rng = np.random.default_rng(6)
    left, right = rng.random((4_000, 12)), rng.random((4_000, 12)) + 1.5
    a, b = (aoa._Block(x[aoa._piece_order(x)], np.ones(len(x)), np.ones(len(x))) for x in (left, right))
    want = aoa._block_sum(a.rows, b.rows, a.shares, b.shares, a.copies, b.copies)
    assert aoa._pieces_sum(a, b, False) == pytest.approx(want, rel=1e-10)


def test_applicability_refuses_bad_input(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0)], "id long, x double")
    with pytest.raises(ValueError):
        aoa.area_of_applicability(df, df, {}, "id")
    with pytest.raises(ValueError):
        aoa.area_of_applicability(df, df, {"nope": 1.0}, "id")
    with pytest.raises(ValueError):
        aoa.area_of_applicability(df, df, {"x": 1.0}, "id")
    with pytest.raises(ValueError):
        aoa.importance_weights({"a": 1.0}, ["a", "b_x"], {})
    assert aoa.importance_weights({"a": 1.0, "use": 2.0}, ["a", "use_not_used"], {"use_not_used": "use"}) == {
        "a": 1.0, "use_not_used": 2.0}


def test_bootstrap_is_stable_and_sensible(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(800), "x": rng.exponential(2.0, 800), "g": np.where(rng.random(800) < 0.3, "u", "v")})
    df = spark.createDataFrame(pdf)
    a = bs.bootstrap_mean_ci(df, "x", "id", "g", replicates=1500).toPandas().sort_values("g").reset_index(drop=True)
    b = bs.bootstrap_mean_ci(df.repartition(13), "x", "id", "g", replicates=1500).toPandas().sort_values("g").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)
    for r in a.itertuples():
        x = pdf[pdf.g == r.g].x
        assert r.n == len(x) and r.statistic == pytest.approx(x.mean())
        assert r.std_error == pytest.approx(x.std(ddof=1) / math.sqrt(len(x)), rel=0.1)
        assert r.conf_low < r.statistic < r.conf_high
        # Right-skewed data: the interval reaches farther up.
        assert r.conf_high - r.statistic > r.statistic - r.conf_low
    every = bs.bootstrap_mean_ci(df, "x", "id", replicates=500).toPandas()
    assert len(every) == 1 and every.n[0] == 800


def test_replicate_sums_of_long_and_short_groups_agree():
    """The draws of a row are the same whichever way its group is summed, over row pieces and incomplete lanes too."""
    rng = np.random.default_rng(8)
    h, x = rng.integers(0, 2**63, 2_500).astype(np.uint64), rng.normal(size=2_500)
    for replicates in (1, 7, 126, 200):
        w = bs._counts(h, 0, replicates, 5).astype(float)
        want = np.stack([w.sum(axis=0), (w * x[:, None]).sum(axis=0)])
        assert bs._replicate_sums(h, x, replicates, 5) == pytest.approx(want, rel=1e-9, abs=1e-9)
        short = bs._short_group_sums(h, x, np.array([0, 900, 901]), replicates, 5)
        assert short.sum(axis=0) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_long_groups_are_summed_without_a_table_of_draws(monkeypatch):
    def refuse(*_):
        raise AssertionError("a table of rows x replicates")

    monkeypatch.setattr(bs, "_counts", refuse)
    batch = pd.DataFrame({"grp": ["=a"] * 300 + ["=b"] * 200, "h": np.arange(500), "x": np.ones(500)})
    out = pd.concat(bs._accumulator(50, 1)(iter([batch, batch])))
    assert list(out["grp"]) == ["=a", "=b"] and all((w == wx).all() for w, wx in zip(out["w"], out["wx"]))


def test_replicate_weights_are_poisson():
    h = np.arange(40000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = bs._counts(h, 0, 12, 5)
    assert w.shape == (40000, 12)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert np.abs(np.corrcoef(w.T) - np.eye(12)).max() < 0.03
    assert (bs._counts(h, 6, 12, 5) == w[:, 6:12]).all()
    assert (w == 0).mean() == pytest.approx(math.exp(-1), abs=0.005)


def test_bca_limits_of_symmetric_replicates():
    t = np.array([bs.NORMAL.inv_cdf((i + 0.5) / 999) for i in range(999)])
    low, high = bs.bca_limits(t, 0.0, 0.0, 0.95)
    assert low == pytest.approx(-1.96, abs=0.02) and high == pytest.approx(1.96, abs=0.02)


def test_frequency_tables_keep_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "c string")
    got = rows(pr.condition_counts(df, {"is_a": F.col("c") == "a"}).select("outcome", "n"))
    assert got == [(True, 2), (None, 1)]
    assert rows(pr.tally_share(df, ["c"]))[0] == ("a", 2, pytest.approx(2 / 3))


def test_missing_keys_are_groups_of_their_own(spark):
    from swardshift.operators.bootstrap import bootstrap_mean_ci
    from swardshift.operators.density import kde_table
    from swardshift.operators.levels import share_of_total
    from swardshift.operators.ordering import running_total

    data = [(k, g, float(k % 7)) for k, g in enumerate([None] * 20 + [""] * 20 + ["a"] * 20)]
    df = spark.createDataFrame(data, "id long, g string, x double")
    medians = {r["g"]: r["m"] for r in qu.strict_quantile(df, ["g"], "x", 0.5, "m").collect()}
    want = {g: sorted(x for _, h, x in data if h == g) for g in (None, "", "a")}
    assert medians == {g: (v[9] + v[10]) / 2 for g, v in want.items()}
    boot = {r["g"]: (r["n"], r["statistic"]) for r in bootstrap_mean_ci(df, "x", "id", "g", replicates=200).collect()}
    assert boot == {g: (20, pytest.approx(sum(v) / 20)) for g, v in want.items()}
    curves = kde_table(df, "x", ["g"], points=16).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in curves} == {None: 16, "": 16, "a": 16}
    totals = running_total(df, ["g"], ["id"], F.col("x"), "t").groupBy("g").agg(F.max("t").alias("t")).collect()
    assert {r["g"]: r["t"] for r in totals} == {g: sum(v) for g, v in want.items()}
    parts = spark.createDataFrame([(None, "ALL", 8.0), (None, "p", 2.0), ("a", "ALL", 4.0), ("a", "p", 1.0)], "g string, c string, v double")
    shares = {r["g"]: r["share"] for r in share_of_total(parts, ["g"], "c", "ALL", "v").where("c = 'p'").collect()}
    assert shares == {None: 25.0, "a": 25.0}


def test_quantiles_between_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0,), (inf,), (inf,)], "x double")
    assert qu.exact_quantiles(df, [], "x", [0.5, 0.0], ["m", "lo"]).first()[:] == (inf, 1.0)


def test_wide_correlations_with_missing_values(spark):
    from swardshift.operators.correlate import spearman_pairs

    rng = np.random.default_rng(3)
    frame = pd.DataFrame({c: np.where(rng.random(300) < 0.2, np.nan, rng.integers(0, 30, 300).astype(float)) for c in "abcd"})
    frame["e"], frame["id"] = 1.0, 7  # a constant column, and ids that repeat
    got = {(r["var1"], r["var2"]): (r["n"], r["rho"]) for r in spearman_pairs(spark.createDataFrame(frame), ["id"], list("abcde")).collect()}
    assert len(got) == 10
    for (a, b), (n, rho) in got.items():
        both = frame[[a, b]].dropna()
        ranks = both.rank()
        assert n == len(both)
        assert rho is None if b == "e" else rho == pytest.approx(ranks[a].corr(ranks[b]))


def test_rankings_are_shared_by_columns_missing_together(spark):
    """Columns of one source are missing in the same rows; pairs within and between sources against pandas."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({f"c{k}": rng.integers(0, 40, 400).astype(float) for k in range(24)})
    for source in range(4):
        frame.loc[rng.random(400) < 0.15, [f"c{k}" for k in range(24) if k % 4 == source]] = np.nan
    frame["id"] = range(400)
    names = [c for c in frame if c != "id"]
    got = {(r["var1"], r["var2"]): r["rho"] for r in co.spearman_pairs(spark.createDataFrame(frame), ["id"], names).collect()}
    want = frame[names].corr(method="spearman")
    assert len(got) == 24 * 23 // 2
    assert all(rho == pytest.approx(want.loc[a, b]) for (a, b), rho in got.items())


def test_densities_of_many_groups(spark):
    """Each group's curve against the sum of its binned kernels; a missing group is one, a group of one row has no curve."""
    rng = np.random.default_rng(8)
    groups = [*[f"g{k}" for k in range(300)], None]
    data = [(g, float(v)) for g in groups for v in rng.normal(0, 3, 12)] + [("alone", 1.0), ("flat", 2.0), ("flat", 2.0), ("alone", None)]
    found = de.kde_table(spark.createDataFrame(data, "g string, x double"), "x", ["g"], 16, bins=64).collect()
    assert len(found) == 16 * 303
    for g in [None, "g0", "g299"]:
        v = np.array([x for h, x in data if h == g])
        q1, median, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        bw = 0.9 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2
        at = (v - v.min()) / ((v.max() - v.min()) / 63)
        left = np.minimum(np.floor(at), 62)
        mass = np.bincount(left.astype(int), 1 - (at - left), 64) + np.bincount(left.astype(int) + 1, at - left, 64)
        centres, grid = np.linspace(v.min(), v.max(), 64), np.linspace(v.min(), v.max(), 16)
        want = np.exp(-0.5 * ((grid[:, None] - centres) / bw) ** 2) @ mass / (len(v) * bw * np.sqrt(2 * np.pi))
        curve = sorted((r for r in found if r["g"] == g), key=lambda r: r["point"])
        assert [r["density"] for r in curve] == pytest.approx(list(want)) and curve[0]["median"] == pytest.approx(median)
    assert all(r["density"] is None for r in found if r["g"] in ("alone", "flat"))


def test_rows_on_planes_meet_through_nodes(spark, monkeypatch):
    """0/1 columns beside two measures: planes far apart are not worked out pair by pair, and the mean is that of all pairs."""
    monkeypatch.setattr(aoa, "PAIR_S", 1e-3)  # as if there were many more rows
    monkeypatch.setattr(aoa, "FRAGMENT_ROWS", 90)
    rng = np.random.default_rng(21)
    n = 2500
    hot = np.column_stack([np.eye(4)[rng.integers(0, 4, n)] * 1.3, np.eye(2)[rng.integers(0, 2, n)] * 0.2])
    rows = np.column_stack([rng.normal(size=n) * 2, hot, rng.random(n) - 40])
    rows[40:60] = rows[3]
    given = [(i if i != 9 else 8, [float(x) for x in r]) for i, r in enumerate(rows)]  # an id that comes twice
    df = spark.createDataFrame(given, "id long, vec array<double>").repartition(3)
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
    ids = pd.Series(d.sum(axis=1)).groupby([i for i, _ in given]).mean() / (n - 1)
    pairs = spark.sparkContext.accumulator(0)
    real = aoa._block_sum
    monkeypatch.setattr(aoa, "_block_sum", lambda a, b, *rest: pairs.add(len(a) * len(b)) or real(a, b, *rest))
    assert aoa.mean_train_distance(df) == pytest.approx(ids.mean(), rel=1e-11)
    assert 0 < pairs.value < n * n / 3


def test_rows_settled_at_home_make_no_further_visits(spark, monkeypatch):
    """Leaves are cut between values that near rows do not differ in: few rows look beyond their own leaf."""
    monkeypatch.setattr(aoa, "LEAF_ROWS", 60)
    rng = np.random.default_rng(22)

    def rows(n):
        return np.column_stack([rng.random((n, 2)) * [6.0, 3.0], np.eye(8)[rng.integers(0, 8, n)] * 1.3, np.eye(5)[rng.integers(0, 5, n)] * 1.2])

    train, new = rows(8000), rows(900)
    new[5] += 30.0
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, vec array<double>")
    visits = []
    got = aoa.nearest_train_distance(frame(new), frame(train), len(train), visits).toPandas().sort_values("id")
    assert got.min_dist.to_numpy() == pytest.approx(np.sqrt(((new[:, None] - train[None]) ** 2).sum(-1)).min(axis=1), abs=1e-9)
    assert visits[0] == len(new) and sum(visits[1:]) < len(new)
