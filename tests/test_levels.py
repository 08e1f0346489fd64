import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from swardshift.operators import joins, levels, ordering, reshape
from swardshift.plans import covariates as cov


def test_finest_level_wins_even_when_missing(spark):
    df = spark.createDataFrame(
        [(1, 0, "a", 10.0), (1, 2, "a", None), (2, 0, "a", 1.0), (2, 0, "a", 3.0), (3, 1, "b", float("nan")), (3, 0, "b", 2.0)],
        "id long, level int, g string, v double",
    )
    want = [(1, "a", None), (2, "a", 2.0), (3, "b", None)]
    for lv in (levels.REGION_LEVELS, None):
        assert rows(levels.finest_level_mean(df, ["id"], "level", ["g"], "v", lv)) == want


def _random_cube(spark, seed=5):
    rng = random.Random(seed)
    regions = {0: ["A", "B"], 1: ["A1", "A2", "B1"], 2: ["A11", "A12", "A21", "B11"]}
    cube = [
        (g, t, c, None if rng.random() < 0.2 else round(rng.uniform(1, 9), 3))
        for lv in regions for g in regions[lv] for t in (1.0, 2.0, 3.0) for c in "xyz" if rng.random() < 0.7
    ]
    key = []
    for p in range(30):
        leaf = rng.choice(regions[2])
        for lv, code in ((0, leaf[:1]), (1, leaf[:2]), (2, leaf)):
            for version in range(rng.choice([1, 2])):
                key.append((p, lv, code, 10.0 + lv + version))
    cube_df = spark.createDataFrame(cube, "geo string, time double, cat string, values double")
    key_df = spark.createDataFrame(key, "point_id long, level int, region_id string, area_km2 double")
    return cube, key, cube_df, key_df


@pytest.mark.parametrize("area", [None, "area_km2"])
def test_summing_before_the_join_changes_nothing(spark, area):
    """Sums per region give what averaging every joined row gives, area versions weighing in."""
    cube, key, cube_df, key_df = _random_cube(spark)
    want = {}
    for p, cat in itertools.product(range(30), "xyz"):
        for lv in (0, 1, 2):
            joined = [
                v / (a if area else 1) if v is not None else None
                for (q, l, code, a) in key if q == p and l == lv
                for (g, _, c, v) in cube if g == code and c == cat
            ]
            if joined:
                present = [v for v in joined if v is not None]
                want[p, cat] = sum(present) / len(present) if present else None
    got = {
        (r["point_id"], r["cat"]): r["values"]
        for r in levels.region_means(cube_df, key_df, ["cat"], area=area, levels=(0, 1, 2)).collect()
    }
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (pytest.approx(v) if v is not None else None)


def test_share_is_null_without_total(spark):
    df = spark.createDataFrame([(1, "T", 4.0), (1, "a", 1.0), (2, "a", 1.0), (3, "T", 0.0), (3, "a", 1.0)],
                               "id long, cat string, v double")
    got = rows(levels.share_of_total(df, ["id"], "cat", "T", "v").where("cat = 'a'").select("id", "share"))
    assert got == [(1, 25.0), (2, None), (3, None)]
    assert rows(levels.share_table(df, ["id"], "cat", ["T", "a"], "T", "v")) == [(1, 25.0), (2, None), (3, None)]
    kept = levels.share_table(df, ["id"], "cat", ["T", "a"], "T", "v", keep_ref=True)
    assert kept.where("id = 1").first()["T"] == 100.0


def test_rollup_keeps_published_rows(spark):
    df = spark.createDataFrame([("DE11", "x", 1.0), ("DE12", "x", 2.0), ("DE1", "x", 9.0), ("FR11", "x", None)],
                               "geo string, c string, v double")
    assert rows(levels.rollup_codes(df, "geo", ["c"], "v")) == sorted(
        [("DE11", "x", 1.0), ("DE12", "x", 2.0), ("DE1", "x", 9.0), ("FR11", "x", None), ("DE1", "x", 3.0),
         ("FR1", "x", None)], key=lambda t: tuple((v is None, v) for v in t))


def test_ambiguous_regions(spark):
    key = spark.createDataFrame(
        [
            (1, 2003, 2, "A1", 5.0), (1, 2003, 2, "A2", None), (1, 2006, 2, "A1", 5.0), (1, 2006, 2, "A1", 5.0),
            (2, 2003, 2, "B1", None), (1, 2003, 0, "A", 1.0),
        ],
        "p long, y int, l int, r string, a double",
    )
    # A2 is seen once among the conflicting rows, with a missing area; duplicates count once.
    got = rows(joins.resolve_ambiguous_regions(key, "p", "y", "l", "r").select("p", "y", "l", "r"))
    assert got == [(1, 2003, 0, "A"), (1, 2003, 2, "A1"), (1, 2006, 2, "A1"), (2, 2003, 2, "B1")]


def test_null_safe_joins(spark):
    a = spark.createDataFrame([(1, None), (1, 2.0)], "id long, x double")
    b = spark.createDataFrame([(1, None)], "id long, x double")
    assert rows(joins.null_safe_anti(a, b)) == [(1, 2.0)]
    assert rows(joins.with_group_count(a.union(b), ["id", "x"], "n")) == [(1, 2.0, 1), (1, None, 2), (1, None, 2)]
    with pytest.raises(ValueError):
        joins.natural_join(a, b, ["id"])


def test_running_total_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 3).alias("g"), F.col("id"))
    got = ordering.running_total(df, ["g"], ["id"], F.col("id"), "s").collect()
    sums = {0: 0, 1: 0, 2: 0}
    want = {}
    for i in range(5000):
        sums[i % 3] += i
        want[i] = sums[i % 3]
    assert {r["id"]: r["s"] for r in got} == want


@pytest.mark.parametrize("batch", [3, 10_000])
def test_running_total_of_awkward_groups(spark, batch):
    """Missing and NaN keys, one group with most rows, groups that span partitions and batches; whole numbers stay whole."""
    import random

    rng = random.Random(batch)
    keys = [None, float("nan"), 1.0, 2.0, *[float(k) for k in range(10, 40)]]
    data = [(i, rng.choice(["a", None]), 2.0 if rng.random() < 0.6 else rng.choice(keys), rng.choice([None, 1, 2, 5])) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, g string, h double, v int").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = ordering.running_total(df, ["g", "h"], [F.desc("id")], F.col("v"), "s")
        doubles = {r["id"]: r["s"] for r in ordering.running_total(df, [], ["id"], F.col("v") / 2, "s").collect()}
        assert got.columns == ["id", "g", "h", "v", "s"] and got.schema["s"].dataType.simpleString() == "bigint"
        sums, want = {}, {}
        for i, g, h, v in reversed(data):
            k = (g, repr(h))
            want[i] = sums[k] = sums.get(k, 0) + (v or 0)
        assert {r["id"]: r["s"] for r in got.collect()} == want
        upto = 0.0
        for i, _, _, v in data:
            upto += (v or 0) / 2
            assert doubles[i] == upto
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_running_total_of_no_rows(spark):
    df = spark.range(0).withColumn("g", F.lit("a"))
    assert ordering.running_total(df, ["g"], ["id"], F.col("id"), "s").collect() == []
    assert ordering.number_rows(df, ["id"]).collect() == []


def test_pages_and_ties(spark):
    df = spark.createDataFrame([(c, v) for c, v in zip("abcdefgh", [5.0, 5.0, 4.0, 4.0, 4.0, 3.0, 2.0, 1.0])], "name string, value double")
    assert [r["name"] for r in ordering.top_n_with_ties(df, "value", 3).orderBy("name").collect()] == list("abcde")
    paged = ordering.grid_cells(ordering.paginate(df, ["name"], 4), "pos", 2).orderBy("row").collect()
    assert [(r["page"], r["pos"], r["cell"]) for r in paged][3:6] == [(1, 4, "B2"), (2, 1, "A1"), (2, 2, "A2")]


def test_lumping_is_strict_and_leaves_missing_out(spark):
    values = ["a"] * 90 + ["b"] * 5 + ["c"] * 5 + [None] * 50
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, c string")
    lumped = reshape.lump_rare(df, ["c"], 0.05)
    assert rows(lumped.groupBy("c").count()) == [("Other", 10), ("a", 90), (None, 50)]
    coded, source = reshape.one_hot_columns(lumped.dropna(), {"c": ["Other", "a"]})
    assert coded.columns == ["id", "c_Other", "c_a"] and source == {"c_Other": "c", "c_a": "c"}
    assert coded.agg(F.sum("c_a"), F.sum("c_Other")).first()[:] == (90, 10)


def test_spread_and_uniqueness(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, None, 2.0), (2, "b", 3.0)], "id long, k string, v double")
    assert rows(reshape.spread(df, ["id"], "k", "v", ["a", "b"])) == [(1, 1.0, None), (2, None, 3.0)]
    with pytest.raises(ValueError):
        reshape.assert_unique(df.union(df), ["id", "k"])
    with pytest.raises(ValueError):
        reshape.assemble_features([df.select("id", "v"), df.select("id", "v")], ["id"])


def _stat_cube(spark):
    rng = random.Random(3)
    base = {"agrarea": "TOTAL", "farmtype": "TOTAL", "unit": "HA", "so_eur": "TOTAL", "leg_form": "TOTAL",
            "lsu": "TOTAL", "crop_rot": "TOTAL", "soil_cov": "ARA"}
    dims = ["agrarea", "farmtype", "unit", "so_eur", "leg_form", "lsu", "crop_rot", "soil_cov", "tillage", "crops",
            "animals", "irr_area", "indic_agr", "strucpro", "nutrient", "indic_ag", "pesticid"]
    wanted = {
        "ef_lus_main": [{"crops": c} for c in ("UAA", "ARA", "J0000", "PECR", "WA", "FCONV_UCONV")],
        "ef_m_farmleg": [{"indic_agr": i, "farmtype": f} for i in ("UAA_HA", "FARM_LSU_LS") for f in ("TOTAL", "FT15_SO")],
        "ef_lus_allcrops": [{"crops": c} for c in ("ARA", "C1000", "XARAX", "J0000", "J1000", "PECR", "F1000")],
        "ef_lsk_main": [{"animals": a, "unit": "LSU"} for a in ("A2000", "A6000", "A0010")],
        "ef_mp_irri": [{"irr_area": "IRR"}],
        "ef_mp_soil": [{"crop_rot": c} for c in ("TOTAL", "PC0", "PC1-24", "PC25-49")] + [{"soil_cov": "COVER"}],
        "ef_mp_prac": [{"tillage": t} for t in ("ARA", "ZERO")],
        "apro_cpshr": [{"strucpro": "YI_HU_EU", "crops": "C1100"}],
        "aei_pr_gnb": [{"indic_ag": "BAL_UAA", "nutrient": "N"}],
        "aei_fm_salpest09": [{"pesticid": p} for p in ("F", "H")],
        "aei_fm_usefert": [{"nutrient": n} for n in ("N", "P")],
        "aei_fm_manfert": [{"nutrient": n} for n in ("N", "P", "K")],
        "aei_ps_inp": [{"indic_ag": "HIGH", "unit": "PC_AREA"}],
        "aei_fm_ms": [{"indic_ag": "STORE", "unit": "NR"}],
    }
    out = []
    for name, cells in wanted.items():
        for geo in ("AA", "AA1", "AA11", "AA12"):
            for time in (2010.0, 2013.0):
                for cell in cells:
                    if geo == "AA12" and name == "ef_lus_main" and cell["crops"] == "WA":
                        continue
                    row = {**base, **cell}
                    out.append((name, geo, time, float(rng.randint(1, 50)), *[row.get(d) for d in dims]))
    schema = "dataset string, geo string, time double, values double, " + ", ".join(f"{d} string" for d in dims)
    return spark.createDataFrame(out, schema), out, dims


def test_all_recipes_on_a_small_cube(spark):
    cube, raw, dims = _stat_cube(spark)
    key = spark.createDataFrame(
        [(p, y, lv, code, 10.0 * (lv + 1)) for p, leaf in ((1, "AA11"), (2, "AA12"))
         for y in (2010, 2013) for lv, code in ((0, "AA"), (1, "AA1"), (2, leaf))],
        "point_id long, year int, level int, region_id string, area_km2 double",
    )
    wide = cov.build_covariates(lambda d: cube.where(F.col("dataset") == d).drop("dataset"), key, with_unused=True)
    got = {r["point_id"]: r.asDict() for r in wide.collect()}

    def mean(dataset, geo, **cell):
        vals = [r[3] for r in raw if r[0] == dataset and r[1] == geo
                and all(r[4 + dims.index(d)] == v for d, v in cell.items())]
        return sum(vals) / len(vals) if vals else None

    for p, leaf in ((1, "AA11"), (2, "AA12")):
        uaa = mean("ef_lus_main", leaf, crops="UAA")
        row = got[p]
        assert row["animalDens"] == pytest.approx(
            mean("ef_m_farmleg", leaf, indic_agr="FARM_LSU_LS", farmtype="TOTAL")
            / mean("ef_m_farmleg", leaf, indic_agr="UAA_HA", farmtype="TOTAL"))
        assert row["ARArelUAA"] == pytest.approx(mean("ef_lus_main", leaf, crops="ARA") / uaa * 100)
        # Wooded area is not published for AA12: the next level up stands in, over the same total.
        wa = mean("ef_lus_main", leaf, crops="WA") or mean("ef_lus_main", "AA1", crops="WA")
        assert row["WArelUAA"] == pytest.approx(wa / uaa * 100)
        ara = mean("ef_lus_allcrops", leaf, crops="ARA")
        assert row["XARAX"] == pytest.approx(mean("ef_lus_allcrops", leaf, crops="XARAX") / ara * 100)
        assert row["PECR"] == 100.0 and "ARA" not in row and "J0000" not in row
        assert row["A2000"] == pytest.approx(mean("ef_lsk_main", leaf, animals="A2000") / uaa)
        assert "A6000" not in row and "A0010" not in row
        assert row["IRR"] == pytest.approx(mean("ef_mp_irri", leaf, irr_area="IRR") / uaa * 100)
        assert row["PC1_24"] == pytest.approx(
            mean("ef_mp_soil", leaf, crop_rot="PC1-24") / mean("ef_mp_soil", leaf, crop_rot="TOTAL", soil_cov="ARA") * 100)
        assert row["PC50_74"] is None
        assert row["Nfert"] == pytest.approx(1000 * mean("aei_fm_usefert", leaf, nutrient="N") / uaa)
        assert row["KfertSale"] == pytest.approx(1000 * mean("aei_fm_manfert", leaf, nutrient="K") / uaa)
        assert row["HIGH"] == pytest.approx(mean("aei_ps_inp", leaf, indic_ag="HIGH"))
        assert row["STORE"] == pytest.approx(mean("aei_fm_ms", leaf, indic_ag="STORE") / 30.0)
        assert row["C1100yield"] == pytest.approx(mean("apro_cpshr", leaf, crops="C1100"))
        assert row["Fungicide"] == pytest.approx(mean("aei_fm_salpest09", leaf, pesticid="F") / uaa)


def test_monthly_medians(spark):
    from swardshift.plans.vegetation import monthly_medians

    rng = random.Random(1)
    many = [rng.random() for _ in range(301)]
    data = [(1, 3, v) for v in many] + [(1, 6, None), (1, 6, 1.0), (2, 9, 0.5), (2, 12, 0.7), (2, 12, 0.9), (3, 5, 0.4)]
    df = spark.createDataFrame(data, "point_id long, month int, ndvi double")
    got = rows(monthly_medians(df))
    assert got[0][1] == pytest.approx(sorted(many)[150]) and got[0][2] is None and got[0][5] is None
    assert got[1] == (2, None, None, 0.5, pytest.approx(0.8), 0.7)
    # A point seen in no listed month keeps its row and its overall median.
    assert got[2] == (3, None, None, None, None, 0.4)
    assert rows(monthly_medians(df, features={3: "m3", 6: "m6"}))[2] == (3, None, None)
