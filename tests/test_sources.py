import pytest
from conftest import rows
from pyspark.sql import functions as F

from swardshift.operators import columns as cl
from swardshift.plans import catalogue as ct
from swardshift.plans import survey as sv
from swardshift.sources import tables as tb


def test_names():
    assert tb.repair_names(["pH(CaCl2)", "PC1-24", "x", "x"]) == ["pH.CaCl2.", "PC1.24", "x...3", "x...4"]
    assert tb.repair_names(["pH(CaCl2)", "PC1-24", "9a"], "_") == ["pH_CaCl2_", "PC1_24", "_9a"]


def test_sheets_and_stages(spark, tmp_path):
    (tmp_path / "s.csv").write_text("POINT_ID,pH(CaCl2)\n1,4.5\nabc,NaN\n")
    df = tb.read_sheet(spark, str(tmp_path / "s.csv"), "POINT_ID string, `pH(CaCl2)` double")
    assert df.columns == ["POINT_ID", "pH_CaCl2_"] and df.count() == 2
    path = tb.write_stage(df, str(tmp_path / "stage"))
    assert tb.read_stage(spark, path).count() == 2


def test_cube_filters_reach_the_scan(spark, tmp_path):
    data = [("d1", "DE", 2010.0, 1.0, "HA", "UAA"), ("d1", "DE", 2010.0, 2.0, "PC", "UAA"), ("d2", "FR", 2010.0, 3.0, "HA", "ARA")]
    cube = spark.createDataFrame(data, "dataset string, geo string, time double, values double, unit string, crops string")
    path = tb.write_stage(cube, str(tmp_path / "cube"), ["dataset"])
    got = tb.read_cube(spark, path, "d1", {"unit": "HA", "crops": ["UAA", "ARA"]})
    assert sorted(got.columns) == ["crops", "geo", "time", "values"] and got.count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and "EqualTo(unit,HA)" in plan


def test_dictionary_versions(spark, tmp_path):
    root = str(tmp_path / "dict")
    first = spark.createDataFrame([("a", 1)], "name string, modelEffect int")
    tb.write_dictionary(first, root, 1)
    tb.write_dictionary(tb.read_dictionary(spark, root).withColumn("modelEffect", F.lit(0)), root, 2)
    assert rows(tb.read_dictionary(spark, root)) == [("a", 0)]


def test_column_selection(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "id long, s string, ndvi13 double")
    with pytest.warns(UserWarning):
        assert cl.select_known(df, ["id", "nope"]).columns == ["id"]
    assert cl.add_prefix(df, "ndvi", "partner_").columns == ["id", "s", "partner_ndvi13"]
    assert cl.select_where(df, cl.is_text).columns == ["s"]
    d = spark.createDataFrame([("id", None, 1), ("s", "soil", 1), ("ndvi13", "0info", 1)], "name string, class0 string, modelEffect int")
    assert cl.select_by_dictionary(df, d, "class0 != '0info' and modelEffect = 1").columns == ["s"]


def test_dictionary_rules_in_order(spark):
    screened = spark.createDataFrame(
        [("BIO1", 0), ("BIO5", 0), ("N0000T", 0), ("id", 0), ("hole", 1), ("ok", 0), ("first", 1)], "name string, drop_na int"
    ).selectExpr("*", "'numeric' type", "0L na", "0D mean", "0D min", "0D max", "0L nlevs")
    hand = spark.createDataFrame(
        [("id", "0info", None, 1), ("ok", "soil", None, 1), ("first", "soil", 1, 0), ("hole", "soil", 0, 1), ("BIO5", "clim", None, None)],
        "name string, class0 string, modelSOC int, modelEffect int",
    ).selectExpr("*", "name nameFull", "'u' unit", "'' class1", "'' class2", "'' source")
    out = {r["name"]: r["modelEffect"] for r in ct.update_dictionary(ct.drop_flags(screened), hand).collect()}
    assert out == {"BIO1": 0, "BIO5": None, "N0000T": 0, "id": 0, "hole": 0, "ok": 1, "first": 1}
    df = spark.createDataFrame([(1.0, None, 3.0), (1.0, 2.0, 3.0)], "ok double, first double, OCstock double")
    d = spark.createDataFrame([("ok", 1), ("first", 1)], "name string, modelEffect int")
    assert rows(ct.model_table(df, d, "OCstock")) == [(1.0, 2.0, 3.0)]


def test_survey_from_waves_to_usable_sites(spark):
    soil = spark.createDataFrame(
        [
            (1, None, 30.0, 40.0, 10.0, 1.9, 2.0, 10.0, 20.0, 10.0, 6.0, 6.5),
            (2, None, None, 40.0, None, 2.0, 0.1, 10.0, 20.0, 10.0, 6.0, 6.5),
            (3, None, 30.0, 40.0, 10.0, 30.0, 2.0, 10.0, 20.0, 80.0, 6.0, 6.5),
            (4, 25.0, 30.0, 40.0, 10.0, 40.0, 2.0, 10.0, 20.0, 10.0, 6.0, 6.5),
        ],
        "Point_ID long, Clay double, Silt double, Sand double, Coarse double, OC double, N double, P double, K double, "
        "CaCO3 double, pH_CaCl2_ double, pH_H2O_ double",
    )
    w09 = spark.createDataFrame([("1", "n/a", 11.0, 12.0, 13.0), ("2", "5", 21.0, 22.0, 23.0), ("x", "1", 1.0, 1.0, 1.0)],
                                "POINT_ID string, coarse string, clay double, silt double, sand double")
    bg = spark.createDataFrame([("1", -999.0, 14.0, 15.0, 16.0)], "POINT_ID string, coarse double, clay double, silt double, sand double")
    ro = spark.createDataFrame([("2", 6.0, -999.0, 25.0, 26.0)], "POINT_ID string, coarse double, clay double, silt double, sand double")
    merged = sv.combine_waves(soil, w09, [bg, ro])
    got = {r["Point_ID"]: r for r in merged.collect()}
    assert got[1]["Clay"] is None            # both waves present: contradiction
    assert got[2]["Clay"] == 21.0            # 2012 holds the missing code
    assert got[2]["Silt"] is None and got[2]["Coarse"] is None
    assert got[4]["Clay"] == 25.0
    anc = spark.createDataFrame(
        [(1, 9.0, None, "s1", None, "Alpine Bio-geographical Region"), (2, 9.0, 3.0, None, None, "Steppic"), (4, 9.0, 3.0, None, "s2", None)],
        "POI long, Elevation double, Aspect double, Natura2000_sitecode1 string, Natura2000_sitecode2 string, BioGeo string",
    )
    pts = spark.createDataFrame([(i, 1.0 * i, 50.0, "B1", "U1", "Cropland" if i < 4 else "Woodland") for i in (1, 2, 3, 4)],
                                "Point_ID long, lon double, lat double, LC string, LU string, LC0_Desc string")
    man = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "POINT_ID long, WM int")
    out = sv.derive_measures(sv.attach_site_data(merged, anc, pts, man))
    got = {r["Point_ID"]: r for r in out.collect()}
    assert got[1]["OC"] is None and got[2]["OC"] == 0.2          # the limit holds after the change of unit
    assert got[2]["N"] is None and got[2]["CN"] is None
    assert got[1]["Aspect"] == 0.0 and got[1]["BioGeo"] == "Alpine" and got[1]["natura"] == "yes"
    assert got[2]["natura"] == "no" and got[4]["natura"] == "yes" and got[3]["natura"] == "no"
    assert [got[i]["WM"] for i in (1, 2, 3, 4)] == ["Irrigation", "not relevant", "not relevant", None]
    r = got[4]
    bd = 0.80806 + 0.823844 * 2.718281828459045 ** (-0.27993 * 4) + 0.0014065 * 40 - 0.0010299 * 25
    assert r["OCstock"] == pytest.approx(4 * bd * 20 * 0.9) and r["pH_H2O"] == 6.5
    assert [r["Point_ID"] for r in sv.usable_sites(out).collect()] == [2]
