import numpy as np
import pandas as pd
import pytest

from swardshift.operators import forests as fo
from swardshift.operators.profile import regression_metrics
from swardshift.plans import transfer as tr
from swardshift.sources.tables import load_model, save_model

SMALL = {"trees": 15, "depth": 6}


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.default_rng(0)
    n = 500
    pdf = pd.DataFrame(
        {
            "point_id": range(n),
            "clay": rng.normal(size=n),
            "rain": rng.normal(size=n),
            "noise": rng.normal(size=n),
            "soil": rng.choice(["loam", "sand_fine", "peat"], n, p=[0.6, 0.37, 0.03]),
            "use": rng.choice(["Grassland", "Cropland"], n),
        }
    )
    pdf["obs"] = 3 * pdf.clay + pdf.rain + (pdf.soil == "loam") * 2 + rng.normal(size=n) * 0.2 - (pdf.use == "Cropland") * 4
    return spark.createDataFrame(pdf).cache()


NUM, TXT = ["clay", "rain", "noise"], ["soil"]


def test_forest_validation_and_importance(spark, sites, tmp_path):
    grass = sites.where("use = 'Grassland'")
    forest = fo.fit_forest(grass, "obs", NUM, TXT, **SMALL)
    r2 = regression_metrics(forest.predict(grass), "obs", "pred").first()["r2"]
    cv = fo.kfold_metrics(grass, "obs", NUM, TXT, "point_id", folds=3, **SMALL).first()["r2"]
    oob = fo.out_of_bag_predictions(grass, "obs", NUM, TXT, "point_id", bags=4, trees=12, depth=6)
    oob_r2 = regression_metrics(oob, "obs", "pred").first()["r2"]
    assert r2 > cv > 0.6 and oob_r2 > 0.5 and abs(oob_r2 - cv) < 0.25
    imp = {r["name"]: r["value"] for r in fo.permutation_importance(forest, grass, "point_id").collect()}
    assert set(imp) == {*NUM, *TXT}
    assert imp["clay"] > imp["rain"] > imp["noise"] and abs(imp["noise"]) < 0.1 * imp["clay"]
    again = {r["name"]: r["value"] for r in fo.permutation_importance(forest, grass.repartition(3), "point_id").collect()}
    assert again == pytest.approx(imp)
    loaded = load_model(save_model(forest.model, str(tmp_path / "m")))
    assert loaded.getNumTrees == forest.model.getNumTrees


def test_partial_dependence(spark, sites):
    grass = sites.where("use = 'Grassland'")
    forest = fo.fit_forest(grass, "obs", NUM, TXT, **SMALL)
    pd_ = fo.partial_dependence(forest, grass, ["clay", "soil"], 11).toPandas()
    clay = pd_[pd_.name == "clay"].sort_values("point")
    assert len(clay) == 11 and np.corrcoef(clay.value, clay.yhat)[0, 1] > 0.9
    lo, hi = grass.selectExpr("min(clay)", "max(clay)").first()
    assert clay.value.iloc[0] == lo and clay.value.iloc[-1] == pytest.approx(hi)
    soil = pd_[pd_.name == "soil"].set_index("level").yhat
    assert set(soil.index) >= {"loam", "sand_fine", "peat"} and soil["loam"] > soil["sand_fine"] + 0.5
    # Against predicting with the column overwritten row by row.
    from pyspark.sql import functions as F

    by_hand = forest.predict(grass.withColumn("soil", F.lit("loam"))).agg(F.avg("pred")).first()[0]
    assert soil["loam"] == pytest.approx(by_hand)


def test_transfer_finds_the_class_effect(spark, sites):
    t = tr.transfer_effects(sites, "obs", "use", "Grassland", "Cropland", NUM, TXT, **SMALL)
    pred = t.pred.toPandas()
    assert len(pred) == sites.count()
    assert pred[pred.split == "ref"].aoa.isna().all() and pred[pred.split == "treat"].aoa.notna().all()
    inside = pred[pred.aoa == 1]
    assert inside.effect.mean() == pytest.approx(4, abs=0.6)
    assert t.inside.selectExpr("sum(rel)").first()[0] == pytest.approx(1)
    assert tr.effect_rows(t.pred).count() == len(inside)
    forest, train = tr.explain_effects(t.pred, sites, NUM, TXT, **SMALL)
    assert train.count() == len(inside) and forest.target == "effect"
    rel = tr.transfer_effects(sites, "obs", "use", "Grassland", "Cropland", NUM, effect="Rel", importance={"clay": 1, "rain": 1, "noise": 0}, **SMALL)
    assert "effect" in rel.pred.columns


def test_levels_with_separators_get_their_weight(spark, sites):
    rows = tr.with_split(sites, "use", "Grassland", ["Grassland", "Cropland"])
    coded, source = tr.coded_for_distance(rows, NUM, TXT, "point_id")
    assert source == {"soil_Other": "soil", "soil_loam": "soil", "soil_sand_fine": "soil"}
    assert coded.selectExpr("min(soil_Other + soil_loam + soil_sand_fine)").first()[0] == 1


def test_partial_dependence_equals_predicting_each_grid_point(spark, sites):
    """One walk per row and tree against the whole table predicted again for every point, missing inputs left out."""
    from pyspark.sql import functions as F

    holes = sites.withColumn("clay", F.when(F.rand(3) > 0.1, F.col("clay")))
    forest = fo.fit_forest(holes, "obs", NUM, TXT, **SMALL)
    complete = holes.dropna(subset=[*NUM, *TXT])
    got = fo.partial_dependence(forest, holes, [*NUM, *TXT], 5).collect()
    assert len(got) == 5 * len(NUM) + sum(len(forest.levels(c)) for c in TXT)
    for r in got:
        value = F.lit(r["level"]) if r["level"] is not None else F.lit(r["value"])
        want = forest.predict(complete.withColumn(r["name"], value)).agg(F.avg("pred")).first()[0]
        assert r["yhat"] == pytest.approx(want), r


def test_partial_dependence_without_complete_rows(spark, sites):
    from pyspark.sql import functions as F

    forest = fo.fit_forest(sites, "obs", NUM, TXT, **SMALL)
    empty = fo.partial_dependence(forest, sites.withColumn("clay", F.lit(None).cast("double")), ["clay", "soil"], 5)
    assert empty.columns == ["name", "point", "value", "level", "yhat"] and empty.isEmpty()


def test_trees_do_not_walk_from_the_root_at_each_level(spark):
    df = spark.createDataFrame([(float(i % 7), float(i)) for i in range(60)], "x double, y double")
    assert fo.fit_forest(df, "y", ["x"], trees=2, depth=3).model.getCacheNodeIds()


def test_model_quality_joins_its_table_once(spark, monkeypatch):
    """What the fits, the ranking and the metrics read is a written table, not the join."""
    from verification import models

    class Seen(Exception):
        pass

    def fit(rows, *_, **__):
        raise Seen(rows.inputFiles())

    joined = spark.createDataFrame([(1, 2.0)], "o_orderkey long, price double")
    monkeypatch.setattr(models, "order_table", lambda *_: joined)
    monkeypatch.setattr(models, "fit_forest", fit)
    with pytest.raises(Seen) as seen:
        models.model_quality(spark, "nowhere")
    assert seen.value.args[0]
