"""Forests and the transfer between classes.

Large forests differ between libraries and carry no SQL. A single tree of one
split without sampling does not: SQL finds the same best split, so the stumps
below hold fitting, prediction, cross-validation, importance, partial
dependence and transfer to exact values.
"""

import uuid

from pyspark.sql import functions as F

from swardshift.operators.density import kde_table
from swardshift.operators.forests import (
    Forest,
    fit_forest,
    held_out_importance,
    kfold_metrics,
    kfold_predictions,
    out_of_bag_predictions,
    partial_dependence,
    permutation_importance,
)
from swardshift.operators.profile import regression_metrics
from swardshift.plans.transfer import effect_rows, explain_effects, transfer_direction, transfer_effects
from swardshift.session import cut_lineage
from swardshift.stages import shared_folder
from swardshift.operators.bootstrap import bootstrap_mean_ci

from .registry import query, r, table

NUMERIC = ["quantity", "discount", "tax", "lines"]
TEXT = ["priority"]
# Small forests keep the check short; every row of the tables takes part.
SIZE = {"trees": 12, "depth": 8}


def order_table(spark, sf):
    """One row per order: its price, what drives it, and a class to transfer between."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("price"),
        F.sum("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
        F.count(F.lit(1)).cast("double").alias("lines"),
    )
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "Grassland").otherwise("Cropland").alias("use"),
    )
    return lines.join(orders, "o_orderkey")


@query("rf_predict")
def rf_predict(spark, sf):
    rows = order_table(spark, sf)
    forest = fit_forest(rows, "price", NUMERIC, TEXT, **SIZE)
    return forest.predict(rows).select("o_orderkey", "price", "pred")


@query("kfold")
def kfold(spark, sf):
    return kfold_metrics(order_table(spark, sf), "price", NUMERIC, TEXT, "o_orderkey", folds=5, **SIZE)


@query("out_of_bag")
def out_of_bag(spark, sf):
    oob = out_of_bag_predictions(
        order_table(spark, sf), "price", NUMERIC, TEXT, "o_orderkey", bags=4, trees=12, depth=8
    )
    return regression_metrics(oob, "obs", "pred")


@query("perm_importance")
def perm_importance(spark, sf):
    rows = order_table(spark, sf)
    return permutation_importance(fit_forest(rows, "price", NUMERIC, TEXT, **SIZE), rows, "o_orderkey")


@query("partial_dependence")
def pdp(spark, sf):
    rows = order_table(spark, sf)
    return partial_dependence(fit_forest(rows, "price", NUMERIC, TEXT, **SIZE), rows, ["quantity", "priority"], 51)


def _transfer(spark, sf):
    return transfer_effects(
        order_table(spark, sf), "price", "use", "Grassland", "Cropland", NUMERIC, TEXT, "o_orderkey", **SIZE
    )


@query("transfer_effects")
def transfer(spark, sf):
    return _transfer(spark, sf).pred


@query("transfer_inside_share")
def inside_share(spark, sf):
    return _transfer(spark, sf).inside


@query("transfer_mean_effect")
def mean_effect(spark, sf):
    return bootstrap_mean_ci(effect_rows(_transfer(spark, sf).pred), "effect", "o_orderkey", replicates=10_000)


@query("explain_effects")
def explain(spark, sf):
    rows = order_table(spark, sf)
    pred = _transfer(spark, sf).pred
    forest, train = explain_effects(pred, rows.withColumnRenamed("price", "obs"), [*NUMERIC, "obs"], TEXT,
                                    "o_orderkey", **SIZE)
    return permutation_importance(forest, train, "o_orderkey")


@query("effect_density")
def effect_density(spark, sf):
    pred = _transfer(spark, sf).pred.where("split = 'treat'")
    return kde_table(pred, "effect", ["aoa"], 512)


# Rows, split and bounds of a transfer are fixed whatever the trees look like.
TRANSFER_SQL = """
lines as (select l_orderkey as o_orderkey, sum(l_extendedprice) as price from lineitem group by 1),
t as (select o_orderkey, price, case when o_orderstatus = 'F' then 'ref' else 'treat' end as split
      from lines join orders using (o_orderkey))
"""


@query(
    "transfer_rows",
    f"""with {TRANSFER_SQL} select o_orderkey, split, round(price, 2) as obs, true as within_reference,
        true as effect_is_difference, split = 'treat' as judged from t""",
)
def transfer_rows(spark, sf):
    """Forest predictions average reference values, so they never leave their range."""
    pred = _transfer(spark, sf).pred
    span = pred.where("split = 'ref'").agg(F.min("obs").alias("lo"), F.max("obs").alias("hi")).first()
    return pred.select(
        "o_orderkey", "split", r("obs", 2).alias("obs"),
        F.col("pred").between(span["lo"] - 1e-6, span["hi"] + 1e-6).alias("within_reference"),
        (F.abs(F.col("effect") - (F.col("pred") - F.col("obs"))) < 1e-9).alias("effect_is_difference"),
        F.col("aoa").isNotNull().alias("judged"),
    )


@query(
    "kfold_rows",
    f"""with {TRANSFER_SQL} select o_orderkey, round(price, 2) as obs, true as predicted from t""",
)
def kfold_rows(spark, sf):
    """Every row is held out exactly once."""
    from swardshift.operators.forests import kfold_predictions

    cv = kfold_predictions(order_table(spark, sf), "price", NUMERIC, TEXT, "o_orderkey", folds=5, **SIZE)
    return cv.select("o_orderkey", r("obs", 2).alias("obs"), F.col("pred").isNotNull().alias("predicted"))


@query(
    "model_quality",
    """select 'fit' as what, true as explains, true as quantity_first
       union all select 'held out', true, true""",
)
def model_quality(spark, sf):
    """Price follows quantity: the forest explains most of it and ranks quantity first."""
    # Read by the fits, the ranking and the metrics: joined once.
    rows = cut_lineage(order_table(spark, sf))
    forest = fit_forest(rows, "price", NUMERIC, TEXT, **SIZE)
    top = permutation_importance(forest, rows, "o_orderkey").orderBy(F.desc("value")).first()["name"]
    fit = regression_metrics(forest.predict(rows), "price", "pred").select(F.lit("fit").alias("what"), "r2")
    held = kfold_metrics(rows, "price", NUMERIC, TEXT, "o_orderkey", folds=5, **SIZE).select(
        F.lit("held out").alias("what"), "r2"
    )
    return fit.unionByName(held).select(
        "what", (F.col("r2") > 0.5).alias("explains"), F.lit(top in ("quantity", "lines")).alias("quantity_first")
    )


@query(
    "partial_dependence_grid",
    """with lines as (select l_orderkey, sum(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey
         group by 1),
       s as (select min(q) as lo, max(q) as hi from lines)
    select 'quantity' as name, point::integer as point, round(lo + (hi - lo) * point / 50, 6) as value,
      cast(null as varchar) as level from s, range(51) g(point)
    union all select 'priority', null, null, o_orderpriority from orders
      where o_orderkey in (select l_orderkey from lineitem) group by o_orderpriority""",
)
def partial_dependence_grid(spark, sf):
    table_ = pdp(spark, sf)
    numbered = F.when(F.col("level").isNull(), F.col("point"))
    return table_.select("name", numbered.alias("point"), r("value").alias("value"), "level")


STUMP = {"trees": 1, "depth": 1, "mtry": 3, "bootstrap": False}
COARSE = ["disc", "lines", "qty"]
COARSE_SQL = """
t as (select o_orderkey, price, lines, qty, disc, case when o_orderstatus = 'F' then 'Grassland' else 'Cropland' end as use
  from (select l_orderkey as o_orderkey, sum(l_extendedprice) as price, count(*)::double as lines,
          floor(sum(l_quantity) / 20) as qty, round(max(l_discount) * 100) as disc from lineitem group by 1)
  join orders using (o_orderkey))
"""


def stump_sql(rows: str) -> str:
    """``best``: the split of one feature with the least squared error, and the means on its sides, per ``g`` of ``rows``."""
    return f"""
    long as (select g, unnest(['disc', 'lines', 'qty']) as f, unnest([disc, lines, qty]) as v, price from ({rows})),
    st as (select g, f, v, count(*) as n, sum(price) as s from long group by all),
    cum as (select g, f, v, sum(n) over w as nl, sum(s) over w as sl, sum(n) over (partition by g, f) as nt,
        sum(s) over (partition by g, f) as tot, lead(v) over (partition by g, f order by v) as nv
      from st window w as (partition by g, f order by v)),
    best as (select g, f, (v + nv) / 2 as cut, sl / nl as pl, (tot - sl) / (nt - nl) as pr from cum
      where nv is not null and nl >= 5 and nt - nl >= 5
      qualify row_number() over (partition by g order by sl * sl / nl + (tot - sl) * (tot - sl) / (nt - nl) desc, f) = 1)
    """


SPLIT = "case when (case f when 'disc' then {d} when 'lines' then {l} else {q} end) <= cut then pl else pr end"
PREDICT = SPLIT.format(d="t.disc", l="t.lines", q="t.qty")


def coarse_table(spark, sf):
    """One row per order with inputs of few distinct values."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("price"), F.count(F.lit(1)).cast("double").alias("lines"),
        F.floor(F.sum("l_quantity") / 20).cast("double").alias("qty"), F.round(F.max("l_discount") * 100).alias("disc"),
    )
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "Grassland").otherwise("Cropland").alias("use"))
    return lines.join(orders, "o_orderkey")


@query(
    "stump_predict",
    f"""with {COARSE_SQL}, {stump_sql("select 0 as g, * from t")}
    select o_orderkey, round({PREDICT}, 4) as pred from t, best""",
)
def stump_predict(spark, sf):
    """Fitted, saved, loaded, and then predicted with."""
    rows = coarse_table(spark, sf)
    path = fit_forest(rows, "price", COARSE, **STUMP).save(f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}")
    return Forest.load(path).predict(rows).select("o_orderkey", r("pred", 4).alias("pred"))


FOLD_SQL = "(('0x' || substr(md5('fold 123:' || o_orderkey), 1, 8))::bigint % 5)::integer"


@query(
    "stump_kfold",
    f"""with {COARSE_SQL}, m as (select *, {FOLD_SQL} as fold from t),
    {stump_sql("select k as g, m.* from m, range(5) r(k) where fold <> k")}
    select o_orderkey, fold, round({PREDICT}, 4) as pred from m t join best on g = fold""",
)
def stump_kfold(spark, sf):
    cv = kfold_predictions(coarse_table(spark, sf), "price", COARSE, [], "o_orderkey", **STUMP)
    return cv.select("o_orderkey", "fold", r("pred", 4).alias("pred"))


@query(
    "stump_importance",
    f"""with {COARSE_SQL}, {stump_sql("select 0 as g, * from t")},
    m as (select *, row_number() over (order by md5('deal 123:' || o_orderkey), o_orderkey) as i, count(*) over () as n from t),
    p as (select a.price, {SPLIT.format(d="a.disc", l="a.lines", q="a.qty")} as own,
        {SPLIT.format(d="b.disc", l="b.lines", q="b.qty")} as dealt, best.f
      from m a join m b on b.i = case when a.i = a.n then 1 else a.i + 1 end, best),
    e as (select f, avg((dealt - price) * (dealt - price)) - avg((own - price) * (own - price)) as rise from p group by f)
    select name, round(coalesce(rise, 0) / 1e6, 3) + 0.0 as rise from (values ('disc'), ('lines'), ('qty')) v(name) left join e on f = name""",
)
def stump_importance(spark, sf):
    rows = coarse_table(spark, sf)
    scores = permutation_importance(fit_forest(rows, "price", COARSE, **STUMP), rows, "o_orderkey")
    return scores.select("name", (F.round(F.col("value") / 1e6, 3) + F.lit(0.0)).alias("rise"))


@query(
    "stump_dependence",
    f"""with {COARSE_SQL}, {stump_sql("select 0 as g, * from t")},
    span as (select f as name, min(v) as lo, max(v) as hi from long group by f),
    grid as (select name, point::integer as point, lo + (hi - lo) * point / 50 as value from span, range(51) r(point)),
    means as (select avg({PREDICT}) as mean from t, best)
    select name, point, round(value, 6) as value, round(case when name <> f then mean when value <= cut then pl else pr end, 3) as yhat
    from grid, best, means""",
)
def stump_dependence(spark, sf):
    rows = coarse_table(spark, sf)
    pd = partial_dependence(fit_forest(rows, "price", COARSE, **STUMP), rows, COARSE)
    return pd.select("name", F.col("point").cast("int").alias("point"), r("value").alias("value"), r("yhat", 3).alias("yhat"))


@query(
    "stump_transfer",
    f"""with {COARSE_SQL}, {stump_sql("select 0 as g, * from t where use = 'Cropland'")}
    select o_orderkey, case when use = 'Cropland' then 'ref' else 'treat' end as split, round({PREDICT}, 4) as pred,
      round({PREDICT} - price, 3) + 0.0 as effect from t, best""",
)
def stump_transfer(spark, sf):
    """Trained on the class that the direction names, applied to both."""
    found = transfer_direction(
        coarse_table(spark, sf), "price", "use", "grassToCrop", COARSE, [], "o_orderkey",
        importance={c: 1.0 for c in COARSE}, **STUMP,
    )
    return found.pred.select("o_orderkey", "split", r("pred", 4).alias("pred"), r("effect", 3).alias("effect"))


@query("held_out_importance")
def importance_on_unseen_rows(spark, sf):
    return held_out_importance(order_table(spark, sf), "price", NUMERIC, TEXT, "o_orderkey", bags=4, trees=12, depth=8)
