"""Profiles, correlation screening, densities, applicability and the variable catalogue."""

from pyspark.sql import functions as F

from swardshift.operators.applicability import area_of_applicability, train_distances
from swardshift.operators.bootstrap import bootstrap_mean_ci
from swardshift.operators.correlate import collinear_pairs, component_table, correlation_table, rotated_loadings, spearman_pairs
from swardshift.operators.density import histogram_by_breaks, kde_table, natural_breaks
from swardshift.operators.profile import (
    missing_screen,
    profile_columns,
    regression_metrics,
    scale_parameters,
    standardize,
)
from swardshift.functions.measures import interval_index, round_breaks
from swardshift.operators.reshape import gather
from swardshift.plans.catalogue import (
    drop_flags,
    importance_table,
    panel_pages,
    section_ranges,
    update_dictionary,
    variable_table,
)
from swardshift.session import cut_lineage

from .registry import query, r, rounded, table

HOLED_SQL = """
holed as (select case when c_acctbal < 0 then null else c_acctbal end as balance, c_nationkey::double as nation,
  case when c_acctbal > 9950 then null else c_custkey::double end as number,
  case when c_mktsegment = 'BUILDING' then null else c_mktsegment end as segment from customer)
"""
NUMERIC = ["balance", "nation", "number"]


def holed(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
        F.when(F.col("c_acctbal") <= 9950, F.col("c_custkey").cast("double")).alias("number"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
    )


PROFILE_SQL = "p as (" + " union all ".join(
    f"""select '{c}' as name, 'numeric' as type, (count(*) - count({c}))::bigint as na, avg({c}) as mean,
    stddev_samp({c}) as disp, min({c}) as min, max({c}) as max, 0::bigint as nlevs, median({c}) as median,
    1.4826 * mad({c}) as mad from holed"""
    for c in NUMERIC
) + """ union all select 'segment', 'character', (select count(*) - count(segment) from holed)::bigint, null,
    1 - max(n) / sum(n), min(n)::double, max(n)::double, count(*)::bigint, null, null
    from (select segment, count(*) as n from holed where segment is not null group by 1))"""
SHOWN = ["mean", "disp", "min", "max", "median", "mad"]


@query(
    "profile",
    f"""with {HOLED_SQL}, {PROFILE_SQL}
    select name, type, na, nlevs, {", ".join(f"round({c}, 4) as {c}" for c in SHOWN)} from p""",
)
def profile(spark, sf):
    return rounded(profile_columns(holed(spark, sf), robust=True), *SHOWN, digits=4)


@query(
    "missing_screen",
    f"""with {HOLED_SQL}, {PROFILE_SQL}
    select name, na, (na > 0.01 * (select count(*) from customer))::integer as drop_na from p""",
)
def screen(spark, sf):
    h = holed(spark, sf)
    return missing_screen(profile_columns(h), h.count()).select("name", "na", "drop_na")


ORDER_SQL = """
measures as (select l_orderkey as id, sum(l_quantity) as quantity, sum(l_extendedprice) as price,
  case when max(l_tax) = 0.08 then null else avg(l_discount) end as discount,
  case when count(*) > 7 then null else count(*)::double end as lines from lineitem group by 1)
"""
MEASURES = ["quantity", "price", "discount", "lines"]


def order_measures(spark, sf):
    n = F.count(F.lit(1))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("price"),
        F.when(F.max("l_tax") != 0.08, F.avg("l_discount")).alias("discount"),
        F.when(n <= 7, n.cast("double")).alias("lines"),
    )


def _spearman_sql():
    pairs = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]]
    # Discounts are means of few values, so equal ones can differ in the last bit: compare at 9 digits.
    parts = [
        f"""select '{a}' as var1, '{b}' as var2, count(*)::bigint as n, corr(ra, rb) as rho from (
        select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra,
               rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb
        from (select round({a}, 9) as a, round({b}, 9) as b from measures
              where {a} is not null and {b} is not null))"""
        for a, b in pairs
    ]
    return f"with {ORDER_SQL}, s as ({' union all '.join(parts)})"


def spearman(spark, sf):
    m = rounded(order_measures(spark, sf), *MEASURES, digits=9)
    return spearman_pairs(cut_lineage(m), ["id"], MEASURES)


@query("spearman_pairs", _spearman_sql() + " select var1, var2, n, round(rho, 6) as rho from s")
def spearman_query(spark, sf):
    return spearman(spark, sf).withColumn("rho", r("rho"))


@query(
    "collinear_pairs",
    _spearman_sql() + " select var1, var2, round(rho, 2) as rho from s where abs(round(rho, 2)) > 0.8",
)
def collinear(spark, sf):
    return collinear_pairs(spearman(spark, sf)).select("var1", "var2", "rho")


@query(
    "standardize",
    f"""with {ORDER_SQL}, p as (select {", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in MEASURES)}
         from measures)
    select id, {", ".join(f"round(coalesce(({c} - m_{c}) / s_{c}, 0), 6) as {c}" for c in MEASURES)} from measures, p""",
)
def standardized(spark, sf):
    m = order_measures(spark, sf)
    return rounded(standardize(m, MEASURES, scale_parameters(m, MEASURES)), *MEASURES)


@query(
    "regression_metrics",
    """with v as (select l_returnflag, l_extendedprice as obs, l_quantity * 1500 as pred from lineitem)
    select l_returnflag, round(sqrt(avg((pred - obs) ** 2)), 4) as rmse,
      round(1 - sum((pred - obs) ** 2) / (var_pop(obs) * count(*)), 6) as r2, round(avg(obs) - avg(pred), 4) as bias
    from v group by 1""",
)
def metrics(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("obs"), (F.col("l_quantity") * 1500).alias("pred")
    )
    out = regression_metrics(li, "obs", "pred", ["l_returnflag"])
    return out.select("l_returnflag", r("rmse", 4).alias("rmse"), r("r2").alias("r2"), r("bias", 4).alias("bias"))


KDE_POINTS = 64
KDE_SHAPE = """
shape as (select event_type, count(*) as n, min(value) as lo, max(value) as hi, median(value) as med,
  0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34)
    * pow(count(*), -0.2) as bw from events group by 1)
"""
KDE_TAIL = f"""
grid as (select event_type, point, lo + point * ((hi - lo) / {KDE_POINTS - 1}) as x, n, bw, med
  from shape, range({KDE_POINTS}) t(point))
select event_type, point::integer as point, round(any_value(x), 6) as x, round(any_value(med), 6) as median,
  round(sum(w * exp(-0.5 * pow((x - v) / bw, 2)) / (n * bw * sqrt(2 * pi()))), 8) as density
from grid join mass using (event_type) group by event_type, point
"""


@query(
    "kde_table",
    f"with {KDE_SHAPE}, mass as (select event_type, value as v, count(*) as w from events group by all), {KDE_TAIL}",
)
def kde(spark, sf):
    out = kde_table(table(spark, sf, "events"), "value", ["event_type"], KDE_POINTS, bins=None)
    return rounded(rounded(out, "x", "median"), "density", digits=8)


@query(
    "kde_binned",
    f"""with {KDE_SHAPE}, b as (select event_type, lo, (hi - lo) / 255 as width, (value - lo) / ((hi - lo) / 255) as p
         from events join shape using (event_type)),
       f as (select *, least(floor(p), 254) as l from b),
       mass as (select event_type, any_value(lo) + bin * any_value(width) as v, sum(w) as w from (
         select event_type, lo, width, l as bin, 1 - (p - l) as w from f
         union all select event_type, lo, width, l + 1, p - l from f) group by event_type, bin), {KDE_TAIL}""",
)
def kde_binned(spark, sf):
    out = kde_table(table(spark, sf, "events"), "value", ["event_type"], KDE_POINTS, bins=256)
    return rounded(rounded(out, "x", "median"), "density", digits=8)


@query(
    "histogram_breaks",
    """select event_type, case when value < 1 then 0 when value < 5 then 1 when value < 20 then 2 when value < 100 then 3
         else 4 end as bin, count(*)::bigint as n from events where value between 0 and 500 group by all""",
)
def histogram(spark, sf):
    return histogram_by_breaks(table(spark, sf, "events"), "value", [0, 1, 5, 20, 100, 500], ["event_type"])


@query("natural_breaks")
def jenks(spark, sf):
    """Breaks, their rounded labels and the rows in each class."""
    prices = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    breaks = natural_breaks(prices, "p_retailprice", 5)
    labels = round_breaks(breaks)
    rows = prices.groupBy(interval_index("p_retailprice", breaks).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("lowest"), F.max("p_retailprice").alias("highest")
    )
    label = F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("class") + 1)
    return rows.withColumn("label", label)


@query(
    "pca_components",
    f"""with {ORDER_SQL}, c as (select corr(quantity, price) as r12 from measures
        where quantity is not null and price is not null)
    select 1::integer as component, round(1 + abs(r12), 6) as eigenvalue, round((1 + abs(r12)) / 2, 6) as share,
      (1 + abs(r12)) > 1 as kept from c
    union all select 2, round(1 - abs(r12), 6), round((1 - abs(r12)) / 2, 6), (1 - abs(r12)) > 1 from c""",
)
def pca_two(spark, sf):
    """Two columns, for which the eigenvalues are one plus and minus the correlation."""
    t = component_table(order_measures(spark, sf), ["quantity", "price"])
    return t.select("component", r("eigenvalue").alias("eigenvalue"), r("share").alias("share"), "kept")


@query("pca_varimax")
def pca_varimax(spark, sf):
    return rotated_loadings(order_measures(spark, sf), MEASURES, 2)


@query(
    "loading_communalities",
    """select 'quantity' as variable, 1.0::double as communality union all select 'price', 1.0
       union all select 'discount', 1.0 union all select 'lines', 1.0""",
)
def communalities(spark, sf):
    """Rotating all components leaves each variable's variance whole."""
    load = rotated_loadings(order_measures(spark, sf), MEASURES, len(MEASURES), cutoff=0.0)
    return load.groupBy("variable").agg(r(F.sum(F.col("loading") * F.col("loading"))).alias("communality"))


@query(
    "natural_break_ends",
    """select min(p_retailprice) as lowest, max(p_retailprice) as highest, count(*)::bigint as n, 5::bigint as classes
       from part""",
)
def break_ends(spark, sf):
    """The classes cover all rows between the smallest and the largest value."""
    return jenks(spark, sf).agg(
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("classes"),
    )


AOA_DIMS = 64


def _aoa_sql(cluster: bool):
    away = "and a.cl <> b.cl" if cluster else ""
    return f"""with long as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x
        from embeddings),
    p as (select i, avg(x) as m, stddev_samp(x) as s from long where label % 2 = 0 group by 1),
    z as (select vec_id, label % 2 as odd, label as cl, list((x - m) / s * (1.0 / i) order by i) as v
          from long join p using (i) group by all),
    tt as (select a.vec_id, avg(list_distance(a.v, b.v)) as mean_d, min(list_distance(a.v, b.v)) as min_d
           from z a join z b on a.odd = 0 and b.odd = 0 and a.vec_id <> b.vec_id {away} group by 1),
    scale as (select avg(mean_d) as m, quantile_cont(min_d / (select avg(mean_d) from tt), 0.95) as q from tt),
    nn as (select a.vec_id, min(list_distance(a.v, b.v)) as d from z a join z b on a.odd = 1 and b.odd = 0 group by 1)
    select vec_id, round(d / m, 6) as di, case when d / m > q then 0 else 1 end as aoa from nn, scale"""


def _aoa_frames(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(AOA_DIMS)]
    )
    weights = {f"e{i}": 1.0 / (i + 1) for i in range(AOA_DIMS)}
    return e.where("label % 2 = 1"), e.where("label % 2 = 0"), weights


@query("area_of_applicability", _aoa_sql(False))
def aoa(spark, sf):
    new, train, weights = _aoa_frames(spark, sf)
    out = area_of_applicability(new, train, weights, "vec_id")
    return out.withColumn("di", r("di"))


@query("area_of_applicability_clustered", _aoa_sql(True))
def aoa_clustered(spark, sf):
    new, train, weights = _aoa_frames(spark, sf)
    out = area_of_applicability(new, train, weights, "vec_id", cluster="label")
    return out.withColumn("di", r("di"))


@query(
    "train_distances",
    """select a.vec_id as id, round(avg(list_distance(a.embedding, b.embedding)), 4) as mean_dist,
         round(min(list_distance(a.embedding, b.embedding)), 4) as min_dist
       from (select vec_id, embedding::double[] as embedding from embeddings) a
       join (select vec_id, embedding::double[] as embedding from embeddings) b on a.vec_id <> b.vec_id group by 1""",
)
def pairwise(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    e = cut_lineage(e)
    return rounded(train_distances(e, e.count()), "mean_dist", "min_dist", digits=4)


HOT_COLUMNS = {"priority": [f"o_orderpriority = '{p}'" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")],
               "nation": [f"c_nationkey = {k}" for k in range(25)], "segment": [f"c_mktsegment = '{m}'" for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]}
HOT_WEIGHTS = {"total": 2.0, "balance": 1.0} | {f"{c}_{k}": 0.5 / (1 + i) for i, (c, tests) in enumerate(HOT_COLUMNS.items()) for k in range(len(tests))}
HOT_TESTS = [f"case when {t} then 1.0 else 0.0 end" for tests in HOT_COLUMNS.values() for t in tests]


def _hot_sql() -> str:
    columns = ["o_totalprice", "c_acctbal", *HOT_TESTS]
    scale = ", ".join(f"avg(({c})::double) filter (o_orderstatus = 'F') as m{i}, stddev_samp(({c})::double) filter (o_orderstatus = 'F') as s{i}" for i, c in enumerate(columns))
    vector = ", ".join(f"coalesce((({c})::double - m{i}) / nullif(s{i}, 0), 0) * {w}" for i, (c, w) in enumerate(zip(columns, HOT_WEIGHTS.values())))
    return f"""with base as (select * from orders join customer on c_custkey = o_custkey), p as (select {scale} from base),
    z as materialized (select o_orderkey, o_orderstatus as st, [{vector}] as v from base, p),
    tt as (select a.o_orderkey, avg(list_distance(a.v, b.v)) as mean_d, min(list_distance(a.v, b.v)) as min_d
           from z a join z b on a.st = 'F' and b.st = 'F' and a.o_orderkey <> b.o_orderkey group by 1),
    scale as (select avg(mean_d) as m, quantile_cont(min_d / (select avg(mean_d) from tt), 0.95) as q from tt),
    nn as (select a.o_orderkey, min(list_distance(a.v, b.v)) as d from z a join z b on a.st <> 'F' and b.st = 'F' group by 1)
    select o_orderkey, round(d / m, 6) as di, case when d / m > q then 0 else 1 end as aoa from nn, scale"""


@query("area_of_applicability_one_hot", _hot_sql())
def aoa_one_hot(spark, sf):
    """Two measures beside 35 columns of 0 and 1."""
    base = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    names = [n for n in HOT_WEIGHTS if n not in ("total", "balance")]
    rows = base.select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("total"), F.col("c_acctbal").alias("balance"),
        *[F.expr(t).cast("double").alias(n) for n, t in zip(names, HOT_TESTS)],
    )
    out = area_of_applicability(rows.where("o_orderstatus <> 'F'"), rows.where("o_orderstatus = 'F'"), HOT_WEIGHTS, "o_orderkey")
    return out.withColumn("di", r("di"))


@query("bootstrap_ci")
def bootstrap(spark, sf):
    li = table(spark, sf, "lineitem").withColumn(
        "row", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )
    return bootstrap_mean_ci(li, "l_extendedprice", "row", "l_returnflag", replicates=1000)


@query(
    "bootstrap_estimates",
    """select l_returnflag, count(*)::bigint as n, round(avg(l_extendedprice), 4) as statistic, true as bracketed,
         true as se_close from lineitem group by 1""",
)
def bootstrap_estimates(spark, sf):
    """Estimate within its limits, and the standard error near that of a mean."""
    li = table(spark, sf, "lineitem").withColumn(
        "row", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )
    ci = bootstrap_mean_ci(li, "l_extendedprice", "row", "l_returnflag", replicates=1000)
    plain = li.groupBy("l_returnflag").agg(
        (F.stddev_samp("l_extendedprice") / F.sqrt(F.count(F.lit(1)))).alias("se")
    )
    return ci.join(plain, "l_returnflag").select(
        "l_returnflag", "n", r("statistic", 4).alias("statistic"),
        ((F.col("conf_low") < F.col("statistic")) & (F.col("statistic") < F.col("conf_high"))).alias("bracketed"),
        (F.abs(F.col("std_error") / F.col("se") - 1) < 0.15).alias("se_close"),
    )


# The dictionary describes line measures; its classes follow from the measures' own profile.
DICT_SQL = """
nums as (select l_orderkey::double as orderkey, l_partkey::double as partkey, l_linenumber::double as linenumber,
  l_quantity as quantity, l_extendedprice as price, nullif(l_discount, 0.0) as discount, l_tax as tax from lineitem),
prof as (
  {parts}
  union all select 'returnflag', 'character', 0::bigint, null, min(n)::double, max(n)::double, count(*)::bigint
    from (select count(*) as n from lineitem group by l_returnflag)),
flags as (select *, (na > 0.01 * (select count(*) from lineitem))::integer as drop_na,
  (contains(name, 'key') and name <> 'partkey')::integer as drop_clim, (name = 'tax')::integer as drop_manual from prof),
dict as (select name, 'Measure ' || name || repeat('.', name_len) as "nameFull", 'u' as unit,
  case when max > 100000 then 'target' when nlevs > 0 then '0info' when max > 20 then 'soil' else 'anthro' end as class0,
  case when max > 100000 then 1 when max > 1000 then 0 end as "modelSOC", 1 as "modelEffect"
  from (select *, 8 * length(name) as name_len from prof)),
updated as (select f.*, d."nameFull", d.unit, d.class0, d."modelSOC", case when d."modelSOC" = 1 then 1
  when class0 = '0info' then 0 when greatest(drop_na, drop_clim, drop_manual) = 1 then 0
  else d."modelEffect" end as use from flags f left join dict d using (name)),
shown as (select name, case when type = 'numeric' then 'C' else 'F(' || nlevs || ')' end as type,
  case when length("nameFull") > 50 then left("nameFull", 47) || '...' else "nameFull" end as "nameFull", class0,
  case when "modelSOC" = 1 then 'x' when "modelSOC" is not null then '' end as "modelSOC",
  row_number() over (order by class0 desc, name) as row from updated where class0 <> '0info' and use = 1)
""".replace(
    "{parts}",
    " union all ".join(
        f"select '{c}' as name, 'numeric' as type, (count(*) - count({c}))::bigint as na, avg({c}) as mean, "
        f"min({c}) as min, max({c}) as max, 0::bigint as nlevs from nums"
        for c in ("orderkey", "partkey", "linenumber", "quantity", "price", "discount", "tax")
    ),
)


def line_dictionary(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(
        F.col("l_orderkey").cast("double").alias("orderkey"), F.col("l_partkey").cast("double").alias("partkey"),
        F.col("l_linenumber").cast("double").alias("linenumber"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("returnflag"),
    )
    profile = cut_lineage(profile_columns(rows))
    flagged = drop_flags(missing_screen(profile, rows.count()), "key", ["partkey"], ["tax"])
    top = F.col("max")
    dictionary = profile.select(
        "name",
        F.concat(F.lit("Measure "), "name", F.repeat(F.lit("."), 8 * F.length("name"))).alias("nameFull"),
        F.lit("u").alias("unit"),
        F.when(top > 100000, "target").when(F.col("nlevs") > 0, "0info").when(top > 20, "soil").otherwise("anthro")
        .alias("class0"),
        F.lit(None).cast("string").alias("class1"), F.lit(None).cast("string").alias("class2"),
        F.lit("lineitem").alias("source"),
        F.when(top > 100000, 1).when(top > 1000, 0).alias("modelSOC"),
        F.lit(1).alias("modelEffect"),
    )
    return update_dictionary(flagged, dictionary)


@query(
    "dictionary_update",
    f"""with {DICT_SQL} select name, type, na, round(mean, 7) as mean, nlevs, class0, "modelSOC",
        use as "modelEffect" from updated""",
)
def dictionary_update(spark, sf):
    d = line_dictionary(spark, sf)
    return d.select("name", "type", "na", r("mean", 7).alias("mean"), "nlevs", "class0", "modelSOC", "modelEffect")


@query(
    "variable_catalogue",
    f"""with {DICT_SQL} select name, type, "nameFull", class0, "modelSOC", row from shown""",
)
def catalogue(spark, sf):
    return variable_table(line_dictionary(spark, sf)).select("name", "type", "nameFull", "class0", "modelSOC", "row")


@query(
    "section_ranges",
    f"""with {DICT_SQL} select case when class0 = 'target' then 'soil' else class0 end as section,
        min(row) as first_row, max(row) as last_row from shown group by 1""",
)
def sections(spark, sf):
    return section_ranges(variable_table(line_dictionary(spark, sf)))


@query(
    "panel_pages",
    f"""with {DICT_SQL}, c as (select name, row_number() over (order by row) as row from shown where type = 'C')
    select name, row, ceil(row / 4)::bigint as page, (row - 1) % 4 + 1 as pos,
      chr(65 + (((row - 1) % 4) // 2)::integer) || (1 + ((row - 1) % 4) % 2) as cell from c""",
)
def panels(spark, sf):
    return panel_pages(variable_table(line_dictionary(spark, sf)), 2, 2).select("name", "row", "page", "pos", "cell")


@query(
    "importance_table",
    """with v as (select p_brand as name, count(*)::double as value from part group by 1),
       t as (select * from v qualify rank() over (order by value desc) <= 7),
       d as (select distinct p_brand as name, 'Brand ' || substr(p_brand, 7) as full_name from part
             where p_brand <> 'Brand#4')
    select name, value, case when name = 'Brand#4' then 'Fourth' else full_name end as "nameFull",
      case when name = 'Brand#4' then 'n' when full_name is not null then 'pieces' end as unit
    from t left join d using (name)""",
)
def importance(spark, sf):
    p = table(spark, sf, "part")
    v = p.groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    d = p.where("p_brand <> 'Brand#4'").select(
        F.col("p_brand").alias("name"), F.concat(F.lit("Brand "), F.substring("p_brand", 7, 9)).alias("nameFull"),
        F.lit("pieces").alias("unit"),
    ).distinct()
    return importance_table(v, d, 7, {"Brand#4": ("Fourth", "n")})


WIDE = 150


@query(
    "wide_correlation",
    f"""with base as (select o_orderkey as id, count(*) as a, sum(l_quantity)::bigint as b from orders join lineitem
          on l_orderkey = o_orderkey group by 1),
        long as (select id, k, ((a * k + b * (k % 7) + id * (k % 13)) % (17 + k))::double as v from base, range(1, {WIDE + 1}) r(k))
    select 'c' || x.k as var1, 'c' || y.k as var2, round(corr(x.v, y.v), 6) + 0.0 as rho from long x join long y
      on x.id = y.id and x.k < y.k group by x.k, y.k""",
)
def wide_correlation(spark, sf):
    """As many columns as a screening of all candidate variables has, in one pass."""
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("a"), F.sum("l_quantity").cast("long").alias("b"))
    base = a.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id")
    cols = {f"c{k}": ((F.col("a") * k + F.col("b") * (k % 7) + F.col("id") * (k % 13)) % (17 + k)).cast("double") for k in range(1, WIDE + 1)}
    return correlation_table(base.select(*[c.alias(n) for n, c in cols.items()]), list(cols)).withColumn("rho", r("rho"))


def _breaks_sql(classes: int, source: str = "part", value: str = "p_retailprice") -> str:
    """Fisher's dynamic program, a layer of CTEs for each class, over the distinct values; the last layer for all values only."""
    cost = "(b.cq - a.cq) - (b.cs - a.cs) * (b.cs - a.cs) / (b.cn - a.cn)"
    parts = [
        f"""t as (select {value} as x from {source}), v as (select x, count(*)::double as n from t group by 1),
        z as (select x, n, x - (select avg(x) from v) as d from v),
        o as (select x, row_number() over w as j, sum(n) over w as cn, sum(n * d) over w as cs, sum(n * d * d) over w as cq
          from z window w as (order by x)),
        b1 as (select j, cq - cs * cs / cn as cost, 0::bigint as cut from o)"""
    ]
    for k in range(2, classes + 1):
        parts.append(
            f"b{k} as materialized (select b.j, min(p.cost + {cost}) as cost, arg_min(a.j, p.cost + {cost}) as cut "
            f"from b{k - 1} p join o a on a.j = p.j join o b on b.j > a.j{' and b.j = (select max(j) from o)' if k == classes else ''} group by b.j)"
        )
    parts.append(f"e{classes} as (select max(j) as j from o)")
    for k in range(classes, 1, -1):
        parts.append(f"e{k - 1} as (select cut as j from b{k} join e{k} using (j))")
    ends = " union all ".join(f"select {k - 1} as class, j from e{k}" for k in range(1, classes + 1))
    return (
        f"with {', '.join(parts)}, ends as ({ends}), spans as (select class, x as top, lag(x) over (order by class) as below from ends join o using (j)) "
        "select class::integer as class, count(*)::bigint as n, min(t.x) as lowest, max(t.x) as highest "
        "from t join spans on t.x <= top and (below is null or t.x > below) group by class"
    )


@query("natural_break_classes", _breaks_sql(5))
def natural_break_classes(spark, sf):
    return jenks(spark, sf).select(F.col("class").cast("int").alias("class"), "n", "lowest", "highest")


def _classed(values, classes):
    breaks = natural_breaks(values, "x", classes)
    return values.groupBy(interval_index("x", breaks).cast("int").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lowest"), F.max("x").alias("highest")
    )


@query("natural_breaks_many_values", _breaks_sql(3, "lineitem", "floor(l_extendedprice / 4)"))
def natural_breaks_many_values(spark, sf):
    """Three classes of over 20,000 distinct values."""
    return _classed(table(spark, sf, "lineitem").select(F.floor(F.col("l_extendedprice") / 4).cast("double").alias("x")), 3)


@query("natural_breaks_all_values", _breaks_sql(2, "lineitem", "l_extendedprice"))
def natural_breaks_all_values(spark, sf):
    """Two classes of every price that occurs."""
    return _classed(table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("x")), 2)
