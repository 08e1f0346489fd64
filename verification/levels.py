"""Region-level means, shares, roll-ups and the flagship covariate query."""

from pyspark.sql import functions as F

from swardshift.operators.joins import keep_extreme_ties, null_safe_anti, resolve_ambiguous_regions
from swardshift.operators.levels import (
    finest_level_mean,
    latest_period_share,
    level_area,
    mean_retained_level,
    region_means,
    rollup_codes,
    share_of_total,
    share_table,
)
from swardshift.operators.reshape import assemble_features, spread

from .registry import query, r, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# Order totals as a statistics cube: every region publishes, a nation only where
# the mean order of the category is above a limit (small cells are withheld).
CUBE_SQL = """
flat as (
  select n_name as nation, r_name as region, year(o_orderdate) as time, o_orderpriority as category, o_totalprice
  from orders join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
published as (
  select nation, category from flat group by all having avg(o_totalprice) > 252000),
cube as (
  select region as geo, time, category, sum(o_totalprice) as v from flat group by all
  union all
  select nation, time, category, sum(o_totalprice) as v from flat
    semi join published using (nation, category) group by all),
key as (
  select c_custkey, 0 as level, r_name as region_id, (r_regionkey + 1.5)::double as area_km2
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all
  select c_custkey, 0, r_name, (r_regionkey + 2.25)::double
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where r_name <> 'ASIA'
  union all
  select c_custkey, 1, n_name, (n_nationkey + 0.5)::double
    from customer join nation on c_nationkey = n_nationkey)
"""


def flat_orders(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
            F.year("o_orderdate").alias("time"),
            F.col("o_orderpriority").alias("category"),
            "o_totalprice",
        )
    )


def cube_and_key(spark, sf):
    flat = flat_orders(spark, sf)
    by_nation = flat.groupBy("nation", "region", "time", "category").agg(
        F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n")
    )
    by_region = by_nation.groupBy(F.col("region").alias("geo"), "time", "category").agg(F.sum("v").alias("v"))
    published = (
        by_nation.groupBy("nation", "category")
        .agg((F.sum("v") / F.sum("n")).alias("m"))
        .where("m > 252000")
        .select("nation", "category")
    )
    shown = by_nation.join(published, ["nation", "category"], "left_semi")
    cube = by_region.unionByName(shown.select(F.col("nation").alias("geo"), "time", "category", "v"))
    placed = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    at_region = F.struct(F.lit(0).alias("level"), F.col("r_name").alias("region_id"),
                         (F.col("r_regionkey") + 1.5).alias("area_km2"))
    second = F.struct(F.lit(0).alias("level"), F.col("r_name").alias("region_id"),
                      (F.col("r_regionkey") + 2.25).alias("area_km2"))
    at_nation = F.struct(F.lit(1).alias("level"), F.col("n_name").alias("region_id"),
                         (F.col("n_nationkey") + 0.5).alias("area_km2"))
    versions = F.when(F.col("r_name") != "ASIA", F.array(at_region, second, at_nation)).otherwise(
        F.array(at_region, at_nation)
    )
    return cube, placed.select("c_custkey", F.inline(versions))


LEVELS = {"ids": ["c_custkey"], "value": "v", "levels": (0, 1)}

FINEST_SQL = """
joined as (select k.c_custkey, k.level, k.area_km2, c.category, c.time, c.v
           from key k join cube c on k.region_id = c.geo),
means as (select c_custkey, level, category, avg(v) as m from joined group by all),
ranked as (select *, row_number() over (partition by c_custkey, category order by level desc) as rn from means),
finest as (select c_custkey, category, m, level from ranked where rn = 1)
"""


@query(
    "finest_level_mean",
    f"""with {CUBE_SQL}, {FINEST_SQL}
    select c_custkey, category, round(m, 5) as mean_value, level from finest""",
)
def finest(spark, sf):
    cube, key = cube_and_key(spark, sf)
    means = region_means(cube, key, ["category"], keep_level=True, out="mean_value", **LEVELS)
    return means.withColumn("mean_value", r("mean_value", 5))


@query(
    "finest_level_rows",
    f"""with {CUBE_SQL}, {FINEST_SQL}
    select c_custkey, category, round(m, 5) as mean_value from finest""",
)
def finest_rows(spark, sf):
    """The same from the joined rows, with any number of levels."""
    cube, key = cube_and_key(spark, sf)
    joined = key.join(cube, F.col("region_id") == F.col("geo"))
    means = finest_level_mean(joined, ["c_custkey"], "level", ["category"], "v", None, out="mean_value")
    return means.withColumn("mean_value", r("mean_value", 5))


@query(
    "mean_retained_level",
    f"""with {CUBE_SQL}, {FINEST_SQL} select round(avg(level), 2) as mean_level from finest""",
)
def retained(spark, sf):
    cube, key = cube_and_key(spark, sf)
    return mean_retained_level(region_means(cube, key, ["category"], keep_level=True, **LEVELS))


@query(
    "mean_per_region_area",
    f"""with {CUBE_SQL},
    joined as (select k.c_custkey, k.level, c.category, c.v / k.area_km2 as v
               from key k join cube c on k.region_id = c.geo),
    means as (select c_custkey, level, category, avg(v) as m from joined group by all),
    ranked as (select *, row_number() over (partition by c_custkey, category order by level desc) as rn from means)
    select c_custkey, category, round(m, 5) as density from ranked where rn = 1""",
)
def per_region_area(spark, sf):
    cube, key = cube_and_key(spark, sf)
    return region_means(cube, key, ["category"], area="area_km2", out="density", **LEVELS).withColumn(
        "density", r("density", 5)
    )


AREA_SQL = """
rolled as (select geo, category, time, v from cube),
area as (select c_custkey, level, category as class, avg(v) as area from key join rolled on region_id = geo
         group by all)
"""


@query(
    "normalised_by_reference",
    f"""with {CUBE_SQL}, {AREA_SQL},
    joined as (select k.c_custkey, k.level, c.category, 100 * c.v / a.area as v
               from key k join cube c on k.region_id = c.geo
               left join area a on a.c_custkey = k.c_custkey and a.level = k.level and a.class = '3-MEDIUM'),
    means as (select c_custkey, level, category, avg(v) as m from joined group by all),
    ranked as (select *, row_number() over (partition by c_custkey, category order by level desc) as rn from means)
    select c_custkey, category, round(m, 5) as share from ranked where rn = 1""",
)
def normalised(spark, sf):
    cube, key = cube_and_key(spark, sf)
    area = level_area(cube, key, "category", ids=["c_custkey"], value="v").where("class = '3-MEDIUM'")
    means = region_means(
        cube, key, ["category"], area_cube=area, factor=100.0, out="share", **LEVELS
    )
    return means.withColumn("share", r("share", 5))


@query(
    "reference_area",
    f"""with {CUBE_SQL}, {AREA_SQL} select c_custkey, level, class, round(area, 5) as area from area""",
)
def reference(spark, sf):
    cube, key = cube_and_key(spark, sf)
    return level_area(cube, key, "category", ids=["c_custkey"], value="v").withColumn("area", r("area", 5))


FLAGSHIP_SQL = f"""with {CUBE_SQL}, {FINEST_SQL},
wide as (select c_custkey, {", ".join(
    f"max(case when category = '{p}' then m end) as v{i}" for i, p in enumerate(PRIORITIES))}
  from finest group by 1)
select c_custkey, {", ".join(
    f'round(v{i} / v2 * 100, 6) as "{p}_rel"' for i, p in enumerate(PRIORITIES) if i != 2)} from wide"""


@query("covariate_shares", FLAGSHIP_SQL)
def covariate_shares(spark, sf):
    """Cube -> region key -> finest level -> share of a reference -> one row per point."""
    cube, key = cube_and_key(spark, sf)
    means = region_means(cube, key, ["category"], **LEVELS)
    wide = share_table(means, ["c_custkey"], "category", PRIORITIES, "3-MEDIUM", "values", "_rel")
    return wide.select("c_custkey", *[r(f"`{c}`").alias(c) for c in wide.columns[1:]])


SHARE_SQL = """
rev as (select c_custkey, o_orderstatus as cat, sum(o_totalprice) as v
        from orders join customer on o_custkey = c_custkey group by all),
both_ as (select * from rev union all select c_custkey, 'TOTAL', sum(v) from rev group by 1)
"""


def revenue_with_total(spark, sf):
    rev = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("cat")).agg(
        F.sum("o_totalprice").alias("v")
    )
    total = rev.groupBy("c_custkey").agg(F.sum("v").alias("v")).withColumn("cat", F.lit("TOTAL"))
    return rev.unionByName(total)


@query(
    "share_of_total",
    f"""with {SHARE_SQL}, t as (select c_custkey, v as total from both_ where cat = 'TOTAL')
    select c_custkey, cat, round(v / total * 100, 6) as share from both_ join t using (c_custkey)""",
)
def shares(spark, sf):
    s = share_of_total(revenue_with_total(spark, sf), ["c_custkey"], "cat", "TOTAL", "v")
    return s.select("c_custkey", "cat", r("share").alias("share"))


@query(
    "share_pivot",
    f"""with {SHARE_SQL}, w as (select c_custkey, max(case when cat = 'F' then v end) as f,
      max(case when cat = 'O' then v end) as o, max(case when cat = 'P' then v end) as p,
      max(case when cat = 'TOTAL' then v end) as t from both_ group by 1)
    select c_custkey, round(f / t * 100, 6) as "Frel", round(o / t * 100, 6) as "Orel",
      round(p / t * 100, 6) as "Prel" from w""",
)
def share_pivot(spark, sf):
    w = share_table(
        revenue_with_total(spark, sf), ["c_custkey"], "cat", ["F", "O", "P", "TOTAL"], "TOTAL", "v", "rel"
    )
    return w.select("c_custkey", *[r(c).alias(c) for c in w.columns[1:]])


@query(
    "share_by_regex",
    """with v as (select p_brand, p_type, sum(p_retailprice) as v from part
         where regexp_matches(p_type, 'STANDARD|^E|^S|^P') group by all),
       t as (select p_brand, max(v) as total from v where p_type = 'STANDARD' group by 1)
    select p_brand, p_type, round(v / total * 100, 6) as share from v left join t using (p_brand)""",
)
def share_by_regex(spark, sf):
    v = (
        table(spark, sf, "part")
        .where(F.col("p_type").rlike("STANDARD|^E|^S|^P"))
        .groupBy("p_brand", "p_type")
        .agg(F.sum("p_retailprice").alias("v"))
    )
    return share_of_total(v, ["p_brand"], "p_type", "STANDARD", "v").select(
        "p_brand", "p_type", r("share").alias("share")
    )


CODES_SQL = """
codes as (select chr(65 + r_regionkey::integer) || chr(75 + r_regionkey::integer) || chr(48 + (n_nationkey // 10)::integer)
            || chr(48 + (n_nationkey % 10)::integer) as geo, o_orderpriority as crops, year(o_orderdate) as time,
            case when o_orderstatus = 'P' and o_totalprice > 499000 then null else o_totalprice end as v
          from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
            join region on n_regionkey = r_regionkey),
raw as (select geo, crops, time, case when count(v) = count(*) then sum(v) end as v from codes group by all)
"""


def coded_cube(spark, sf):
    rows = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    nk, rk = F.col("n_nationkey"), F.col("r_regionkey")
    geo = F.concat(F.char(65 + rk), F.char(75 + rk), F.char(48 + F.floor(nk / 10)), F.char(48 + nk % 10))
    from swardshift.functions.strict import strict_sum

    v = F.when(~((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 499000)), F.col("o_totalprice"))
    return rows.select(
        geo.alias("geo"), F.col("o_orderpriority").alias("crops"), F.year("o_orderdate").alias("time"), v.alias("v")
    ).groupBy("geo", "crops", "time").agg(strict_sum("v").alias("v"))


@query(
    "rollup_codes",
    f"""with {CODES_SQL}, up as (select left(geo, 3) as geo, crops, time,
        case when count(v) = count(*) then sum(v) end as v from raw where length(geo) = 4 group by all)
    select geo, crops, time, round(v, 2) as v from raw union all select geo, crops, time, round(v, 2) from up""",
)
def rollup(spark, sf):
    rolled = rollup_codes(coded_cube(spark, sf), "geo", ["crops", "time"], "v")
    return rolled.withColumn("time", F.col("time").cast("bigint")).withColumn("v", r("v", 2))


@query(
    "latest_period_share",
    """with y as (select n_name as geo, o_orderpriority as crops, year(o_orderdate) as time, sum(o_totalprice) as v
         from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
       m as (select *, max(time) over (partition by geo, crops) as latest from y),
       s as (select crops, sum(v) as v from m where time = latest group by 1)
    select crops, round(v, 2) as v, round((select max(v) from s where crops = '5-LOW'), 2) as ref,
      round(v / (select max(v) from s where crops = '5-LOW'), 6) as rel from s""",
)
def latest(spark, sf):
    flat = flat_orders(spark, sf)
    y = flat.groupBy(F.col("nation").alias("geo"), F.col("category").alias("crops"), "time").agg(
        F.sum("o_totalprice").alias("v")
    )
    s = latest_period_share(y, ["geo"], "time", "crops", "v", "5-LOW")
    return s.select("crops", r("v", 2).alias("v"), r("ref", 2).alias("ref"), r("rel").alias("rel"))


@query(
    "extreme_ties",
    """select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
       qualify l_quantity = max(l_quantity) over (partition by l_suppkey)""",
)
def extreme(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return keep_extreme_ties(li, ["l_suppkey"], "l_quantity")


# Order placements as a region key: point = customer, year, level by priority, region by nation of the line.
DUP_SQL = """
key as (select distinct o_custkey as point, year(o_orderdate) as y,
          case when o_orderpriority in ('1-URGENT', '2-HIGH') then 0 else 1 end as level,
          o_orderstatus as region, case when o_orderstatus = 'P' then null else 1.5::double end as area from orders)
"""


def dup_key(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("point"),
        F.year("o_orderdate").alias("y"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0).otherwise(1).alias("level"),
        F.col("o_orderstatus").alias("region"),
        F.when(F.col("o_orderstatus") != "P", 1.5).alias("area"),
    )


@query(
    "dup_resolution",
    f"""with {DUP_SQL},
    n0 as (select *, count(*) over (partition by point, y, level) as n0 from key),
    a as (select * from n0 where point in (select point from n0 where n0 > 1)),
    b as (select * from a where level in (select level from a where n0 > 1)),
    c as (select *, count(*) over (partition by point, region) as n1 from b),
    lost as (select * from c where n0 > 1 and n1 = 1)
    select k.point, k.y, k.level, k.region, k.area from key k
    where not exists (select 1 from lost l where l.point = k.point and l.y = k.y and l.level = k.level
      and l.region = k.region and l.area is not distinct from k.area)""",
)
def dup_resolution(spark, sf):
    out = resolve_ambiguous_regions(dup_key(spark, sf), "point", "y", "level", "region")
    return out.withColumn("y", F.col("y").cast("bigint"))


@query(
    "null_safe_anti",
    f"""with {DUP_SQL}, gone as (select distinct point, area from key where level = 0)
    select point, y, level, region from key k where not exists (
      select 1 from gone g where g.point = k.point and g.area is not distinct from k.area)""",
)
def anti(spark, sf):
    key = dup_key(spark, sf).distinct()
    out = null_safe_anti(key, key.where("level = 0").select("point", "area"))
    return out.select("point", F.col("y").cast("bigint").alias("y"), "level", "region")


@query(
    "assemble_features",
    """with a as (select o_custkey as id, max(case when o_orderstatus = 'F' then o_totalprice end) as max_f,
           max(case when o_orderstatus = 'O' then o_totalprice end) as max_o from orders
           where o_totalprice > 400000 group by 1),
       b as (select c_custkey as id, c_acctbal as balance from customer where c_acctbal > 0),
       c as (select o_custkey as id, count(*)::bigint as n_low from orders where o_orderpriority = '5-LOW' group by 1)
    select id, max_f, max_o, balance, n_low from a full join b using (id) full join c using (id)""",
)
def assemble(spark, sf):
    o = table(spark, sf, "orders")
    big = o.where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("id"), "o_orderstatus").agg(
        F.max("o_totalprice").alias("v")
    )
    a = spread(big.where("o_orderstatus in ('F', 'O', 'P')"), ["id"], "o_orderstatus", "v", ["F", "O"], "max_")
    a = a.withColumnsRenamed({"max_F": "max_f", "max_O": "max_o"})
    b = table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")
    )
    c = o.where("o_orderpriority = '5-LOW'").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n_low")
    )
    return assemble_features([a, b, c], ["id"])
