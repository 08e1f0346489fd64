"""Ranking, paging, one-hot coding and month pivots."""

from pyspark.sql import functions as F

from swardshift.operators.ordering import grid_cells, number_rows, paginate, top_k, top_n_with_ties
from swardshift.operators.quantiles import exact_quantiles, strict_quantile
from swardshift.operators.reshape import lump_rare, one_hot_columns
from swardshift.plans.vegetation import monthly_medians

from .registry import query, r, table


@query(
    "top_k_per_group",
    """select l_suppkey, l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) as price, rank from (
         select *, row_number() over (partition by l_suppkey
           order by l_extendedprice, l_orderkey, l_linenumber, l_partkey)::integer as rank from lineitem)
       where rank <= 5""",
)
def top_k_per_group(spark, sf):
    best = top_k(
        table(spark, sf, "lineitem"), ["l_suppkey"],
        ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], 5, rank="rank",
    )
    return best.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", r("l_extendedprice", 2).alias("price"), "rank"
    )


@query(
    "top_n_ties",
    """select p_partkey, p_size from part qualify rank() over (order by p_size desc) <= 7""",
)
def top_n_ties(spark, sf):
    return top_n_with_ties(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 7)


@query(
    "paginate",
    """with n as (select p_partkey, p_name, row_number() over (order by p_name, p_partkey) as row from part),
       p as (select *, ceil(row / 16)::bigint as page from n)
    select p_partkey, row, page, row - (page - 1) * 16 as pos,
      chr(65 + ((row - (page - 1) * 16 - 1) // 4)::integer) || (1 + (row - (page - 1) * 16 - 1) % 4) as cell from p""",
)
def pages(spark, sf):
    p = paginate(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 16)
    return grid_cells(p, "pos", 4).select("p_partkey", "row", "page", "pos", "cell")


@query(
    "row_numbers",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over
         (order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as row from lineitem""",
)
def row_numbers(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = table(spark, sf, "lineitem").select(*cols, "l_extendedprice")
    return number_rows(li, [F.desc("l_extendedprice"), *cols]).select(*cols, "row")


ONE_HOT_LEVELS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "lump_one_hot",
    """with v as (select p_partkey, case when p_size > 45 then null else p_brand end as brand, p_type as type from part),
       c as (select brand, count(*) / (select count(brand) from v) as share from v where brand is not null group by 1),
       l as (select p_partkey, case when v.brand is null then null when c.share > 0.04 then v.brand else 'Other' end
               as brand, type from v left join c using (brand))
    select p_partkey, brand,
      (type = 'ECONOMY')::integer as "type_ECONOMY", (type = 'LARGE')::integer as "type_LARGE",
      (type = 'MEDIUM')::integer as "type_MEDIUM", (type = 'PROMO')::integer as "type_PROMO",
      (type = 'SMALL')::integer as "type_SMALL", (type = 'STANDARD')::integer as "type_STANDARD" from l""",
)
def lump(spark, sf):
    v = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") <= 45, F.col("p_brand")).alias("brand"),
        F.col("p_type").alias("type"),
    )
    lumped = lump_rare(v, ["brand"], 0.04)
    return one_hot_columns(lumped, {"type": ONE_HOT_LEVELS})[0]


MONTH_SQL = """
obs as (select user_id, case when hour(ts) < 6 then 3 when hour(ts) < 12 then 6 when hour(ts) < 18 then 9 else 12 end
          as month, case when value > 60 then null else value end as v from events)
"""


def observations(spark, sf):
    h = F.hour("ts")
    return table(spark, sf, "events").select(
        "user_id",
        F.when(h < 6, 3).when(h < 12, 6).when(h < 18, 9).otherwise(12).alias("month"),
        F.when(F.col("value") <= 60, F.col("value")).alias("v"),
    )


@query(
    "month_pivot",
    f"""with {MONTH_SQL}
    select user_id, {", ".join(
        f"round(case when count(v) filter (month = {m}) = count(*) filter (month = {m}) "
        f"then median(v) filter (month = {m}) end, 6) as {n}"
        for m, n in ((3, "ndvi13"), (6, "ndvi14"), (9, "ndvi15"), (12, "ndvi16")))},
      round(case when count(v) = count(*) then median(v) end, 6) as ndvi17
    from obs group by 1""",
)
def month_pivot(spark, sf):
    wide = monthly_medians(observations(spark, sf), "user_id", "month", "v")
    return wide.select("user_id", *[r(c).alias(c) for c in wide.columns[1:]])


@query(
    "strict_median",
    f"""with {MONTH_SQL}
    select user_id, month, round(case when count(v) = count(*) then median(v) end, 6) as q5 from obs group by all""",
)
def strict_median_query(spark, sf):
    q = strict_quantile(observations(spark, sf), ["user_id", "month"], "v", 0.5, "q5")
    return q.withColumn("q5", r("q5"))


@query("global_median", """select round(median(o_totalprice), 4) as median from orders""")
def global_median(spark, sf):
    """Taken the distributed way, as a table of any size would be."""
    q = exact_quantiles(table(spark, sf, "orders"), [], "o_totalprice", [0.5], ["median"])
    return q.withColumn("median", r("median", 4))


@query(
    "group_quantiles",
    """select l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) as q05,
         round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.95), 4) as q95
       from lineitem group by 1""",
)
def group_quantiles(spark, sf):
    """Groups above and below the limit, so both ways are used."""
    li = table(spark, sf, "lineitem")
    q = exact_quantiles(
        li, ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95], ["q05", "q50", "q95"]
    )
    return q.select("l_returnflag", *[r(c, 4).alias(c) for c in ("q05", "q50", "q95")])
