"""Cleaning, recoding, text and selection queries."""

from pyspark.sql import functions as F

from swardshift.functions import measures as m
from swardshift.functions import text as tx
from swardshift.functions.strict import strict_sum
from swardshift.operators.columns import (
    add_prefix,
    all_of,
    filter_bbox,
    is_numeric,
    null_sentinels,
    select_where,
)
from swardshift.operators.profile import condition_counts, tally_share
from swardshift.operators.reshape import gather

from .registry import query, r, table

# Three waves of one measure: the latest, and two earlier ones with gaps.
WAVES_SQL = """
waves as (
  select o_orderkey,
    case when o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') then null else o_totalprice end as base,
    case when o_orderstatus = 'F' then null when o_orderpriority = '2-HIGH' then -999.0
         else o_totalprice / 2 end as w09,
    case when o_orderstatus = 'O' then null when o_orderpriority = '1-URGENT' then -999.0
         else o_totalprice / 3 end as w12
  from orders)
"""


def waves(spark, sf):
    o = table(spark, sf, "orders")
    p, s, v = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    return o.select(
        "o_orderkey",
        F.when(~p.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), v).alias("base"),
        F.when(s == "F", None).when(p == "2-HIGH", -999.0).otherwise(v / 2).alias("w09"),
        F.when(s == "O", None).when(p == "1-URGENT", -999.0).otherwise(v / 3).alias("w12"),
    )


@query(
    "exclusive_fill",
    f"""with {WAVES_SQL}, clean as (
      select o_orderkey, base, nullif(w09, -999.0) as w09, nullif(w12, -999.0) as w12 from waves)
    select o_orderkey, round(case when base is not null then base
      when w09 is not null and w12 is not null then null
      when w09 is not null then w09 else w12 end, 4) as filled from clean""",
)
def exclusive_fill(spark, sf):
    clean = null_sentinels(waves(spark, sf), {"w09": [-999.0], "w12": [-999.0]})
    return clean.select("o_orderkey", r(m.exclusive_fill("base", "w09", "w12"), 4).alias("filled"))


@query(
    "sentinels_to_missing",
    f"""with {WAVES_SQL}
    select count(*)::bigint as n, count(nullif(w09, -999.0))::bigint as n09,
           count(nullif(w12, -999.0))::bigint as n12, count(base)::bigint as n_base from waves""",
)
def sentinels_to_missing(spark, sf):
    clean = null_sentinels(waves(spark, sf), [-999.0])
    return clean.agg(
        F.count(F.lit(1)).alias("n"), F.count("w09").alias("n09"), F.count("w12").alias("n12"),
        F.count("base").alias("n_base"),
    )


SOIL_SQL = """
soil as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    case when l_quantity / 10 < 0.2 then null else l_quantity / 10 end as oc,
    case when l_discount / 2 < 0.02 then null else l_discount / 2 end as n,
    l_quantity as sand, 100 - 2 * l_quantity as clay, l_tax * 100 as coarse
  from lineitem)
"""


@query(
    "clean_derive",
    f"""with {SOIL_SQL}, dense as (
      select *, 0.80806 + 0.823844 * exp(-0.27993 * oc) + 0.0014065 * sand - 0.0010299 * clay as bd from soil)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(bd, 6) as bd,
      round(oc * bd * 20 * (1 - coarse / 100), 5) as oc_stock,
      round(n * bd * 20 * (1 - coarse / 100), 5) as n_stock,
      round(case when oc is not null and n is not null then oc / n end, 5) as cn from dense""",
)
def clean_derive(spark, sf):
    li = table(spark, sf, "lineitem")
    soil = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        m.censor_below(F.col("l_quantity") / 10, m.OC_DETECTION_LIMIT).alias("oc"),
        m.censor_below(F.col("l_discount") / 2, m.N_DETECTION_LIMIT).alias("n"),
        F.col("l_quantity").alias("sand"),
        (100 - 2 * F.col("l_quantity")).alias("clay"),
        (F.col("l_tax") * 100).alias("coarse"),
    ).withColumn("bd", m.bulk_density("oc", "sand", "clay"))
    return soil.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        r("bd").alias("bd"),
        r(m.stock("oc", "bd", "coarse"), 5).alias("oc_stock"),
        r(m.stock("n", "bd", "coarse"), 5).alias("n_stock"),
        r(m.ratio_if_both("oc", "n"), 5).alias("cn"),
    )


@query(
    "site_filter",
    """select l_orderkey, l_linenumber, l_partkey, l_returnflag, round(l_extendedprice, 2) as price from lineitem
       where l_returnflag in ('A', 'N') and nullif(l_discount, 0.0) is not null
         and l_quantity <= 15 / 1.72 and l_tax < 0.05""",
)
def site_filter(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("discount", F.nullif("l_discount", F.lit(0.0)))
    kept = li.where(
        all_of(
            [
                F.col("l_returnflag").isin("A", "N"),
                F.col("discount").isNotNull(),
                F.col("l_quantity") <= m.OC_MINERAL_LIMIT,
                F.col("l_tax") < 0.05,
            ]
        )
    )
    return kept.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", r("l_extendedprice", 2).alias("price")
    )


@query(
    "code_recode",
    """select case l_linenumber when 1 then 'Irrigation' when 2 then 'Potential irrigation'
         when 3 then 'Drainage' when 4 then 'Irrigation and drainage' when 5 then 'not visible'
         else 'not relevant' end as water, count(*)::bigint as n,
         round(sum(l_extendedprice), 2) as price
       from lineitem group by 1""",
)
def code_recode(spark, sf):
    li = table(spark, sf, "lineitem")
    label = m.recode("l_linenumber", m.WATER_MANAGEMENT, m.WATER_MANAGEMENT_DEFAULT)
    return li.groupBy(label.alias("water")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("l_extendedprice"), 2).alias("price")
    )


EFFECT_SQL = """
effects as (
  select l_orderkey, l_linenumber, l_partkey,
    case when l_discount = 0 then null else l_quantity * (0.5 + l_tax * 10) - 20 end as effect
  from lineitem)
"""


def effects(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_discount") != 0, F.col("l_quantity") * (0.5 + F.col("l_tax") * 10) - 20).alias("effect"),
    )


@query(
    "bin_effect",
    f"""with {EFFECT_SQL}, cut as (select case when effect < -5 then 'Less than -5'
          when effect < 5 then '-5 to  5' when effect < 15 then '5 to 15' when effect < 25 then '15 to 25'
          else 'More than 25' end as faithful,
          case when effect is null then null when effect < -5 then 0 when effect < 5 then 1
          when effect < 15 then 2 when effect < 25 then 3 else 4 end as ord from effects)
    select faithful, cast(ord as integer) as ord, count(*)::bigint as n from cut group by all""",
)
def bin_effect(spark, sf):
    e = effects(spark, sf)
    strictly = m.bin_effect("effect", missing_as_last=False)
    return e.groupBy(
        m.bin_effect("effect").alias("faithful"), m.ordinal(strictly, m.EFFECT_LABELS).cast("int").alias("ord")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "interval_bins",
    """select case when l_quantity < 10 then 0 when l_quantity < 25 then 1 when l_quantity < 40 then 2 else 3 end
         as bin, case when l_quantity < 10 then '[1,10)' when l_quantity < 25 then '[10,25)'
         when l_quantity < 40 then '[25,40)' else '[40,50]' end as label, count(*)::bigint as n
       from lineitem where l_quantity between 1 and 50 group by all""",
)
def interval_bins(spark, sf):
    breaks = [1.0, 10.0, 25.0, 40.0, 50.0]
    li = table(spark, sf, "lineitem").select(
        m.interval_index("l_quantity", breaks).alias("bin"), m.interval_label("l_quantity", breaks).alias("label")
    )
    return li.where("bin is not null").groupBy("bin", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "effect_sizes",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice - l_quantity * 1000, 2) as effect_abs,
         round(case when l_quantity * l_discount > 0 then ln(l_extendedprice / (l_quantity * l_discount)) end, 6)
           as effect_rel
       from lineitem""",
)
def effect_sizes(spark, sf):
    li = table(spark, sf, "lineitem")
    q, d, p = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        r(m.effect_size(p, q * 1000, "Abs"), 2).alias("effect_abs"),
        r(m.effect_size(p, q * d, "Rel")).alias("effect_rel"),
    )


@query(
    "presence_and_defaults",
    """select case when nullif(c_mktsegment, 'BUILDING') is not null or nullif(c_acctbal > 0, false) then 'yes'
         else 'no' end as natura, round(sum(coalesce(case when c_acctbal < 0 then null else c_acctbal end, 0)), 2)
         as balance, count(*)::bigint as n from customer group by 1""",
)
def presence_and_defaults(spark, sf):
    c = table(spark, sf, "customer")
    a = F.nullif("c_mktsegment", F.lit("BUILDING"))
    b = F.when(F.col("c_acctbal") > 0, F.lit("site"))
    balance = F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.lit(0.0))
    return c.groupBy(m.presence_flag(a, b).alias("natura")).agg(
        r(F.sum(balance), 2).alias("balance"), F.count(F.lit(1)).alias("n")
    )


@query(
    "string_ops",
    """select c_custkey,
         case when instr(c_name, '0') > 0 then left(c_name, instr(c_name, '0') - 1) || '/' ||
           substr(c_name, instr(c_name, '0') + 1) else c_name end as first_replaced,
         regexp_replace(c_mktsegment || '_' || c_nationkey || '_x', '_[^_]*$', '') as stripped,
         try_cast(substr(c_name, 10) as double) as parsed,
         try_cast(c_mktsegment as double) as unparsed,
         case when length(repeat(c_mktsegment, 6)) > 50 then left(repeat(c_mktsegment, 6), 47) || '...'
           else repeat(c_mktsegment, 6) end as cut,
         replace(c_name, 'Customer#', '') as removed
       from customer""",
)
def string_ops(spark, sf):
    c = table(spark, sf, "customer")
    code = F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("x"))
    return c.select(
        "c_custkey",
        tx.replace_first("c_name", "0", "/").alias("first_replaced"),
        tx.strip_last_suffix(code).alias("stripped"),
        tx.to_number(F.substring("c_name", 10, 100)).alias("parsed"),
        tx.to_number("c_mktsegment").alias("unparsed"),
        tx.truncate(F.repeat("c_mktsegment", F.lit(6)), 50).alias("cut"),
        tx.remove_first("c_name", "Customer#").alias("removed"),
    )


@query(
    "region_levels",
    """with codes as (select c_custkey, left('AB12345', cast(1 + c_nationkey % 6 as integer)) as code from customer)
    select case length(code) when 2 then 0 when 3 then 1 when 4 then 2 when 5 then 3 end as level,
      count(*)::bigint as n from codes group by 1""",
)
def region_levels(spark, sf):
    c = table(spark, sf, "customer").select(
        F.left(F.lit("AB12345"), (1 + F.col("c_nationkey") % 6).cast("int")).alias("code")
    )
    return c.groupBy(m.region_level("code").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "layer_names",
    """select o_orderkey, '/store/' || regexp_replace(name, '^([^;]*);', '\\1/') as location
       from (select o_orderkey, o_orderpriority || ';ndvi;' || o_orderstatus as name from orders
             where o_orderpriority <> '5-LOW'
             union all select o_orderkey, o_orderpriority || ';other' from orders where o_orderpriority = '5-LOW')
       where contains(name, 'ndvi')""",
)
def layer_names(spark, sf):
    from swardshift.sources.features import layer_catalogue

    o = table(spark, sf, "orders")
    tail = F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit(";ndvi;"), "o_orderstatus"))
    named = o.select(
        "o_orderkey", F.concat("o_orderpriority", F.coalesce(tail, F.lit(";other"))).alias("name")
    )
    located = layer_catalogue(named, "name", "ndvi", "/store/", keep=["o_orderkey"])
    return located


@query(
    "count_condition",
    """with c as (select nullif(o_totalprice, o_totalprice) as never,
         case when o_orderstatus = 'P' then null else o_totalprice end as price, o_orderpriority as p from orders)
    select condition, outcome, count(*)::bigint as n from (
      select 'urgent' as condition, p in ('1-URGENT', '2-HIGH') as outcome from c
      union all select 'cheap', price <= 200000 from c
      union all select 'present', price is not null from c) group by all""",
)
def count_condition(spark, sf):
    o = table(spark, sf, "orders")
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return condition_counts(
        o,
        {
            "urgent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
            "cheap": price <= 200000,
            "present": price.isNotNull(),
        },
    )


@query(
    "tally_share",
    """select o_orderstatus, count(*)::bigint as n, round(count(*) / (select count(*) from orders), 6) as rel
       from orders group by 1""",
)
def tally(spark, sf):
    t = tally_share(table(spark, sf, "orders"), ["o_orderstatus"])
    return t.withColumn("rel", r("rel"))


@query(
    "strict_aggregates",
    """with v as (select l_suppkey, l_returnflag, case when l_quantity = 50 and l_tax = 0.08 then null
         else l_extendedprice end as x from lineitem)
    select l_suppkey, l_returnflag, case when count(x) = count(*) then round(sum(x), 2) end as strict_total,
      round(sum(x), 2) as total, round(avg(x) + 1e-7, 4) as mean from v group by all""",
)
def strict_aggregates(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag",
        F.when(~((F.col("l_quantity") == 50) & (F.col("l_tax") == 0.08)), F.col("l_extendedprice")).alias("x"),
    )
    return li.groupBy("l_suppkey", "l_returnflag").agg(
        r(strict_sum("x"), 2).alias("strict_total"), r(F.sum("x"), 2).alias("total"), r(F.avg("x") + 1e-7, 4).alias("mean")
    )


@query(
    "unpivot_long",
    """with w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as quantity, nullif(l_discount, 0.0) as discount,
         l_tax as tax from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'quantity' as measure, quantity as amount from w
    union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'discount', discount from w
    union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'tax', tax from w""",
)
def unpivot_long(spark, sf):
    w = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("quantity"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return gather(w, ids, ["quantity", "discount", "tax"], "measure", "amount")


@query(
    "select_and_prefix",
    """select p_partkey as partner_p_partkey, p_size as partner_p_size, p_retailprice as partner_p_retailprice
       from part""",
)
def select_and_prefix(spark, sf):
    return add_prefix(select_where(table(spark, sf, "part"), is_numeric), "p_", "partner_")


LONLAT_SQL = """
spots as (
  select c_custkey, c_nationkey, c_mktsegment, c_acctbal,
    -10 + 50 * ((c_custkey * 48271 + 11) % 65537) / 65537.0::double as lon,
    35 + 30 * ((c_custkey * 30269 + 7) % 65521) / 65521.0::double as lat
  from customer)
"""


def spots(spark, sf):
    """Customers as points on the map."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal",
        (-10 + 50 * ((k * 48271 + 11) % 65537) / F.lit(65537.0)).alias("lon"),
        (35 + 30 * ((k * 30269 + 7) % 65521) / F.lit(65521.0)).alias("lat"),
    )


@query(
    "filter_bbox",
    f"""with {LONLAT_SQL} select c_custkey, round(lon, 6) as lon, round(lat, 6) as lat from spots
        where lon between -8.1 and 30 and lat between 36 and 60.5""",
)
def bbox(spark, sf):
    kept = filter_bbox(spots(spark, sf), -8.1, 30, 36, 60.5)
    return kept.select("c_custkey", r("lon").alias("lon"), r("lat").alias("lat"))


@query(
    "ratio_scatter",
    """select o_orderkey, round(log10(o_totalprice / nullif(o_custkey, 0)), 6) as log_ratio,
         o_totalprice < 250000 as cheap from orders""",
)
def ratio_scatter(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", r(m.log10_ratio("o_totalprice", "o_custkey")).alias("log_ratio"),
        (F.col("o_totalprice") < 250000).alias("cheap"),
    )


@query(
    "effect_map",
    """select l_orderkey, l_linenumber, l_partkey, case when not inside then 'outside'
      when effect < -5 then 'Less than -5' when effect < 5 then '-5 to  5' when effect < 15 then '5 to 15'
      when effect < 25 then '15 to 25' else 'More than 25' end as mark
    from (select l_orderkey, l_linenumber, l_partkey, l_tax >= 0.02 as inside,
      case when l_discount = 0 then null else l_quantity * (0.5 + l_tax * 10) - 20 end as effect from lineitem)""",
)
def effect_map(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_tax") >= 0.02, 1).otherwise(0).alias("aoa"),
        F.when(F.col("l_discount") != 0, F.col("l_quantity") * (0.5 + F.col("l_tax") * 10) - 20).alias("effect"),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("aoa") == 0, "outside").otherwise(m.bin_effect("effect")).alias("mark"),
    )
