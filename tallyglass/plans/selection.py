"""Projection, filters, predicates (SEL)."""

from pyspark.sql import functions as F

from tallyglass.operators import present
from tallyglass.plans.common import days, money, ratio, revenue
from tallyglass.plans.registry import query


@query("sel_1_projection", "SELECT n_nationkey AS id, n_name AS nation, n_regionkey AS region_id FROM nation")
def _(t):
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nation"),
                           F.col("n_regionkey").alias("region_id"))


@query("sel_2_equality_and_range", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000""")
def _(t):
    o = t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000))
    return o.select("o_orderkey", "o_totalprice")


@query("sel_3_null_predicates", """
WITH c AS (SELECT nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)
SELECT CAST(count(*) FILTER (WHERE seg IS NULL) AS BIGINT) AS missing,
       CAST(count(*) FILTER (WHERE seg IS NOT NULL) AS BIGINT) AS present FROM c""")
def _(t):
    seg = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.agg(F.count_if(seg.isNull()).alias("missing"), F.count_if(seg.isNotNull()).alias("present"))


@query("sel_4_conjunction_and_in", """
SELECT p_partkey, p_name, p_size FROM part
WHERE p_type IN ('PROMO', 'SMALL') AND p_brand = 'Brand#3' AND p_size >= 10""")
def _(t):
    p = t.part.where(F.col("p_type").isin("PROMO", "SMALL") & (F.col("p_brand") == "Brand#3") & (F.col("p_size") >= 10))
    return p.select("p_partkey", "p_name", "p_size")


@query("sel_5_between_dates", """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS avg_total FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'""")
def _(t):
    o = t.orders.where(days("o_orderdate", "1996-03-01", "1996-04-01"))
    return o.agg(F.count("*").alias("n"), money(F.avg("o_totalprice")).alias("avg_total"))


@query("sel_6_column_to_column", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey = l_suppkey""")
def _(t):
    return t.lineitem.where(F.col("l_partkey") == F.col("l_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("sel_7_arithmetic", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
       round(l_quantity / 7, 6) AS weeks FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             ratio(revenue() * (1 + F.col("l_tax"))).alias("charge"),
                             ratio(F.col("l_quantity") / 7).alias("weeks"))


@query("sel_8_conditional", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium'
       ELSE 'small' END AS band, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done FROM orders""")
def _(t):
    total = F.col("o_totalprice")
    band = F.when(total > 300000, "large").when(total > 100000, "medium").otherwise("small")
    done = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return t.orders.select("o_orderkey", band.alias("band"), done.alias("done"))


@query("sel_9_safe_divide", """
SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_discount = 0) AS BIGINT) AS undefined_rows,
       round(avg(CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END), 6) AS tax_per_discount
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    q = F.try_divide("l_tax", "l_discount")
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(q.isNull()).alias("undefined_rows"),
                                                  ratio(F.avg(q)).alias("tax_per_discount"))


@query("sel_10_result_finishing", """
SELECT p_type, round(avg(p_retailprice), 2) AS avg_price FROM part GROUP BY p_type ORDER BY avg_price DESC""")
def _(t):
    return present.finish(t.part.groupBy("p_type").agg(F.avg("p_retailprice").alias("avg_price")))


@query("sel_11_midnight_timestamps", """
SELECT 'o_orderdate' AS "column", bool_and(date_trunc('day', o_orderdate) = o_orderdate) AS date_only FROM orders
UNION ALL SELECT 'ts', bool_and(date_trunc('day', ts) = ts) FROM events""")
def _(t):
    return present.midnight_columns(t.orders).unionByName(present.midnight_columns(t.events))


@query("sel_12_null_safe_preview", """
SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE value END AS value,
       (SELECT count(*) FROM events) AS row_count FROM events ORDER BY event_id LIMIT 50""")
def _(t):
    v = F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value"))
    return present.preview(t.events.select("event_id", v.alias("value")), ["event_id"])
