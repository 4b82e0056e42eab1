"""Chart data (VIZ)."""

from pyspark.sql import functions as F

from tallyglass.operators import charts
from tallyglass.plans.common import money, ratio
from tallyglass.plans.registry import query


@query("viz_1_histogram", """
WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / w), 19) AS INTEGER) AS bin, round(lo + least(floor((o_totalprice - lo) / w), 19) * w, 4) AS low, CAST(count(*) AS BIGINT) AS n FROM orders, e GROUP BY 1, 2""")
def _(t):
    return charts.histogram(t.orders, "o_totalprice").select("bin", money("low").alias("low"), "n")


@query("viz_2_shares", """
SELECT o_orderpriority, round(sum(o_totalprice), 4) AS total, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share,
 (SELECT count(DISTINCT o_orderpriority) FROM orders) <= 8 AS pie_ok FROM orders GROUP BY 1""")
def _(t):
    s = charts.shares(t.orders, "o_orderpriority", "o_totalprice")
    return s.select("o_orderpriority", money("total").alias("total"), ratio("share").alias("share"), "pie_ok")


@query("viz_3_scale_spread", "SELECT round(max(l_extendedprice) / max(l_discount), 6) AS spread, max(l_extendedprice) / max(l_discount) > 10 AS separate_panels FROM lineitem")
def _(t):
    return charts.scale_spread(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).select(ratio("spread").alias("spread"), "separate_panels")


@query("viz_4_composite_label", "SELECT p_type || ' · ' || p_size AS label, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy(charts.x_label("p_type", "p_size").alias("label")).agg(F.count("*").alias("n"))


@query("viz_5_year_like", """
SELECT 'year' AS "column", bool_and(year(o_orderdate) BETWEEN 1900 AND 2100) AS year_like FROM orders
UNION ALL SELECT 'text_year', true UNION ALL SELECT 'o_orderpriority', false UNION ALL SELECT 'o_orderkey', false""")
def _(t):
    o = t.orders.select(F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy").alias("text_year"), "o_orderpriority", "o_orderkey")
    return charts.year_like(o, o.columns)
