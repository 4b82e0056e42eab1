"""Joins (JN). No broadcast is forced: Spark sizes each side and picks the strategy."""

from pyspark.sql import functions as F

from tallyglass.plans.common import days, money, ratio, revenue
from tallyglass.plans.registry import query


def sales(t):
    """lineitem with its order and customer."""
    li = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))


@query("jn_1_inner_two_way", """
SELECT n_name, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 4) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def _(t):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("customers"), money(F.sum("c_acctbal")).alias("balance"))


@query("jn_2_region_revenue", """
SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name ORDER BY revenue DESC LIMIT 3""")
def region_revenue(t):
    # One line per order first: the fact table shrinks before it meets orders.
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(revenue()).alias("rev"))
    o = t.orders.select("o_orderkey", "o_custkey")
    by_nation = (per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                 .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
                 .groupBy("c_nationkey").agg(F.sum("rev").alias("rev")))
    j = (by_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    return (j.groupBy("r_name").agg(money(F.sum("rev")).alias("revenue"))
            .orderBy(F.desc("revenue"), "r_name").limit(3))


@query("jn_3_self_join", """
SELECT a.n_name AS nation, b.n_name AS peer, r_name FROM nation a
JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
JOIN region ON a.n_regionkey = r_regionkey""")
def _(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    j = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    j = j.join(t.region, F.col("a.n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("a.n_name").alias("nation"), F.col("b.n_name").alias("peer"), "r_name")


@query("jn_4_dimension_in_two_roles", """
SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN nation sn ON s_nationkey = sn.n_nationkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2""")
def _(t):
    li = t.lineitem.where(days("l_shipdate", "1996-01-01", "1997-01-01"))
    j = (li.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
         .groupBy("c_nationkey", "s_nationkey").agg(F.sum(revenue()).alias("rev")))
    cn = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))
    sn = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    return (j.join(cn, "c_nationkey").join(sn, "s_nationkey")
            .select("customer_nation", "supplier_nation", money("rev").alias("revenue")))


@query("jn_5_left_outer_zero_groups", """
SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS lines FROM orders
LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def _(t):
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    j = t.orders.select("o_orderkey").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("jn_6_anti_join", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def _(t):
    li = t.lineitem.where(F.col("l_orderkey").isNotNull())
    return t.orders.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_totalprice")


@query("jn_7_semi_join_all_of", """
SELECT o_custkey, CAST(count(DISTINCT p_type) AS BIGINT) AS types FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'LARGE') GROUP BY o_custkey
HAVING count(DISTINCT p_type) = 2""")
def _(t):
    p = t.part.where(F.col("p_type").isin("PROMO", "LARGE"))
    j = t.lineitem.join(p, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_custkey").agg(F.count_distinct("p_type").alias("types")).where("types = 2")


@query("jn_7_semi_join_membership", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)""")
def _(t):
    big = t.orders.where("o_totalprice > 480000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("jn_8_derived_aggregate", """
SELECT n_name, round(avg(total), 4) AS avg_spend FROM nation JOIN (
  SELECT c_nationkey, c_custkey, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey
  GROUP BY c_nationkey, c_custkey) s ON s.c_nationkey = n_nationkey GROUP BY n_name""")
def _(t):
    spend = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    per_nation = (t.customer.join(spend, F.col("c_custkey") == F.col("o_custkey"))
                  .groupBy("c_nationkey").agg(money(F.avg("total")).alias("avg_spend")))
    return t.nation.join(per_nation, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "avg_spend")


@query("jn_9_scalar_subquery", """
WITH s AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT CAST(count(*) AS BIGINT) AS above_average FROM s WHERE total > (SELECT avg(total) FROM s)""")
def _(t):
    s = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    # The right side is a global aggregate: exactly one row.
    return s.crossJoin(s.agg(F.avg("total").alias("mean"))).where("total > mean").agg(F.count("*").alias("above_average"))


@query("jn_15_cross_product", """
SELECT r_name, CAST(k AS INTEGER) AS k, CAST(count(*) FILTER (WHERE n_nationkey >= k) AS BIGINT) AS nations
FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT unnest([0, 5, 10, 15, 20]) AS k) ks GROUP BY 1, 2""")
def _(t):
    # A fixed grid of cut-offs against the rows: exploded per row, so no join at all.
    j = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    j = j.select("r_name", "n_nationkey", F.explode(F.array(*[F.lit(k) for k in (0, 5, 10, 15, 20)])).alias("k"))
    return j.groupBy("r_name", "k").agg(F.count_if(F.col("n_nationkey") >= F.col("k")).alias("nations"))


@query("jn_9_share_of_customers", """
SELECT round(100.0 * count(*) / (SELECT count(*) FROM customer), 6) AS pct FROM (
  SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2500000)""")
def _(t):
    big = (t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).where("total > 2500000")
           .agg(F.count("*").alias("big")))
    n = t.customer.agg(F.count("*").alias("n"))
    return big.crossJoin(n).select(ratio(100.0 * F.col("big") / F.col("n")).alias("pct"))
