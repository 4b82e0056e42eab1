"""Sort, limit, top-k, set operations (TOP, SET)."""

from pyspark.sql import functions as F

from tallyglass.operators import ties
from tallyglass.plans.common import money, revenue
from tallyglass.plans.registry import query


@query("top_1_order_by_aggregate", """
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment""")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_mktsegment")


@query("top_2_top_k_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("top_2_top_k_groups", """
SELECT s_suppkey, s_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem
JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY revenue DESC, s_suppkey LIMIT 5""")
def _(t):
    per = t.lineitem.groupBy("l_suppkey").agg(money(F.sum(revenue())).alias("revenue"))
    j = per.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select("s_suppkey", "s_name", "revenue").orderBy(F.desc("revenue"), "s_suppkey").limit(5)


@query("top_3_limit_and_offset", "SELECT DISTINCT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 1 OFFSET 1")
def _(t):
    return t.orders.select("o_totalprice").distinct().orderBy(F.desc("o_totalprice")).offset(1).limit(1)


@query("top_4_limit_tie", """
WITH r AS (SELECT p_size, row_number() OVER (ORDER BY p_size DESC) - 1 AS i FROM part)
SELECT 9 AS last_row, (SELECT p_size FROM r WHERE i = 9) = (SELECT p_size FROM r WHERE i = 10) AS tie""")
def _(t):
    return ties.limit_tie(t.part, [F.desc("p_size")], ["p_size"], 10)


@query("top_4_group_limit_ties", """
WITH r AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rn FROM part)
SELECT p_brand FROM r WHERE rn IN (3, 4) GROUP BY p_brand HAVING count(*) = 2 AND count(DISTINCT p_size) = 1""")
def _(t):
    return ties.group_limit_ties(t.part, ["p_brand"], [F.desc("p_size")], ["p_size"], 3)


@query("top_4_rank_ties", """
WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rk FROM part)
SELECT p_brand, CAST(count(*) AS BIGINT) AS winners FROM r WHERE rk = 1 GROUP BY p_brand HAVING count(*) > 1""")
def _(t):
    return ties.rank_ties(t.part, ["p_brand"], [F.desc("p_size")])


@query("top_5_most_frequent_values", """
SELECT p_name, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name ORDER BY n DESC, p_name LIMIT 5""")
def _(t):
    g = t.part.where("p_name IS NOT NULL").groupBy("p_name").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "p_name").limit(5)


@query("set_1_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return t.part.select("p_brand", "p_type").distinct()


@query("set_2_set_operations", """
SELECT 'union' AS op, c_nationkey AS k FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'union_all', c_nationkey FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', c_nationkey FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("k"))
    b = t.supplier.select(F.col("s_nationkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, d in parts.items():
        d = d.select(F.lit(name).alias("op"), "k")
        out = d if out is None else out.unionByName(d)
    return out


@query("set_3_recursive_calendar", """
WITH RECURSIVE d(day) AS (SELECT date_trunc('day', min(ts)) FROM events
  UNION ALL SELECT day + INTERVAL 1 DAY FROM d WHERE day < (SELECT date_trunc('day', max(ts)) FROM events))
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(count(event_id) AS BIGINT) AS n
FROM d LEFT JOIN events ON date_trunc('day', ts) = day GROUP BY 1""")
def _(t):
    # A recursive day list is a sequence in Spark: no iteration.
    day = F.date_trunc("day", "ts").cast("date")
    per = t.events.groupBy(day.alias("d")).agg(F.count("*").alias("n"))
    cal = t.events.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias("d"))
    return cal.join(per, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("set_4_key_overlap", """
SELECT DISTINCT l.doc_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.lang = 'en'""")
def _(t):
    a = t.labels.select("doc_id")
    b = t.documents.where("lang = 'en'").select("doc_id")
    return a.intersect(b)
