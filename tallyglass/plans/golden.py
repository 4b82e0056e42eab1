"""Business questions over the star schema, one query per shape asked for."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyglass.plans.common import days, money, ratio, revenue
from tallyglass.plans.registry import query


def customer_nation(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))


def part_sales(t):
    """Revenue, lines, quantity per part: the fact table folds before it meets the dimension."""
    per = t.lineitem.groupBy("l_partkey").agg(F.sum(revenue()).alias("rev"), F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"))
    return per.join(t.part, F.col("l_partkey") == F.col("p_partkey"))


def spend(t):
    return t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))


def nation_orders(t):
    s = spend(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return s.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))


def supplier_sales(t):
    per = t.lineitem.groupBy("l_suppkey").agg(F.sum(revenue()).alias("rev"), F.count("*").alias("lines"))
    return per.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))


_REV = "sum(l_extendedprice * (1 - l_discount))"
_N = "CAST(count(*) AS BIGINT) AS n"


@query("golden_row_counts", " UNION ALL ".join(f"SELECT '{x}' AS name, {_N} FROM {x}" for x in ("customer", "part", "supplier", "orders", "lineitem")))
def _(t):
    out = None
    for x in ("customer", "part", "supplier", "orders", "lineitem"):
        d = getattr(t, x).agg(F.count("*").alias("n")).select(F.lit(x).alias("name"), "n")
        out = d if out is None else out.unionByName(d)
    return out


@query("golden_orders_of_a_year", f"SELECT {_N}, round(sum(o_totalprice), 4) AS total FROM orders WHERE year(o_orderdate) = 1997")
def _(t):
    return t.orders.where(days("o_orderdate", "1997-01-01", "1998-01-01")).agg(F.count("*").alias("n"), money(F.sum("o_totalprice")).alias("total"))


@query("golden_extremes", "SELECT max(o_totalprice) AS largest, strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, round(avg(l_extendedprice) / 60.0, 6) AS per_minute FROM orders, (SELECT avg(l_extendedprice) AS l_extendedprice FROM lineitem) GROUP BY l_extendedprice")
def _(t):
    o = t.orders.agg(F.max("o_totalprice").alias("largest"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("earliest"))
    return o.crossJoin(t.lineitem.agg(ratio(F.avg("l_extendedprice") / 60.0).alias("per_minute")))


@query("golden_count_of_one_value", "SELECT CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    return t.customer.where("c_mktsegment = 'BUILDING'").agg(F.count("*").alias("n"))


@query("golden_count_above", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 250000")
def _(t):
    return t.orders.where("o_totalprice > 250000").agg(F.count("*").alias("n"))


@query("golden_missing_values", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT nullif(o_orderpriority, '5-LOW') AS p FROM orders) WHERE p IS NULL")
def _(t):
    return t.orders.select(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("p")).where("p IS NULL").agg(F.count("*").alias("n"))


@query("golden_distinct_list", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey = 3")
def _(t):
    return t.customer.where("c_nationkey = 3").select("c_mktsegment").distinct()


@query("golden_lookup_by_name", "SELECT c_custkey, c_acctbal FROM customer WHERE c_name = 'Customer#000000042' AND c_nationkey IS NOT NULL")
def _(t):
    return t.customer.where("c_name = 'Customer#000000042' AND c_nationkey IS NOT NULL").select("c_custkey", "c_acctbal")


@query("golden_monthly_counts", f"SELECT strftime(o_orderdate, '%m') AS month, {_N} FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1 ORDER BY 1")
def _(t):
    o = t.orders.where(days("o_orderdate", "1996-01-01", "1997-01-01"))
    return o.groupBy(F.date_format("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n")).orderBy("month")


@query("golden_quarterly_revenue", "SELECT CAST((month(o_orderdate) + 2) // 3 AS INTEGER) AS quarter, round(sum(o_totalprice), 4) AS total FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1 ORDER BY 1")
def _(t):
    o = t.orders.where(days("o_orderdate", "1998-01-01", "1999-01-01"))
    return o.groupBy(F.quarter("o_orderdate").alias("quarter")).agg(money(F.sum("o_totalprice")).alias("total")).orderBy("quarter")


@query("golden_best_month", "SELECT strftime(o_orderdate, '%Y-%m') AS ym FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, ym LIMIT 1")
def _(t):
    m = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.sum("o_totalprice").alias("v"))
    return m.orderBy(F.desc("v"), "ym").limit(1).select("ym")


@query("golden_orders_per_nation_and_year", f"SELECT n_name, {_N} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) = 1999 GROUP BY 1")
def _(t):
    per = t.orders.where(days("o_orderdate", "1999-01-01", "2000-01-01")).groupBy("o_custkey").agg(F.count("*").alias("k"))
    j = customer_nation(t).join(per, F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("n_name").agg(F.sum("k").alias("n"))


@query("golden_average_by_group", "SELECT c_mktsegment, round(avg(o_totalprice), 4) AS avg_total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY avg_total DESC")
def _(t):
    j = spend(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(money(F.sum("total") / F.sum("n")).alias("avg_total")).orderBy(F.desc("avg_total"))


@query("golden_customers_of_one_nation", f"SELECT {_N} FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'")
def _(t):
    return customer_nation(t).where("n_name = 'NATION_7'").agg(F.count("*").alias("n"))


@query("golden_items_of_one_parent", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = 42")
def _(t):
    return t.lineitem.where("l_orderkey = 42").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("golden_lines_of_one_brand", f"SELECT {_N} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#3'")
def _(t):
    return t.lineitem.join(t.part.where("p_brand = 'Brand#3'"), F.col("l_partkey") == F.col("p_partkey")).agg(F.count("*").alias("n"))


@query("golden_distinct_buyers", "SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO'")
def _(t):
    li = t.lineitem.join(t.part.where("p_type = 'PROMO'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    buyers = t.orders.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_custkey").count()
    return buyers.agg(F.count("*").alias("n"))


@query("golden_sellers_of_a_type", "SELECT DISTINCT s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_type = 'LARGE' AND p_size = 50")
def _(t):
    li = t.lineitem.join(t.part.where("p_type = 'LARGE' AND p_size = 50"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return t.supplier.join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_name").distinct()


@query("golden_average_size_by_brand", "SELECT p_brand, round(avg(p_size), 6) AS avg_size, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(ratio(F.avg("p_size")).alias("avg_size"), F.count("*").alias("n"))


@query("golden_revenue_by_type", f"SELECT p_type, round({_REV}, 4) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(t):
    return part_sales(t).groupBy("p_type").agg(money(F.sum("rev")).alias("revenue"))


@query("golden_best_type", f"SELECT p_type FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY {_REV} DESC, p_type LIMIT 1")
def _(t):
    return part_sales(t).groupBy("p_type").agg(F.sum("rev").alias("r")).orderBy(F.desc("r"), "p_type").limit(1).select("p_type")


@query("golden_top_customers", "SELECT c_name, round(sum(o_totalprice), 4) AS spent FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name ORDER BY spent DESC, c_name LIMIT 5")
def _(t):
    # Five keys are found first; only they meet the customer table.
    top = spend(t).orderBy(F.desc("total"), "o_custkey").limit(5)
    return top.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_name", money("total").alias("spent")).orderBy(F.desc("spent"), "c_name")


@query("golden_top_nations", "SELECT n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY sum(o_totalprice) DESC LIMIT 3")
def _(t):
    return nation_orders(t).orderBy(F.desc("total"), "n_name").limit(3).select("n_name")


@query("golden_top_suppliers_with_minimum", f"SELECT s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name HAVING count(*) >= 590 ORDER BY avg(l_extendedprice * (1 - l_discount)) DESC LIMIT 3")
def _(t):
    s = supplier_sales(t).where("lines >= 590")
    return s.orderBy(F.desc(F.col("rev") / F.col("lines")), "s_name").limit(3).select("s_name")


@query("golden_handled_sales_in_a_year", "SELECT n_name, round(sum(o_totalprice), 4) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) = 1995 GROUP BY 1 ORDER BY total DESC LIMIT 1")
def _(t):
    per = t.orders.where(days("o_orderdate", "1995-01-01", "1996-01-01")).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    j = per.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("v").alias("v"))
    j = j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("n_name", money("v").alias("total")).orderBy(F.desc("total")).limit(1)


@query("golden_big_spenders", "SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name HAVING sum(o_totalprice) > 3500000")
def _(t):
    return t.customer.join(spend(t).where("total > 3500000"), F.col("c_custkey") == F.col("o_custkey")).select("c_name")


@query("golden_buyers_from_many_suppliers", "SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey, c_name HAVING count(DISTINCT l_suppkey) > 40")
def _(t):
    pairs = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    many = pairs.groupBy("o_custkey", "l_suppkey").count().groupBy("o_custkey").agg(F.count("*").alias("k")).where("k > 40")
    return t.customer.join(many, F.col("c_custkey") == F.col("o_custkey")).select("c_name")


@query("golden_orders_with_many_lines", f"SELECT {_N} FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 6)")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k")).where("k > 6").agg(F.count("*").alias("n"))


@query("golden_orders_with_one_line", f"SELECT {_N} FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k")).where("k = 1").agg(F.count("*").alias("n"))


@query("golden_suppliers_of_several_types", f"SELECT {_N} FROM (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT p_type) > 5)")
def _(t):
    pairs = t.lineitem.select("l_suppkey", "l_partkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    k = pairs.groupBy("l_suppkey", "p_type").count().groupBy("l_suppkey").agg(F.count("*").alias("k"))
    return k.where("k > 5").agg(F.count("*").alias("n"))


@query("golden_suppliers_per_brand", "SELECT p_brand, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(t):
    pairs = t.lineitem.select("l_suppkey", "l_partkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return pairs.groupBy("p_brand", "l_suppkey").count().groupBy("p_brand").agg(F.count("*").alias("suppliers"))


@query("golden_never_bought_a_type", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type = 'SMALL' AND p_size > 20)")
def _(t):
    li = t.lineitem.join(t.part.where("p_type = 'SMALL' AND p_size > 20"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    buyers = t.orders.where("o_custkey IS NOT NULL").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return t.customer.join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("golden_parts_not_sold_in_a_year", f"SELECT {_N} FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1999)")
def _(t):
    sold = t.lineitem.where(days("l_shipdate", "1999-01-01", "2000-01-01")).where("l_partkey IS NOT NULL")
    return t.part.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_anti").agg(F.count("*").alias("n"))


@query("golden_share_of_one_group", "SELECT round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS pct FROM lineitem")
def _(t):
    p = F.col("l_extendedprice")
    return t.lineitem.agg(ratio(100.0 * F.sum(F.when(F.col("l_returnflag") == "R", p).otherwise(0)) / F.sum(p)).alias("pct"))


@query("golden_share_per_group", "SELECT p_type, round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS pct FROM part GROUP BY 1")
def _(t):
    g = t.part.groupBy("p_type").agg(F.count("*").alias("n"))
    return g.crossJoin(g.agg(F.sum("n").alias("all"))).select("p_type", ratio(100.0 * F.col("n") / F.col("all")).alias("pct"))


@query("golden_active_every_year", f"SELECT {_N} FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 2000 GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) = 5)")
def _(t):
    y = t.orders.where(days("o_orderdate", "1996-01-01", "2001-01-01")).groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("k"))
    return y.where("k = 5").agg(F.count("*").alias("n"))


@query("golden_sales_per_nation_and_year", "SELECT n_name, strftime(o_orderdate, '%Y') AS year, round(sum(o_totalprice), 4) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(t):
    per = t.orders.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    j = per.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "year").agg(F.sum("v").alias("v"))
    return j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "year", money("v").alias("total")).orderBy("n_name", "year")


@query("golden_best_brand_per_region", f"""WITH g AS (SELECT r_name, p_brand, {_REV} AS rev FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_name, p_brand FROM (SELECT *, rank() OVER (PARTITION BY r_name ORDER BY rev DESC) AS rk FROM g) WHERE rk = 1""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_partkey", revenue().alias("rev")).join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    per = li.groupBy("l_orderkey", "p_brand").agg(F.sum("rev").alias("rev"))
    g = (per.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
         .groupBy("c_nationkey", "p_brand").agg(F.sum("rev").alias("rev"))
         .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
         .groupBy("r_name", "p_brand").agg(F.sum("rev").alias("rev")))
    w = Window.partitionBy("r_name").orderBy(F.desc("rev"))
    return g.withColumn("rk", F.rank().over(w)).where("rk = 1").select("r_name", "p_brand")


@query("golden_supplier_nation_hierarchy", "SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_name", "n_name", "r_name"))


@query("golden_customers_per_nation_with_zero", "SELECT n_name, CAST(count(c_custkey) AS BIGINT) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9500 GROUP BY n_nationkey, n_name")
def _(t):
    per = t.customer.where("c_acctbal > 9500").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    return t.nation.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("k", F.lit(0)).alias("n"))
