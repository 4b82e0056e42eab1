"""Date-pruned questions over a large fact table (events and orders stand in for trips)."""

from pyspark.sql import functions as F

from tallyglass.plans.common import days, money, ratio, revenue
from tallyglass.plans.registry import query


def between(col, a, b):
    return f"{col} >= TIMESTAMP '{a}' AND {col} < TIMESTAMP '{b}'"


_WEEK = between("ts", "2024-01-08", "2024-01-15")
_MONTH = between("o_orderdate", "1997-05-01", "1997-06-01")


def week(t):
    return t.events.where(days("ts", "2024-01-08", "2024-01-15"))


def month_orders(t):
    return t.orders.where(days("o_orderdate", "1997-05-01", "1997-06-01"))


def by_nation(t, orders):
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("v"))
    j = per.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("k").alias("n"), F.sum("v").alias("total"))
    return j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))


@query("warehouse_count_on_a_day", "SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE " + between("ts", "2024-01-05", "2024-01-06"))
def _(t):
    return t.events.where(days("ts", "2024-01-05", "2024-01-06")).agg(F.count("*").alias("n"))


@query("warehouse_range_aggregates", f"SELECT round(avg(value), 6) AS mean, round(sum(value), 4) AS total, max(value) AS top, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events WHERE {_WEEK}")
def _(t):
    return week(t).agg(ratio(F.avg("value")).alias("mean"), money(F.sum("value")).alias("total"), F.max("value").alias("top"), F.count_distinct("user_id").alias("users"))


@query("warehouse_whole_range", "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events")
def _(t):
    return t.events.agg(F.count("*").alias("n"), money(F.sum("value")).alias("total"))


@query("warehouse_per_day", f"SELECT strftime(ts, '%Y-%m-%d') AS d, CAST(count(*) AS BIGINT) AS n FROM events WHERE {_WEEK} GROUP BY 1 ORDER BY 1")
def _(t):
    return week(t).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.count("*").alias("n")).orderBy("d")


@query("warehouse_per_month", "SELECT CAST(month(o_orderdate) AS INTEGER) AS m, round(sum(o_totalprice), 4) AS total FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1 ORDER BY 1")
def _(t):
    o = t.orders.where(days("o_orderdate", "1997-01-01", "1998-01-01"))
    return o.groupBy(F.month("o_orderdate").alias("m")).agg(money(F.sum("o_totalprice")).alias("total")).orderBy("m")


@query("warehouse_half_year_counts", "SELECT CAST(month(o_orderdate) AS INTEGER) AS m, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01' AND o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def _(t):
    return t.orders.where(days("o_orderdate", "1998-01-01", "1998-07-01")).groupBy(F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))


@query("warehouse_percentage_of_a_code", f"SELECT round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / count(*), 6) AS purchases, round(100.0 * count(*) FILTER (WHERE event_type = 'view') / count(*), 6) AS views FROM events WHERE {_WEEK}")
def _(t):
    share = lambda c: ratio(F.try_divide(100.0 * F.count_if(F.col("event_type") == c), F.count("*")))
    return week(t).agg(share("purchase").alias("purchases"), share("view").alias("views"))


@query("warehouse_mean_of_ratios", "SELECT round(100.0 * avg(l_tax / l_discount), 6) AS pct FROM lineitem WHERE " + between("l_shipdate", "1998-03-01", "1998-04-01") + " AND l_discount > 0 AND l_returnflag = 'A'")
def _(t):
    li = t.lineitem.where(days("l_shipdate", "1998-03-01", "1998-04-01")).where("l_discount > 0 AND l_returnflag = 'A'")
    return li.agg(ratio(100.0 * F.avg(F.col("l_tax") / F.col("l_discount"))).alias("pct"))


@query("warehouse_mean_of_ratios_by_nation", "SELECT round(100 * avg(l_tax / l_discount), 6) AS pct FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_4' AND l_discount > 0")
def _(t):
    s = t.supplier.join(t.nation.where("n_name = 'NATION_4'"), F.col("s_nationkey") == F.col("n_nationkey"))
    li = t.lineitem.where("l_discount > 0").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return li.agg(ratio(100 * F.avg(F.col("l_tax") / F.col("l_discount"))).alias("pct"))


@query("warehouse_unit_price", "SELECT round(avg(l_extendedprice / l_quantity), 6) AS unit FROM lineitem WHERE " + between("l_shipdate", "1999-11-01", "1999-12-01") + " AND l_quantity > 1")
def _(t):
    li = t.lineitem.where(days("l_shipdate", "1999-11-01", "1999-12-01")).where("l_quantity > 1")
    return li.agg(ratio(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).alias("unit"))


@query("warehouse_busiest_hour", f"SELECT CAST(hour(ts) AS INTEGER) AS h FROM events WHERE {_WEEK} GROUP BY 1 ORDER BY count(*) DESC, h LIMIT 1")
def _(t):
    return week(t).groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h").limit(1).select("h")


@query("warehouse_best_hour_by_average", f"SELECT CAST(hour(ts) AS INTEGER) AS h FROM events WHERE {_WEEK} AND event_type = 'purchase' GROUP BY 1 ORDER BY avg(value) DESC, h LIMIT 1")
def _(t):
    g = week(t).where("event_type = 'purchase'").groupBy(F.hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    return g.orderBy(F.desc("v"), "h").limit(1).select("h")


@query("warehouse_quietest_day", "SELECT strftime(ts, '%Y-%m-%d') AS d FROM events GROUP BY 1 ORDER BY count(*), d LIMIT 1")
def _(t):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.count("*").alias("n")).orderBy("n", "d").limit(1).select("d")


@query("warehouse_most_frequent_code", "SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(1).select("event_type")


@query("warehouse_weekend_average", "SELECT round(avg(value), 6) AS mean FROM events WHERE dayofweek(ts) IN (0, 6)")
def _(t):
    return t.events.where(F.dayofweek("ts").isin(1, 7)).agg(ratio(F.avg("value")).alias("mean"))


@query("warehouse_long_pauses", "WITH g AS (SELECT date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS s FROM events) SELECT CAST(count(*) AS BIGINT) AS n FROM g WHERE s > 7200")
def _(t):
    # Pauses longer than two hours between a user's events, whole seconds apart.
    from tallyglass.operators import history
    sec = t.events.select("user_id", F.date_trunc("second", "ts").alias("s"))
    g = history.gaps(sec, ["user_id"], "s").where("gap_us > 7200000000")
    return g.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"))


@query("warehouse_edge_values", "SELECT CAST(count(*) FILTER (WHERE l_tax = 0) AS BIGINT) AS zero, CAST(count(*) FILTER (WHERE l_extendedprice < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (WHERE l_quantity > 45) AS BIGINT) AS large, round(avg(l_extendedprice) FILTER (WHERE l_quantity > 45), 4) AS large_price FROM lineitem")
def _(t):
    q = F.col("l_quantity") > 45
    return t.lineitem.agg(F.count_if(F.col("l_tax") == 0).alias("zero"), F.count_if(F.col("l_extendedprice") < 0).alias("negative"),
                          F.count_if(q).alias("large"), money(F.avg(F.when(q, F.col("l_extendedprice")))).alias("large_price"))


@query("warehouse_same_zone", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE " + between("l_shipdate", "1997-01-01", "1997-02-01") + " AND c_nationkey = s_nationkey")
def _(t):
    li = t.lineitem.where(days("l_shipdate", "1997-01-01", "1997-02-01")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    j = li.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.where("c_nationkey = s_nationkey").agg(F.count("*").alias("n"))


@query("warehouse_two_roles", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE r_name = 'ASIA' AND sn.n_name = 'NATION_4' AND " + between("l_shipdate", "1996-01-01", "1999-01-01"))
def _(t):
    sup = t.supplier.join(t.nation.where("n_name = 'NATION_4'"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    asia = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    cust = t.customer.join(asia, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    li = t.lineitem.where(days("l_shipdate", "1996-01-01", "1999-01-01")).join(sup, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    o = t.orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count("*").alias("n"))


@query("warehouse_top_zones", f"SELECT n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE {_MONTH} GROUP BY 1 ORDER BY count(*) DESC, n_name LIMIT 5")
def _(t):
    return by_nation(t, month_orders(t)).orderBy(F.desc("n"), "n_name").limit(5).select("n_name")


@query("warehouse_breakdown_by_borough", f"SELECT r_name, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {_MONTH} GROUP BY 1")
def _(t):
    j = by_nation(t, month_orders(t)).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.sum("n").alias("n"))


@query("warehouse_top_boroughs_by_amount", "SELECT r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE " + between("o_orderdate", "1997-01-01", "1997-04-01") + " GROUP BY 1 ORDER BY sum(o_totalprice) DESC LIMIT 3")
def _(t):
    j = by_nation(t, t.orders.where(days("o_orderdate", "1997-01-01", "1997-04-01"))).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.sum("total").alias("v")).orderBy(F.desc("v"), "r_name").limit(3).select("r_name")


@query("warehouse_one_zone_average", f"SELECT round(avg(o_totalprice), 4) AS mean, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE {_MONTH} AND n_name = 'NATION_9'")
def _(t):
    j = by_nation(t, month_orders(t)).where("n_name = 'NATION_9'")
    return j.agg(money(F.sum("total") / F.sum("n")).alias("mean"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("warehouse_average_by_code", f"SELECT event_type, round(avg(value), 6) AS mean FROM events WHERE {_WEEK} AND event_type IN ('purchase', 'view') GROUP BY 1")
def _(t):
    return week(t).where(F.col("event_type").isin("purchase", "view")).groupBy("event_type").agg(ratio(F.avg("value")).alias("mean"))


@query("warehouse_revenue_by_region", "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE " + between("l_shipdate", "1998-01-01", "1999-01-01") + " GROUP BY 1")
def _(t):
    per = t.lineitem.where(days("l_shipdate", "1998-01-01", "1999-01-01")).groupBy("l_suppkey").agg(F.sum(revenue()).alias("rev"))
    j = (per.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
         .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    return j.groupBy("r_name").agg(money(F.sum("rev")).alias("revenue"))
