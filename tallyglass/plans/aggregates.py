"""Aggregation (AGG)."""

from pyspark.sql import functions as F

from tallyglass.operators import stats, summary
from tallyglass.plans.common import money, ratio, revenue
from tallyglass.plans.registry import query


@query("agg_1_global", """
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 4) AS mean,
       min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders""")
def _(t):
    c = "o_totalprice"
    return t.orders.agg(F.count("*").alias("n"), money(F.sum(c)).alias("total"), money(F.avg(c)).alias("mean"),
                        F.min(c).alias("low"), F.max(c).alias("high"))


@query("agg_2_grouped", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS qty,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_discount), 6) AS avg_discount,
       CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        money(F.sum("l_quantity")).alias("qty"), money(F.sum(revenue())).alias("revenue"),
        ratio(F.avg("l_discount")).alias("avg_discount"), F.count("*").alias("n"))


@query("agg_3_having", """
SELECT c_nationkey, CAST(count(*) AS BIGINT) AS customers FROM customer GROUP BY c_nationkey HAVING count(*) > 60""")
def _(t):
    return t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers")).where("customers > 60")


@query("agg_4_count_distinct", """
SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts,
       CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY l_returnflag""")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"),
                                                  F.count_distinct("l_suppkey").alias("suppliers"))


@query("agg_4_distinct_under_having", """
SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey FROM orders GROUP BY o_custkey
HAVING count(DISTINCT year(o_orderdate)) = 7)""")
def _(t):
    years = t.orders.groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("years"))
    return years.where("years = 7").agg(F.count("*").alias("n"))


@query("agg_5_conditional_percentage", """
SELECT p_type, round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 6) AS pct_returned
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""")
def _(t):
    # Counts per part travel, not lines.
    per_part = t.lineitem.groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"),
                                                   F.count("*").alias("n"))
    j = per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_type").agg(ratio(F.try_divide(100.0 * F.sum("r"), F.sum("n"))).alias("pct_returned"))


@query("agg_6_ratio_of_aggregates_and_mean_of_ratios", """
SELECT round(count(*) * 1.0 / count(DISTINCT l_orderkey), 6) AS lines_per_order,
       round(avg(l_extendedprice / l_quantity), 6) AS mean_unit_price,
       round(sum(l_extendedprice) / sum(l_quantity), 6) AS overall_unit_price FROM lineitem""")
def _(t):
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    # Per order first: a count of groups replaces one huge distinct.
    per = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(price / qty).alias("unit"),
                                               F.sum(price).alias("p"), F.sum(qty).alias("q"))
    return per.agg(ratio(F.sum("n") / F.count("*")).alias("lines_per_order"),
                   ratio(F.sum("unit") / F.sum("n")).alias("mean_unit_price"),
                   ratio(F.sum("p") / F.sum("q")).alias("overall_unit_price"))


@query("agg_7_two_level", """
SELECT n_name, round(max(total), 4) AS top_spend FROM (
  SELECT c_nationkey, c_custkey, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey
  GROUP BY 1, 2) s JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def _(t):
    spend = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    j = t.customer.join(spend, F.col("c_custkey") == F.col("o_custkey"))
    top = j.groupBy("c_nationkey").agg(money(F.max("total")).alias("top_spend"))
    return top.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "top_spend")


@query("agg_8_cross_tab", """
SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 4) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def _(t):
    per = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    j = per.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    j = j.groupBy("c_nationkey", "year").agg(money(F.sum("v")).alias("total"))
    return j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "year", "total")


@query("agg_9_calendar_buckets", """
SELECT 'year' AS unit, strftime(o_orderdate, '%Y') AS bucket, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'quarter', strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate), count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'hour', strftime(ts, '%H'), count(*) FROM events GROUP BY 2""")
def _(t):
    d = F.col("o_orderdate")
    o = t.orders.select(F.explode(F.array(
        F.struct(F.lit("year").alias("unit"), F.date_format(d, "yyyy").alias("bucket")),
        F.struct(F.lit("quarter").alias("unit"), F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d)).alias("bucket")),
        F.struct(F.lit("month").alias("unit"), F.date_format(d, "yyyy-MM").alias("bucket")))).alias("b"))
    e = t.events.select(F.explode(F.array(
        F.struct(F.lit("day").alias("unit"), F.date_format("ts", "yyyy-MM-dd").alias("bucket")),
        F.struct(F.lit("hour").alias("unit"), F.date_format("ts", "HH").alias("bucket")))).alias("b"))
    both = [x.select("b.*").groupBy("unit", "bucket").agg(F.count("*").alias("n")) for x in (o, e)]
    return both[0].unionByName(both[1])


@query("agg_10_statistical", """
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(stddev_samp(l_extendedprice), 4) AS sd,
       round(stddev_pop(l_extendedprice), 4) AS sd_pop, round(var_samp(l_quantity), 4) AS var_qty,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    p = "l_extendedprice"
    moments = t.lineitem.groupBy("l_returnflag").agg(
        ratio(stats.pearson(F.col("l_quantity"), F.col(p))).alias("r"), money(F.stddev_samp(p)).alias("sd"),
        money(F.stddev_pop(p)).alias("sd_pop"), money(F.var_samp("l_quantity")).alias("var_qty"))
    q = summary.exact_quantiles(t.lineitem, ["l_returnflag"], p, {"median": 0.5, "p90": 0.9})
    return moments.join(q, "l_returnflag").select(*moments.columns, money("median").alias("median"), money("p90").alias("p90"))


@query("agg_13_numeric_describe", """
SELECT 'o_totalprice' AS "column", CAST(count(o_totalprice) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean,
       round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, .25), 4) AS q1,
       round(quantile_cont(o_totalprice, .5), 4) AS median, round(quantile_cont(o_totalprice, .75), 4) AS q3,
       max(o_totalprice) AS high FROM orders
UNION ALL
SELECT 'o_custkey', count(o_custkey), round(avg(o_custkey), 4), round(stddev_samp(o_custkey), 4), min(o_custkey),
       round(quantile_cont(o_custkey, .25), 4), round(quantile_cont(o_custkey, .5), 4),
       round(quantile_cont(o_custkey, .75), 4), max(o_custkey) FROM orders""")
def _(t):
    d = summary.describe(t.orders, ["o_totalprice", "o_custkey"])
    return d.select("column", "n", *[money(c).alias(c) for c in ("mean", "sd", "low", "q1", "median", "q3", "high")])
