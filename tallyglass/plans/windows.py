"""Windows (WIN). Windows without a partition only ever run over small aggregates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyglass.operators import history, pareto
from tallyglass.plans.common import money, ratio, revenue
from tallyglass.plans.registry import query


def yearly_revenue(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("rev"))


@query("win_1_lag_delta", """
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS rev FROM orders GROUP BY 1),
d AS (SELECT year, rev - lag(rev) OVER (ORDER BY year) AS change FROM y)
SELECT year, round(change, 4) AS change FROM d WHERE change IS NOT NULL""")
def _(t):
    w = Window.orderBy("year")  # one row per calendar year
    d = yearly_revenue(t).withColumn("change", F.col("rev") - F.lag("rev").over(w))
    return d.where("change IS NOT NULL").select("year", money("change").alias("change")).orderBy("year")


@query("win_2_running_total", """
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS rev FROM orders GROUP BY 1)
SELECT year, round(sum(rev) OVER (ORDER BY year), 4) AS running FROM y""")
def _(t):
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return yearly_revenue(t).select("year", money(F.sum("rev").over(w)).alias("running")).orderBy("year")


@query("win_3_rank_top_per_partition", """
WITH g AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, p_type, sum(l_extendedprice * (1 - l_discount)) AS rev
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY rev DESC) AS rk FROM g)
SELECT year, p_type, round(rev, 4) AS revenue FROM r WHERE rk = 1""")
def _(t):
    per_part = t.lineitem.groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(F.sum(revenue()).alias("rev"))
    g = (per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
         .groupBy("year", "p_type").agg(F.sum("rev").alias("rev")))
    w = Window.partitionBy("year").orderBy(F.desc("rev"))
    return (g.withColumn("rk", F.rank().over(w)).where("rk = 1")
            .select("year", "p_type", money("rev").alias("revenue")).orderBy("year", "p_type"))


@query("win_4_median_gap", """
WITH g AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events)
SELECT event_type, round(quantile_cont(gap / 1000000.0, 0.5), 6) AS median_gap_s FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def _(t):
    return history.median_gap(t.events, ["event_type"], "ts").select("event_type", ratio("median_gap_s").alias("median_gap_s"))


@query("win_5_last_turns", """
SELECT conv_id, turn, CAST(count(*) OVER w AS BIGINT) AS n_before,
       md5(coalesce(string_agg(role || ':' || text, ' | ') OVER w, '')) AS context_md5 FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def _(t):
    c = t.conversations.withColumn("said", F.concat("role", F.lit(":"), "text"))
    h = history.last_turns(c, "conv_id", "turn", "said", k=3)
    return h.select("conv_id", "turn", F.size("context").cast("long").alias("n_before"),
                    F.md5(F.array_join(F.transform("context", lambda x: x["text"]), " | ")).alias("context_md5"))


@query("win_6_rolling_day_count", """
SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM events""")
def _(t):
    return history.rolling_count(t.events, "user_id", "ts", "event_id").select("event_id", "used")


@query("win_7_running_max_frontier", """
WITH p AS (SELECT p_brand AS series, p_partkey AS point, p_retailprice AS cost, CAST(p_size AS DOUBLE) AS score FROM part),
d AS (SELECT *, max(score) OVER (PARTITION BY series ORDER BY cost, score DESC, point
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p)
SELECT series, point, cost, score FROM d WHERE best IS NULL OR score > best""")
def _(t):
    p = t.part.select(F.col("p_brand").alias("series"), F.col("p_partkey").alias("point"),
                      F.col("p_retailprice").alias("cost"), F.col("p_size").cast("double").alias("score"))
    return pareto.frontier(p, "series", "cost", "score", "point")


@query("win_8_share_of_total", """
WITH g AS (SELECT n_regionkey, n_name, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_name, round(100 * total / sum(total) OVER (), 6) AS pct,
       round(100 * total / sum(total) OVER (PARTITION BY n_regionkey), 6) AS pct_in_region FROM g""")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    g = (per.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("v").alias("total"))
         .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")))
    everything, region = Window.partitionBy(F.lit(1)), Window.partitionBy("n_regionkey")
    return g.select("n_name", ratio(100 * F.col("total") / F.sum("total").over(everything)).alias("pct"),
                    ratio(100 * F.col("total") / F.sum("total").over(region)).alias("pct_in_region"))
