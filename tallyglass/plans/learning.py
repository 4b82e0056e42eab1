"""Forecasts, clusters, anomalies, the router (ML)."""

from pyspark.sql import functions as F

from tallyglass.functions import features
from tallyglass.operators import anomaly, cluster, forecast, router, sampling
from tallyglass.plans.common import money, ratio
from tallyglass.plans.registry import query


@query("ml_1_frequency_detection", """
WITH d AS (SELECT 'events ' || event_type AS series, ts AS t FROM events UNION ALL SELECT 'orders by month', date_trunc('month', o_orderdate) FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS o_orderdate FROM orders)),
g AS (SELECT series, epoch(t) - lag(epoch(t)) OVER (PARTITION BY series ORDER BY t) AS g FROM d), m AS (SELECT series, quantile_cont(g, .5) / 86400 AS d FROM g WHERE g IS NOT NULL GROUP BY 1)
SELECT series, CASE WHEN d <= 2 THEN 'D' WHEN d <= 8 THEN 'W' WHEN d <= 35 THEN 'MS' ELSE 'YS' END AS freq FROM m""")
def _(t):
    m = t.orders.select(F.lit("orders by month").alias("series"), F.date_trunc("month", "o_orderdate").alias("t")).distinct()
    e = t.events.select(F.concat(F.lit("events "), "event_type").alias("series"), F.col("ts").alias("t"))
    return forecast.frequency(e.unionByName(m), "series", "t")


@query("ml_2_regular_calendar", """
WITH d AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS p, sum(value) AS v FROM events GROUP BY 1, 2),
c AS (SELECT event_type, unnest(generate_series(min(p), max(p), INTERVAL 1 DAY)) AS p FROM d GROUP BY 1)
SELECT c.event_type, strftime(c.p, '%Y-%m-%d') AS period, round(last_value(v IGNORE NULLS) OVER (PARTITION BY c.event_type ORDER BY c.p), 4) AS value
FROM c LEFT JOIN d ON c.event_type = d.event_type AND c.p = d.p""")
def _(t):
    r = forecast.regularize(t.events, "event_type", "ts", "value")
    return r.select("event_type", F.date_format("period", "yyyy-MM-dd").alias("period"), money("value").alias("value"))


@query("ml_3_holt_winters")
def _(t):
    r = forecast.regularize(t.events, "event_type", "ts", "value")
    f = forecast.holt_winters(r, "event_type")
    return f.select("event_type", "freq", "step", F.date_format("period", "yyyy-MM-dd").alias("period"),
                    *[money(c).alias(c) for c in ("forecast", "lower", "upper")], "mape", "rmse", "status")


@query("ml_4_kmeans_elbow")
def _(t):
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return cluster.kmeans(p, ["p_size", "p_retailprice"], max_k=6, tries=1)[1]


@query("ml_5_iqr_anomalies", """
WITH f AS (SELECT quantile_cont(value, .25) AS q1, quantile_cont(value, .75) AS q3 FROM events), b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f)
SELECT event_id, value, 'value outside [' || printf('%.2f', lo) || ', ' || printf('%.2f', hi) || ']; ' AS anomaly_reason FROM events, b WHERE value < lo OR value > hi""")
def _(t):
    return anomaly.detect(t.events.select("event_id", "value"), ["value"])


def routed(t):
    """Recorded outcomes of a cheap and a strong run on every order, hard when its text is long or urgent."""
    k = F.col("o_orderkey")
    hard = (F.col("o_totalprice") > 300000).cast("double")
    cheap = F.pmod(F.xxhash64(k), F.lit(100)) > 15 + 50 * hard
    strong = F.pmod(F.xxhash64(k, F.lit(1)), F.lit(100)) > 8
    f = features.wording(F.concat_ws(" ", F.lit("total of each order by"), "o_orderpriority"))
    return t.orders.select("o_orderkey", hard.alias("hard"), f["log_len"].alias("log_len"), (F.col("o_custkey") % 7).cast("double").alias("noise"),
                           cheap.alias("cheap_ok"), strong.alias("strong_ok"), F.lit(0.001).alias("cheap_cost"), F.lit(0.005).alias("strong_cost"),
                           sampling.half("o_orderkey").alias("half"))


_FEATURES = ["hard", "log_len", "noise"]


def scored(t):
    r = routed(t).withColumn("failed", ~F.col("cheap_ok"))
    model = router.fit(r.where("half = 0"), _FEATURES, "failed")
    return router.p_fail(model, r.where("half = 1"))


@query("ml_6_router_fit")
def _(t):
    return scored(t).select("o_orderkey", "hard", ratio("p_fail").alias("p_fail"))


@query("ml_7_threshold_replay")
def _(t):
    c = router.replay(scored(t))
    return c.select("threshold", *[ratio(x).alias(x) for x in ("ex", "cost_mean", "share_strong")])


@query("ml_7_threshold_choice")
def _(t):
    s = scored(t)
    return router.choose(router.replay(s), s)


@query("ml_7_price_replay", """
WITH s AS (SELECT p_type, p_size / 50.0 AS p, p_partkey % 3 > 0 AS cheap, p_partkey % 10 > 0 AS strong FROM part), g AS (SELECT unnest(range(0, 21)) / 20.0 AS threshold)
SELECT p_type, threshold, round(avg((CASE WHEN p > threshold THEN strong ELSE cheap END)::INT), 6) AS ex, round(avg(CASE WHEN p > threshold THEN 0.005 ELSE 0.001 END), 6) AS cost_mean,
 round(avg((p > threshold)::INT), 6) AS share_strong FROM s, g GROUP BY 1, 2""")
def _(t):
    k = F.col("p_partkey")
    s = t.part.select("p_type", (F.col("p_size") / 50.0).alias("p_fail"), (k % 3 > 0).alias("cheap_ok"), (k % 10 > 0).alias("strong_ok"),
                      F.lit(0.001).alias("cheap_cost"), F.lit(0.005).alias("strong_cost"))
    c = router.replay(s, ["p_type"])
    return c.select("p_type", "threshold", *[ratio(x).alias(x) for x in ("ex", "cost_mean", "share_strong")])


@query("ml_8_half_split", """SELECT CAST(('0x' || substr(md5(o_orderkey || ':0'), 1, 1))::INTEGER % 2 AS INTEGER) AS half, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def _(t):
    return t.orders.groupBy(sampling.half("o_orderkey").alias("half")).agg(F.count("*").alias("n"))
