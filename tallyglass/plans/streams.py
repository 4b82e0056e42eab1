"""Streaming twins (STR), drained with availableNow and read back."""

from pyspark.sql import functions as F

from tallyglass.operators.profile import union
from tallyglass.plans import sqltext as S
from tallyglass.plans.common import ratio
from tallyglass.plans.logs import feedback, live_runs
from tallyglass.plans.registry import query
from tallyglass.sources import sinks
from tallyglass.streaming import jobs


#: Rows of a file, and files of a batch, of a stream in time order: what one key may bring into a task at once.
FILE_ROWS, BATCH_FILES = 100_000, 8


def stream(t, df, name, order=None):
    """A table written as files and read as a stream: one drained batch, or, with `order`, several that follow each other in it."""
    path = sinks.scratch(t.spark, name)
    reader = t.spark.readStream.schema(df.schema)
    if order:
        jobs.write_ordered(df, path, order, FILE_ROWS)
        reader = reader.option("maxFilesPerTrigger", BATCH_FILES)
    else:
        df.write.parquet(path)
    s = reader.parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else s


@query("str_1_daily_windows", """
WITH c AS (SELECT ts, event_id % 5 AS service, event_type <> 'error' AND event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0 AS passed, value / 1000 AS cost FROM events)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, service, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE passed) AS BIGINT) AS passes, round(avg(cost), 6) AS cost
FROM c GROUP BY date_trunc('day', ts), service HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    r = live_runs(t).withColumn("service", F.col("run_id") % 5).select("ts", "service", "passed", "cost_usd", "latency_s")
    d, _q = jobs.run(jobs.daily_windows(stream(t, r, "runs"), "service"), "daily")
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "service", "runs", "passes", ratio("cost").alias("cost"))


@query("str_1_drift_alerts", f"""
WITH c AS (SELECT date_trunc('day', ts) AS day, event_id % 5 AS service, event_type <> 'error' AND event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0 AS passed, value AS lat, value / 1000 AS cost FROM events),
g AS (SELECT day, service, count(*) AS cn, count(*) FILTER (WHERE passed) AS ck, quantile_disc(lat, .95) AS c95, avg(cost) AS cc FROM c
 WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL),
b AS (SELECT g.day, g.service, count(*) AS bn, avg(passed::INT) AS bp, quantile_disc(lat, .95) AS b95, avg(cost) AS bc FROM g JOIN c ON c.service = g.service AND c.day < g.day AND c.day >= g.day - INTERVAL 7 DAY GROUP BY ALL),
h AS (SELECT day, service, cn AS n, ck AS k FROM g), e AS ({S.rate_ends('h', 'day, service')}),
j AS (SELECT *, cn >= 20 AND coalesce(bn, 0) >= 20 AS enough FROM g LEFT JOIN b USING (day, service) LEFT JOIN e USING (day, service)),
a AS (SELECT *, concat_ws('; ', CASE WHEN enough AND hi < bp THEN printf('pass rate dropped: %.1f%% [%.1f%%, %.1f%%] vs baseline %.1f%%', ck / cn * 100, lo * 100, hi * 100, bp * 100) END,
 CASE WHEN enough AND c95 > 1.5 * b95 THEN printf('p95 latency %.1fs vs baseline %.1fs', c95, b95) END,
 CASE WHEN enough AND bc > 0 AND cc > 1.5 * bc THEN printf('cost per question $%.5f vs baseline $%.5f', cc, bc) END) AS alerts FROM j)
SELECT strftime(day, '%Y-%m-%d') AS day, service, CAST(cn AS BIGINT) AS window_runs, CAST(coalesce(bn, 0) AS BIGINT) AS baseline_runs, round(c95, 6) AS cur_p95, round(b95, 6) AS base_p95,
 round(ck / cn, 6) AS cur_pass, round(bp, 6) AS base_pass, round(cc, 12) AS cur_cost, round(bc, 12) AS base_cost, alerts,
 CASE WHEN NOT enough THEN 'insufficient data' WHEN alerts <> '' THEN 'alert' ELSE 'ok' END AS status FROM a""")
def _(t):
    r = live_runs(t).withColumn("service", F.col("run_id") % 5).select("ts", "service", "passed", "cost_usd", "latency_s")
    d = jobs.drift_alerts(stream(t, r, "drift-runs", ["ts"]), "service")
    num = ("cur_p95", "base_p95", "cur_pass", "base_pass")
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "service", "window_runs", "baseline_runs", *[ratio(c).alias(c) for c in num],
                    *[F.round(c, 12).alias(c) for c in ("cur_cost", "base_cost")],
                    F.array_join("alerts", "; ").alias("alerts"), "status")


@query("str_2_rolling_budget", """
SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM events""")
def _(t):
    s = stream(t, t.events.select("ts", "event_id", "user_id"), "hits", ["ts"])
    d, _q = jobs.run(jobs.stateful(s, "user_id", "event_id", F.unix_micros("ts"), jobs.RollingCount(), "used long"), "budget")
    return d.select(F.col("u").alias("event_id"), "used")


@query("str_4_run_assembly", """
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
r AS (SELECT user_id AS run_id, min(ts) AS a, max(ts) AS b, count(*) AS spans, sum(value) AS d FROM s GROUP BY user_id, n)
SELECT run_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS started, CAST(spans AS BIGINT) AS spans, round(d, 4) AS duration_ms FROM r
WHERE b + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    e = t.events.select("ts", F.col("event_id").alias("span_id"), F.col("user_id").alias("run_id"), F.col("value").alias("duration_ms"))
    d, _q = jobs.run(jobs.assemble_runs(stream(t, e.unionAll(e), "spans"), "6 hours"), "assembled")
    return d.select("run_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "spans", F.round("duration_ms", 4).alias("duration_ms"))


@query("str_5_sampled_scoring", """
SELECT event_id AS run_id, event_type <> 'error' AND event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0 AS passed FROM events
WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT < CAST(floor(0.1 * 4294967296) AS BIGINT)""")
def _(t):
    r = live_runs(t).select("ts", "run_id", "error", "n_rows", "status", "warning")
    return jobs.scored_sink(stream(t, r, "live"), 0.1).select("run_id", "passed")


@query("str_6_feedback_fan_out", """
WITH f AS (SELECT CAST(event_id AS VARCHAR) AS run_id, CASE WHEN event_type = 'purchase' THEN 'up' WHEN event_type = 'error' THEN 'down' ELSE 'none' END AS rating, event_id % 3 > 0 AS has FROM events)
SELECT 'feedback' AS sink, run_id AS id FROM f WHERE rating <> 'none' UNION ALL SELECT 'memory', 'user-' || run_id FROM f WHERE rating = 'up' AND has UNION ALL SELECT 'review', run_id FROM f WHERE rating = 'down'""")
def _(t):
    parts = jobs.feedback_fan_out(stream(t, feedback(t), "feedback"))
    return union([d.select(F.lit(n).alias("sink"), F.col("id" if n == "memory" else "run_id").alias("id")) for n, d in parts.items()])


@query("str_7_conversation_memory", """
SELECT conv_id, turn, md5(coalesce(string_agg(role || ':' || text, ' | ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '')) AS context_md5 FROM conversations""")
def _(t):
    said = F.concat("role", F.lit(":"), "text").alias("said")
    s = stream(t, t.conversations.select("turn", "conv_id", said), "turns", ["turn", "conv_id"])
    d, _q = jobs.run(jobs.stateful(s, "conv_id", "turn", F.col("turn"), jobs.Memory(3), "context string", ["said"]), "memory")
    return d.select(F.col("k").alias("conv_id"), F.col("u").alias("turn"), F.md5("context").alias("context_md5"))
