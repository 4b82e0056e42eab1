"""Log analytics (LOG, JN-10, JN-14, AGG-11)."""

from pyspark.sql import functions as F

from tallyglass import fixed
from tallyglass.operators import logs
from tallyglass.operators.profile import union
from tallyglass.plans import sqltext as S
from tallyglass.plans.common import ratio
from tallyglass.plans.registry import query

_MODELS = ["gemini-2.5-flash", "gemini-2.5-pro", "ollama/local", "unlisted"]
_PRICE_SQL = " ".join(f"WHEN '{m}' THEN {{{i}}}" for i, m in enumerate(fixed.MODEL_PRICES))
_IN_SQL = "CASE model " + " ".join(f"WHEN '{m}' THEN {a}" for m, (a, _) in fixed.MODEL_PRICES.items()) + f" ELSE {fixed.DEFAULT_PRICE[0]} END"
_OUT_SQL = "CASE model " + " ".join(f"WHEN '{m}' THEN {b}" for m, (_, b) in fixed.MODEL_PRICES.items()) + f" ELSE {fixed.DEFAULT_PRICE[1]} END"
_SPANS = f"""s0 AS (SELECT user_id AS run_id, event_id AS span_id, event_type AS agent_name, ts AS started_at, value AS duration_ms,
 CAST(json_extract(props, '$.k') AS BIGINT) * 1000 AS tokens_in, CAST(json_extract(props, '$.k') AS BIGINT) * 40 AS tokens_out,
 list_extract(['{"', '".join(_MODELS)}'], CAST(event_id % 4 + 1 AS INTEGER)) AS model FROM events),
s AS (SELECT *, CASE WHEN model LIKE 'ollama/%' THEN 0.0 ELSE round(tokens_in / 1e6 * {_IN_SQL} + tokens_out / 1e6 * {_OUT_SQL}, 6) END AS cost FROM s0)"""


def spans(t):
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("event_id") % 4 + 1).cast("int"))
    s = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("agent_name"),
                        F.col("ts").alias("started_at"), F.col("value").alias("duration_ms"), (k * 1000).alias("tokens_in"), (k * 40).alias("tokens_out"),
                        model.alias("model"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    return logs.with_cost(s)


@query("jn_10_lookup_with_default", f"WITH {_SPANS} SELECT span_id, model, round(cost, 5) AS cost_usd FROM s")
def _(t):
    return spans(t).select("span_id", "model", F.round("cost_usd", 5).alias("cost_usd"))


@query("log_1_run_summary", f"""WITH {_SPANS},
a AS (SELECT run_id, agent_name, min(started_at) AS t0 FROM s GROUP BY 1, 2), l AS (SELECT run_id, string_agg(agent_name, ',' ORDER BY t0) AS agents FROM a GROUP BY 1)
SELECT run_id, CAST(count(*) AS BIGINT) AS n_spans, round(sum(duration_ms), 2) AS total_duration_ms, CAST(sum(tokens_in) AS BIGINT) AS total_tokens_in,
 CAST(sum(tokens_out) AS BIGINT) AS total_tokens_out, round(sum(cost), 5) AS total_cost_usd, CAST(count(*) FILTER (WHERE agent_name = 'error') AS BIGINT) AS errors, any_value(agents) AS distinct_agents
FROM s JOIN l USING (run_id) GROUP BY 1""")
def _(t):
    r = logs.run_summary(spans(t))
    return r.withColumn("distinct_agents", F.array_join("distinct_agents", ",")).withColumn("total_cost_usd", F.round("total_cost_usd", 5))


@query("log_1_agent_sequence", f"WITH {_SPANS} SELECT run_id, span_id, row_number() OVER (PARTITION BY run_id ORDER BY started_at, span_id) AS position, agent_name FROM s")
def _(t):
    return logs.agent_sequence(spans(t))


@query("log_2_cost_attribution", f"""WITH {_SPANS} SELECT model, agent_name, strftime(started_at, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS calls,
 round(sum(cost), 5) AS cost_usd FROM s GROUP BY 1, 2, 3""")
def _(t):
    g = spans(t).groupBy("model", "agent_name", F.date_format("started_at", "yyyy-MM-dd").alias("day"))
    return g.agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 5).alias("cost_usd"))


@query("log_3_session_totals", f"""WITH {_SPANS} SELECT strftime(started_at, '%Y-%m-%d') AS session, CAST(count(DISTINCT run_id) AS BIGINT) AS runs, round(sum(cost), 5) AS cost_usd,
 CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens, round(sum(duration_ms), 2) AS duration_ms FROM s GROUP BY 1""")
def _(t):
    s = spans(t).withColumn("session", F.date_format("started_at", "yyyy-MM-dd"))
    return logs.session_totals(s, "session").withColumn("cost_usd", F.round("cost_usd", 5))


_RUNS = """r AS (SELECT event_id AS run_id, user_id AS service, ts, CASE WHEN event_type = 'error' THEN 'failed' END AS error, CAST(event_id % 5 AS INTEGER) AS n_rows,
 CASE WHEN event_id % 7 = 0 THEN 'rejected' ELSE 'validated' END AS status, CASE WHEN event_id % 11 = 0 THEN 'unsupported' END AS warning, value AS latency_s, value / 1000 AS cost_usd FROM events),
c AS (SELECT *, error IS NULL AND n_rows > 0 AND status <> 'rejected' AND warning IS NULL AS passed FROM r)"""


def live_runs(t):
    e = F.col("event_id")
    r = t.events.select(e.alias("run_id"), F.col("user_id").alias("service"), "ts", F.when(F.col("event_type") == "error", "failed").alias("error"),
                        (e % 5).cast("int").alias("n_rows"), F.when(e % 7 == 0, "rejected").otherwise("validated").alias("status"),
                        F.when(e % 11 == 0, "unsupported").alias("warning"), F.col("value").alias("latency_s"), (F.col("value") / 1000).alias("cost_usd"))
    return logs.with_checks(r)


@query("log_4_quality_checks", f"WITH {_RUNS} SELECT run_id, error IS NULL AS executed, n_rows > 0 AS non_empty, status <> 'rejected' AS critic_ok, warning IS NULL AS numbers_supported, passed FROM c")
def _(t):
    return live_runs(t).select("run_id", "executed", "non_empty", "critic_ok", "numbers_supported", "passed")


@query("log_5_rate_sampling", f"WITH {_RUNS} SELECT run_id, passed FROM c WHERE ('0x' || substr(md5(CAST(run_id AS VARCHAR)), 1, 8))::BIGINT < CAST(floor(0.1 * 4294967296) AS BIGINT)")
def _(t):
    return live_runs(t).where(logs.sampled("run_id", 0.1)).select("run_id", "passed")


_DRIFT = f"""{_RUNS}, n AS (SELECT max(ts) AS now FROM c),
w AS (SELECT c.*, CASE WHEN ts >= now - INTERVAL 1 DAY THEN 'cur' WHEN ts >= now - INTERVAL 8 DAY THEN 'base' END AS w FROM c, n)"""


@query("log_6_drift_windows", f"""WITH {_DRIFT},
g AS (SELECT run_id % 5 AS service, count(*) FILTER (WHERE w = 'cur') AS cn, count(*) FILTER (WHERE w = 'base') AS bn, avg(passed::INT) FILTER (WHERE w = 'cur') AS cp,
 avg(passed::INT) FILTER (WHERE w = 'base') AS bp, quantile_cont(latency_s, .95) FILTER (WHERE w = 'cur') AS c95, quantile_cont(latency_s, .95) FILTER (WHERE w = 'base') AS b95,
 avg(cost_usd) FILTER (WHERE w = 'cur') AS cc, avg(cost_usd) FILTER (WHERE w = 'base') AS bc FROM w WHERE w IS NOT NULL GROUP BY 1)
SELECT service, CAST(cn AS BIGINT) AS window_runs, CAST(bn AS BIGINT) AS baseline_runs, round(cp, 6) AS cur_pass, round(bp, 6) AS base_pass, round(c95, 6) AS cur_p95, round(b95, 6) AS base_p95,
 round(cc, 6) AS cur_cost, round(bc, 6) AS base_cost, cn >= 20 AND bn >= 20 AND c95 > 1.5 * b95 AS slow, cn >= 20 AND bn >= 20 AND cc > 1.5 * bc AS dear FROM g""")
def _(t):
    d = logs.drift(live_runs(t).withColumn("service", F.col("run_id") % 5), ["service"])
    num = ("cur_pass", "base_pass", "cur_p95", "base_p95", "cur_cost", "base_cost")
    return d.select("service", "window_runs", "baseline_runs", *[ratio(c).alias(c) for c in num], "slow", "dear")


@query("log_6_drift_alerts", f"""WITH {_DRIFT},
g AS (SELECT service, count(*) FILTER (WHERE w = 'cur') AS cn, count(*) FILTER (WHERE w = 'base') AS bn, count(*) FILTER (WHERE w = 'cur' AND passed) AS ck,
 avg(passed::INT) FILTER (WHERE w = 'base') AS bp, quantile_cont(latency_s, .95) FILTER (WHERE w = 'cur') AS c95, quantile_cont(latency_s, .95) FILTER (WHERE w = 'base') AS b95,
 avg(cost_usd) FILTER (WHERE w = 'cur') AS cc, avg(cost_usd) FILTER (WHERE w = 'base') AS bc FROM w WHERE w IS NOT NULL GROUP BY 1),
h AS (SELECT service, cn AS n, ck AS k FROM g WHERE cn > 0), e AS ({S.rate_ends('h', 'service')}),
j AS (SELECT *, cn >= 3 AND bn >= 3 AS enough FROM g LEFT JOIN e USING (service)),
a AS (SELECT *, concat_ws('; ', CASE WHEN enough AND hi < bp THEN printf('pass rate dropped: %.1f%% [%.1f%%, %.1f%%] vs baseline %.1f%%', ck / cn * 100, lo * 100, hi * 100, bp * 100) END,
 CASE WHEN enough AND c95 > 1.5 * b95 THEN printf('p95 latency %.1fs vs baseline %.1fs', c95, b95) END,
 CASE WHEN enough AND bc > 0 AND cc > 1.5 * bc THEN printf('cost per question $%.5f vs baseline $%.5f', cc, bc) END) AS alerts FROM j)
SELECT service, CAST(cn AS BIGINT) AS window_runs, CAST(bn AS BIGINT) AS baseline_runs, round(hi, 6) AS cur_hi, alerts,
 CASE WHEN NOT enough THEN 'insufficient data' WHEN alerts <> '' THEN 'alert' ELSE 'ok' END AS status FROM a""")
def _(t):
    d = logs.drift(live_runs(t), ["service"], min_runs=3)
    return d.select("service", "window_runs", "baseline_runs", ratio("cur_hi").alias("cur_hi"), F.array_join("alerts", "; ").alias("alerts"), "status")


@query("log_7_audit_trail", "SELECT event_id AS id, user_id AS api_key, event_type AS status FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 100")
def _(t):
    a = t.events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("api_key"), F.col("event_type").alias("status"))
    return logs.recent(a, 100, "7").select("id", F.col("api_key").cast("long").alias("api_key"), "status")


_FB = """f AS (SELECT CAST(event_id AS VARCHAR) AS run_id, CASE WHEN event_type = 'purchase' THEN 'up' WHEN event_type = 'error' THEN 'down' ELSE 'none' END AS rating,
 event_type AS question, CASE WHEN event_id % 3 > 0 THEN 'SELECT 1' END AS sql, CASE WHEN user_id % 2 = 0 THEN 'sample' ELSE 'own' END AS datasource, user_id FROM events)"""


def feedback(t):
    e = F.col("event_id")
    rating = F.when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down").otherwise("none")
    return t.events.select(e.cast("string").alias("run_id"), rating.alias("rating"), F.col("event_type").alias("question"),
                           F.when(e % 3 > 0, "SELECT 1").alias("sql"), F.when(F.col("user_id") % 2 == 0, "sample").otherwise("own").alias("datasource"), "user_id")


@query("log_8_feedback_routing", f"""WITH {_FB} SELECT 'feedback' AS sink, run_id AS id FROM f WHERE rating <> 'none'
UNION ALL SELECT 'memory', 'user-' || run_id FROM f WHERE rating = 'up' AND sql IS NOT NULL UNION ALL SELECT 'review', run_id FROM f WHERE rating = 'down'""")
def _(t):
    parts = logs.route_feedback(feedback(t))
    return union([d.select(F.lit(n).alias("sink"), F.col("id" if n == "memory" else "run_id").alias("id")) for n, d in parts.items()])


@query("jn_14_review_queue", f"WITH {_FB} SELECT run_id FROM f WHERE rating = 'down' AND user_id % 4 > 0")
def _(t):
    f = feedback(t)
    return logs.review_queue(logs.route_feedback(f)["review"], f.where("user_id % 4 = 0").select("run_id")).select("run_id")


@query("log_9_promotion_check", f"""WITH {_FB} SELECT run_id, CASE WHEN rating <> 'down' THEN 'not in the review queue' WHEN datasource <> 'sample' THEN 'not on the sample'
 WHEN sql IS NULL THEN 'gold result is empty' ELSE 'promoted' END AS verdict FROM f WHERE rating <> 'none'""")
def _(t):
    f = feedback(t)
    return logs.promotion_check(f.where("rating <> 'none'"), logs.route_feedback(f)["review"], f.where("sql IS NOT NULL"))


@query("agg_11_feedback_stats", f"""WITH {_FB} SELECT datasource, CAST(count(*) AS BIGINT) AS ratings, CAST(count(*) FILTER (WHERE rating = 'up') AS BIGINT) AS up,
 CAST(count(*) FILTER (WHERE rating = 'down') AS BIGINT) AS down FROM f WHERE rating <> 'none' GROUP BY 1""")
def _(t):
    return logs.feedback_stats(feedback(t).where("rating <> 'none'"), ["datasource"])
