"""Analytics over append-only logs: runs, cost, checks, drift, audit, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass import fixed
from tallyglass.functions import tails
from tallyglass.operators.history import DAY_US, micros
from tallyglass.operators.summary import exact_quantiles


def prices(spark) -> DataFrame:
    """model, usd_in, usd_out per million tokens: a list of a dozen rows."""
    return spark.createDataFrame([(m, i, o) for m, (i, o) in fixed.MODEL_PRICES.items()], "model string, usd_in double, usd_out double")


def with_cost(spans: DataFrame) -> DataFrame:
    """Adds cost_usd from model, tokens_in, tokens_out; unknown models cost the default, local ones nothing."""
    j = spans.join(prices(spans.sparkSession), "model", "left")
    i, o = (F.coalesce(c, F.lit(d)) for c, d in zip(("usd_in", "usd_out"), fixed.DEFAULT_PRICE))
    cost = F.round(F.col("tokens_in") / 1e6 * i + F.col("tokens_out") / 1e6 * o, 6)
    cost = F.when(F.col("model").startswith(fixed.FREE_MODEL_PREFIX), 0.0).otherwise(cost)
    return j.withColumn("cost_usd", cost).drop("usd_in", "usd_out")


def run_summary(spans: DataFrame) -> DataFrame:
    """One row per run over records with a span id. `distinct_agents` lists each agent once, in order of first use."""
    s = spans.where("span_id IS NOT NULL")
    # Agents of a run fold before anything is listed: the list is as long as there are agents.
    a = s.groupBy("run_id", "agent_name").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("ms"), F.sum("tokens_in").alias("ti"), F.sum("tokens_out").alias("to"),
        F.sum("cost_usd").alias("c"), F.count_if(F.col("status") == "error").alias("e"), F.min("started_at").alias("t0"))
    return a.groupBy("run_id").agg(
        F.sum("n").alias("n_spans"), F.round(F.sum("ms"), 2).alias("total_duration_ms"), F.sum("ti").alias("total_tokens_in"),
        F.sum("to").alias("total_tokens_out"), F.round(F.sum("c"), 6).alias("total_cost_usd"), F.sum("e").alias("errors"),
        F.transform(F.array_sort(F.collect_list(F.struct("t0", "agent_name"))), lambda x: x["agent_name"]).alias("distinct_agents"))


def agent_sequence(spans: DataFrame, slice_us: int = DAY_US) -> DataFrame:
    """run_id, span_id, position, agent_name: every span numbered in time order.

    Long runs are numbered slice by slice; only slice totals are summed per run.
    """
    s = spans.where("span_id IS NOT NULL").withColumn("_slice", F.floor(micros("started_at") / F.lit(slice_us)))
    n = s.groupBy("run_id", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("run_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    start = n.select("run_id", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy("run_id", "_slice").orderBy("started_at", "span_id")
    return s.join(start, ["run_id", "_slice"]).select(
        "run_id", "span_id", (F.col("_start") + F.row_number().over(w)).alias("position"), "agent_name")


def session_totals(spans: DataFrame, session: str) -> DataFrame:
    """Totals over the runs that have spans."""
    per_run = spans.where("span_id IS NOT NULL").groupBy(session, "run_id").agg(
        F.sum("cost_usd").alias("c"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("t"), F.sum("duration_ms").alias("d"))
    return per_run.groupBy(session).agg(F.count("*").alias("runs"), F.round(F.sum("c"), 6).alias("cost_usd"),
                                        F.sum("t").alias("tokens"), F.round(F.sum("d"), 2).alias("duration_ms"))


def with_checks(runs: DataFrame) -> DataFrame:
    """Adds executed, non_empty, critic_ok, numbers_supported, passed from error, n_rows, status, warning."""
    executed = F.col("error").isNull() & F.col("n_rows").isNotNull()
    full = F.coalesce(F.col("n_rows") > 0, F.lit(False))
    ok = F.coalesce(F.col("status") != "rejected", F.lit(True))
    supported = F.col("warning").isNull()
    return (runs.withColumn("executed", executed).withColumn("non_empty", full).withColumn("critic_ok", ok)
            .withColumn("numbers_supported", supported).withColumn("passed", executed & full & ok & supported))


def sampled(key: str, rate: float) -> Column:
    """A repeatable share of keys: the same key always gets the same answer."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") < F.lit(int(rate * 2**32))


def drift(records: DataFrame, keys: list[str], now: Column | None = None, window_us: int = DAY_US, baseline_us: int = 7 * DAY_US,
          min_runs: int = 20, latency_ratio: float = 1.5, cost_ratio: float = 1.5) -> DataFrame:
    """Current window against the one before, per key, for ts, passed, latency_s, cost_usd.

    `now` defaults to the newest record of the whole log.
    """
    r = records.withColumn("_t", micros("ts"))
    if now is None:
        r = r.crossJoin(records.agg(F.max(micros("ts")).alias("_now")))
    else:
        r = r.withColumn("_now", F.unix_micros(now))
    age = F.col("_now") - F.col("_t")
    part = F.when((age >= 0) & (age <= window_us), "cur").when((age > window_us) & (age <= window_us + baseline_us), "base")
    r = r.withColumn("_w", part).where("_w IS NOT NULL")
    g = r.groupBy(*keys, "_w").agg(F.count("*").alias("_n"), F.count_if("passed").alias("_k"), F.avg("cost_usd").alias("_cost"))
    q = exact_quantiles(r, [*keys, "_w"], "latency_s", {"_p95": 0.95})
    s = g.join(q, [*keys, "_w"])
    pick = lambda w, c: F.max(F.when(F.col("_w") == w, F.col(c)))
    m = s.groupBy(*keys).agg(*[pick(w, c).alias(w + c) for w in ("cur", "base") for c in ("_n", "_k", "_cost", "_p95")])
    return judged(m, keys, min_runs, latency_ratio, cost_ratio)


def judged(m: DataFrame, keys: list[str], min_runs: int = 20, latency_ratio: float = 1.5, cost_ratio: float = 1.5) -> DataFrame:
    """Alerts of one row per key with the count _n, passes _k, mean cost _cost and latency _p95 of both windows (prefix cur and base)."""
    m = m.withColumn("window_runs", F.coalesce("cur_n", F.lit(0))).withColumn("baseline_runs", F.coalesce("base_n", F.lit(0)))
    enough = (F.col("window_runs") >= min_runs) & (F.col("baseline_runs") >= min_runs)
    m = m.withColumn("_ci", tails.rate_interval(F.col("cur_n").cast("double"), F.col("cur_k").cast("double")))
    m = m.withColumn("cur_pass", F.col("cur_k") / F.col("cur_n")).withColumn("base_pass", F.col("base_k") / F.col("base_n"))
    pass_alert = enough & (F.col("_ci.hi") < F.col("base_pass"))
    slow = enough & (F.col("cur_p95") > latency_ratio * F.col("base_p95"))
    dear = enough & (F.col("base_cost") > 0) & (F.col("cur_cost") > cost_ratio * F.col("base_cost"))
    alerts = F.array_compact(F.array(
        F.when(pass_alert, F.format_string("pass rate dropped: %.1f%% [%.1f%%, %.1f%%] vs baseline %.1f%%", F.col("cur_pass") * 100,
                                           F.col("_ci.lo") * 100, F.col("_ci.hi") * 100, F.col("base_pass") * 100)),
        F.when(slow, F.format_string("p95 latency %.1fs vs baseline %.1fs", "cur_p95", "base_p95")),
        F.when(dear, F.format_string("cost per question $%.5f vs baseline $%.5f", "cur_cost", "base_cost"))))
    status = F.when(~enough, "insufficient data").when(F.size(alerts) > 0, "alert").otherwise("ok")
    return m.select(*keys, "window_runs", "baseline_runs", "cur_pass", F.col("_ci.lo").alias("cur_lo"), F.col("_ci.hi").alias("cur_hi"), "base_pass",
                    "cur_p95", "base_p95", "cur_cost", "base_cost", F.coalesce(slow, F.lit(False)).alias("slow"),
                    F.coalesce(dear, F.lit(False)).alias("dear"), alerts.alias("alerts"), status.alias("status"))


def recent(audit: DataFrame, limit: int = 100, api_key: str | None = None) -> DataFrame:
    a = audit if api_key is None else audit.where(F.col("api_key") == api_key)
    return a.orderBy(F.desc("id")).limit(limit)


def route_feedback(feedback: DataFrame) -> dict[str, DataFrame]:
    """The three destinations of one feedback input."""
    up = (F.col("rating") == "up") & F.col("sql").isNotNull() & (F.length("sql") > 0)
    return {
        "feedback": feedback.where(F.col("rating").isin("up", "down")),
        "memory": feedback.where(up).select(F.concat(F.lit("user-"), "run_id").alias("id"), "question", "sql",
                                            F.col("datasource").alias("db_id"), F.lit("user").alias("source")),
        "review": feedback.where(F.col("rating") == "down"),
    }


def review_queue(review: DataFrame, promoted: DataFrame) -> DataFrame:
    return review.join(promoted.where("run_id IS NOT NULL"), "run_id", "left_anti")


def promotion_check(wanted: DataFrame, review: DataFrame, gold_rows: DataFrame, sample: str = "sample") -> DataFrame:
    """run_id, verdict: in the queue, on the fixed sample, and its gold result has rows. gold_rows: run_id per row."""
    r = review.select("run_id", "datasource").distinct()
    have = gold_rows.select("run_id").distinct().withColumn("_rows", F.lit(True))
    j = wanted.select("run_id").join(r, "run_id", "left").join(have, "run_id", "left")
    verdict = (F.when(F.col("datasource").isNull(), "not in the review queue").when(F.col("datasource") != sample, "not on the sample")
               .when(F.col("_rows").isNull(), "gold result is empty").otherwise("promoted"))
    return j.select("run_id", verdict.alias("verdict"))


def feedback_stats(feedback: DataFrame, keys: list[str] = ()) -> DataFrame:
    return feedback.groupBy(*keys).agg(F.count("*").alias("ratings"), F.count_if(F.col("rating") == "up").alias("up"),
                                       F.count_if(F.col("rating") == "down").alias("down"))
