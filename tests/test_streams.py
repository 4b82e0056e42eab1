"""Streams over several batches give the batch answers; late rows are counted."""

import time

from pyspark.sql import functions as F

from tallyglass.operators import history, logs
from tallyglass.plans import streams
from tallyglass.sources import sinks
from tallyglass.streaming import jobs


def staged(spark, frames, name):
    """One file per frame, written in order."""
    path = sinks.scratch(spark, name)
    for f in frames:
        time.sleep(1.1)  # files are taken by modification time, kept in seconds
        f.coalesce(1).write.mode("append").parquet(path)
    return path


def thirds(t):
    e = t.events.select("ts", "event_id", "user_id")
    day = F.dayofmonth("ts")
    return e, [e.where(day <= 10), e.where((day > 10) & (day <= 20)), e.where(day > 20)]


def stream(spark, path, schema):
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def test_rolling_count_over_batches(spark, t):
    e, parts = thirds(t)
    s = stream(spark, staged(spark, parts, "t-hits"), e.schema)
    got, q = jobs.run(jobs.stateful(s, "user_id", "event_id", F.unix_micros("ts"), jobs.RollingCount(), "used long"), "t-budget")
    want = {r["event_id"]: r["used"] for r in history.rolling_count(e, "user_id", "ts", "event_id").collect()}
    assert {r["u"]: r["used"] for r in got.collect()} == want and len([p for p in q.recentProgress if p.numInputRows]) == 3


def test_late_rows_are_dropped_and_counted(spark, t):
    e, parts = thirds(t)
    runs = lambda d: d.select("ts", F.lit(1).alias("service"), F.lit(True).alias("passed"), F.lit(0.1).alias("cost_usd"), F.lit(1.0).alias("latency_s"))
    # A batch is judged by the watermark of the batch before the last one.
    frames = [runs(parts[0]), runs(parts[2].where("day(ts) <= 25")), runs(parts[2].where("day(ts) > 25")), runs(parts[1])]
    s = stream(spark, staged(spark, frames, "t-late"), frames[0].schema)
    got, q = jobs.run(jobs.daily_windows(s, "service"), "t-daily")
    days = {r["day"].day for r in got.collect()}
    assert jobs.rows_dropped(q) > 0 and 5 in days and not days & set(range(12, 20))


def test_a_table_is_streamed_in_order_and_in_parts(spark, t, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 300)
    monkeypatch.setattr(streams, "BATCH_FILES", 1)
    e = t.events.select("ts", "event_id", "user_id")
    e = e.unionAll(e.where("event_id % 3 = 0").withColumn("event_id", -F.col("event_id") - 1))  # hits of one instant
    s = streams.stream(t, e, "t-ordered", ["ts"])
    got, q = jobs.run(jobs.stateful(s, "user_id", "event_id", F.unix_micros("ts"), jobs.RollingCount(), "used long"), "t-ordered-budget")
    want = {r["event_id"]: r["used"] for r in history.rolling_count(e, "user_id", "ts", "event_id").collect()}
    assert {r["u"]: r["used"] for r in got.collect()} == want and len([p for p in q.recentProgress if p.numInputRows]) > 2


def test_drift_alerts_equal_the_batch_report(spark, t):
    """Days close over several batches; each day's row says what the batch report says with that day's end as now."""
    e = t.events.select("ts", (F.col("event_id") % 2).alias("service"), (F.col("event_type") != "error").alias("passed"),
                        (F.col("value") * F.when(F.dayofmonth("ts") == 20, 4).otherwise(1)).alias("latency_s"), (F.col("value") / 1000).alias("cost_usd"))
    day = F.dayofmonth("ts")
    parts = [e.where(day <= 10), e.where((day > 10) & (day <= 20)), e.where(day > 20)]
    got = jobs.drift_alerts(stream(spark, staged(spark, parts, "t-drift"), e.schema), "service", min_runs=10).collect()
    assert len({r["day"] for r in got}) >= 28 and len(got) == len({(r["day"], r["service"]) for r in got})
    for d in (9, 20):
        now = F.lit(f"2024-01-{d + 1:02d} 00:00:00").cast("timestamp") - F.expr("interval 1 microsecond")
        want = {r["service"]: r for r in logs.drift(e, ["service"], now, window_us=jobs.DAY_US - 1, min_runs=10).collect()}
        mine = {r["service"]: r for r in got if r["day"].day == d}
        assert set(mine) == set(want) == {0, 1}
        for s, w in want.items():
            m = mine[s]
            assert [m[c] for c in ("window_runs", "baseline_runs", "dear")] == [w[c] for c in ("window_runs", "baseline_runs", "dear")]
            calm = lambda r: [a for a in r["alerts"] if "p95" not in a]
            assert calm(m) == calm(w)
            assert abs(m["cur_pass"] - w["cur_pass"]) < 1e-12 and abs(m["base_cost"] - w["base_cost"]) < 1e-12
            of = e.where((F.col("service") == s) & (day <= d))
            now_p, then_p = (of.where(c).select(F.expr("percentile_disc(0.95) within group (order by latency_s)")).first()[0]
                             for c in (day == d, (day < d) & (day >= d - 7)))
            assert (m["cur_p95"], m["base_p95"]) == (now_p, then_p) and m["slow"] == (now_p > 1.5 * then_p)
            assert m["slow"] or d == 9


def test_drift_alerts_without_a_closed_day(spark, t):
    e = t.events.where("event_id < 0").select("ts", F.lit(1).alias("service"), F.lit(True).alias("passed"), F.col("value").alias("latency_s"), F.col("value").alias("cost_usd"))
    got = jobs.drift_alerts(stream(spark, staged(spark, [e], "t-drift-empty"), e.schema), "service")
    assert got.count() == 0 and {"day", "service", "alerts", "status"} <= set(got.columns)
