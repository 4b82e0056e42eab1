"""Structured Streaming twins of the log operators."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyglass.operators import logs
from tallyglass.sources import sinks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000
#: Times in one entry of a key's state.
PACKED = 1 << 16


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream with event time in `ts`."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    # Watermarks need a zoned timestamp; the session zone is UTC.
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def write_ordered(df: DataFrame, path: str, order: list[str], rows: int) -> None:
    """Writes a table as files of about `rows` rows that a stream takes in the given order; equal keys share a file.

    Streams take files by modification time, so the files get times a second apart; a file system that doesn't keep them
    is refused.
    """
    jvm = df.sparkSession._jvm
    df.repartitionByRange(max(1, -(-df.count() // rows)), *order).write.parquet(path)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    listed = lambda: sorted((s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda s: int(s.getPath().getName().split("-")[1]))
    files = listed()
    start = (int(time.time()) - len(files)) * 1000
    for i, s in enumerate(files):
        fs.setTimes(s.getPath(), start + 1000 * i, -1)
    if [s.getModificationTime() for s in listed()] != [start + 1000 * i for i in range(len(files))]:
        raise RuntimeError("the file system doesn't keep modification times, which order a stream's files")


def run(df: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, object]:
    """Drain the stream into Parquet and read it back: (frame, query)."""
    spark = df.sparkSession
    out, cp = sinks.scratch(spark, name), sinks.scratch(spark, name + "-cp")
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", cp)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out), q


def rows_dropped(query) -> int:
    """Late rows the watermark discarded, summed over the progress reports."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def daily_windows(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """day, key, runs, passed, mean cost and p95 latency (mergeable sketch) per closed day."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), key)
    d = g.agg(F.count("*").alias("runs"), F.count_if("passed").alias("passes"), F.avg("cost_usd").alias("cost"),
              F.expr("kll_sketch_agg_double(latency_s)").alias("_k"))
    return d.select(F.col("window.start").alias("day"), key, "runs", "passes", "cost",
                    F.expr("kll_sketch_get_quantile_double(_k, 0.95D)").alias("p95"))


def drift_alerts(events: DataFrame, key: str, late: str = "1 hour", baseline_days: int = 7, sketch: int = 4096, **limits) -> DataFrame:
    """Drained: a row per key and closed day that had runs, judged against the `baseline_days` calendar days before it.

    A day is one row with a mergeable latency sketch, exact up to `sketch` runs of a key and day (rank error about 1 / sketch beyond).
    Its p95 is a run's latency, the smallest that 95% of the runs do not exceed; logs.drift interpolates between two runs.
    When the watermark closes days, their rows are stored and judged against the stored rows before them, so a
    batch reads a week of day rows, never runs. A replayed batch overwrites its folders. Columns as logs.judged, and `day`.
    """
    spark = events.sparkSession
    days, alerts = sinks.scratch(spark, "drift-days"), sinks.scratch(spark, "drift-alerts")
    g = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.col(key))
    closed = g.agg(F.count("*").alias("_n"), F.count_if("passed").alias("_k"), F.sum("cost_usd").alias("_sum"), F.count("cost_usd").alias("_costs"),
                   F.expr(f"kll_sketch_agg_double(latency_s, {int(sketch)})").alias("_s")).select(F.col("window.start").alias("day"), key, "_n", "_k", "_sum", "_costs", "_s")
    p95 = lambda c: F.when(F.expr(f"kll_sketch_get_n_double({c})") > 0, F.expr(f"kll_sketch_get_quantile_double({c}, 0.95D)"))

    def verdicts(now: DataFrame, seen: DataFrame) -> DataFrame:
        n, b = now.alias("n"), seen.alias("b")
        before = F.col("n.day") - F.make_dt_interval(days=F.lit(baseline_days))
        near = n.join(b, F.col(f"n.{key}").eqNullSafe(F.col(f"b.{key}")) & (F.col("b.day") >= before) & (F.col("b.day") < F.col("n.day")), "left")
        base = near.groupBy(F.col("n.day"), F.col(f"n.{key}")).agg(
            F.first("n._n").alias("cur_n"), F.first("n._k").alias("cur_k"), (F.first("n._sum") / F.first("n._costs")).alias("cur_cost"), F.first("n._s").alias("_now"),
            F.sum("b._n").alias("base_n"), F.sum("b._k").alias("base_k"), (F.sum("b._sum") / F.sum("b._costs")).alias("base_cost"),
            F.expr("kll_merge_agg_double(b._s)").alias("_then"))
        return logs.judged(base.withColumn("cur_p95", p95("_now")).withColumn("base_p95", p95("_then")), ["day", key], **limits)

    def write(batch, i):
        if batch.isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{days}/batch={i}")
        stored = spark.read.schema(f"{closed_schema}, batch long").option("basePath", days).parquet(days).where(F.col("batch") <= i)
        verdicts(stored.where(F.col("batch") == i), stored).write.mode("overwrite").parquet(f"{alerts}/batch={i}")

    closed_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in closed.schema.fields)
    empty = spark.createDataFrame([], closed.schema)
    shape = verdicts(empty, empty).schema
    idempotent_batches(closed, write, "drift")
    return read_back(spark, alerts, shape)


class _PerKey(StatefulProcessor):
    """Rows of one key in time order within a batch; with `buckets`, the rows of all keys of a bucket."""

    buckets = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def close(self) -> None:
        pass

    @staticmethod
    def ordered(rows) -> pd.DataFrame:
        every = pd.concat(list(rows), ignore_index=True)
        return every.sort_values(["t", "u"], kind="stable")


class RollingCount(_PerKey):
    """How many hits of the key lie within the window that ends at each hit; hits of one instant see each other.

    Keys are dealt into `buckets`, and a bucket's rows and state are worked off together, as a call and a state read per key
    cost more than its few hits. The state is the keys and times of each key's last window, packed.
    """

    buckets = 256

    def __init__(self, window_us: int = DAY_US):
        self.window_us = window_us

    def open(self):
        self.hits = self.handle.getListState("hits", T.StructType([T.StructField("packed", T.BinaryType())]))

    def handleInputRows(self, key, rows, timerValues):
        new = pa.concat_tables([pa.Table.from_pandas(r[["k", "u", "t"]], preserve_index=False) for r in rows], promote_options="permissive")
        past = [pa.ipc.open_stream(h[0]).read_all() for h in self.hits.get()] if self.hits.exists() else []
        n = new.num_rows
        kept = pa.concat_tables([new.select(["k", "t"]), *past], promote_options="permissive")
        code = kept["k"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        t = kept["t"].to_numpy().astype(np.int64)
        # Places of (key, time) in one order: times become ranks, so that no product overflows.
        moments = np.unique(t)
        width = len(moments) + 1
        every = np.sort(code * width + np.searchsorted(moments, t))
        up_to = lambda c, x: np.searchsorted(every, c * width + np.searchsorted(moments, x, "right"))
        used = up_to(code[:n], t[:n]) - up_to(code[:n], t[:n] - self.window_us)
        last = np.full(code.max() + 1, np.iinfo(np.int64).min)
        np.maximum.at(last, code, t)
        live = kept.filter(pa.array(t > last[code] - self.window_us)).combine_chunks()
        state = []
        for i in range(0, live.num_rows, PACKED):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, live.schema) as w:
                w.write_table(live.slice(i, PACKED))
            state.append((out.getvalue().to_pybytes(),))
        self.hits.put(state)
        yield pd.DataFrame({"k": new["k"].to_pandas(), "u": new["u"].to_pandas(), "used": used})


class Memory(_PerKey):
    """The last k turns of a conversation before each turn."""

    def __init__(self, k: int = 3):
        self.k = k

    def open(self):
        self.turns = self.handle.getListState("turns", T.StructType([T.StructField("text", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues):
        d = self.ordered(rows)
        past = [x[0] for x in self.turns.get()] if self.turns.exists() else []
        context = []
        for said in d["said"].to_numpy():
            context.append(" | ".join(past))
            past = (past + [said])[-self.k:]
        self.turns.put([(x,) for x in past])
        yield pd.DataFrame({"k": key[0], "u": d["u"].to_numpy(), "context": context})


def stateful(events: DataFrame, key: str, uid: str, time_us, processor: _PerKey, out: str, extra: list[str] = ()) -> DataFrame:
    """Run a per-key processor over a stream; `time_us` orders the rows of a key."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    d = events.select(F.col(key).alias("k"), F.col(uid).alias("u"), time_us.alias("t"), *extra)
    schema = f"k {d.schema['k'].dataType.simpleString()}, u {d.schema['u'].dataType.simpleString()}, {out}"
    if processor.buckets:
        d = d.withColumn("_bucket", F.when(F.col("k").isNull(), -1).otherwise(F.pmod(F.xxhash64("k"), F.lit(processor.buckets)).cast("int")))
    return d.groupBy("_bucket" if processor.buckets else "k").transformWithStateInPandas(processor, schema, "Append", "None")


def assemble_runs(spans: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a run's spans; repeated spans count once."""
    s = spans.withWatermark("ts", late).dropDuplicatesWithinWatermark(["span_id"])
    g = s.groupBy("run_id", F.session_window("ts", gap)).agg(F.count("*").alias("spans"), F.sum("duration_ms").alias("duration_ms"))
    return g.select("run_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "spans", "duration_ms")


def idempotent_batches(df: DataFrame, write, name: str):
    """foreachBatch with one folder per batch id: a replayed batch overwrites itself."""
    cp = sinks.scratch(df.sparkSession, name + "-cp")
    q = df.writeStream.foreachBatch(lambda batch, i: write(batch, i)).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_back(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What the batches wrote; nothing if none had rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def scored_sink(runs: DataFrame, rate: float) -> DataFrame:
    """Score a share of the runs as they arrive (runs already carry error, n_rows, status, warning)."""
    spark, out = runs.sparkSession, sinks.scratch(runs.sparkSession, "scored")
    picked = logs.with_checks(runs).where(logs.sampled("run_id", rate))
    schema = picked.schema

    def write(batch, i):
        batch.write.mode("overwrite").parquet(f"{out}/batch={i}")

    idempotent_batches(picked, write, "scored")
    return spark.read.schema(schema).parquet(out)


def feedback_fan_out(feedback: DataFrame) -> dict[str, DataFrame]:
    """Three sinks fed by one stream."""
    spark, root = feedback.sparkSession, sinks.scratch(feedback.sparkSession, "feedback")
    shapes = {n: d.schema for n, d in logs.route_feedback(feedback).items()}

    def write(batch, i):
        # One read of the batch for three writes.
        batch = batch.persist()
        for n, d in logs.route_feedback(batch).items():
            d.write.mode("overwrite").parquet(f"{root}/{n}/batch={i}")
        batch.unpersist()

    idempotent_batches(feedback, write, "feedback")
    return {n: spark.read.schema(s).parquet(f"{root}/{n}") for n, s in shapes.items()}
