"""Steps that must not gather a large share of the rows in one task, and whole results of round 3."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import eda, evaluate, lexical, profile, quality, retrieval, stats, values, vectors
from tallyglass.streaming import jobs


@pytest.fixture
def planned(spark):
    """Plans as at a size where Spark would not broadcast by itself."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def numbers(spark, n=200):
    return spark.range(n).select(F.col("id").cast("double").alias("a"), (F.col("id") * 7 % 13).cast("double").alias("b"))


def test_cells_are_not_shuffled_by_column(spark, planned):
    """a column name as a join key put all cells of a column into one task."""
    for df in (stats.outliers(numbers(spark)), stats.audit(numbers(spark))):
        plan = planned(df)
        assert "SortMergeJoin [column" not in plan and "BroadcastHashJoin [column" in plan
    assert quality.validate_result(numbers(spark), "r").first()["rows"] == 200


def test_distinct_values_are_not_shuffled_by_column(spark, planned):
    """dimensions and time axes pick their columns' values without a sort of them."""
    df = spark.range(50).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"))
    freq = profile.frequencies(df)
    plan = planned(profile.date_facts(freq, profile.column_facts(df, freq).withColumn("role", profile.role())))
    assert "LeftSemi" in plan and "SortMergeJoin [column#" not in [x for x in plan.split("\n") if "LeftSemi" in x][0]
    assert {r["column"]: r["date_frequency"] for r in profile.profile(df).collect()} == {"ts": "daily", "kind": None}


def test_report_shuffles_categories_only(spark, monkeypatch):
    """values of numeric columns were shuffled to count what no row of the report shows."""
    df = spark.createDataFrame([(1.0, "x", None), (float("nan"), "x", "y"), (None, None, "y"), (2.0, "z", "y")], "n double, k string, m string")
    seen, plain = [], profile.frequencies
    monkeypatch.setattr(profile, "frequencies", lambda d: seen.append(d.columns) or plain(d))
    got = {(r["section"], r["metric"]): r["value"] for r in eda.report(df).collect()}
    assert got["Missing Values", "n"] == "2 (50.0%)" and got["Overview", "Missing Values"] == "4 (33.3%)"
    assert got["Categorical Stats", "k"] == "2 unique values"
    assert seen == [["k", "m"]]


def test_ablation_sends_the_plan_to_the_items(spark, planned):
    """few benchmarks and runs as join keys."""
    runs = spark.createDataFrame([("b", "x", 0, None), ("b", "y", 1, None)], "benchmark string, run string, position int, baseline string")
    items = spark.createDataFrame([("b", r, i, i % 2 == 0) for i in range(40) for r in "xy"], "benchmark string, run string, item long, match boolean")
    df = evaluate.ablation(runs, items)
    assert "BroadcastHashJoin [benchmark" in planned(df)
    assert {(r["run"], r["n"], r["n_paired"]) for r in df.collect()} == {("x", 40, None), ("y", 40, 40)}


def test_every_match_is_scored(spark):
    """no rank ends the list."""
    d = spark.range(60).select("id", F.concat(F.lit("alpha "), F.repeat(F.lit("beta "), F.col("id").cast("int") % 5)).alias("text"))
    q = spark.createDataFrame([(1, "alpha"), (2, "beta alpha"), (3, "none")], "id long, text string")
    got = lexical.scores(lexical.build(d, "id", "text", shard_docs=16), q, "id", "text").groupBy("query").count().collect()
    assert {r["query"]: r["count"] for r in got} == {1: 60, 2: 60}


def test_weights_of_repeated_null_and_odd_texts(spark):
    """as hashed feature by feature; rows of one id are added up, over batches too."""
    import hashlib
    rows = [(1, "Alpha beta"), (1, "beta 😀 gamma"), (2, None), (3, ""), (None, "delta"), (4, "Ärger ÑANDÚ")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    want = {}
    for r in df.select("id", F.concat(F.transform(retrieval.tx.tokens(F.col("text")), lambda w: F.concat(F.lit("w:"), w)),
                                      F.transform(retrieval.tx.trigrams(F.col("text")), lambda g: F.concat(F.lit("c:"), g))).alias("f")).collect():
        for f in r["f"] or []:
            h = hashlib.md5(f.encode()).digest()
            want.setdefault(r["id"], np.zeros(512))[(h[0] + 256 * h[1]) % 512] += 1 if h[7] >= 128 else -1
    got = {(r["id"], r["dim"]): r["weight"] for r in retrieval.hashed_weights(df, "id", "text").collect()}
    full = {(k, i): x / np.sqrt((v * v).sum()) for k, v in want.items() for i, x in enumerate(v) if x}
    assert got.keys() == full.keys() and all(abs(got[k] - full[k]) < 1e-12 for k in got)
    plan = retrieval.hashed_weights(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(id" in plan


def test_a_small_index_is_sent_and_answers_as_a_large_one(spark, monkeypatch):
    """queries of one version were one group; F10: angles are held block by block."""
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(120)]
    df = spark.createDataFrame(v, "id long, vec array<double>, version int")
    ix = vectors.build(df, by="version", lists=9)
    rows = lambda d: sorted((r["query"], r["doc"], round(r["score"], 9), r["rank"]) for r in d.collect())
    sent = {f: vectors.search(ix, df, 4, floor=f, by="version", probes=3) for f in (None, 1.5)}
    assert "MapInPandas" in sent[None]._jdf.queryExecution().executedPlan().toString() and "FlatMapCoGroups" not in sent[None]._jdf.queryExecution().executedPlan().toString()
    sent = {f: rows(d) for f, d in sent.items()}
    monkeypatch.setattr(vectors, "SENT", 0)
    monkeypatch.setattr(vectors, "ANGLES", 20)
    assert {f: rows(vectors.search(ix, df, 4, floor=f, by="version", probes=3)) for f in (None, 1.5)} == sent


def test_rolling_counts_are_made_by_bucket():
    """one call and one state read served one key."""
    class Kept:
        rows = []
        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        def put(self, rows):
            self.rows = rows
    import pandas as pd
    p = jobs.RollingCount(10)
    p.hits = Kept()
    first = pd.concat(p.handleInputRows((0,), iter([pd.DataFrame({"k": [1, 2, 1], "u": [0, 1, 2], "t": [0, 0, 5]}), pd.DataFrame({"k": [1], "u": [3], "t": [5]})]), None))
    assert dict(zip(first["u"], first["used"])) == {0: 1, 1: 1, 2: 3, 3: 3}
    then = pd.concat(p.handleInputRows((0,), iter([pd.DataFrame({"k": [1, 2], "u": [4, 5], "t": [10, 9]})]), None))
    assert dict(zip(then["u"], then["used"])) == {4: 3, 5: 2}


def test_null_keys_leave_other_keys_alone(spark):
    """beside null keys, the state of one key reached others."""
    import tempfile
    rows = [(i, None if i % 7 == 0 else i % 5, i * 3600) for i in range(60)]
    path = tempfile.mkdtemp(prefix="run-")
    df = spark.createDataFrame(rows, "event_id long, user_id long, t long").select("event_id", "user_id", F.timestamp_seconds("t").alias("ts"))
    df.write.mode("overwrite").parquet(path)
    s = spark.readStream.schema(df.schema).parquet(path)
    got, _ = jobs.run(jobs.stateful(s, "user_id", "event_id", F.unix_micros("ts"), jobs.RollingCount(), "used long"), "t-null-keys")
    want = {i: sum(1 for _, v, y in rows if v == u and x - 86400 < y <= x) for i, u, x in rows}
    assert {r["u"]: r["used"] for r in got.collect()} == want


def test_each_distinct_span_is_matched_once_and_few_values_are_compared(spark, planned, monkeypatch):
    """F8: every span of every question met the values, and values that share no gram with a span were prepared for it."""
    names = spark.range(500).select(F.format_string("Customer#%09d", "id").alias("name"))
    lands = spark.createDataFrame([("Germany",), ("Switzerland",), ("x" * 900,), (None,)], "land string")
    asked = spark.range(300).select("id", F.lit("total billed to germany, switzerlannd and customers").alias("q"))
    met, whole = [], values.similar
    monkeypatch.setattr(values, "QUESTIONS", 50)
    monkeypatch.setattr(values, "similar", lambda a, b: met.append((a.count(), b.count())) or whole(a, b))
    got = values.match_values(asked, "id", "q", values.value_index({"c": names, "n": lands}))
    assert met[0][0] < 30 and met[0][1] <= 2
    assert "BroadcastHashJoin [_low" in planned(got) and "RoundRobinPartitioning(7)" in planned(got)
    rows = got.collect()
    assert sorted({(r.value, r.span, r.score, r["rank"]) for r in rows}) == [("Germany", "germany", 1.0, 1), ("Switzerland", "switzerlannd", 0.786, 2)] and len(rows) == 600
