"""What the Jaccard join keeps and moves: few jobs for its components, texts squeezed and left in their buckets."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import graph, jaccard


@pytest.mark.parametrize(("edges", "most"), [([(1, 10 + k) for k in range(30)] + [(5, 6)], 2), ([(i, i + 1) for i in range(30)], 6)])
def test_components_stop_as_soon_as_only_stars_are_left(spark, monkeypatch, edges, most):
    kept = []
    whole = graph.keep
    monkeypatch.setattr(graph, "keep", lambda df, kind: kept.append(kind) or whole(df, kind))
    got = {r.u: r.v for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    first = {1: {10 + k: 1 for k in range(30)} | {6: 5}, 0: {i: 0 for i in range(1, 31)}}[edges[0][0]]
    assert got == first and len(kept) <= most


def test_squeezed_texts_give_the_same_sets(monkeypatch):
    monkeypatch.setattr(jaccard.W, "BLOCK_BYTES", 64)
    texts = pa.array([" ".join(f"w{i}" for i in range(n)) for n in (0, 3, 5, 90, 7)] + [None, "é " * 9])
    a = {r: s.tolist() for r, s in jaccard.shingle_sets(texts)}
    b = {r: s.tolist() for x in [pa.chunked_array(jaccard.squeezed(texts), pa.binary()).combine_chunks()] for r, s in jaccard.squeezed_sets(x)}
    assert a == b and len(a) == 7
    assert list(jaccard.squeezed_sets(pa.array([], pa.binary()))) == []


def test_texts_stay_where_they_are_and_bring_the_columns_of_the_asking_rows(spark, make):
    docs = make([(i, f"a{i} b c d e f") for i in range(40)])
    found = jaccard.profile(docs)
    lists = found.filter("set is not null").select(F.col("set").alias("node"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = jaccard.Texts(docs, found, lists).of(lists.select("node", (F.col("node") % 7).alias("mark")))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        # ids, names and wanted keys are dealt, the texts below and above the last join are not
        assert plan.count("Exchange hashpartitioning") == 3 and "Bucketed: true" in plan.split("Exchange")[-1]
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == 40 and all(r.mark == int(np.fmod(r.node, 7)) for r in got)
