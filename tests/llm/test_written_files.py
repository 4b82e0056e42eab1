"""How many files results are written as: a bounded number for each core, however many partitions the shuffles have."""

import pytest
from pyspark.sql import functions as F

from tallyglass.llm import common, jaccard, suffixes, winnow


@pytest.fixture
def many(spark):
    """A session whose shuffles have many partitions that AQE does not merge."""
    conf = {"spark.sql.shuffle.partitions": "120", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield max(4 * spark.sparkContext.defaultParallelism, 120 // 8)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_kept_results_are_few_files_with_all_rows(spark, many):
    df = spark.range(5_000).repartition(120, "id")
    kept = common.keep(df.groupBy((F.col("id") % 999).alias("k")).agg(F.sum("id").alias("s")))
    assert 0 < len(kept.inputFiles()) <= many < 120
    assert {r.k: r.s for r in kept.collect()} == {k: sum(range(k, 5_000, 999)) for k in range(999)}


def test_more_shuffle_partitions_give_more_files(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(64 * spark.sparkContext.defaultParallelism))
    try:
        assert common.merged(spark.range(9).repartition(9_999)).rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("module", [suffixes, winnow, jaccard])
def test_queries_give_few_partitions(spark, make, many, monkeypatch, module):
    tables = {"documents": make([(i, f"a b c d e f g h i j k l m n o p {i % 3}") for i in range(30)])}
    tables["benchmark"] = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    monkeypatch.setattr(module, "table", lambda spark, sf_dir, name: tables[name])
    got = module.query(spark, "")
    assert got.rdd.getNumPartitions() <= many
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == list(range(30))
