"""The registered queries: SQL twins, empty tables, foreign columns, and the pipeline stage by stage."""

from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyglass import llm
from tallyglass.llm import common, credentials, jaccard, mixing, quality, shards, suffixes, tokens, toxicity, warc, winnow

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = llm.load()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in ("op12_spelling", "op13_negatives"):  # these return one row per word, and per anchor and pair
        n = spark.read.parquet(f"{SMALL}/{'pages' if 'warc' in name else 'embeddings' if 'metric' in name else 'documents'}.parquet").count()
        assert len(got) == n
    if name in SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = con.sql(SQL[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        key = [c for c in ("anchor_id", "positive_id", "rank") if c in got.columns] or got.columns[0]
        a, b = (x[sorted(got.columns)].sort_values(key).reset_index(drop=True).astype(object) for x in (got, want))
        pd.testing.assert_frame_equal(a.where(a.notna(), None), b.where(b.notna(), None), check_dtype=False)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


OPERATORS = {
    "suffixes": lambda d, lb, bm: suffixes.removed_bytes(d),
    "mix": lambda d, lb, bm: mixing.mix(d),
    "mixed": lambda d, lb, bm: mixing.mixed_documents(d),
    "toxicity": lambda d, lb, bm: toxicity.score(d, lb),
    "winnow": lambda d, lb, bm: winnow.decontaminate(d, bm),
    "clean": lambda d, lb, bm: winnow.clean_documents(d, bm),
    "assign": lambda d, lb, bm: shards.assign(d),
    "shard": lambda d, lb, bm: shards.shard_documents(d),
    "quality": lambda d, lb, bm: quality.score(d, lb),
    "kept": lambda d, lb, bm: quality.kept_documents(d, lb),
    "jaccard": lambda d, lb, bm: jaccard.join(d),
    "one": lambda d, lb, bm: jaccard.one_per_component(d),
    "secrets": lambda d, lb, bm: credentials.scan(d),
}
ODD = [(1, "", None), (2, None, None), (None, None, "a"), (None, "password=abcdef x y z", None), (3, "a b c d e f", "a"), (3, "a b c d e f", "a"), (3, "another text", "b"), (4, "é" * 5000, "b"), (5, "\x00\n\t ", "b")]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_odd_rows(spark, make, clash, labels, benchmark, name):
    run = OPERATORS[name]
    assert run(make([]), labels.limit(0), benchmark.limit(0)).collect() == []
    odd = clash(ODD)
    nulls = spark.createDataFrame([(None, None, None), (3, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, "a b"), (1, None), (2, "")], "item_id long, text string")
    got = run(odd, nulls, items).collect()
    if name not in ("mixed", "kept", "one", "clean"):
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)


def test_empty_pages_and_tokens(spark, make):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(none).collect() == []
    odd = spark.createDataFrame([(None, "u", "x"), (1, None, None), (1, None, None), (2, "u", "")], "page_id long, url string, html string").withColumns({"uri": F.lit(1), "refers_to": F.lit(2), "_id": F.lit(3)})
    assert Counter((r.page_id, r.record_type) for r in warc.archive_pages(odd).collect()) == {(1, "response"): 2, (2, "revisit"): 1}
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert tokens.encode_documents(make([]), path).collect() == []
    got = tokens.encode_documents(make(ODD), path).collect()
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == [0, *pd.Series([r.n_tokens for r in sorted(got, key=lambda r: r.start)]).cumsum()[:-1]]


def test_pipeline_stages(spark):
    docs = common.table(spark, SMALL, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.keep(stage(spark, docs, SMALL), name)
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    a, b = seen["quality_rules"]
    assert ids(b) == ids(quality.score(a, common.table(spark, SMALL, "labels")).filter("kept"))
    a, b = seen["ngram_jaccard_join"]
    assert ids(b) == ids(jaccard.join(a).filter("doc_id = component_id"))
    a, b = seen["benchmark_decontamination"]
    assert ids(b) == ids(winnow.decontaminate(a, common.table(spark, SMALL, "benchmark")).filter("not contaminated"))
    a, b = seen["source_mixing"]
    assert Counter(ids(b)) == Counter({r.doc_id: r.copies for r in mixing.mix(a).filter("copies > 0").collect()})
    a, b = seen["sharding"]
    assert ids(a) == ids(b) and b.select("shard", "slot").distinct().count() == b.count()


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert len(got) and {"doc_id", "text", "shard", "slot"} <= set(got.columns)
