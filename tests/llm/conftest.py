import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""
    def build(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.repartition(parts) if full else df
    return build


@pytest.fixture(scope="session")
def clash(make):
    """Columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    def build(rows):
        names = ("_id", "_row", "_h", "_k", "_i", "_src", "_words", "_bad", "_gone", "_ps", "node", "token", "items", "size", "shard", "slot", "kept", "score", "bucket", "uri")
        return make(rows).withColumns({n: F.lit(1) for n in names})
    return build
