"""Shared pieces: table access, checkpoints, running sums over hashed buckets."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of this process only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix=f"llm-{os.getpid()}-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def merged(df: DataFrame) -> DataFrame:
    """The rows in fewer partitions, put together without a shuffle, for what is written next: a file for each of them.

    Four for each core, and an eighth of the session's shuffle partitions where that is more, so they grow with the input.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def keep(df: DataFrame, kind: str = "table") -> DataFrame:
    """Writes a result that several jobs read as Parquet into the shared folder and reads it back.

    That cuts the lineage: retries after a lost executor read the files, and nothing is computed twice.
    """
    path = scratch(df.sparkSession, kind)
    merged(df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_dealt(df: DataFrame, column: str, kind: str = "table") -> DataFrame:
    """As `keep`, but in buckets of a column: joins on it move the other side only, however often they are made.

    One bucket for each shuffle partition of the session. Such a join can't split a hot key, so join rows to it that
    are distinct in the column. The table leaves the catalog at once, its files stay as those of `keep` do.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, kind)
    name = f"{kind}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, column).saveAsTable(name, format="parquet")
    read = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return read


def fanout(spark: SparkSession) -> int:
    """Slices for two-level sums: follows the partitions that the cluster is set to."""
    return max(256, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(work: DataFrame, *cols: str) -> DataFrame:
    """Rows that each stand for much work (a file, a range), in as many partitions: AQE merges none of a given number."""
    most = 64 * int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(max(1, min(work.count(), most)), *cols)


def row_id(id_col: str = "doc_id", text: str = "text"):
    """The doc_id as text; where there is none, one made of the row's text, so that such rows are spread like others."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("n"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def rows_of(docs: DataFrame) -> DataFrame:
    """The rows as one struct column `_row`, so that no column of theirs can clash; `select("_row.*")` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def row_key():
    """A 64-bit hash of doc_id and text, never null: rows of one doc_id with different texts, or without one, stay apart."""
    return F.xxhash64("doc_id", "text")


def source_key(col="source"):
    """Never null, so that it can be grouped and joined: null sources share one key, after all others."""
    c = F.col(col)
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c))


def unit(seed: int, *cols):
    """A seeded md5 of the columns as hex text, and its leading 32 bits as a number in [0, 1)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return h, F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def running(df: DataFrame, part: list[str], slice_col: str, order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows before each row, in the order (slice, order), within `part`.

    `slice_col` must grow with the order. Slices are folded first, so no window ever holds more than one slice,
    however many rows a part has.
    """
    totals = df.groupBy(*part, slice_col).agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*part).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*part, slice_col, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_b"))
    inner = Window.partitionBy(*part, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(before, [*part, slice_col])
        .withColumn(out, F.col("_b") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_b")
    )
