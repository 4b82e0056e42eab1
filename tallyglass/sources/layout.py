"""Partitioned and clustered copies, and what a query over a layout would read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions import numbers


def clustered_copy(df: DataFrame, path: str, date: str, cluster: str, first: str | None = None, last: str | None = None,
                   rows_per_file: int = 5_000_000) -> None:
    """A copy partitioned by event date and sorted by the cluster column inside each file.

    A day is spread over salted tasks, so one hot day is many files instead of one giant task.
    """
    d = df
    if first:
        d = d.where(F.col(date) >= F.lit(first).cast("timestamp_ntz"))
    if last:
        d = d.where(F.col(date) < F.lit(last).cast("timestamp_ntz"))
    d = d.withColumn("event_date", F.to_date(date))
    # AQE splits a day that outgrows the advisory size; the hint keeps a day's rows together otherwise.
    d = d.hint("rebalance", "event_date").sortWithinPartitions("event_date", cluster)
    d.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("event_date").parquet(path)


def clean_dimension(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per key, so that joins cannot count twice."""
    return df.select(*cols).distinct()


def column_chunks(paths: DataFrame) -> DataFrame:
    """path, row_group, column, n_rows, stored_bytes, plain_bytes: one row per column chunk, from the footers of the files in `path`.

    Each task reads the footers of its files and no data. Nested columns are told by their top name.
    """
    def read(batches):
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        names = ["path", "row_group", "column", "n_rows", "stored_bytes", "plain_bytes"]
        for batch in batches:
            rows = []
            for path in batch["path"]:
                where, name = fs.FileSystem.from_uri(path.replace("file:///", "/") if path.startswith("file:") else path)
                with where.open_input_file(name) as f:
                    meta = pq.ParquetFile(f).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        chunk = group.column(c)
                        rows.append((path, g, chunk.path_in_schema.split(".")[0], group.num_rows, chunk.total_compressed_size, chunk.total_uncompressed_size))
            yield pd.DataFrame(rows, columns=names)

    return paths.select("path").mapInPandas(read, "path string, row_group int, column string, n_rows long, stored_bytes long, plain_bytes long")


def scan_estimate(spark: SparkSession, path: str, predicate: Column, confirm_bytes: int | None = None, max_bytes: int | None = None,
                  columns: list[str] | None = None) -> DataFrame:
    """bytes, files, usd, text, verdict of reading `columns` (all, if None) of the files that survive pruning by `predicate`.

    The predicate must be on partition columns. With `columns` the footers of the files say how many bytes these
    columns take; without, the lengths of the files do. No content is read.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).where(predicate)
    one = listed.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
    if columns is not None:
        # A footer is small: files are spread by number, as a scan task would take many of them by their listed length.
        read = column_chunks(listed.select("path").repartition(spark.sparkContext.defaultParallelism, "path"))
        sizes = read.agg(F.coalesce(F.sum(F.when(F.col("column").isin(list(columns)), F.col("stored_bytes"))), F.lit(0)).alias("bytes"))
        one = sizes.crossJoin(one.select("files"))
    v = F.lit("run")
    if confirm_bytes is not None:
        v = F.when(F.col("bytes") > confirm_bytes, "confirm").otherwise(v)
    if max_bytes is not None:
        v = F.when(F.col("bytes") > max_bytes, "refuse").otherwise(v)
    b = F.col("bytes").cast("double")
    return one.select("bytes", "files", numbers.usd(b).alias("usd"), numbers.cost_text(b).alias("text"), v.alias("verdict"))


def savings(estimates: DataFrame, tag: str) -> DataFrame:
    """estimates: tag, layout ('partitioned' or 'flat'), bytes, verdict. Mean bytes by tag and the share saved."""
    m = lambda layout: F.avg(F.when(F.col("layout") == layout, F.col("bytes")))
    return estimates.groupBy(tag).agg(m("partitioned").alias("partitioned_bytes"), m("flat").alias("flat_bytes"),
                                      F.count_if((F.col("layout") == "partitioned") & (F.col("verdict") != "run")).alias("guard_fired")).withColumn(
        "saved_pct", F.round(100 * (1 - F.col("partitioned_bytes") / F.col("flat_bytes")), 2))
