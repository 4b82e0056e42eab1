"""Finishing a result table for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
TIMES = (T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, *TIMES))]


def finish(df: DataFrame, ordered: bool = False) -> DataFrame:
    """Floats to two decimals; one measure beside labels is sorted largest first
    unless the query already chose an order."""
    measures = numeric_columns(df)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    if len(measures) == 1 and len(df.columns) > 1 and not ordered:
        df = df.orderBy(F.col(measures[0]).desc_nulls_last(), *[c for c in df.columns if c != measures[0]])
    return df.select(*[F.round(c, 2).alias(c) if c in floats else F.col(c) for c in df.columns])


def midnight_columns(df: DataFrame) -> DataFrame:
    """One row per timestamp column: do all its values fall on midnight?"""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, TIMES)]
    one = df.agg(*[F.coalesce(F.bool_and(F.date_trunc("day", c) == F.col(c)), F.lit(True)).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "date_only")


def preview(df: DataFrame, order: list[str], n: int = 50) -> DataFrame:
    """The first n rows in a stated order, NaN shown as NULL, with the full row count."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    total = df.agg(F.count("*").alias("row_count"))
    head = df.orderBy(*order).limit(n)
    shown = [F.nanvl(c, F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns]
    return head.select(*shown).crossJoin(total)
