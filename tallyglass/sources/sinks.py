"""Sinks: appends, snapshots, listings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.session import checkpoint_root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] = ()) -> None:
    w = df.write.mode("append").format(fmt)
    (w.partitionBy(*by) if by else w).save(path)


def snapshot(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A result as one replaceable snapshot."""
    df.write.mode("overwrite").format(fmt).save(path)


def newest_first(df: DataFrame, created: str, limit: int | None = None) -> DataFrame:
    d = df.orderBy(F.desc(created))
    return d if limit is None else d.limit(limit)
