"""Top-k cuts whose answer is not determined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def limit_tie(df: DataFrame, order: list, keys: list[str], k: int, offset: int = 0) -> DataFrame:
    """One row: do the last row inside the limit and the first row outside share their order keys?

    `order` are the sort columns, `keys` their names in df.
    """
    top = df.select(*keys).orderBy(*order).limit(offset + k + 1)
    n = top.agg(F.count("*").alias("rows"))
    edge = top.offset(offset + k - 1).agg(F.count("*").alias("_edge"),
                                          F.count_distinct(F.struct(*keys)).alias("_keys"))
    return n.crossJoin(edge).select(
        F.lit(offset + k - 1).alias("last_row"),
        ((F.col("_edge") == 2) & (F.col("_keys") == 1)).alias("tie"))


def group_limit_ties(df: DataFrame, by: list[str], order: list, keys: list[str], k: int) -> DataFrame:
    """Groups whose top-k cut falls between equal order keys."""
    w = Window.partitionBy(*by).orderBy(*order)
    r = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k + 1)
    e = r.where(F.col("_rn") >= k).groupBy(*by).agg(F.count("*").alias("_n"), F.count_distinct(F.struct(*keys)).alias("_k"))
    return e.where("_n = 2 AND _k = 1").select(*by)


def rank_ties(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Groups in which rank 1 is shared: the "best per group" has several answers."""
    w = Window.partitionBy(*by).orderBy(*order)
    r = df.withColumn("_rk", F.rank().over(w)).where("_rk = 1")
    return r.groupBy(*by).agg(F.count("*").alias("winners")).where("winners > 1")
