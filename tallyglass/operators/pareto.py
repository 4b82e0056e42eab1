"""Cost/score frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frontier(df: DataFrame, series: str, cost: str, score: str, point: str, cells: int = 64) -> DataFrame:
    """Points that no cheaper (or equally cheap) point matches or beats, per series.

    Two phases: each hash cell of a series keeps its own frontier, and only the
    survivors of all cells meet in one window. A dominated point is dominated
    in every superset, so the local cut loses nothing.
    """
    def keep(d: DataFrame, keys: list[str]) -> DataFrame:
        w = (Window.partitionBy(*keys).orderBy(cost, F.desc(score), point)
             .rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("_best", F.max(score).over(w))
        return d.where(F.col("_best").isNull() | (F.col(score) > F.col("_best"))).drop("_best")

    local = keep(df.withColumn("_cell", F.pmod(F.xxhash64(point), F.lit(cells))), [series, "_cell"]).drop("_cell")
    return keep(local, [series])
