"""Data behind charts: bins, shares, scale spread, labels, year axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin, low, high, n: equal widths from minimum to maximum, the last bin closed."""
    v = df.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    e = v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    j = v.crossJoin(e).withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    b = F.when(F.col("_w") > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1))).otherwise(0).cast("int")
    g = j.groupBy(b.alias("bin"), "_lo", "_w").agg(F.count("*").alias("n"))
    return g.select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "n")


def shares(df: DataFrame, category: str, value: str, limit: int = 8) -> DataFrame:
    """category, total, share, pie_ok: a pie is readable up to `limit` categories; the shares come either way."""
    g = df.groupBy(category).agg(F.sum(value).alias("total"))
    t = g.agg(F.sum("total").alias("_t"), F.count("*").alias("_n"))
    return g.crossJoin(t).select(category, "total", F.try_divide("total", "_t").alias("share"), (F.col("_n") <= limit).alias("pie_ok"))


def scale_spread(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the ratio of the largest to the smallest measure, and whether they need panels of their own."""
    one = df.agg(F.array(*[F.max(F.abs(c)).cast("double") for c in cols]).alias("_m"))
    m = F.filter("_m", lambda x: x.isNotNull() & (x != 0))
    spread = F.when(F.size(m) > 1, F.array_max(m) / F.array_min(m)).otherwise(1.0)
    return one.select(spread.alias("spread"), (spread > 10).alias("separate_panels"))


def x_label(*cols: str):
    return F.concat_ws(" · ", *[F.col(c).cast("string") for c in cols])


def year_like(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, year_like: every value numeric, whole and between 1900 and 2100."""
    def test(c):
        v = F.col(c).cast("string").try_cast("double")
        return F.coalesce(F.bool_and(F.coalesce((v == F.floor(v)) & v.between(1900, 2100), F.lit(False))), F.lit(False))

    return df.agg(*[test(c).alias(c) for c in cols]).unpivot([], cols, "column", "year_like")


