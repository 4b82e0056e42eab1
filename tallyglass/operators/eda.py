"""Exploratory report over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.operators import profile, stats, summary
from tallyglass.operators.present import FLOATING, numeric_columns, time_columns


def _rows(df: DataFrame, part: int, order, section: str, metric, value, detail) -> DataFrame:
    return df.select(F.lit(part).alias("part"), order.cast("double").alias("order"), F.lit(section).alias("section"),
                     metric.alias("metric"), value.alias("value"), detail.alias("detail"))


def report(df: DataFrame) -> DataFrame:
    """(part, order, section, metric, value, detail): the sections of the report as rows."""
    nums, times = numeric_columns(df), time_columns(df)
    cats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    pos = lambda names: F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column"))
    # One scan counts rows and missing cells; only the categorical columns' distinct values are shown, so only they are shuffled.
    gone = lambda f: F.col(f"`{f.name}`").isNull() | (F.isnan(f"`{f.name}`") if isinstance(f.dataType, FLOATING) else F.lit(False))
    counts = [F.struct(F.lit(f.name).alias("column"), F.count("*").alias("rows"), F.count_if(gone(f)).alias("missing")) for f in df.schema.fields]
    facts = df.agg(F.array(*counts).alias("_f")).select(F.explode("_f").alias("_f")).select("_f.*").where("rows > 0")
    total = facts.agg(F.max("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum("rows").alias("cells"))
    dups = (df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("copies"), F.sum("_n").alias("rows")))
    pct = lambda a, b: F.format_string("%,d (%.1f%%)", a, 100.0 * F.col(a) / F.col(b))
    parts = [
        _rows(total, 0, F.lit(0), "Overview", F.lit("Dataset Shape"),
              F.format_string("%,d rows x " + str(len(df.columns)) + " columns", "rows"),
              F.lit(f"Numeric: {len(nums)}, Categorical: {len(cats)}, Datetime: {len(times)}")),
        _rows(total, 0, F.lit(1), "Overview", F.lit("Missing Values"), pct("missing", "cells"),
              F.lit("Total missing cells across all columns")),
        _rows(dups.where("copies > 0"), 0, F.lit(2), "Overview", F.lit("Duplicate Rows"), pct("copies", "rows"),
              F.lit("Exact duplicate rows")),
    ]
    if nums:
        d = summary.describe(df, nums).where("n > 0")
        parts.append(_rows(d, 1, pos(nums) * 3, "Numeric Stats", F.col("column"), F.format_string("mean=%.2f, std=%.2f", "mean", "sd"),
                           F.format_string("min=%.2f, 25%%=%.2f, median=%.2f, 75%%=%.2f, max=%.2f", "low", "q1", "median", "q3", "high")))
        o = stats.outliers(df, nums).where("n_outliers > 0")
        parts.append(_rows(o, 1, pos(nums) * 3 + 1, "Outliers", F.col("column"),
                           F.format_string("%d outliers (%.1f%%)", "n_outliers", F.col("share") * 100),
                           F.format_string("Tukey fences: [%.2f, %.2f]", "lower_fence", "upper_fence")))
        s = stats.skewness(df, nums).where("verdict NOT IN ('symmetric', 'undefined')")
        parts.append(_rows(s, 1, pos(nums) * 3 + 2, "Distribution", F.concat("column", F.lit(" skewness")),
                           F.format_string("%.3f (%s)", "skew", "verdict"),
                           F.when(F.col("p_value").isNull(), "n too small for test").otherwise(F.format_string("p-value=%.4f", "p_value"))))
    if cats:
        freq = profile.frequencies(df.select(*[f"`{c}`" for c in cats]))
        top = profile.top_values(freq, 3)
        unique = freq.groupBy("column").agg(F.count("value").alias("unique"))
        shown = F.array_join(F.transform(F.arrays_zip("top_values", "top_counts"), lambda x: F.format_string(
            "%s (%d)", x["top_values"], x["top_counts"])), ", ")
        c = unique.join(top, "column")
        parts.append(_rows(c, 2, pos(cats), "Categorical Stats", F.col("column"), F.format_string("%d unique values", "unique"),
                           F.concat(F.lit("Top: "), shown)))
    if len(nums) >= 2:
        pairs = [f"{a} vs {b}" for a, b in stats.pairs(nums)]
        k = stats.correlation_test(df, nums).withColumn("column", F.concat_ws(" vs ", "column_a", "column_b"))
        parts.append(_rows(k, 3, pos(pairs), "Correlations", F.col("column"), F.format_string("r=%.4f (%s)", "r", "verdict"),
                           F.format_string("p=%.6f, n=%d, significant=%s", "p_value", "n", F.initcap(F.col("significant").cast("string")))))
    parts.append(_rows(facts.where("missing > 0"), 4, -F.col("missing"), "Missing Values", F.col("column"), pct("missing", "rows"),
                       F.lit("Missing values in this column")))
    return profile.union(parts).orderBy("part", "order", "metric")


def correlation_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """All numeric pairs, strongest first."""
    c = stats.correlations(df, cols).select("column_a", "column_b", F.round("r", 4).alias("correlation"))
    return c.orderBy(F.abs("correlation").desc_nulls_last(), "column_a", "column_b")
