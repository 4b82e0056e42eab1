"""Verdicts on results, claims and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass import fixed
from tallyglass.operators import stats
from tallyglass.operators.present import numeric_columns
from tallyglass.operators.profile import union


def status(confidence: Column) -> Column:
    return (F.when(confidence >= fixed.WARN_BELOW, "validated")
            .when(confidence >= fixed.REJECT_BELOW, "validated_with_warnings").otherwise("rejected"))


def verdict_columns(start: int, rules: list[tuple[Column, Column | None, int]]) -> tuple[Column, Column]:
    """(warnings, confidence) from (condition, warning or None, penalty) rules."""
    texts = [F.when(c, w) for c, w, _ in rules if w is not None]
    loss = F.lit(0)
    for c, _, p in rules:
        loss = loss + F.when(c, p).otherwise(0)
    return F.array_compact(F.array(*texts)), F.lit(start) - loss


def validate_result(df: DataFrame, name: str) -> DataFrame:
    """One verdict row for a whole result table."""
    nums = numeric_columns(df)
    g = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    # Rows and extra copies come from the grouped rows; column checks from one scan.
    dup = g.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))
    checks = []
    for i, c in enumerate(nums):
        top = F.max(F.col(c).cast("double"))
        checks.append(F.struct(
            F.lit(i * 2).alias("pos"), F.when(F.count(c) == 0, F.lit(f"Column '{c}' is entirely null")).alias("warning"), F.lit(15).alias("loss")))
        checks.append(F.struct(
            F.lit(i * 2 + 1).alias("pos"),
            F.when(top > 1e12, F.format_string(f"Column '{c}' has very large values (%.0f) - possible aggregation of ID column", top)).alias("warning"),
            F.lit(10).alias("loss")))
    column_rows = (df.agg(F.array(*checks).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*").where("warning IS NOT NULL")
                   if checks else df.sparkSession.createDataFrame([], "pos int, warning string, loss int"))
    shape = dup.select(F.explode(F.array(
        F.struct(F.lit(10_000).alias("pos"), F.when(
            (F.col("rows") > 500), F.format_string("Result has %d rows - consider adding more specific filters", "rows")).alias("warning"), F.lit(5).alias("loss")),
        F.struct(F.lit(10_001).alias("pos"), F.when(F.col("duplicates") > 0, F.format_string(
            "Result contains %d duplicate rows", "duplicates")).alias("warning"), F.lit(5).alias("loss")))).alias("_s")).select("_s.*")
    parts = [column_rows, shape.where("warning IS NOT NULL")]
    if nums:
        order = F.array_position(F.array(*[F.lit(c) for c in nums]), F.col("column")).cast("int")
        a = stats.audit(df, nums).crossJoin(dup.select("rows")).where("rows >= 20")
        pos = F.lit(20_000) + order * 2 + F.when(F.col("check") == "skew", 1).otherwise(0)
        parts.append(a.select(pos.alias("pos"), "warning", F.lit(5).alias("loss")))
    # A handful of rows per column: bounded by the schema.
    w = union(parts).agg(F.array_sort(F.collect_list(F.struct("pos", "warning"))).alias("_w"), F.coalesce(F.sum("loss"), F.lit(0)).alias("_loss"))
    empty = F.col("rows") == 0
    confidence = F.when(empty, 20).otherwise(F.greatest(F.lit(0), F.lit(fixed.START_CONFIDENCE) - F.col("_loss"))).cast("int")
    texts = F.when(empty, F.array(F.lit("Query returned no results"))).otherwise(F.transform("_w", lambda x: x["warning"]))
    return dup.crossJoin(w).select(F.lit(name).alias("result"), "rows", "duplicates", confidence.alias("confidence"),
                                   F.when(empty, "rejected").otherwise(status(F.lit(fixed.START_CONFIDENCE) - F.col("_loss"))).alias("status"),
                                   texts.alias("warnings"))


def validate_claims(claims: DataFrame) -> DataFrame:
    """Adds warnings, confidence, status to rows with sample_size, correlation, pct_change,
    base_value, ci_width, forecast (each may be NULL)."""
    n, r, pct, base = F.col("sample_size"), F.abs("correlation"), F.col("pct_change"), F.col("base_value")
    yes = lambda c: F.coalesce(c, F.lit(False))
    warnings, confidence = verdict_columns(fixed.START_CONFIDENCE, [
        (yes(n < 30), F.format_string("Sample size is only %d. Results may not be statistically significant (n < 30).", n), 20),
        (yes(n < 10), None, 20),
        (yes(r < 0.1), F.format_string("Correlation of %.3f is negligible", "correlation"), 15),
        (yes((r >= 0.1) & (r < 0.3)), F.format_string("Correlation of %.3f is weak", "correlation"), 10),
        (yes((base < 10) & (F.abs(pct) > 100)), F.format_string("A %.0f%% change from a base of %.1f may be misleading", "pct_change", "base_value"), 15),
        (yes(F.col("ci_width") > F.abs("forecast") * 2),
         F.lit("Confidence interval is wider than the forecast value - prediction is very uncertain"), 25),
    ])
    return claims.select("*", warnings.alias("warnings"), F.greatest(F.lit(0), confidence).alias("confidence"), status(confidence).alias("status"))


def validate_charts(charts: DataFrame) -> DataFrame:
    """Adds a verdict to rows with chart_type, n_rows, x_distinct, x_temporal, x_numeric."""
    kind = F.col("chart_type")
    warnings, confidence = verdict_columns(fixed.CHART_START_CONFIDENCE, [
        ((kind == "pie") & (F.col("x_distinct") > 6),
         F.format_string("Pie chart has %d slices - consider a bar chart instead", "x_distinct"), 20),
        ((kind == "line") & ~F.col("x_temporal") & ~F.col("x_numeric"),
         F.lit("Line chart x-axis is not temporal or numeric - may be misleading"), 15),
        ((kind == "line") & (F.col("n_rows") < 3),
         F.format_string("Only %d data points for trend line - insufficient for trend analysis", "n_rows"), 20),
    ])
    return charts.select("*", warnings.alias("warnings"), F.greatest(F.lit(0), confidence).alias("confidence"), status(confidence).alias("status"))


def combine(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings joined, the lower confidence; the first status stays as it was."""
    b = second.select(*keys, F.col("warnings").alias("_w"), F.col("confidence").alias("_c"))
    j = first.join(b, keys, "left")
    return j.select(*keys, F.concat("warnings", F.coalesce("_w", F.array().cast("array<string>"))).alias("warnings"),
                    F.least("confidence", "_c").alias("confidence"), "status")
