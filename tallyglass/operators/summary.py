"""Column summaries over whole tables, with exact quantiles that stay distributed.

The built-in exact ``percentile`` keeps every distinct value of a group in one
task. Here a mergeable sketch first brackets each quantile; one more pass counts
the rows below the bracket and keeps only the values inside it and their two
neighbours, so the window that picks the exact ranks sees a vanishing share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.session import beside

SKETCH_ACCURACY = 50_000


def long_form(df: DataFrame, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, column, value): one row per non-null numeric cell."""
    vals = [F.col(c).cast("double").alias(c) for c in cols]
    return df.select(*keys, *vals).unpivot(list(keys), cols, "column", "value").where("value IS NOT NULL")


def exact_quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float],
                    accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Linear-interpolation quantiles per key: columns keys + one per name in probs."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, v.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    names = list(probs)
    eps = 2.0 / accuracy
    edges = [max(0.0, probs[n] - eps) for n in names] + [min(1.0, probs[n] + eps) for n in names]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_e"))
    spec = F.array(*[
        F.struct(F.lit(i).alias("_q"), F.col("_e")[i].alias("_lo"), F.col("_e")[len(names) + i].alias("_hi"),
                 (F.lit(float(probs[n])) * (F.col("_n") - 1)).alias("_h"))
        for i, n in enumerate(names)])
    brackets = (beside(sketch) if keys else sketch).select(*keys, F.explode(spec).alias("_s")).select(*keys, "_s.*")
    j = rows.join(brackets, list(keys)) if keys else rows.crossJoin(brackets)
    # The rows below a bracket fold into one counted row before the shuffle, and those above. The slack on each side is
    # twice the sketch's error; as ranks are rounded, the wanted one may be the next beyond: the largest value below, or
    # the smallest above.
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    inside = F.when(F.col("_v").between(F.col("_lo"), F.col("_hi")), F.col("_v"))
    counted = j.groupBy(*keys, "_q", "_h", side.alias("_side"), inside.alias("_in")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    counted = counted.withColumn("_v", F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least")))
    w = Window.partitionBy(*keys, "_q").orderBy("_v")
    ranked = counted.withColumn("_end", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda r: F.min(F.when(F.col("_end") > r, F.col("_v")))
    picked = ranked.groupBy(*keys, "_q").agg(
        at(F.floor("_h")).alias("_a"), at(F.ceil("_h")).alias("_b"), F.first("_h").alias("_h"))
    val = F.col("_a") + (F.col("_h") - F.floor("_h")) * (F.col("_b") - F.col("_a"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == i, val)).alias(n) for i, n in enumerate(names)])


def column_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float], keys: list[str] = (),
                     exact: bool = True, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Quantiles of many columns at once: keys + column + one per name in probs.

    ``exact=False`` stops at the sketch: one pass, rank error at most 1/accuracy.
    """
    rows = long_form(df, cols, keys)
    by = [*keys, "column"]
    if exact:
        return exact_quantiles(rows, by, "value", probs, accuracy)
    q = rows.groupBy(*by).agg(F.percentile_approx("value", list(probs.values()), accuracy).alias("_e"))
    return q.select(*by, *[F.col("_e")[i].alias(n) for i, n in enumerate(probs)])


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """One scan for all columns, then one row per column."""
    parts = []
    for c in cols:
        v = F.col(c).cast("double")
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
            F.min(v).alias("low"), F.max(v).alias("high"), F.skewness(v).alias("g1"), F.sum(v).alias("total")))
    return df.agg(F.array(*parts).alias("_m")).select(F.explode("_m").alias("_m")).select("_m.*")


def describe(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """count, mean, sd, min, quartiles, max per numeric column."""
    q = column_quantiles(df, cols, QUARTILES, exact=exact)
    return (moments(df, cols).join(q, "column", "left")
            .select("column", "n", "mean", "sd", "low", "q1", "median", "q3", "high"))
