"""Statistics of columns and groups: fences, skew, effect size, correlation, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import tails
from tallyglass.operators.present import numeric_columns
from tallyglass.operators.summary import column_quantiles, long_form, moments


def fences(df: DataFrame, cols: list[str], k: float = 1.5, exact: bool = True) -> DataFrame:
    """column, q1, q3, lo, hi. One row per column."""
    q = column_quantiles(df, cols, {"q1": 0.25, "q3": 0.75}, exact=exact)
    iqr = F.col("q3") - F.col("q1")
    return q.select("column", "q1", "q3", (F.col("q1") - k * iqr).alias("lo"), (F.col("q3") + k * iqr).alias("hi"))


def outliers(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Tukey report per numeric column with at least four values."""
    cols = cols or numeric_columns(df)
    # One row per column meets the cells: bounded by the schema, not by the data.
    cells = long_form(df, cols).where("NOT isnan(value)").join(F.broadcast(fences(df, cols, exact=exact)), "column")
    flat = F.col("q1") == F.col("q3")
    out = F.count_if(~flat & ((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))))
    g = cells.groupBy("column", "lo", "hi").agg(F.count("*").alias("n"), out.alias("n_outliers")).where("n >= 4")
    return g.select("column", "n", "n_outliers", F.round(F.col("n_outliers") / F.col("n"), 4).alias("share"),
                    F.round("lo", 4).alias("lower_fence"), F.round("hi", 4).alias("upper_fence"))


def adjusted_skew(n: Column, g1: Column) -> Column:
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * g1)


def skew_z(n: Column, g1: Column) -> Column:
    """D'Agostino's normal score of the population skewness."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    y = F.when(y == 0, 1.0).otherwise(y)
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    return F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))


def skewness(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or numeric_columns(df)
    # Doubles: n squared overflows a long on a large table.
    m = moments(df, cols).where("n >= 3").withColumn("_n", F.col("n").cast("double"))
    g1 = F.when(F.isnan("g1"), F.lit(None)).otherwise(F.col("g1"))
    sk = adjusted_skew(F.col("_n"), g1)
    m = m.withColumn("_sk", sk).withColumn("_z", F.when(F.col("_n") >= 8, F.abs(skew_z(F.col("_n"), g1))))
    a = F.abs("_sk")
    verdict = (F.when(F.col("_sk").isNull(), "undefined").when(a < 0.5, "symmetric")
               .when(a < 1.0, "moderate").otherwise("high"))
    return m.select("column", "n", F.round("_sk", 4).alias("skew"),
                    tails.erfc(F.col("_z") / F.sqrt(F.lit(2.0))).alias("p_value"), verdict.alias("verdict"))


def magnitude(x: Column, cuts: tuple[float, float, float], names: tuple[str, str, str, str]) -> Column:
    a = F.abs(x)
    return F.when(a < cuts[0], names[0]).when(a < cuts[1], names[1]).when(a < cuts[2], names[2]).otherwise(names[3])


def effect_size(df: DataFrame, group: str, value: str, a, b, keys: list[str] = ()) -> DataFrame:
    """Cohen's d of group a against group b, per key. One conditional aggregation, no join."""
    v = F.col(value).cast("double")
    pa, pb = F.when(F.col(group) == a, v), F.when(F.col(group) == b, v)
    s = df.where(F.col(group).isin(a, b)).groupBy(*keys).agg(
        F.count(pa).alias("n_a"), F.count(pb).alias("n_b"), F.avg(pa).alias("_ma"), F.avg(pb).alias("_mb"),
        F.var_samp(pa).alias("_va"), F.var_samp(pb).alias("_vb")).where("n_a >= 2 AND n_b >= 2")
    pooled = ((F.col("n_a") - 1) * F.col("_va") + (F.col("n_b") - 1) * F.col("_vb")) / (F.col("n_a") + F.col("n_b") - 2)
    d = F.when(pooled > 0, (F.col("_ma") - F.col("_mb")) / F.sqrt(pooled)).otherwise(0.0)
    names = ("negligible", "small", "medium", "large")
    return s.select(*keys, "n_a", "n_b", F.round("_ma", 4).alias("mean_a"), F.round("_mb", 4).alias("mean_b"),
                    F.round(d, 4).alias("d"), magnitude(d, (0.2, 0.5, 0.8), names).alias("magnitude"))


def pairs(cols: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; NULL where a side is constant (never a division by zero)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def correlations(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """r and complete pairs of every pair of numeric columns, in one scan."""
    cols = cols or numeric_columns(df)
    parts = []
    for a, b in pairs(cols):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        r = pearson(x, y)
        parts.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), r.alias("r"),
                              F.count_if(both).alias("n")))
    return df.agg(F.array(*parts).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def correlation_test(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    c = correlations(df, cols).where("n >= 3").withColumn("_p", tails.correlation_p("r", F.col("n").cast("double")))
    names = ("negligible", "weak", "moderate", "strong")
    verdict = F.when(F.col("r").isNotNull(), magnitude(F.col("r"), (0.1, 0.3, 0.6), names))
    return c.select("column_a", "column_b", F.round("r", 4).alias("r"), F.round("_p", 6).alias("p_value"), "n",
                    verdict.alias("verdict"), ((F.col("_p") < 0.05) & (F.abs("r") >= 0.1)).alias("significant"))


def audit(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column, check, warning: heavy outlier shares and high skew."""
    o = outliers(df, cols).where("share >= 0.1 AND n >= 10").select(
        "column", F.lit("outliers").alias("check"),
        F.format_string("Column '%s' has %d outliers (%.1f%%) outside [%.2f, %.2f]", "column", "n_outliers",
                        F.col("share") * 100, "lower_fence", "upper_fence").alias("warning"))
    s = skewness(df, cols).where("verdict = 'high'").select(
        "column", F.lit("skew").alias("check"),
        F.format_string("Column '%s' is highly skewed (skew=%.2f) — consider log-scale charts or a median-based summary",
                        "column", "skew").alias("warning"))
    return o.unionByName(s)
