"""Evaluation statistics over outcomes: rates, paired differences, gates, power."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import tails
from tallyglass.operators.summary import exact_quantiles


def rates(df: DataFrame, keys: list[str], passed: str) -> DataFrame:
    """keys, n, passes, point, lo, hi: counts are made on Spark, the draws on one row per key."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("passes"))
    g = g.withColumn("_ci", tails.rate_interval(F.col("n").cast("double"), F.col("passes").cast("double")))
    return g.select(*keys, "n", "passes", (F.col("passes") / F.col("n")).alias("point"),
                    F.col("_ci.lo").alias("lo"), F.col("_ci.hi").alias("hi"))


def paired(a: DataFrame, b: DataFrame, item: list[str], passed: str) -> DataFrame:
    """item, base, this: the items both runs have."""
    x = a.select(*item, F.col(passed).alias("base"))
    y = b.select(*item, F.col(passed).alias("this"))
    return x.join(y, item)


def paired_test(pairs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Difference, its interval and the exact McNemar p of (base, this) outcomes per key."""
    x, y = F.col("base"), F.col("this")
    g = pairs.groupBy(*keys).agg(F.count("*").alias("n_paired"), F.count_if(x & ~y).alias("only_base"),
                                 F.count_if(~x & y).alias("only_this"))
    g = g.withColumn("_same", F.col("n_paired") - F.col("only_base") - F.col("only_this"))
    dbl = lambda c: F.col(c).cast("double")
    g = g.withColumn("_ci", tails.delta_interval(dbl("only_base"), dbl("_same"), dbl("only_this")))
    return g.select(*keys, "n_paired", "only_base", "only_this",
                    ((F.col("only_this") - F.col("only_base")) / F.col("n_paired")).alias("delta"),
                    F.col("_ci.lo").alias("delta_lo"), F.col("_ci.hi").alias("delta_hi"),
                    tails.binomial_two_sided("only_base", "only_this").alias("mcnemar_p"))


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {"p50": 0.5, "p95": 0.95})


def gate(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """PASS unless the whole interval lies below the baseline point; no baseline, no gate.

    `current` comes from rates(); `baseline` has keys + baseline.
    """
    j = current.join(baseline, keys, "left")
    verdict = (F.when(F.col("baseline").isNull(), "SKIPPED").when(F.col("hi") >= F.col("baseline"), "PASS")
               .otherwise("FAIL"))
    return j.withColumn("verdict", verdict)


def mde_paired(n: Column, discordance: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.lit(z) * F.sqrt(discordance / n)


def ci_halfwidth(n: Column, p: Column) -> Column:
    return F.lit(NormalDist().inv_cdf(0.975)) * F.sqrt(p * (1 - p) / n)
