"""A difficulty router: fit on recorded outcomes, replayed over thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.cluster import scale, standardize


@dataclass(frozen=True)
class Router:
    model: LogisticRegressionModel
    features: list[str]
    scales: dict[str, tuple[float, float]]


def fit(df: DataFrame, features: list[str], failed: str) -> Router:
    """Balanced, ridge-penalised logistic regression on z-scores; the router keeps the scales it was fitted with."""
    scales = scale(df, features)
    z = standardize(df, features, scales).withColumn("label", F.col(failed).cast("double"))
    n = {r["label"]: r["n"] for r in z.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(n.values())
    weight = F.lit(0.0)
    for label, k in n.items():
        weight = F.when(F.col("label") == label, total / (2 * k)).otherwise(weight)
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / total, elasticNetParam=0.0,
                            standardization=False, maxIter=200)
    return Router(lr.fit(z.withColumn("weight", weight)), features, scales)


def p_fail(router: Router, df: DataFrame) -> DataFrame:
    """Adds p_fail; a row's value depends on that row and the router alone."""
    z = standardize(df, router.features, router.scales)
    return router.model.transform(z).withColumn("p_fail", vector_to_array("probability")[1]).select(*df.columns, "p_fail")


def replay(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """threshold, ex, cost_mean, share_strong for p_fail, cheap_ok, strong_ok, cheap_cost, strong_cost.

    Each row is repeated for the 21 fixed thresholds and folds into sums at once.
    """
    grid = F.array(*[F.lit(i / 20) for i in range(21)])
    r = scored.withColumn("threshold", F.explode(grid)).withColumn("_strong", F.col("p_fail") > F.col("threshold"))
    pick = lambda a, b: F.avg(F.when(F.col("_strong"), F.col(a)).otherwise(F.col(b)).cast("double"))
    return r.groupBy(*keys, "threshold").agg(pick("strong_ok", "cheap_ok").alias("ex"), pick("strong_cost", "cheap_cost").alias("cost_mean"),
                                             F.avg(F.col("_strong").cast("double")).alias("share_strong"))


def choose(curve: DataFrame, scored: DataFrame) -> DataFrame:
    """The cheapest threshold within one point of the strong model's accuracy, else the most accurate."""
    s = scored.agg(F.avg(F.col("strong_ok").cast("double")).alias("_s"))
    c = curve.crossJoin(s).withColumn("_ok", F.col("ex") >= F.col("_s") - 0.01)
    ok = F.min_by(F.struct("threshold", "ex", "cost_mean", "share_strong"), F.when(F.col("_ok"), F.struct("cost_mean", "threshold")))
    top = F.max_by(F.struct("threshold", "ex", "cost_mean", "share_strong"), F.struct("ex", -F.col("threshold")))
    return c.agg(F.coalesce(ok, top).alias("_c")).select("_c.*")


