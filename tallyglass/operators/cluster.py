"""K-means with the number of clusters chosen at the elbow."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scale(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column over the rows without a NULL: one row, two numbers per column."""
    one = df.dropna(subset=cols).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (one[f"m{i}"] or 0.0, one[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: list[str], scales: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds features: z-scores by the given scales, or the frame's own; constants stay at zero. Rows with a NULL are dropped."""
    scales = scales or scale(df, cols)
    d = df.dropna(subset=cols).withColumns({f"_z_{c}": (F.col(c) - scales[c][0]) / scales[c][1] for c in cols})
    v = VectorAssembler(inputCols=[f"_z_{c}" for c in cols], outputCol="features").transform(d)
    return v.select(*df.columns, "features")


def elbow(inertias: list[float], first: int = 2) -> int:
    """The k after the sharpest bend of the inertia curve."""
    if len(inertias) <= 2:
        return first
    drop = [a - b for a, b in zip(inertias, inertias[1:])]
    bend = [a - b for a, b in zip(drop, drop[1:])]
    return first + bend.index(max(bend)) + 1


def kmeans(df: DataFrame, cols: list[str], max_k: int = 8, tries: int = 3, seed: int = 42):
    """(rows with Cluster, profile rows, inertias). Each fit is a distributed job on the cached vectors."""
    if len(cols) < 2:
        raise ValueError("need at least 2 numeric columns")
    v = standardize(df, cols).persist()
    n = v.count()
    if n < 4:
        raise ValueError(f"need at least 4 rows, got {n}")

    def fit(k: int):
        models = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="Cluster").fit(v) for i in range(tries)]
        return min(models, key=lambda m: m.summary.trainingCost)

    models = {k: fit(k) for k in range(2, min(max_k, n - 1) + 1)}
    inertias = [m.summary.trainingCost for m in models.values()]
    best = models[elbow(inertias)]
    rows = best.transform(v).drop("features")
    profile = rows.groupBy("Cluster").agg(F.count("*").alias("size"), F.round(100.0 * F.count("*") / n, 1).alias("percentage"),
                                          *[F.round(F.avg(c), 2).alias(f"avg_{c}") for c in cols])
    return rows, profile, inertias
