"""A generated orders table for timing runs: the same rows for the same seed on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def orders(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """order_date, region (8), category (50), amount, quantity derived from hashes of the row id."""
    d = spark.range(n)
    pick = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(m))
    unit = lambda salt: (pick(salt, 1_000_000) + 0.5) / 1_000_000
    # The sum of two exponentials is a gamma variate of shape 2.
    amount = F.round(-30.0 * (F.log(unit(3)) + F.log(unit(4))), 2)
    return d.select(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), pick(0, 1461).cast("int")), "yyyy-MM-dd").alias("order_date"),
                    F.concat(F.lit("region_"), pick(1, 8)).alias("region"), F.concat(F.lit("cat_"), pick(2, 50)).alias("category"),
                    amount.alias("amount"), (pick(5, 9) + 1).cast("int").alias("quantity"))
