"""Repeatable samples and splits: order comes from a hash of the id, never from row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, seed: int = 0):
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))


def _ranked(df: DataFrame, key: str, stratum: str, size: int, seed: int, at_least: int = 0) -> DataFrame:
    n = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_total"))
    quota = n.crossJoin(total).select(stratum, F.greatest(F.lit(at_least), F.bround(size * F.col("_n") / F.col("_total"))).alias("_quota"))
    w = Window.partitionBy(stratum).orderBy(draw(key, seed), key)
    # The constant bound lets every task drop all but `size` rows of a stratum before the shuffle.
    r = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(size, at_least))
    return r.join(quota, stratum)


def stratified(df: DataFrame, key: str, stratum: str, size: int, seed: int = 0) -> DataFrame:
    """Exactly `size` rows, shared out by stratum; rounding gaps are filled in hash order."""
    r = _ranked(df, key, stratum, size, seed)
    picked = r.where(F.col("_rn") <= F.col("_quota")).withColumn("_part", F.lit(0)).drop("_quota")
    rest = df.join(picked.select(key), key, "left_anti").orderBy(draw(key, seed), key).limit(size)
    rest = rest.withColumn("_rn", F.lit(0)).withColumn("_part", F.lit(1))
    every = picked.select(*df.columns, "_part", "_rn").unionByName(rest.select(*df.columns, "_part", "_rn"))
    return every.orderBy("_part", F.when(F.col("_part") == 0, F.col(stratum)), "_rn", draw(key, seed), key).limit(size).select(*df.columns)


def failures(df: DataFrame, key: str, stratum: str, matched: str, n: int = 50, seed: int = 0) -> DataFrame:
    """Misses only, at least one per stratum, at most n."""
    r = _ranked(df.where(~F.col(matched)), key, stratum, n, seed, at_least=1)
    return r.where(F.col("_rn") <= F.col("_quota")).orderBy(draw(key, seed), key).limit(n).select(*df.columns)


def held_out_groups(df: DataFrame, group: str, fraction: float = 0.05, seed: int = 0) -> DataFrame:
    """Adds split: whole groups, max(1, round(fraction x groups)) of them, go to validation."""
    g = df.select(group).distinct()
    n = g.agg(F.greatest(F.lit(1), F.bround(F.count("*") * fraction)).cast("long").alias("_k"))
    # The chosen groups are the k smallest hashes: found by a cut-off, not by numbering all groups.
    h = g.withColumn("_h", draw(group, seed))
    w = Window.partitionBy(F.substring("_h", 1, 2)).orderBy("_h")
    local = h.withColumn("_r", F.row_number().over(w)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = local.groupBy("_b").agg(F.count("*").alias("_c"))
    start = sizes.withColumn("_start", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    val = local.join(start, "_b").crossJoin(n).where(F.col("_start") + F.col("_r") <= F.col("_k")).select(group, F.lit("val").alias("split"))
    return df.join(val, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def half(key: str, seed: int = 0):
    """0 or 1: an order-free split in two."""
    return F.conv(F.substring(draw(key, seed), 1, 1), 16, 10).cast("int") % 2
