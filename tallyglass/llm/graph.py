"""Connected components of a link table, by joins and folded minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import keep


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and none of these is a u itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    each = ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("least"))
    return not each.agg(F.max((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("least") == 0)))).first()[0]


def _large(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest of its smaller neighbours to the others and itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Links (u, v) to (u, v) with v the smallest node of u's component; smallest nodes have no row.

    Alternates two star steps until all that is left is stars around smallest nodes; the number of rounds grows with the
    logarithm of the longest chain. A node with many links is folded map-side and joined, never gathered.
    """
    edges = keep(edges.filter("u <> v").select("u", "v"), "links")
    while True:
        edges = keep(_small(_large(edges)), "links")
        if _stars(edges):
            return edges
