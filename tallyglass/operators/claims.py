"""Are the numbers in a text supported by the table it talks about?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import numbers


def mentions(texts: DataFrame, rid: str, text: str, question: str | None = None) -> DataFrame:
    """rid, pos, value, decimals, raw, tol: the numbers worth checking."""
    asked = F.transform(numbers.numbers(F.col(question)), lambda x: x["value"]) if question else F.array().cast("array<double>")
    m = texts.select(rid, asked.alias("_asked"), F.posexplode(numbers.numbers(F.col(text))).alias("pos", "_n"))
    m = m.select(rid, "_asked", "pos", "_n.*")
    small = (F.abs("value") > 0) & (F.abs("value") <= 10) & (F.col("decimals") == 0)
    m = m.where(~small & ~F.array_contains("_asked", F.col("value")))
    tol = F.greatest(F.lit(0.5) * F.pow(F.lit(10.0), -F.col("decimals")), F.abs("value") * 0.005)
    return m.select(rid, "pos", "value", "decimals", "raw", tol.alias("tol"))


def candidates(results: DataFrame, rid: str, cols: list[str] | None = None) -> DataFrame:
    """rid, candidate: row count, numeric cells, their hundredfold, sums, means; numbers inside text columns."""
    cols = cols or [c for c in results.columns if c != rid]
    counts = results.groupBy(rid).agg(F.count("*").cast("double").alias("candidate"))
    cells = results.select(rid, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([rid], cols, "column", "value")
    # Equal cells are one candidate: they fold before the shuffle.
    cells = cells.where("value IS NOT NULL").groupBy(rid, "column", "value").agg(F.count("*").alias("n"))
    cells = cells.withColumn("num", F.col("value").try_cast("double")).withColumn("num", F.when(~F.isnan("num"), F.col("num")))
    kinds = cells.groupBy(rid, "column").agg(
        F.sum(F.when(F.col("num").isNotNull(), F.col("n"))).alias("n_num"), F.sum(F.col("num") * F.col("n")).alias("total"))
    stats = kinds.where("n_num > 0").select(rid, F.explode(F.array("total", F.col("total") / F.col("n_num"))).alias("candidate"))
    direct = cells.where("num IS NOT NULL").select(rid, F.explode(F.array("num", F.col("num") * 100)).alias("candidate"))
    wordy = kinds.where("n_num IS NULL").select(rid, "column")
    inside = cells.where("num IS NULL").join(wordy, [rid, "column"], "left_semi").select(
        rid, F.explode(numbers.numbers(F.col("value"))).alias("_x")).select(rid, F.col("_x.value").alias("candidate"))
    out = counts.unionByName(direct).unionByName(stats).unionByName(inside)
    return out.select(rid, F.abs("candidate").alias("candidate")).distinct()


def unsupported(found: DataFrame, cands: DataFrame, rid: str) -> DataFrame:
    """Mentions without a candidate within their tolerance (absolute values are compared).

    A tolerance join made equi: each mention picks the power-of-two grid that is as
    wide as its whole interval, so it touches two cells; candidates are placed on
    the grids their result needs.
    """
    v = F.abs("value")
    level = F.ceil(F.log2(2 * F.col("tol"))).cast("int")
    m = found.withColumn("_level", level)
    width = F.pow(F.lit(2.0), F.col("_level"))
    m = m.withColumn("_cells", F.array_distinct(F.array(F.floor((v - F.col("tol")) / width), F.floor((v + F.col("tol")) / width),
                                                        F.floor(v / width))))
    levels = m.select(rid, "_level").distinct()
    placed = cands.join(levels, rid).withColumn("_cell", F.floor(F.col("candidate") / F.pow(F.lit(2.0), F.col("_level"))))
    spread = m.withColumn("_cell", F.explode("_cells"))
    near = F.abs(F.col("candidate") - F.abs("value")) <= F.col("tol")
    j = spread.join(placed, [rid, "_level", "_cell"], "left")
    # Hits fold to one flag per mention while the join streams.
    g = j.groupBy(rid, *[c for c in found.columns if c != rid]).agg(F.coalesce(F.bool_or(near), F.lit(False)).alias("_ok"))
    return g.where("NOT _ok").select(*found.columns)


def check(texts: DataFrame, rid: str, text: str, results: DataFrame, question: str | None = None,
          cols: list[str] | None = None) -> DataFrame:
    """rid, n_unsupported, warning: one row per text; the warning names the first five."""
    bad = unsupported(mentions(texts, rid, text, question), candidates(results, rid, cols), rid)
    g = bad.groupBy(rid).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("_b"))
    named = F.array_join(F.transform(F.slice("_b", 1, 5), lambda x: x["raw"]), ", ")
    warn = F.concat(F.lit("Narrative mentions numbers not supported by the result table: "), named)
    return texts.select(rid).join(g.select(rid, "_n", warn.alias("warning")), rid, "left").select(
        rid, F.coalesce("_n", F.lit(0)).alias("n_unsupported"), "warning")
