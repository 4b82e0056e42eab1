"""Personal data in tables: detection over whole columns, masking, access reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass import fixed
from tallyglass.functions import personal
from tallyglass.operators.present import text_columns
from tallyglass.operators.profile import union


def detect(frames: dict[str, DataFrame], min_share: float = 0.5) -> DataFrame:
    """table, column, kind: by name first, else the most common kind of value if its share is high.

    Every text cell is looked at; the cells fold to (column, kind) counts before any shuffle.
    """
    spark = next(iter(frames.values())).sparkSession
    names = spark.createDataFrame([(t, c, i) for t, d in frames.items() for i, c in enumerate(d.columns)],
                                  "table string, column string, position int")
    named = names.withColumn("_by_name", personal.name_kind(F.col("column")))
    cells = [d.select(*text_columns(d)).unpivot([], text_columns(d), "column", "value")
             .select(F.lit(t).alias("table"), "column", personal.value_kind(F.col("value")).alias("kind"),
                     F.col("value").isNotNull().alias("seen"))
             for t, d in frames.items() if text_columns(d)]
    if cells:
        counts = union(cells).where("seen").groupBy("table", "column", "kind").agg(F.count("*").alias("n"))
        total = counts.groupBy("table", "column").agg(F.sum("n").alias("_total"))
        best = counts.where("kind IS NOT NULL").groupBy("table", "column").agg(
            F.max_by("kind", F.struct("n", "kind")).alias("_by_value"), F.max("n").alias("_n"))
        found = best.join(total, ["table", "column"]).where(F.col("_n") / F.col("_total") >= min_share)
        named = named.join(found.select("table", "column", "_by_value"), ["table", "column"], "left")
    else:
        named = named.withColumn("_by_value", F.lit(None).cast("string"))
    return named.select("table", "column", F.coalesce("_by_name", "_by_value").alias("kind")).where("kind IS NOT NULL")


def mask_catalog(catalog: DataFrame, report: DataFrame, local_only: bool = False) -> DataFrame:
    """Samples of personal columns become placeholders with a note; local-only drops every sample."""
    j = catalog.join(report.select("table", "column", "kind"), ["table", "column"], "left")
    hidden = F.array(F.format_string("<%s>", "kind"))
    note = F.format_string("contains %s (PII, values hidden)", F.lower("kind"))
    samples = F.lit(None).cast("array<string>") if local_only else F.when(F.col("kind").isNotNull(), hidden).otherwise(F.col("samples"))
    return j.withColumn("samples", samples).withColumn(
        "note", F.when(F.col("kind").isNotNull() & F.lit(not local_only), note)).drop("kind")


def mask_columns(df: DataFrame, kinds: dict[str, str], risky: tuple[str, ...] = fixed.HIGH_RISK_KINDS) -> DataFrame:
    """Replace the columns of a high-risk kind, matched by name without case."""
    low = {c.lower(): k for c, k in kinds.items()}
    out = []
    for c in df.columns:
        k = low.get(c.lower())
        out.append(F.lit(f"<{k}>").alias(c) if k in risky else F.col(c))
    return df.select(*out)


def mask_result(df: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Mask a result: kinds come from the report by column name, else from the result itself.

    The kinds are one short row per column, read once to build the projection.
    """
    own = detect({"result": df}).select("column", "kind")
    rows = own.select(F.col("column").alias("c"), "kind", F.lit(1).alias("rank"))
    if report is not None:
        rows = rows.unionByName(report.select(F.col("column").alias("c"), "kind", F.lit(0).alias("rank")))
    wanted = rows.where(F.lower("c").isin(*[c.lower() for c in df.columns]))
    w = Window.partitionBy(F.lower("c")).orderBy("rank", "kind")
    first = wanted.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return mask_columns(df, {r["c"]: r["kind"] for r in first.select("c", "kind").collect()})


def free_text(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, kind, n: kinds of the whitespace-separated words of each text."""
    # Only words with a digit or an @ can be of a kind; they are cut out in one linear pass.
    worth = F.regexp_extract_all(text, F.lit(r"(?U)(?<!\S)[^\s@\p{Nd}]*+[@\p{Nd}]\S*"), F.lit(0))
    words = df.select(*key, F.explode(worth).alias("_w"))
    k = words.select(*key, personal.value_kind(F.col("_w")).alias("kind")).where("kind IS NOT NULL")
    return k.groupBy(*key, "kind").agg(F.count("*").alias("n"))


def columns_touched(access: DataFrame, report: DataFrame, query: str) -> DataFrame:
    """Per query the personal columns it read, sorted. `access` lists (query, table, column)."""
    a = access.select(query, F.lower("table").alias("_t"), F.lower("column").alias("_c")).distinct()
    r = report.select(F.lower("table").alias("_t"), F.lower("column").alias("_c"))
    hit = a.join(r, ["_t", "_c"], "left_semi").groupBy(query).agg(
        F.sort_array(F.collect_set(F.concat_ws(".", "_t", "_c"))).alias("pii_columns_touched"))
    return access.select(query).distinct().join(hit, query, "left").select(
        query, F.coalesce("pii_columns_touched", F.array().cast("array<string>")).alias("pii_columns_touched"))
