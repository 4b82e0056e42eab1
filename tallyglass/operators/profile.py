"""Whole-table profiles, catalogs, key checks and schema fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions import numbers
from tallyglass.operators import history
from tallyglass.operators.present import FLOATING, NUMERIC, TIMES
from tallyglass.operators.summary import column_quantiles, moments
from tallyglass.tables import FOREIGN_KEYS, PRIMARY_KEYS

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, (T.DateType, *TIMES)):
        return "time"
    if isinstance(dt, INTEGERS):
        return "integer"
    if isinstance(dt, (*NUMERIC, T.BooleanType)):
        return "number"
    return "text" if isinstance(dt, T.StringType) else "other"


def cells(df: DataFrame) -> DataFrame:
    """(column, value): every cell as text; NaN counts as missing."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, FLOATING):
            c = F.when(~F.isnan(c), c)
        out.append(c.cast("string").alias(f.name))
    return df.select(*out).unpivot([], df.columns, "column", "value")


def frequencies(df: DataFrame) -> DataFrame:
    """(column, value, n): one shuffle of the distinct values; hot values fold before it."""
    return cells(df).groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(freq: DataFrame, k: int, by: list[str] = ("column",)) -> DataFrame:
    """The k most frequent non-null values per column, ties by value."""
    order = [F.desc("n"), F.col("value")]
    w = Window.partitionBy(*by).orderBy(*order)
    r = freq.where("value IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    g = r.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("_t"))
    return g.select(*by, F.transform("_t", lambda x: x["value"]).alias("top_values"),
                    F.transform("_t", lambda x: x["n"]).alias("top_counts"))


def column_facts(df: DataFrame, freq: DataFrame | None, exact: bool = True) -> DataFrame:
    """column, rows, null_count, unique_count, dated, with the declared type."""
    kinds = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), _kind(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string, kind string")
    if exact:
        dated = F.try_to_timestamp(F.col("value")).isNotNull()
        facts = freq.groupBy("column").agg(
            F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count("value").alias("unique_count"),
            (F.coalesce(F.bool_and(dated | F.col("value").isNull()), F.lit(False)) & (F.count("value") > 0)).alias("dated"))
    else:
        c = cells(df)
        facts = c.groupBy("column").agg(
            F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("null_count"),
            F.approx_count_distinct("value", 0.01).alias("unique_count"),
            ((F.count_if(F.try_to_timestamp(F.col("value")).isNotNull()) == F.count("value")) & (F.count("value") > 0)).alias("dated"))
    return kinds.join(facts, "column")


def role():
    unique, n, kind = F.col("unique_count"), F.col("rows"), F.col("kind")
    return (F.when(kind == "time", "time_axis")
            .when((kind == "integer") & (unique == n) & (unique > 20), "identifier")
            .when(kind.isin("integer", "number"), "measure")
            .when((kind == "text") & F.col("dated"), "time_axis")
            .when((kind == "text") & (unique / F.greatest(n, F.lit(1)) > 0.8), "identifier")
            .when((kind == "text") & (unique > 50), "text")
            .otherwise("dimension"))


def date_facts(freq: DataFrame, roles: DataFrame) -> DataFrame:
    """column, date_range, date_frequency of the time axes, from distinct times and their counts."""
    axes = roles.where("role = 'time_axis'").select("column")
    # One row per column: bounded by the schema.
    d = freq.where("value IS NOT NULL").join(F.broadcast(axes), "column", "left_semi").select(
        "column", F.try_to_timestamp(F.col("value")).alias("ts"), "n")
    span = d.groupBy("column").agg(F.concat(F.min("ts").cast("string"), F.lit(" to "), F.max("ts").cast("string")).alias("date_range"))
    days = F.col("median_gap_s") / 86400.0
    freq_name = F.when(days <= 1, "daily").when(days <= 7, "weekly").when(days <= 31, "monthly").otherwise("yearly")
    gap = history.median_gap(d, ["column"], "ts", weight="n").select("column", freq_name.alias("date_frequency"))
    return span.join(gap, "column", "left")


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column of the whole table.

    ``exact=False`` swaps the shuffle of distinct values for sketches: one scan.
    """
    freq = frequencies(df)
    facts = column_facts(df, freq, exact)
    roles = facts.withColumn("role", role())
    nums = [f.name for f in df.schema.fields if _kind(f.dataType) in ("integer", "number")]
    roles = roles.withColumn("null_pct", F.round(F.col("null_count") / F.greatest("rows", F.lit(1)) * 100, 2))
    r4 = lambda c: F.round(c, 4)
    if nums:
        clean = df.select(*[(F.when(~F.isnan(c), F.col(c)) if isinstance(df.schema[c].dataType, FLOATING) else F.col(c))
                            .cast("double").alias(c) for c in nums])
        m = moments(clean, nums).join(column_quantiles(clean, nums, {"median": 0.5}, exact=exact), "column", "left")
        m = m.select("column", r4("low").alias("min"), r4("high").alias("max"), r4("mean").alias("mean"),
                     r4("median").alias("median"), r4("sd").alias("std"))
        roles = roles.join(m, "column", "left")
    else:
        roles = roles.select("*", *[F.lit(None).cast("double").alias(c) for c in ("min", "max", "mean", "median", "std")])
    if exact:
        dims = roles.where("role = 'dimension'").select("column")
        top = top_values(freq.join(F.broadcast(dims), "column", "left_semi"), 5)
        dates = date_facts(freq, roles)
    else:
        pick = F.expr("approx_top_k(value, 5)")
        top = cells(df).where("value IS NOT NULL").groupBy("column").agg(pick.alias("_t")).select(
            "column", F.transform("_t", lambda x: x["item"]).alias("top_values"))
        times = [f.name for f in df.schema.fields if _kind(f.dataType) == "time"]
        dates = cells(df.select(*times)).groupBy("column").agg(
            F.concat(F.min("value"), F.lit(" to "), F.max("value")).alias("date_range"),
            F.lit(None).cast("string").alias("date_frequency")) if times else None
    out = roles.join(top.select("column", "top_values"), "column", "left")
    out = out.withColumn("top_values", F.when(F.col("role") == "dimension", F.col("top_values")))
    if dates is not None:
        out = out.join(dates, "column", "left")
    else:
        out = out.withColumn("date_range", F.lit(None).cast("string")).withColumn("date_frequency", F.lit(None).cast("string"))
    return out.select("column", "dtype", "role", "rows", "null_count", "null_pct", "unique_count", "min", "max", "mean",
                      "median", "std", "top_values", "date_range", "date_frequency")


def roles(df: DataFrame) -> DataFrame:
    return column_facts(df, frequencies(df)).select("column", role().alias("role"))


def suggestions(role_rows: DataFrame, by: list[str]) -> DataFrame:
    """Analyses the roles of a table allow, in a fixed order."""
    has = lambda r: F.coalesce(F.bool_or(F.col("role") == r), F.lit(False))
    g = role_rows.groupBy(*by).agg(has("time_axis").alias("_t"), has("measure").alias("_m"), has("dimension").alias("_d"),
                                   F.count_if(F.col("role") == "measure").alias("_n"))
    rules = [(F.col("_t") & F.col("_m"), "time series trend analysis"), (F.col("_d") & F.col("_m"), "category comparison"),
             (F.col("_n") >= 2, "correlation analysis"), (F.col("_n") >= 2, "clustering/segmentation"),
             (F.col("_m"), "anomaly detection"), (F.col("_t") & F.col("_m"), "forecasting")]
    return g.select(*by, F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])).alias("analyses"))


# ---- the catalog: every column of every table ----

def catalog(frames: dict[str, DataFrame], n_samples: int = 5, exact: bool = True) -> DataFrame:
    """table, position, column, type, rows, distinct_count, samples, key flags.

    All tables are read as one set of (table, column, value) cells, so the whole
    workspace costs one shuffle. ``exact=False`` counts by sketch and drops samples' exactness.
    """
    spark = next(iter(frames.values())).sparkSession
    fks = {(f.table, f.column): f"{f.ref_table}.{f.ref_column}" for f in FOREIGN_KEYS}
    schema_rows = [(t, i, f.name, f.dataType.simpleString(), f.name in PRIMARY_KEYS.get(t, ()), fks.get((t, f.name)))
                   for t, d in frames.items() for i, f in enumerate(d.schema.fields)]
    base = spark.createDataFrame(schema_rows, "table string, position int, column string, type string, "
                                              "is_key boolean, references string")
    long = union([cells(d).select(F.lit(t).alias("table"), "column", "value") for t, d in frames.items()])
    by = ["table", "column"]
    if exact:
        freq = long.groupBy(*by, "value").agg(F.count("*").alias("n"))
        facts = freq.groupBy(*by).agg(F.sum("n").alias("rows"), F.count("value").alias("distinct_count"))
        samples = top_values(freq, n_samples, by).select(*by, F.col("top_values").alias("samples"))
    else:
        facts = long.groupBy(*by).agg(F.count("*").alias("rows"), F.approx_count_distinct("value").alias("distinct_count"))
        samples = long.where("value IS NOT NULL").groupBy(*by).agg(F.expr(f"approx_top_k(value, {n_samples})").alias("_t"))
        samples = samples.select(*by, F.transform("_t", lambda x: x["item"]).alias("samples"))
    return base.join(facts, by, "left").join(samples, by, "left")


def key_report(frames: dict[str, DataFrame], extra_keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Declared keys checked against the data: duplicate keys and orphan references."""
    out = []
    for table, cols in {**PRIMARY_KEYS, **(extra_keys or {})}.items():
        if table in frames:
            g = frames[table].groupBy(*cols).agg(F.count("*").alias("n"))
            out.append(g.agg(F.count_if(F.col("n") > 1).alias("violations")).select(
                F.lit(table).alias("table"), F.lit("unique " + ", ".join(cols)).alias("rule"), "violations"))
    for fk in FOREIGN_KEYS:
        if fk.table in frames and fk.ref_table in frames:
            child = frames[fk.table].where(F.col(fk.column).isNotNull()).groupBy(F.col(fk.column).alias("_k")).agg(F.count("*").alias("n"))
            parent = frames[fk.ref_table].select(F.col(fk.ref_column).alias("_k"))
            orphans = child.join(parent, "_k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
            out.append(orphans.select(F.lit(fk.table).alias("table"),
                                      F.lit(f"{fk.column} -> {fk.ref_table}.{fk.ref_column}").alias("rule"), "violations"))
    return union(out)


def schema_version(cat: DataFrame, dialect: str = "spark") -> DataFrame:
    """One row: a fingerprint of names and types, blind to the data."""
    per = cat.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("position", "column", "type"))).alias("_c"))
    sig = F.concat(F.col("table"), F.lit(":"), F.array_join(F.transform("_c", lambda x: F.concat_ws(" ", x["column"], x["type"])), ","))
    one = per.agg(F.array_sort(F.collect_list(sig)).alias("_s"))
    return one.select(F.substring(F.sha2(F.concat(F.lit(dialect + "|"), F.array_join("_s", "|")), 256), 1, 16).alias("version"))


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, dropped or retyped between two catalogs."""
    a = before.select("table", "column", F.col("type").alias("old_type"))
    b = after.select("table", "column", F.col("type").alias("new_type"))
    j = a.join(b, ["table", "column"], "full_outer")
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "dropped")
              .when(F.col("old_type") != F.col("new_type"), "retyped"))
    return j.withColumn("change", change).where("change IS NOT NULL")


def schema_card(cat: DataFrame, max_samples: int = 3) -> DataFrame:
    """One text block per table: keys, types, references, distinct counts, samples."""
    keys = Window.partitionBy("table")
    c = cat.withColumn("_keys", F.sum(F.col("is_key").cast("int")).over(keys))
    ref = F.split("references", r"\.")
    shown = F.transform(F.slice(F.coalesce("samples", F.array().cast("array<string>")), 1, max_samples),
                        lambda v: F.when(F.col("type") == "string", numbers.literal(v)).otherwise(v))
    notes = F.array_compact(F.array(
        F.when(F.col("distinct_count").isNotNull(), F.concat(F.format_number("distinct_count", 0), F.lit(" distinct"))),
        F.when(F.size(shown) > 0, F.concat(F.lit("e.g. "), F.array_join(shown, ", ")))))
    line = F.concat(F.lit('  "'), F.col("column"), F.lit('" '), F.col("type"),
                    F.when(F.col("is_key") & (F.col("_keys") == 1), " PRIMARY KEY").otherwise(""),
                    F.when(F.col("references").isNotNull(), F.concat(F.lit(' -> "'), ref[0], F.lit('"."'), ref[1], F.lit('"'))).otherwise(""),
                    F.when(F.size(notes) > 0, F.concat(F.lit(" -- "), F.array_join(notes, "; "))).otherwise(""))
    g = c.withColumn("_line", line).groupBy("table").agg(
        F.max("rows").alias("_rows"), F.array_sort(F.collect_list(F.struct("position", "_line"))).alias("_l"),
        F.array_sort(F.collect_list(F.when(F.col("is_key") & (F.col("_keys") > 1), F.struct("position", "column")))).alias("_k"))
    header = F.concat(F.lit('Table "'), F.col("table"), F.lit('" ('), F.format_number("_rows", 0), F.lit(" rows)"),
                      F.when(F.size("_k") > 0, F.concat(F.lit(' PRIMARY KEY ('), F.array_join(
                          F.transform("_k", lambda x: F.concat(F.lit('"'), x["column"], F.lit('"'))), ", "), F.lit(")"))).otherwise(""))
    return g.select("table", F.concat_ws("\n", header, F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")).alias("card"))


def basic_info(df: DataFrame, name: str, listed: DataFrame) -> DataFrame:
    """Rows, columns, types and stored bytes of one table; `listed` has a row per file with its length."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    one = df.agg(F.count("*").alias("rows")).crossJoin(listed.agg(F.sum("length").alias("bytes")))  # one row each
    return one.select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"), "bytes", F.lit(types).alias("types"))
