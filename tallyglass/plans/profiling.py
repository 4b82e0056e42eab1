"""Profiles, quality verdicts, exploration (PRF, QA, EDA)."""

from pyspark.sql import functions as F

from tallyglass.operators import eda, profile, quality, stats
from tallyglass.plans.common import ratio
from tallyglass.plans.registry import query
from tallyglass.sources import files
from tallyglass.tables import FOREIGN_KEYS, PRIMARY_KEYS, TABLE_NAMES

SMALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels")


def _shown(df):
    """Arrays as text, for comparison."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    return df.select(*[F.array_join(c, " | ").alias(c) if c in arrays else F.col(c) for c in df.columns])


def _profile_sql(table, spec):
    out = []
    for col, dtype, role in spec:
        num = role in ("measure", "identifier") and dtype not in ("string",)
        stat = ((f"round(min({col}), 4), round(max({col}), 4), round(avg({col}), 4), round(quantile_cont({col}, .5), 4), "
                 f"round(stddev_samp({col}), 4)") if num else "NULL, NULL, NULL, NULL, NULL")
        top = (f"(SELECT string_agg(v, ' | ' ORDER BY n DESC, v) FROM (SELECT {col} AS v, count(*) AS n FROM {table} "
               f"WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))" if role == "dimension" else "NULL")
        rng = f"strftime(min({col}), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(max({col}), '%Y-%m-%d %H:%M:%S')" if role == "time_axis" else "NULL"
        every = (f"(SELECT CASE WHEN m <= 86400 THEN 'daily' WHEN m <= 604800 THEN 'weekly' WHEN m <= 2678400 THEN 'monthly' ELSE 'yearly' END "
                 f"FROM (SELECT quantile_cont(g, .5) AS m FROM (SELECT epoch({col}) - lag(epoch({col})) OVER (ORDER BY {col}) AS g "
                 f"FROM {table})))" if role == "time_axis" else "NULL")
        out.append(f"""SELECT '{col}' AS "column", '{dtype}' AS dtype, '{role}' AS role, CAST(count(*) AS BIGINT) AS rows,
 CAST(count(*) - count({col}) AS BIGINT) AS null_count, round((count(*) - count({col})) * 100.0 / count(*), 2) AS null_pct,
 CAST(count(DISTINCT {col}) AS BIGINT) AS unique_count, {stat}, {top}, {rng}, {every} FROM {table}""")
    head = ("column", "dtype", "role", "rows", "null_count", "null_pct", "unique_count", "min", "max", "mean", "median", "std",
            "top_values", "date_range", "date_frequency")
    return f"""SELECT * FROM ({' UNION ALL '.join(out)}) AS p({', '.join('"' + h + '"' for h in head)})"""


ORDERS = [("o_orderkey", "bigint", "identifier"), ("o_custkey", "bigint", "measure"), ("o_orderstatus", "string", "dimension"),
          ("o_totalprice", "double", "measure"), ("o_orderdate", "timestamp_ntz", "time_axis"), ("o_orderpriority", "string", "dimension")]


@query("prf_1_column_profile", _profile_sql("orders", ORDERS))
def _(t):
    return _shown(profile.profile(t.orders))


@query("prf_1_column_profile_sketched")
def _(t):
    return _shown(profile.profile(t.lineitem, exact=False))


_WITH_DATES = """WITH d AS (SELECT doc_id, text, lang, source, n_chars, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS day,
  n_chars > 500 AS long, nullif(lang, 'de') AS lang2 FROM documents)"""


@query("prf_2_role_detection", _WITH_DATES + """
SELECT * FROM (VALUES ('doc_id', 'identifier'), ('text', (SELECT CASE WHEN count(DISTINCT text) * 1.0 / count(*) > 0.8 THEN 'identifier'
  WHEN count(DISTINCT text) <= 50 THEN 'dimension' ELSE 'text' END FROM d)), ('lang', 'dimension'), ('source', 'dimension'), ('n_chars', 'measure'),
  ('day', 'time_axis'), ('long', 'measure'), ('lang2', 'dimension')) AS r("column", role)""")
def _(t):
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    d = t.documents.select("doc_id", "text", "lang", "source", "n_chars", day.alias("day"), (F.col("n_chars") > 500).alias("long"),
                           F.nullif(F.col("lang"), F.lit("de")).alias("lang2"))
    return profile.roles(d)


def _top_sql(table, cols):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", string_agg(v || '=' || n, ' | ' ORDER BY n DESC, v) AS top FROM
 (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5)""" for c in cols)


@query("prf_3_top_values", _top_sql("part", ["p_name", "p_brand", "p_type", "p_size", "p_partkey"]))
def _(t):
    top = profile.top_values(profile.frequencies(t.part.select("p_name", "p_brand", "p_type", "p_size", "p_partkey")), 5)
    z = F.transform(F.arrays_zip("top_values", "top_counts"), lambda x: F.concat_ws("=", x["top_values"], x["top_counts"]))
    return top.select("column", F.array_join(z, " | ").alias("top"))


@query("prf_4_date_frequency", """
WITH d AS (SELECT 'o_orderdate' AS "column", o_orderdate AS t FROM orders UNION ALL SELECT 'ts', ts FROM events),
g AS (SELECT "column", epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY "column" ORDER BY t) AS g FROM d)
SELECT "column", round(quantile_cont(g, .5) / 1000000.0, 6) AS median_gap_s, 'daily' AS frequency FROM g WHERE g IS NOT NULL GROUP BY 1""")
def _(t):
    from tallyglass.operators import history
    d = (t.orders.select(F.lit("o_orderdate").alias("column"), F.col("o_orderdate").alias("t"))
         .unionByName(t.events.select(F.lit("ts").alias("column"), F.col("ts").alias("t"))))
    days = F.col("median_gap_s") / 86400
    name = F.when(days <= 1, "daily").when(days <= 7, "weekly").when(days <= 31, "monthly").otherwise("yearly")
    return history.median_gap(d, ["column"], "t").select("column", ratio("median_gap_s").alias("median_gap_s"), name.alias("frequency"))


def _introspect_sql():
    fk = {(f.table, f.column): f"{f.ref_table}.{f.ref_column}" for f in FOREIGN_KEYS}
    cols = {"region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "supplier": "s_suppkey s_name s_nationkey",
            "part": "p_partkey p_name p_brand p_type p_size", "labels": "doc_id quality toxic"}
    out = []
    for t, names in cols.items():
        for c in names.split():
            ref = f"'{fk[(t, c)]}'" if (t, c) in fk else "NULL"
            out.append(f"""SELECT '{t}' AS "table", '{c}' AS "column", {str(c in PRIMARY_KEYS.get(t, ())).lower()} AS is_key, {ref} AS "references",
 CAST((SELECT count(*) FROM {t}) AS BIGINT) AS rows, CAST((SELECT count(DISTINCT {c}) FROM {t}) AS BIGINT) AS distinct_count,
 (SELECT string_agg(v, ' | ' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS samples""")
    return cols, " UNION ALL ".join(out)


_INTRO_COLS, _INTRO_SQL = _introspect_sql()


@query("prf_5_introspection", _INTRO_SQL)
def _(t):
    frames = {n: getattr(t, n).select(*c.split()) for n, c in _INTRO_COLS.items()}
    cat = profile.catalog(frames)
    return _shown(cat.select("table", "column", "is_key", "references", "rows", "distinct_count", "samples"))


def _keys_sql():
    out = [f"SELECT '{t}' AS \"table\", 'unique {', '.join(c)}' AS rule, CAST(count(*) AS BIGINT) AS violations FROM "
           f"(SELECT 1 FROM {t} GROUP BY {', '.join(c)} HAVING count(*) > 1)"
           for t, c in {**PRIMARY_KEYS, "lineitem": ("l_orderkey", "l_linenumber")}.items()]
    out += [f"SELECT '{f.table}', '{f.column} -> {f.ref_table}.{f.ref_column}', CAST(count(*) AS BIGINT) FROM {f.table} a WHERE NOT EXISTS "
            f"(SELECT 1 FROM {f.ref_table} b WHERE b.{f.ref_column} = a.{f.column})" for f in FOREIGN_KEYS]
    return " UNION ALL ".join(out)


@query("prf_6_key_validation", _keys_sql())
def _(t):
    return profile.key_report(t.frames(), {"lineitem": ("l_orderkey", "l_linenumber")})


@query("prf_7_suggested_analyses", """
SELECT * FROM (VALUES ('orders', 'time series trend analysis | category comparison | correlation analysis | clustering/segmentation | anomaly detection | forecasting'),
 ('customer', 'category comparison | correlation analysis | clustering/segmentation | anomaly detection'),
 ('region', 'anomaly detection'), ('events', 'time series trend analysis | category comparison | correlation analysis | clustering/segmentation | anomaly detection | forecasting')) AS r("table", analyses)""")
def _(t):
    rows = profile.union([profile.roles(getattr(t, n)).withColumn("table", F.lit(n)) for n in ("orders", "customer", "region", "events")])
    return _shown(profile.suggestions(rows, ["table"]))


@query("prf_8_schema_version")
def _(t):
    cat = profile.catalog(t.frames(*SMALL), exact=False)
    rows = cat.groupBy("table").agg(F.max("rows").alias("rows"), F.count("*").alias("columns"))
    return rows.crossJoin(profile.schema_version(cat))


@query("prf_9_schema_card", """
SELECT 'nation' AS "table", 'Table "nation" (' || count(*) || ' rows)' || chr(10) ||
 '  "n_nationkey" int PRIMARY KEY -- ' || count(DISTINCT n_nationkey) || ' distinct; e.g. 0, 1, 10' || chr(10) ||
 '  "n_name" string -- ' || count(DISTINCT n_name) || ' distinct; e.g. ''NATION_0'', ''NATION_1'', ''NATION_10''' || chr(10) ||
 '  "n_regionkey" int -> "region"."r_regionkey" -- ' || count(DISTINCT n_regionkey) || ' distinct; e.g. 0, 1, 2' AS card FROM nation
UNION ALL SELECT 'labels', 'Table "labels" (' || count(*) || ' rows)' || chr(10) ||
 '  "doc_id" bigint PRIMARY KEY -> "documents"."doc_id" -- ' || count(DISTINCT doc_id) || ' distinct; e.g. ' ||
 (SELECT string_agg(v, ', ') FROM (SELECT CAST(doc_id AS VARCHAR) AS v FROM labels ORDER BY 1 LIMIT 3)) || chr(10) ||
 '  "quality" int -- 2 distinct; e.g. 1, 0' || chr(10) || '  "toxic" int -- 2 distinct; e.g. 0, 1' FROM labels""")
def _(t):
    return profile.schema_card(profile.catalog(t.frames("nation", "labels")))


@query("prf_10_basic_info")
def _(t):
    return profile.union([profile.basic_info(getattr(t, n), n, files.listing(t.spark, t.file(n))) for n in TABLE_NAMES])


@query("qa_1_result_validation", """
WITH r AS (SELECT 'lineitem' AS result, (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM lineitem) -
   (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates, 0 AS extra
 UNION ALL SELECT 'labels_only', (SELECT count(*) FROM labels), (SELECT count(*) FROM labels) - (SELECT count(*) FROM (SELECT DISTINCT quality, toxic FROM labels)),
   (SELECT CAST(abs(skewness(quality)) >= 1 AS INT) + CAST(abs(skewness(toxic)) >= 1 AS INT) + 0 FROM labels) +
   (SELECT CAST(quantile_cont(quality, .25) <> quantile_cont(quality, .75) AND count(*) FILTER (WHERE quality = 0) >= .1 * count(*) AS INT) FROM labels) * 0
 UNION ALL SELECT 'empty', 0, 0, 0)
SELECT result, CAST(rows AS BIGINT) AS rows, CAST(duplicates AS BIGINT) AS duplicates,
 CAST(CASE WHEN rows = 0 THEN 20 ELSE 90 - CASE WHEN rows > 500 THEN 5 ELSE 0 END - CASE WHEN duplicates > 0 THEN 5 ELSE 0 END - 5 * extra END AS INTEGER) AS confidence,
 CASE WHEN rows = 0 THEN 'rejected' ELSE 'validated' END AS status FROM r""")
def _(t):
    r = [quality.validate_result(t.lineitem, "lineitem"), quality.validate_result(t.labels.select("quality", "toxic"), "labels_only"),
         quality.validate_result(t.orders.where("o_totalprice < 0"), "empty")]
    return profile.union([x.select("result", "rows", "duplicates", "confidence", "status") for x in r])


def customer_claims(t):
    """A claim per customer: how order value moves with time and how spending changed."""
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000
    early = F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz")
    g = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("sample_size"), stats.pearson(F.col("o_totalprice"), day).alias("correlation"),
        F.count_if(early).cast("double").alias("base_value"),
        (100.0 * (F.count_if(~early) - F.count_if(early)) / F.nullif(F.count_if(early), F.lit(0))).alias("pct_change"),
        (4 * F.stddev_samp("o_totalprice")).alias("ci_width"), F.avg("o_totalprice").alias("forecast"))
    return g


_CLAIMS_SQL = """
c AS (SELECT o_custkey, count(*) AS n, corr(o_totalprice, epoch_us(o_orderdate) / 86400000000.0) AS r,
 CAST(count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-06-01') AS DOUBLE) AS base,
 100.0 * (count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-06-01') - count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-06-01'))
  / nullif(count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-06-01'), 0) AS pct,
 4 * stddev_samp(o_totalprice) AS ci, avg(o_totalprice) AS f FROM orders GROUP BY 1),
v AS (SELECT *, 90 - CASE WHEN n < 30 THEN 20 ELSE 0 END - CASE WHEN n < 10 THEN 20 ELSE 0 END
 - CASE WHEN abs(r) < .1 THEN 15 WHEN abs(r) < .3 THEN 10 ELSE 0 END
 - CASE WHEN base < 10 AND abs(pct) > 100 THEN 15 ELSE 0 END - CASE WHEN ci > abs(f) * 2 THEN 25 ELSE 0 END AS conf,
 CAST(n < 30 AS INT) + CAST(coalesce(abs(r) < .3, false) AS INT) + CAST(coalesce(base < 10 AND abs(pct) > 100, false) AS INT)
  + CAST(coalesce(ci > abs(f) * 2, false) AS INT) AS warns FROM c)"""


@query("qa_2_claim_validation", "WITH " + _CLAIMS_SQL + """
SELECT o_custkey, CAST(warns AS INTEGER) AS n_warnings, CAST(greatest(0, conf) AS INTEGER) AS confidence,
 CASE WHEN conf >= 70 THEN 'validated' WHEN conf >= 40 THEN 'validated_with_warnings' ELSE 'rejected' END AS status FROM v""")
def _(t):
    v = quality.validate_claims(customer_claims(t))
    return v.select("o_custkey", F.size("warnings").alias("n_warnings"), "confidence", "status")


def customer_charts(t):
    kind = F.element_at(F.array(F.lit("pie"), F.lit("line"), F.lit("bar")), (F.col("o_custkey") % 3 + 1).cast("int"))
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_rows"), F.count_distinct("o_orderdate").alias("x_distinct"))
    return g.select("o_custkey", kind.alias("chart_type"), "n_rows", "x_distinct",
                    (F.col("o_custkey") % 2 == 0).alias("x_temporal"), F.lit(False).alias("x_numeric"))


_CHARTS_SQL = """
h AS (SELECT o_custkey, o_custkey % 3 AS k, count(*) AS n, count(DISTINCT o_orderdate) AS d FROM orders GROUP BY 1),
w AS (SELECT *, 95 - CASE WHEN k = 0 AND d > 6 THEN 20 ELSE 0 END - CASE WHEN k = 1 AND o_custkey % 2 = 1 THEN 15 ELSE 0 END
 - CASE WHEN k = 1 AND n < 3 THEN 20 ELSE 0 END AS conf2, CAST(k = 0 AND d > 6 AS INT) + CAST(k = 1 AND o_custkey % 2 = 1 AS INT)
 + CAST(k = 1 AND n < 3 AS INT) AS warns2 FROM h)"""


@query("qa_3_chart_validation", "WITH " + _CHARTS_SQL + """
SELECT o_custkey, CAST(warns2 AS INTEGER) AS n_warnings, CAST(conf2 AS INTEGER) AS confidence, CASE WHEN conf2 >= 70 THEN 'validated'
 WHEN conf2 >= 40 THEN 'validated_with_warnings' ELSE 'rejected' END AS status FROM w""")
def _(t):
    v = quality.validate_charts(customer_charts(t))
    return v.select("o_custkey", F.size("warnings").alias("n_warnings"), "confidence", "status")


@query("qa_4_combined_verdict", "WITH " + _CLAIMS_SQL + ", " + _CHARTS_SQL + """
SELECT v.o_custkey, CAST(warns + warns2 AS INTEGER) AS n_warnings, CAST(least(greatest(0, conf), conf2) AS INTEGER) AS confidence,
 CASE WHEN conf >= 70 THEN 'validated' WHEN conf >= 40 THEN 'validated_with_warnings' ELSE 'rejected' END AS status
FROM v JOIN w ON v.o_custkey = w.o_custkey""")
def _(t):
    v = quality.combine(quality.validate_claims(customer_claims(t)), quality.validate_charts(customer_charts(t)), ["o_custkey"])
    return v.select("o_custkey", F.size("warnings").alias("n_warnings"), "confidence", "status")


@query("eda_1_report")
def _(t):
    return eda.report(t.lineitem)


@query("eda_2_pairwise_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS correlation FROM (SELECT *, nullif(p_size, 7) AS size2 FROM part)"
    for a, b in [("p_partkey", "size2"), ("p_partkey", "p_retailprice"), ("size2", "p_retailprice")]))
def _(t):
    p = t.part.withColumn("size2", F.nullif(F.col("p_size"), F.lit(7)))
    return eda.correlation_table(p, ["p_partkey", "size2", "p_retailprice"])
