"""Statistics (ST)."""

from pyspark.sql import functions as F

from tallyglass.operators import paired, stats
from tallyglass.plans import sqltext as S
from tallyglass.plans.common import ratio
from tallyglass.plans.registry import query

LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(cols, template):
    return " UNION ALL ".join(template.format(c=c) for c in cols)


@query("st_1_tukey_outliers", _each(LINE_MEASURES + ["revenue"], """
SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE q1 <> q3 AND ({c} < lo OR {c} > hi)) AS BIGINT) AS n_outliers,
  round(count(*) FILTER (WHERE q1 <> q3 AND ({c} < lo OR {c} > hi)) / count({c}), 4) AS share,
  round(lo, 4) AS lower_fence, round(hi, 4) AS upper_fence
FROM (SELECT *, l_extendedprice * l_discount * l_tax AS revenue FROM lineitem) d,
 (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
   (SELECT quantile_cont({c}, .25) AS q1, quantile_cont({c}, .75) AS q3
    FROM (SELECT *, l_extendedprice * l_discount * l_tax AS revenue FROM lineitem))) f GROUP BY lo, hi"""))
def _(t):
    li = t.lineitem.withColumn("revenue", F.expr("l_extendedprice * l_discount * l_tax"))
    return stats.outliers(li, LINE_MEASURES + ["revenue"])


@query("st_2_adjusted_skew", _each(["value", "cubed", "constant"], """
SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n, CASE WHEN '{c}' = 'constant' THEN NULL ELSE round(skewness({c}), 4) END AS skew,
  CASE WHEN '{c}' = 'constant' THEN 'undefined' WHEN abs(skewness({c})) < 0.5 THEN 'symmetric'
       WHEN abs(skewness({c})) < 1 THEN 'moderate' ELSE 'high' END AS verdict
FROM (SELECT value, value * value * value AS cubed, 7.0 AS constant FROM events)"""))
def _(t):
    e = t.events.select("value", F.expr("value * value * value").alias("cubed"), F.lit(7.0).alias("constant"))
    return stats.skewness(e).select("column", "n", "skew", "verdict")


@query("st_2_skew_test", f"""
WITH m AS ({_each(LINE_MEASURES, """SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, skewness({c}) AS sk FROM lineitem""")}),
g AS (SELECT *, n::DOUBLE AS d, sk * (n - 2) / sqrt(n::DOUBLE * (n - 1)) * sqrt((n + 1.0::DOUBLE) * (n + 3) / (6 * (n - 2.0::DOUBLE))) AS y FROM m),
b AS (SELECT *, 3 * (d * d + 27 * d - 70) * (d + 1) * (d + 3) / ((d - 2) * (d + 5) * (d + 7) * (d + 9)) AS beta FROM g),
z AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2 FROM b),
e AS (SELECT "column", n, sk, least(40, abs(asinh(CASE WHEN y = 0 THEN 1 ELSE y END / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)))) AS top FROM z),
a AS ({S.integral('e', '"column"', 'exp(-x * x / 2) * sqrt(2 / pi())')})
SELECT "column", n, round(sk, 4) AS skew, abs(round(1 - area, 6)) AS p_value,
 CASE WHEN abs(sk) < 0.5 THEN 'symmetric' WHEN abs(sk) < 1 THEN 'moderate' ELSE 'high' END AS verdict FROM e JOIN a USING ("column")""")
def _(t):
    return stats.skewness(t.lineitem, LINE_MEASURES).select("column", "n", "skew", ratio("p_value").alias("p_value"), "verdict")


@query("st_3_effect_size", """
WITH g AS (SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, count(*) FILTER (WHERE l_returnflag = 'R') AS n_b,
  avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS ma, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS mb,
  var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS va, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS vb
  FROM lineitem GROUP BY 1),
d AS (SELECT *, (ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS d FROM g)
SELECT l_linestatus, n_a, n_b, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round(d, 4) AS d,
  CASE WHEN abs(d) < .2 THEN 'negligible' WHEN abs(d) < .5 THEN 'small' WHEN abs(d) < .8 THEN 'medium' ELSE 'large' END AS magnitude FROM d""")
def _(t):
    return stats.effect_size(t.lineitem, "l_returnflag", "l_extendedprice", "A", "R", ["l_linestatus"])


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r, CAST(count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n FROM lineitem"
                           for a, b in stats.pairs(LINE_MEASURES))


@query("st_4_correlation_test", f"""
WITH c AS ({_PAIRS}), t AS (SELECT *, n - 2.0::DOUBLE AS v, least(60, abs(r) * sqrt((n - 2) / (1 - r * r))) AS top FROM c),
a AS ({S.integral('t', 'column_a, column_b', '2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - (v + 1) / 2 * ln(1 + x * x / v)) / sqrt(v * pi())')}),
p AS (SELECT *, greatest(0, 1 - area) AS p FROM t JOIN a USING (column_a, column_b))
SELECT column_a, column_b, round(r, 4) AS r, round(p, 6) AS p_value, n,
 CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.6 THEN 'moderate' ELSE 'strong' END AS verdict,
 p < 0.05 AND abs(r) >= 0.1 AS significant FROM p""")
def _(t):
    return stats.correlation_test(t.lineitem, LINE_MEASURES)


@query("st_5_audit", _each(["value", "event_id", "user_id"], """
SELECT '{c}' AS "column", 'outliers' AS "check",
  'Column ''{c}'' has ' || n_out || ' outliers (' || printf('%.1f', round(n_out / n, 4) * 100) || '%) outside ['
  || printf('%.2f', round(lo, 4)) || ', ' || printf('%.2f', round(hi, 4)) || ']' AS warning
FROM (SELECT count({c}) AS n, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS n_out, lo, hi FROM events,
  (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
    (SELECT quantile_cont({c}, .25) AS q1, quantile_cont({c}, .75) AS q3 FROM events)) GROUP BY lo, hi)
WHERE n >= 10 AND round(n_out / n, 4) >= 0.1
UNION ALL SELECT '{c}', 'skew', 'Column ''{c}'' is highly skewed (skew=' || printf('%.2f', round(skewness({c}), 4)) ||
  ') — consider log-scale charts or a median-based summary' FROM events HAVING abs(skewness({c})) >= 1"""))
def _(t):
    return stats.audit(t.events)


def outcomes(t):
    """Each event counts as a run of its user; errors fail."""
    return t.events.withColumn("passed", F.col("event_type") != "error")


_OUTCOMES = "o AS (SELECT user_id, event_type <> 'error' AS passed, strftime(ts, '%Y-%m-%d') AS day FROM events)"


@query("st_6_bootstrap_rate", f"""
WITH {_OUTCOMES}, g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE passed) AS k FROM o GROUP BY 1), e AS ({S.rate_ends('g', 'user_id')})
SELECT user_id, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS passes, round(k / n, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi FROM g JOIN e USING (user_id)""")
def _(t):
    r = paired.rates(outcomes(t), ["user_id"], "passed")
    return r.select("user_id", "n", "passes", *[ratio(c).alias(c) for c in ("point", "lo", "hi")])


def labelled(t):
    """Two recorded outcomes of the same documents."""
    q = t.labels.select("doc_id", (F.col("quality") == 1).alias("passed"))
    x = t.labels.select("doc_id", (F.col("toxic") == 1).alias("passed"))
    return paired.paired(q, x, ["doc_id"], "passed")


# All ways in which n steps can fall into worse, same and better, with their probabilities.
@query("st_7_paired_delta", """
WITH g AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) / count(*) AS w, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) / count(*) AS b FROM labels),
s AS (SELECT *, unnest(range(0, n + 1)) AS nb FROM g), c AS (SELECT *, unnest(range(0, n - nb + 1)) AS nw FROM s),
m AS (SELECT n, nb - nw AS d, sum(exp(lgamma(n + 1) - lgamma(nb + 1) - lgamma(nw + 1) - lgamma(n - nb - nw + 1) + CASE WHEN nb = 0 THEN 0 ELSE nb * ln(b) END
  + CASE WHEN nw = 0 THEN 0 ELSE nw * ln(w) END + CASE WHEN nb + nw = n THEN 0 ELSE (n - nb - nw) * ln(1 - b - w) END)) AS m FROM c
  WHERE (b > 0 OR nb = 0) AND (w > 0 OR nw = 0) AND (b + w < 1 OR nb + nw = n) GROUP BY 1, 2),
q AS (SELECT n, d, sum(m) OVER (ORDER BY d) AS c FROM m)
SELECT CAST(any_value(q.n) AS BIGINT) AS n_paired, round(any_value(b - w), 6) AS delta, round(min(d) FILTER (WHERE c >= 0.025 - 1e-12) / any_value(q.n), 6) AS delta_lo,
 round(min(d) FILTER (WHERE c >= 0.975 - 1e-12) / any_value(q.n), 6) AS delta_hi FROM q, g""")
def _(t):
    p = paired.paired_test(labelled(t))
    return p.select("n_paired", *[ratio(c).alias(c) for c in ("delta", "delta_lo", "delta_hi")])


@query("st_8_mcnemar", """
SELECT l.quality * 10 + l.toxic AS cell, CAST(count(*) AS BIGINT) AS n FROM labels l GROUP BY 1""")
def _(t):
    pairs = labelled(t)
    cell = F.col("base").cast("int") * 10 + F.col("this").cast("int")
    return pairs.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


@query("st_8_mcnemar_by_source", """
WITH g AS (SELECT lang, count(*) AS n_paired, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS x, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS y FROM labels JOIN documents USING (doc_id) GROUP BY 1),
i AS (SELECT *, unnest(range(0, least(x, y) + 1)) AS i FROM g)
SELECT lang, CAST(any_value(n_paired) AS BIGINT) AS n_paired, CAST(any_value(x) AS BIGINT) AS only_base, CAST(any_value(y) AS BIGINT) AS only_this,
 round(least(1.0::DOUBLE, 2 * sum(exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2)))), 9) AS mcnemar_p FROM i GROUP BY lang""")
def _(t):
    pairs = labelled(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    p = paired.paired_test(pairs, ["lang"])
    return p.select("lang", "n_paired", "only_base", "only_this", F.round("mcnemar_p", 9).alias("mcnemar_p"))


@query("st_9_percentiles", """
SELECT event_type, round(quantile_cont(value, .5), 6) AS p50, round(quantile_cont(value, .95), 6) AS p95 FROM events GROUP BY 1""")
def _(t):
    return paired.percentiles(t.events, ["event_type"], "value").select(
        "event_type", ratio("p50").alias("p50"), ratio("p95").alias("p95"))


@query("st_10_gate", f"""
WITH {_OUTCOMES}, g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE passed) AS k FROM o WHERE day >= '2024-01-24' GROUP BY 1), e AS ({S.rate_ends('g', 'user_id')}),
b AS (SELECT user_id, avg(passed::INT) AS baseline FROM o WHERE day < '2024-01-24' GROUP BY 1)
SELECT user_id, CAST(n AS BIGINT) AS n, round(k / n, 6) AS point, round(hi, 6) AS hi, round(baseline, 6) AS baseline,
 CASE WHEN baseline IS NULL THEN 'SKIPPED' WHEN hi >= baseline THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g JOIN e USING (user_id) LEFT JOIN b USING (user_id)""")
def _(t):
    day = F.date_format("ts", "yyyy-MM-dd")
    o = outcomes(t).withColumn("day", day)
    now = paired.rates(o.where("day >= '2024-01-24'"), ["user_id"], "passed")
    base = (o.where("day < '2024-01-24'").groupBy("user_id")
            .agg(F.avg(F.col("passed").cast("double")).alias("baseline")))
    g = paired.gate(now, base, ["user_id"])
    return g.select("user_id", "n", *[ratio(c).alias(c) for c in ("point", "hi", "baseline")], "verdict")


@query("st_11_power", """
WITH g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality <> toxic) / count(*) AS disc,
  count(*) FILTER (WHERE quality = 1) / count(*) AS p FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, CAST(n AS BIGINT) AS n, round((1.959963984540054 + 0.8416212335729143) * sqrt(disc / n), 6) AS mde,
  round(1.959963984540054 * sqrt(p * (1 - p) / n), 6) AS halfwidth FROM g""")
def _(t):
    g = labelled(t).join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(
        F.count("*").alias("n"), (F.count_if(F.col("base") != F.col("this")) / F.count("*")).alias("disc"),
        (F.count_if("base") / F.count("*")).alias("p"))
    return g.select("lang", "n", ratio(paired.mde_paired(F.col("n"), F.col("disc"))).alias("mde"),
                    ratio(paired.ci_halfwidth(F.col("n"), F.col("p"))).alias("halfwidth"))
