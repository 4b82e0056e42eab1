"""Comparing tables, scoring runs and cases (EV, AGG-11/12, JN-13)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyglass.operators import compare, evaluate, paired, pareto, sampling
from tallyglass.operators.profile import union
from tallyglass.plans import sqltext as S
from tallyglass.plans.common import ratio
from tallyglass.plans.registry import query


def yearly(t):
    return t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


def _cases(**frames):
    return union([f.select(F.lit(n).alias("test"), "match") for n, f in frames.items()])


_YEARLY = """g AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2),
top AS (SELECT year, round(sum(total), 2) AS total FROM g GROUP BY 1)"""


def _same(test, gold, pred, every="ALL"):
    """The rows of two selections, columns already paired, that either lacks: none if they match."""
    return f"""SELECT '{test}' AS test, NOT EXISTS (({gold} EXCEPT {every} {pred}) UNION ALL ({pred} EXCEPT {every} {gold})) AS match"""


_G = "SELECT o_custkey, year, total FROM g"
_T = "SELECT row_number() OVER (ORDER BY year) AS pos, year, total FROM top"


@query("ev_1_multiset_equality", "WITH " + _YEARLY + " UNION ALL ".join([
    " " + _same("permuted", _G, "SELECT k, year, total FROM (SELECT total, o_custkey AS k, year FROM g)"),
    # text never equals a number, so both sides say which they are
    _same("text_for_number", "SELECT 'n' || o_custkey, year, total FROM g", "SELECT 's' || o_custkey, year, total FROM g"),
    _same("fifth_decimal", _G, "SELECT o_custkey, year, total + 0.00001 FROM g"),
    _same("copied_row", _G, f"SELECT * FROM ({_G} UNION ALL (SELECT o_custkey, year, total FROM g ORDER BY o_custkey, year LIMIT 1))"),
    _same("changed", _G, "SELECT o_custkey, year, CASE WHEN year = 1997 THEN total + 1 ELSE total END FROM g"),
    _same("both_empty", _G + " WHERE total < 0", _G + " WHERE total < 0"),
    _same("ordered", _T, "SELECT row_number() OVER (ORDER BY year), year, total FROM (SELECT total, year FROM top)"),
    _same("reordered", _T, "SELECT row_number() OVER (ORDER BY year DESC), year, total FROM top")]))
def _(t):
    g = yearly(t)
    top = g.groupBy("year").agg(F.round(F.sum("total"), 2).alias("total"))
    w = Window.orderBy("year")  # one row per year
    num = lambda d, o: d.withColumn("pos", F.row_number().over(o))
    return _cases(
        permuted=compare.results_equal(g, g.select("total", F.col("o_custkey").alias("k"), "year")),
        text_for_number=compare.results_equal(g, g.withColumn("o_custkey", F.col("o_custkey").cast("string"))),
        fifth_decimal=compare.results_equal(g, g.withColumn("total", F.col("total") + 0.00001)),
        copied_row=compare.results_equal(g, g.unionAll(g.orderBy("o_custkey", "year").limit(1))),
        changed=compare.results_equal(g, g.withColumn("total", F.when(F.col("year") == 1997, F.col("total") + 1).otherwise(F.col("total")))),
        both_empty=compare.results_equal(g.where("total < 0"), g.where("total < 0")),
        ordered=compare.results_equal(num(top, w), num(top.select("total", "year"), w), position="pos"),
        reordered=compare.results_equal(num(top, w), num(top, Window.orderBy(F.desc("year"))), position="pos"))


@query("ev_2_set_equality", "WITH " + _YEARLY + " UNION ALL ".join([
    " " + _same("copies", _G, f"SELECT * FROM ({_G} UNION ALL {_G})", ""),
    _same("missing", _G, _G + " WHERE year <> 1998", ""),
    _same("text_for_number", "SELECT 'n' || o_custkey, year, total FROM g", "SELECT 's' || o_custkey, year, total FROM g", "")]))
def _(t):
    g = yearly(t)
    return _cases(copies=compare.set_equal(g, g.unionAll(g)), missing=compare.set_equal(g, g.where("year <> 1998")),
                  text_for_number=compare.set_equal(g, g.withColumn("o_custkey", F.col("o_custkey").cast("string"))))


@query("ev_3_extra_columns", "WITH " + _YEARLY + ", more AS (SELECT year, 'x' AS note, total, total * 2 AS twice, CAST(o_custkey AS VARCHAR) AS k FROM g)" + " UNION ALL ".join([
    " " + _same("extra", "SELECT CAST(o_custkey AS VARCHAR), year, total FROM g", "SELECT k, year, total FROM more"),
    # a side with fewer columns than the gold one never matches
    "SELECT 'too_few' AS test, count(*) >= 3 AS match FROM (SELECT unnest(['year', 'total']) AS c)",
    _same("wrong_values", "SELECT CAST(o_custkey AS VARCHAR), year, total FROM g", "SELECT k, year, twice FROM more")]))
def _(t):
    g = yearly(t)
    more = g.select("year", F.lit("x").alias("note"), "total", (F.col("total") * 2).alias("twice"), F.col("o_custkey").cast("string").alias("k"))
    return _cases(extra=compare.results_equal(g, more, extra_columns=True, lenient=True),
                  too_few=compare.results_equal(g, g.select("year", "total"), extra_columns=True, lenient=True),
                  wrong_values=compare.results_equal(g, more.drop("total"), extra_columns=True, lenient=True))


def _sample_sql(src, size, at_least=0):
    return f"""
s AS (SELECT *, md5(o_orderkey || ':0') AS h FROM {src}),
n AS (SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER () AS total FROM s GROUP BY 1),
r AS (SELECT s.*, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS rn, greatest({at_least}, round_even({size} * n / total, 0)) AS q FROM s JOIN n USING (o_orderpriority)),
p AS (SELECT * FROM r WHERE rn <= q)"""


@query("ev_4_stratified_sample", "WITH " + _sample_sql("orders", 203) + """,
x AS (SELECT 0 AS part, o_orderpriority AS st, rn, h, o_orderkey, o_orderpriority FROM p UNION ALL
 (SELECT 1, NULL, 0, h, o_orderkey, o_orderpriority FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p) ORDER BY h, o_orderkey LIMIT 203))
SELECT o_orderkey, o_orderpriority FROM x ORDER BY part, st, rn, h, o_orderkey LIMIT 203""")
def _(t):
    return sampling.stratified(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 203)


@query("ev_5_failure_sample", "WITH m AS (SELECT * FROM orders WHERE NOT o_orderstatus = 'F')," + _sample_sql("m", 50, 1) + """
SELECT o_orderkey, o_orderpriority FROM p ORDER BY h, o_orderkey LIMIT 50""")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("match"))
    return sampling.failures(o, "o_orderkey", "o_orderpriority", "match", 50).select("o_orderkey", "o_orderpriority")


@query("ev_6_label_summary", """
WITH c AS (SELECT CASE doc_id % 4 WHEN 0 THEN ' join ' WHEN 1 THEN 'condition' WHEN 2 THEN 'typo' ELSE ' ' END AS c FROM documents), k AS (SELECT trim(c) AS category FROM c WHERE trim(c) <> '')
SELECT category, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM k), 6) AS share, category <> 'typo' AS known FROM k GROUP BY 1""")
def _(t):
    c = F.expr("CASE doc_id % 4 WHEN 0 THEN ' join ' WHEN 1 THEN 'condition' WHEN 2 THEN 'typo' ELSE ' ' END")
    return evaluate.label_summary(t.documents.select(c.alias("c")), "c").select("category", "n", ratio("share").alias("share"), "known")


@query("ev_7_group_held_out_split", """
WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5(source || ':0')) AS rn FROM g)
SELECT doc_id, CASE WHEN rn <= (SELECT greatest(1, round_even(count(*) * 0.2, 0)) FROM g) THEN 'val' ELSE 'train' END AS split FROM documents JOIN r USING (source)""")
def _(t):
    return sampling.held_out_groups(t.documents, "source", 0.2).select("doc_id", "split")


def run_items(t):
    """Events read as evaluated items: the user is the run, the type the difficulty."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("difficulty"), F.col("event_id").alias("item"),
                           (k % 4 > 0).alias("match"), F.when(F.col("event_type") == "error", "failed").alias("error"),
                           (k % 3 + 1).alias("attempts"), (F.col("value") / 1000).alias("cost_usd"), F.col("value").alias("latency_s"))


_ITEMS = """i AS (SELECT user_id AS run, event_type AS difficulty, event_id AS item, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value FROM events)"""


@query("ev_8_run_summary", f"""WITH {_ITEMS}
SELECT run, CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (WHERE k % 4 > 0) / count(*), 6) AS ex, CAST(count(*) FILTER (WHERE difficulty = 'error') AS BIGINT) AS n_error,
 round(avg(k % 3 + 1), 6) AS mean_attempts, CAST(count(*) FILTER (WHERE k % 4 > 0 AND k % 3 > 0) AS BIGINT) AS repaired, round(sum(value / 1000), 4) AS cost_usd_total,
 round(quantile_cont(value, .5), 6) AS p50, round(quantile_cont(value, .95), 6) AS p95 FROM i GROUP BY run""")
def _(t):
    s = evaluate.run_summary(run_items(t), ["run"])
    return s.select("run", "n", ratio("ex").alias("ex"), "n_error", ratio("mean_attempts").alias("mean_attempts"), "repaired", "cost_usd_total",
                    ratio("p50").alias("p50"), ratio("p95").alias("p95"))


@query("ev_8_run_summary_by_difficulty", f"""WITH {_ITEMS}, g AS (SELECT run, difficulty, count(*) AS n, count(*) FILTER (WHERE i.k % 4 > 0) AS k FROM i GROUP BY 1, 2), e AS ({S.rate_ends('g', 'run, difficulty')})
SELECT run, difficulty, CAST(n AS BIGINT) AS n, round(k / n, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi FROM g JOIN e USING (run, difficulty)""")
def _(t):
    s = paired.rates(run_items(t), ["run", "difficulty"], "match")
    return s.select("run", "difficulty", "n", *[ratio(c).alias(c) for c in ("point", "lo", "hi")])


def part_runs(t):
    """Three recorded runs over the same parts."""
    runs = F.explode(F.array(*[F.struct(F.lit(n).alias("run"), (F.col("p_size") % d > 0).alias("match")) for n, d in (("base", 3), ("wide", 4), ("deep", 5))]))
    items = t.part.select(F.col("p_type").alias("benchmark"), F.col("p_partkey").alias("item"), runs.alias("_r")).select("benchmark", "item", "_r.*")
    plan = t.part.select(F.col("p_type").alias("benchmark")).distinct().select("benchmark", F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("run"), F.lit(b).alias("baseline")) for i, (n, b) in
        enumerate((("base", None), ("wide", None), ("deep", "wide")))])).alias("_p")).select("benchmark", "_p.*")
    return plan, items


@query("ev_9_ablation", """
WITH m AS (SELECT p_type AS benchmark, p_size % 3 > 0 AS a, p_size % 4 > 0 AS b, p_size % 5 > 0 AS c FROM part)
SELECT benchmark, 'base' AS run, CAST(count(*) AS BIGINT) AS n, round(avg(a::INT), 6) AS ex, NULL::BIGINT AS only_base, NULL::BIGINT AS only_this, NULL::DOUBLE AS delta FROM m GROUP BY 1
UNION ALL SELECT benchmark, 'wide', count(*), round(avg(b::INT), 6), count(*) FILTER (WHERE a AND NOT b), count(*) FILTER (WHERE b AND NOT a), round(avg(b::INT - a::INT), 6) FROM m GROUP BY 1
UNION ALL SELECT benchmark, 'deep', count(*), round(avg(c::INT), 6), count(*) FILTER (WHERE b AND NOT c), count(*) FILTER (WHERE c AND NOT b), round(avg(c::INT - b::INT), 6) FROM m GROUP BY 1""")
def _(t):
    a = evaluate.ablation(*part_runs(t))
    return a.select("benchmark", "run", "n", ratio("ex").alias("ex"), "only_base", "only_this", ratio("delta").alias("delta"))


@query("jn_13_paired_items", """
SELECT p_type AS benchmark, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE (p_size % 3 > 0) = (p_size % 4 > 0)) AS BIGINT) AS agree FROM part GROUP BY 1""")
def _(t):
    _, items = part_runs(t)
    p = paired.paired(items.where("run = 'base'"), items.where("run = 'wide'"), ["benchmark", "item"], "match")
    return p.groupBy("benchmark").agg(F.count("*").alias("n"), F.count_if(F.col("base") == F.col("this")).alias("agree"))


@query("ev_10_pareto_frontier", f"""WITH {_ITEMS},
g AS (SELECT run, difficulty, avg(value / 1000) AS cost, count(*) FILTER (WHERE k % 4 > 0) / count(*) AS ex FROM i GROUP BY 1, 2),
d AS (SELECT *, max(ex) OVER (PARTITION BY difficulty ORDER BY cost, ex DESC, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM g)
SELECT difficulty, run, round(cost, 6) AS cost, round(ex, 6) AS ex FROM d WHERE best IS NULL OR ex > best""")
def _(t):
    g = run_items(t).groupBy("run", "difficulty").agg(F.avg("cost_usd").alias("cost"), (F.count_if("match") / F.count("*")).alias("ex"))
    return pareto.frontier(g, "difficulty", "cost", "ex", "run").select("difficulty", "run", ratio("cost").alias("cost"), ratio("ex").alias("ex"))


def cases(t):
    """A scored case per order: what was asked for against what came out."""
    k = F.col("o_orderkey")
    arr = lambda c, *v: F.when(c, F.array(*[F.lit(x) for x in v])).otherwise(F.array().cast("array<string>"))
    return t.orders.select(
        k.alias("id"), F.when(k % 7 == 0, F.array(F.lit("chaos"), F.lit("filter"))).otherwise(F.array("o_orderpriority", F.lit("rank"))).alias("tags"),
        F.when(k % 11 == 0, "blocked").alias("error"), F.when(k % 5 > 0, F.concat(F.lit("SELECT sum(x) FROM t GROUP BY "), "o_orderstatus")).alias("sql"),
        arr(k % 3 > 0, "sum", "group by", "order by", "F").alias("must_contain"), F.array("o_orderstatus", F.col("o_custkey").cast("string")).alias("first_row"),
        F.when(k % 2 == 0, "f").alias("top_value"), (k % 4).cast("int").alias("n_rows"), F.when(k % 3 == 0, 1).alias("row_min"), F.when(k % 3 == 0, 2).alias("row_max"),
        F.lit("ChartType.BAR").alias("chart_type"), arr(k % 4 == 1, "Bar", "line").alias("charts"), F.when(k % 6 > 0, F.concat(F.lit("Status "), "o_orderstatus", F.lit(" leads"))).alias("narrative"),
        arr(k % 5 == 2, "leads", "status o").alias("must_mention"), arr(k % 9 == 0, "status p").alias("must_not_mention"), (k % 100).cast("int").alias("confidence"),
        F.when(k % 8 == 0, 60).alias("min_confidence"), (k % 13 == 0).alias("expect_empty"), (k % 17 == 0).alias("expect_warning"), (k % 2).cast("int").alias("n_warnings"),
        (F.col("o_totalprice") / 1000).alias("duration_s"), "o_orderstatus")


_S = "o_orderkey"
_CASES_SQL = """c AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr, o_custkey AS ck, o_totalprice / 1000 AS dur FROM orders),
p AS (SELECT *, CASE WHEN k % 5 > 0 THEN 'select sum(x) from t group by ' || lower(st) END AS sql, CASE WHEN k % 6 > 0 THEN 'status ' || lower(st) || ' leads' END AS nar FROM c),
h AS (SELECT *, (contains(sql, 'sum')::INT + contains(sql, 'group by')::INT + contains(sql, 'order by')::INT + contains(sql, 'f')::INT) / 4.0 AS kw,
 (contains(nar, 'leads')::INT + contains(nar, 'status o')::INT) / 2.0 AS sd, (contains(lower(st), 'f')) AS hit FROM p),
s AS (
 SELECT k, 'execution' AS name, CASE WHEN k % 11 = 0 THEN 0.0 ELSE 1.0 END AS score, k % 11 > 0 AS ok, CASE WHEN k % 11 = 0 AND k % 7 = 0 THEN 1.0 ELSE 2.0 END AS w FROM h
 UNION ALL SELECT k, 'sql_keywords', CASE WHEN k % 3 = 0 THEN 1.0 WHEN sql IS NULL THEN 0.0 ELSE kw END, CASE WHEN k % 3 = 0 THEN true WHEN sql IS NULL THEN false ELSE kw >= 0.75 END, CASE WHEN k % 3 = 0 THEN 0.5 ELSE 1.0 END FROM h WHERE k % 11 > 0
 UNION ALL SELECT k, 'top_value', CASE WHEN k % 2 > 0 THEN 1.0 WHEN k % 4 = 0 THEN 0.0 WHEN hit THEN 1.0 ELSE 0.0 END, CASE WHEN k % 2 > 0 THEN true WHEN k % 4 = 0 THEN false ELSE hit END, CASE WHEN k % 2 > 0 THEN 0.5 ELSE 1.5 END FROM h WHERE k % 11 > 0
 UNION ALL SELECT k, 'row_count', CASE WHEN k % 3 > 0 OR k % 4 BETWEEN 1 AND 2 THEN 1.0 ELSE 0.0 END, k % 3 > 0 OR k % 4 BETWEEN 1 AND 2, CASE WHEN k % 3 > 0 THEN 0.3 ELSE 0.5 END FROM h WHERE k % 11 > 0
 UNION ALL SELECT k, 'chart_type', 1.0, true, CASE WHEN k % 4 = 1 THEN 0.7 ELSE 0.3 END FROM h WHERE k % 11 > 0
 UNION ALL SELECT k, 'narrative_keywords', CASE WHEN k % 5 <> 2 THEN 1.0 WHEN nar IS NULL THEN 0.0 ELSE sd END, CASE WHEN k % 5 <> 2 THEN true WHEN nar IS NULL THEN false ELSE sd >= 0.5 END, CASE WHEN k % 5 <> 2 THEN 0.3 ELSE 1.0 END FROM h WHERE k % 11 > 0
 UNION ALL SELECT k, 'confidence', CASE WHEN k % 8 > 0 OR k % 100 >= 60 THEN 1.0 ELSE (k % 100) / 60.0 END, k % 8 > 0 OR k % 100 >= 60, CASE WHEN k % 8 > 0 THEN 0.3 ELSE 0.5 END FROM h WHERE k % 11 > 0
 UNION ALL SELECT k, 'expect_empty', (k % 4 = 0)::INT, k % 4 = 0, 1.5 FROM h WHERE k % 11 > 0 AND k % 13 = 0
 UNION ALL SELECT k, 'narrative_no_hallucinate', CASE WHEN nar IS NULL OR NOT contains(nar, 'status p') THEN 1.0 ELSE 0.0 END, nar IS NULL OR NOT contains(nar, 'status p'), CASE WHEN nar IS NULL THEN 1.0 ELSE 1.5 END FROM h WHERE k % 11 > 0 AND k % 9 = 0
 UNION ALL SELECT k, 'expect_warning', (k % 2 > 0)::INT, k % 2 > 0, 1.0 FROM h WHERE k % 11 > 0 AND k % 17 = 0),
card AS (SELECT k, sum(score * w) / sum(w) AS weighted_score, bool_and(ok) AS passed FROM s GROUP BY k)"""


@query("ev_11_case_scorecard", f"WITH {_CASES_SQL} SELECT k AS id, round(weighted_score, 9) AS weighted_score, passed FROM card")
def _(t):
    return evaluate.scorecard(evaluate.case_scores(cases(t))).select("id", F.round("weighted_score", 9).alias("weighted_score"), "passed")


@query("agg_12_scores_by_tag", f"""WITH {_CASES_SQL},
tg AS (SELECT k, unnest(CASE WHEN k % 7 = 0 THEN ['chaos', 'filter'] ELSE [pr, 'rank'] END) AS tag FROM c)
SELECT 'tag' AS kind, tag AS name, CAST(count(*) AS BIGINT) AS n, round(avg(weighted_score), 3) AS score FROM card JOIN tg USING (k) GROUP BY 2
UNION ALL SELECT 'dimension', name, count(*), round(avg(score), 3) FROM s GROUP BY 2
UNION ALL SELECT 'overall', 'overall_score', count(*), round(avg(weighted_score), 3) FROM card
UNION ALL SELECT 'overall', 'pass_rate', count(*), round(avg(passed::INT), 3) FROM card
UNION ALL SELECT 'overall', 'avg_latency_seconds', count(*), round(avg(dur), 3) FROM c""")
def _(t):
    return evaluate.aggregate_cards(evaluate.scorecard(evaluate.case_scores(cases(t))))


@query("ev_12_accuracy_by_tag", f"""WITH {_CASES_SQL},
tg AS (SELECT k, unnest(CASE WHEN k % 7 = 0 THEN ['chaos', 'filter'] ELSE [pr, 'rank'] END) AS tag FROM c),
g AS (SELECT tag, count(*) AS n, count(*) FILTER (WHERE passed) AS k FROM card JOIN tg USING (k) GROUP BY 1), e AS ({S.rate_ends('g', 'tag')})
SELECT tag, CAST(n AS BIGINT) AS n, round(k / n, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi FROM g JOIN e USING (tag)""")
def _(t):
    c = evaluate.scorecard(evaluate.case_scores(cases(t)))
    return evaluate.by_tag(c, "tags", "passed").select("tag", "n", *[ratio(x).alias(x) for x in ("point", "lo", "hi")])


@query("ev_13_model_matrix", f"""WITH {_CASES_SQL}
SELECT name AS dimension, round(avg(score) FILTER (WHERE st = 'F'), 3) AS "F", round(avg(score) FILTER (WHERE st = 'O'), 3) AS "O",
 round(avg(score) FILTER (WHERE st = 'P'), 3) AS "P" FROM s JOIN c USING (k) GROUP BY 1""")
def _(t):
    return evaluate.model_matrix(evaluate.case_scores(cases(t)), "o_orderstatus", ["F", "O", "P"])


@query("ev_14_latest_run", """
SELECT 'bird' || CASE WHEN event_type = 'view' THEN ' (evidence)' ELSE ' (no evidence)' END AS series, max(event_id) AS event_id,
 arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def _(t):
    s = evaluate.series_label(F.lit("bird"), F.col("event_type") == "view")
    return evaluate.latest(t.events.select(s.alias("series"), "event_id", "value"), "series", "event_id")
