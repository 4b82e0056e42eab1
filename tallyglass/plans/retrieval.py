"""Retrieval over text, values, catalogs (RET, JN-12)."""

from pyspark.sql import functions as F

from tallyglass.operators import history, lexical, metrics, profile, retrieval, values, vectors
from tallyglass.plans import sqltext as S
from tallyglass.plans.common import money, ratio
from tallyglass.plans.registry import query
from tallyglass.session import cut
from tallyglass.tables import FOREIGN_KEYS

_BM25 = f"""
tok AS (SELECT doc_id AS doc, unnest({S.tokens('text')}) AS token FROM documents),
tf AS (SELECT doc, token, count(*) AS tf FROM tok GROUP BY 1, 2),
dl AS (SELECT doc, sum(tf) AS dl FROM tf GROUP BY 1),
sh AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS avgdl),
idf AS (SELECT token, count(*) AS df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, sh GROUP BY token, n),
q AS (SELECT item_id AS query, unnest({S.tokens('text')}) AS token FROM benchmark),
bm AS (SELECT query, doc, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM q JOIN tf USING (token) JOIN dl USING (doc) JOIN idf USING (token), sh GROUP BY 1, 2)"""


def _vec_sql(name, table, key):
    return f"""
{name}_f AS (SELECT {key} AS id, 'w:' || unnest({S.tokens('text')}) AS f FROM {table} UNION ALL SELECT {key}, 'c:' || unnest({S.trigrams('text')}) FROM {table}),
{name}_h AS (SELECT id, md5(f) AS h FROM {name}_f),
{name}_w AS (SELECT id, CAST((('0x' || substr(h, 1, 2))::INT + 256 * ('0x' || substr(h, 3, 2))::INT) % 512 AS INTEGER) AS dim,
 sum(CASE WHEN ('0x' || substr(h, 15, 2))::INT >= 128 THEN 1.0 ELSE -1.0 END)::DOUBLE AS w FROM {name}_h GROUP BY 1, 2 HAVING w <> 0),
{name} AS (SELECT id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {name}_w)"""


@query("ret_1_bm25_index", f"WITH {_BM25} SELECT token, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf, (SELECT round(avgdl, 6) FROM sh) AS avgdl FROM idf")
def _(t):
    ix = lexical.build(t.documents, "doc_id", "text")
    return ix.terms.select("token", "df", ratio("idf").alias("idf"), ratio("avgdl").alias("avgdl"))


@query("ret_2_bm25_scores", f"WITH {_BM25} SELECT query, doc, round(score, 6) AS score FROM bm")
def _(t):
    ix = lexical.build(t.documents, "doc_id", "text")
    return lexical.scores(ix, t.benchmark, "item_id", "text").select("query", "doc", ratio("score").alias("score"))


@query("ret_3_hashing_embedding", f"WITH {_vec_sql('v', 'documents', 'doc_id')} SELECT id, dim, round(weight, 6) AS weight FROM v")
def _(t):
    return retrieval.hashed_weights(t.documents, "doc_id", "text").select("id", "dim", ratio("weight").alias("weight"))


def centroids(t):
    """The mean vector of every label, dimension by dimension."""
    e = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    g = m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_v"))
    return g.select(F.col("label").alias("id"), F.transform("_v", lambda s: s["x"]).alias("vec"))


@query("ret_4_vector_top_k", """
WITH e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2),
s AS (SELECT c.label AS query, e.vec_id AS doc, sum(c.x * e.x) AS score FROM e JOIN c USING (i) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1 AS rank FROM s)
SELECT query, doc, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 10""")
def _(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    top = retrieval.vector_topk(centroids(t), v, 10)
    return top.select("query", "doc", ratio("score").alias("score"), "rank")


def vector_index(t):
    return vectors.build(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


@query("ret_4_index_content", """
SELECT CAST(count(*) AS BIGINT) AS n_vectors, CAST(count(DISTINCT vec_id) AS BIGINT) AS n_ids, round(sum(embedding[1]::DOUBLE), 6) AS first_sum FROM embeddings WHERE embedding IS NOT NULL""")
def _(t):
    return vector_index(t).rows.agg(F.count("*").alias("n_vectors"), F.count_distinct("id").alias("n_ids"), ratio(F.sum(F.col("vec")[0])).alias("first_sum"))


@query("ret_4_index_recall")
def _(t):
    asked = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vectors.recall_report(vector_index(t), asked, 10).select("n_queries", "n_true", "lists", "probes", ratio("recall").alias("recall"))


@query("ret_5_rank_fusion", """
WITH a AS (SELECT p_brand AS query, p_partkey AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) - 1 AS rank FROM part),
b AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1 FROM part)
SELECT query, doc, round(sum(1.0 / (61 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def _(t):
    p = t.part.select(F.col("p_brand").alias("query"), F.col("p_partkey").alias("doc"), "p_size", "p_name")
    lists = [history.numbered(p, ["query"], [*o, "doc"], "rank") for o in ([F.desc("p_size")], ["p_name"])]
    return retrieval.rrf(lists).select("query", "doc", F.round("score", 9).alias("score"))


@query("ret_6_hybrid_search", f"""
WITH {_BM25}, {_vec_sql('dv', 'documents', 'doc_id')}, {_vec_sql('qv', 'benchmark', 'item_id')},
every AS (SELECT item_id AS query, doc_id AS doc FROM benchmark, documents WHERE source IS DISTINCT FROM 'src' || item_id % 20),
r1 AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(coalesce(score, 0), 9) DESC, doc) - 1 AS rank FROM every LEFT JOIN bm USING (query, doc)),
dot AS (SELECT qv.id AS query, dv.id AS doc, sum(qv.weight * dv.weight) AS score FROM qv JOIN dv USING (dim) GROUP BY 1, 2),
r2 AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(coalesce(score, 0), 9) DESC, doc) - 1 AS rank FROM every LEFT JOIN dot USING (query, doc)),
f AS (SELECT query, doc, sum(1.0 / (61 + rank)) AS score FROM (SELECT * FROM r1 WHERE rank < 200 UNION ALL SELECT * FROM r2 WHERE rank < 200) GROUP BY 1, 2),
x AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) - 1 AS rank FROM f)
SELECT query, doc, CAST(rank AS INTEGER) AS rank, round(score, 9) AS score FROM x WHERE rank < 3""")
def _(t):
    q = t.benchmark.withColumn("source", F.concat(F.lit("src"), F.col("item_id") % 20))
    r = retrieval.search(t.documents, "doc_id", "text", q, "item_id", "text", 3, 200, "source")
    return r.select("query", "doc", "rank", F.round("score", 9).alias("score"))


def value_questions(t):
    """A question per customer that names a nation, a part and (misspelled) a segment."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.part, F.col("c_custkey") == F.col("p_partkey"))
    seg = F.regexp_replace("c_mktsegment", "R", "RR")
    return c.select("c_custkey", F.concat(F.lit("What was billed to "), F.lower("n_name"), F.lit(" for '"), F.upper("p_name"), F.lit("' in the "), seg,
                                          F.lit(" segment?")).alias("question"))


#: Every text column of every table.
_TEXT_COLS = {"region": "r_name", "nation": "n_name", "customer": "c_name c_mktsegment", "supplier": "s_name", "part": "p_name p_brand p_type",
              "orders": "o_orderstatus o_orderpriority", "lineitem": "l_returnflag l_linestatus", "events": "event_type props",
              "documents": "text lang source", "pages": "url html", "benchmark": "text", "conversations": "role text"}
_VALUES_SQL = " UNION ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {c} AS value FROM {t} WHERE length({c}) > 1" for t, cs in _TEXT_COLS.items() for c in cs.split())
_JACCARD = "len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb)))"


@query("ret_7_value_matching", f"""
WITH cq AS (SELECT c_custkey AS question, 'What was billed to ' || lower(n_name) || ' for ''' || upper(p_name) || ''' in the ' || regexp_replace(c_mktsegment, 'R', 'RR', 'g') || ' segment?' AS text
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN part ON c_custkey = p_partkey),
w AS (SELECT question, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_''.&/-]+') AS w FROM cq),
r AS (SELECT question, 1 + n * 100 + i AS pos, list_slice(w, i, i + n - 1) AS p FROM w, (SELECT unnest([1, 2, 3, 4]) AS n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
s0 AS (SELECT question, pos, trim(array_to_string(p, ' '), '.,?') AS span FROM r WHERE len(list_filter(p, lambda x : lower(x) NOT IN ({S.STOP_LIST}))) > 0
 UNION ALL SELECT question, 0, regexp_extract(text, '''([^'']+)''', 1) FROM cq),
s AS (SELECT * FROM s0 WHERE length(span) > 2),
v AS ({_VALUES_SQL}),
sd AS (SELECT DISTINCT lower(span) AS low FROM s), sg AS (SELECT low, {S.trigrams('low')} AS ga FROM sd),
vd AS (SELECT DISTINCT lower(value) AS low FROM v), vg AS (SELECT * FROM (SELECT low, {S.trigrams('low')} AS gb FROM vd) WHERE len(gb) * .75 <= (SELECT max(len(ga)) FROM sg)),
x1 AS (SELECT low, len(ga) AS na, unnest(ga) AS g FROM sg WHERE low NOT IN (SELECT low FROM vd)), y1 AS (SELECT low, len(gb) AS nb, unnest(gb) AS g FROM vg),
near AS (SELECT x1.low AS l, y1.low AS r, count(*) / (any_value(na) + any_value(nb) - count(*)) AS score FROM x1 JOIN y1 USING (g) GROUP BY 1, 2),
both_ AS (SELECT low AS l, low AS r, 1.0 AS score FROM sd WHERE low IN (SELECT low FROM vd) UNION ALL SELECT l, r, score FROM near WHERE score >= .75),
hit AS (SELECT l AS low, "table", "column", value, score FROM both_ JOIN v ON lower(v.value) = both_.r),
b AS (SELECT question, "table", "column", value, span, score, row_number() OVER (PARTITION BY question, "table", "column", value ORDER BY score DESC, pos) AS k
 FROM s JOIN hit ON lower(s.span) = hit.low),
x AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 3) DESC, length(span) DESC, "table", "column", value) AS rank FROM b WHERE k = 1)
SELECT question, "table", "column", value, span, round(score, 3) AS score, CAST(rank AS INTEGER) AS rank FROM x WHERE rank <= 8""")
def _(t):
    ix = values.value_index(t.frames())
    return values.match_values(value_questions(t), "c_custkey", "question", ix)


@query("jn_12_set_similarity_join", f"""
WITH a AS (SELECT DISTINCT p_name AS l FROM part), g AS (SELECT l, {S.trigrams('l')} AS ga FROM a), h AS (SELECT l AS r, ga AS gb FROM g)
SELECT l, r, round({_JACCARD}, 6) AS score FROM g, h WHERE {_JACCARD} >= 0.3""")
def _(t):
    names = t.part.select("p_name").distinct()
    s = values.similar(names.select(F.col("p_name").alias("l")), names.select(F.col("p_name").alias("r")), 0.3)
    return s.select("l", "r", ratio("score").alias("score"))


CATALOG_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def catalog_and_questions(t):
    frames = t.frames(*CATALOG_TABLES)
    # The catalog is as small as the schema and is read by every step of the ranking.
    cat = cut(profile.catalog(frames, exact=False))
    n = sum(len(d.columns) for d in frames.values())
    q = t.nation.select(F.col("n_nationkey").alias("id"), F.concat(
        F.lit("Which customer segment in "), "n_name", F.lit(" has the highest account balance and order total price?")).alias("text"))
    return cat, q, n


def fk_frame(t):
    return t.spark.createDataFrame([(f.table, f.column, f.ref_table, f.ref_column) for f in FOREIGN_KEYS],
                                   "table string, column string, ref_table string, ref_column string")


def kept_columns(t, ks):
    cat, q, n = catalog_and_questions(t)
    ranked = retrieval.rank_columns(cat, q, "id", "text", n)
    parts = F.split("doc", r"\.")
    cuts = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    top = ranked.select("query", "rank", parts[0].alias("table"), parts[1].alias("column"), cuts).where("rank < k")
    # One pruning for all cut-offs: a question at one k is a question of its own.
    # The selection (questions x k rows) feeds every rule of the pruning: written once.
    both = cut(top.select(F.struct("k", F.col("query").alias("q")).alias("query"), "table", "column"))
    return retrieval.prune(both, cat, fk_frame(t)).select("query.k", F.col("query.q").alias("query"), "table", "column")


@query("ret_8_catalog_search")
def _(t):
    cat, q, n = catalog_and_questions(t)
    return retrieval.rank_columns(cat, q, "id", "text", n).where("rank < 20").select("query", "doc", "rank", F.round("score", 9).alias("score"))


@query("ret_9_join_safe_pruning", """
WITH kept AS (SELECT n_nationkey AS query, t FROM nation, (SELECT unnest(['customer', 'part']) AS t))
SELECT n_nationkey AS query, x.t AS "table", x.c AS "column" FROM nation, (VALUES ('customer', 'c_acctbal'), ('customer', 'c_custkey'),
 ('lineitem', 'l_partkey'), ('part', 'p_brand'), ('part', 'p_partkey'), ('lineitem', 'l_suppkey'), ('supplier', 's_name'), ('supplier', 's_suppkey')) AS x(t, c)""")
def _(t):
    # Columns of customer, part and supplier are wanted; lineitem bridges part and supplier.
    cat = profile.catalog(t.frames(*CATALOG_TABLES), exact=False)
    want = F.explode(F.array(*[F.struct(F.lit(a).alias("table"), F.lit(b).alias("column")) for a, b in
                               (("customer", "c_acctbal"), ("part", "p_brand"), ("supplier", "s_name"))]))
    sel = t.nation.select(F.col("n_nationkey").alias("query"), want.alias("_w")).select("query", "_w.table", "_w.column")
    return retrieval.prune(sel, cat, fk_frame(t))


@query("ret_10_recall_at_k")
def _(t):
    gold = t.nation.select(F.col("n_nationkey").alias("query"), F.explode(F.array(*[
        F.struct(F.lit(a).alias("table"), F.lit(b).alias("column")) for a, b in
        (("customer", "c_mktsegment"), ("customer", "c_acctbal"), ("orders", "o_totalprice"), ("nation", "n_name"))])).alias("_g")).select("query", "_g.*")
    r = retrieval.recall(gold, kept_columns(t, (5, 10, 20)), ["k"])
    return r.select("k", "n", *[ratio(c).alias(c) for c in ("column_recall", "strict_recall", "table_recall")])


@query("ret_11_leakage_guard", """
SELECT CASE WHEN role = 'system' THEN 'chk_' || conv_id ELSE 'user-' || conv_id || '-' || turn END AS id FROM conversations WHERE role = 'system'""")
def _(t):
    i = t.conversations.select(F.when(F.col("role") == "system", F.concat(F.lit("chk_"), "conv_id"))
                               .otherwise(F.concat_ws("-", F.lit("user"), "conv_id", "turn")).alias("id"))
    return retrieval.evaluation_leaks(i, "id")


def cache_case(t):
    cached = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("What is the total spend of all customers in "), "n_name", F.lit("?")).alias("text"),
                             F.col("n_regionkey").alias("version"), F.lit(0.004).alias("cost_usd"))
    q = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("What is the total spend of all customers in "), "n_name")).otherwise(
        F.concat(F.lit("Show the "), F.lower("c_mktsegment"), F.lit(" orders of "), "c_name"))
    return q.select(F.col("c_custkey").alias("id"), asked.alias("text"), F.col("n_regionkey").alias("version")), cached


@query("ret_12_cache_hits", """
SELECT n_regionkey AS version, CAST(count(*) FILTER (WHERE c_custkey % 3 = 0) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE c_custkey % 3 <> 0) AS BIGINT) AS misses,
 round(count(*) FILTER (WHERE c_custkey % 3 = 0) / count(*), 6) AS hit_rate, round(count(*) FILTER (WHERE c_custkey % 3 = 0) * 0.004::DOUBLE, 4) AS usd_saved
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(t):
    q, cached = cache_case(t)
    r = retrieval.cache_report(retrieval.nearest_cached(q, cached), ["version"])
    return r.select("version", "hits", "misses", ratio("hit_rate").alias("hit_rate"), money("usd_saved").alias("usd_saved"))


@query("ret_13_metrics", """
SELECT p_type, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(sum(l_quantity), 4) AS units_sold,
 round(avg(l_discount), 6) AS average_discount, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS return_rate
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    star = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    m = metrics.SALES.compute(star, ["revenue", "units_sold", "average_discount", "return_rate"], ["p_type"])
    return m.select("p_type", money("revenue").alias("revenue"), money("units_sold").alias("units_sold"),
                    ratio("average_discount").alias("average_discount"), ratio("return_rate").alias("return_rate"))


@query("ret_13_relevant_metrics", """
SELECT c_custkey AS query, CASE WHEN c_custkey % 2 = 0 THEN 'revenue' ELSE 'average_discount' END AS metric, 0 AS rank FROM customer""")
def _(t):
    q = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Sales for "), "c_mktsegment"))
                          .otherwise(F.concat(F.lit("rebates for "), "c_mktsegment")).alias("text"))
    return metrics.SALES.relevant(q, "c_custkey", "text")
