"""Numeric claim checks (FTH, JN-11)."""

from pyspark.sql import functions as F

from tallyglass.operators import claims
from tallyglass.plans.registry import query

# What a customer's summary says; every third overstates the total.
_SAID = """SELECT o_custkey, printf('%.4f', sum(o_totalprice) * CASE WHEN o_custkey % 3 = 0 THEN 1.07 ELSE 1 END) AS total_text,
 printf('%.5f', max(o_totalprice) / 1000) AS top_text, printf('%.7f', avg(o_totalprice) * CASE WHEN o_custkey % 5 = 0 THEN 0.5 ELSE 1 END) AS mean_text,
 count(*) AS n FROM orders GROUP BY o_custkey"""

_CHECK_SQL = f"""
WITH s AS ({_SAID}),
m AS (SELECT o_custkey, 1 AS pos, total_text AS raw, CAST(total_text AS DOUBLE) AS v, 4 AS d FROM s
 UNION ALL SELECT o_custkey, 2, top_text || 'k', CAST(top_text AS DOUBLE) * 1000, 2 FROM s
 UNION ALL SELECT o_custkey, 3, '$' || mean_text, CAST(mean_text AS DOUBLE), 7 FROM s
 UNION ALL SELECT o_custkey, 0, CAST(n AS VARCHAR), n, 0 FROM s WHERE n > 10),
c AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS c FROM orders GROUP BY 1
 UNION SELECT o_custkey, o_totalprice FROM orders UNION SELECT o_custkey, o_totalprice * 100 FROM orders
 UNION SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY 1 UNION SELECT o_custkey, avg(o_totalprice) FROM orders GROUP BY 1
 UNION SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) FROM orders),
bad AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.o_custkey = m.o_custkey
  AND abs(abs(c.c) - abs(m.v)) <= greatest(0.5 * pow(10.0, -m.d), abs(m.v) * 0.005)))"""


def summaries(t):
    """One generated sentence per customer."""
    k, total = F.col("o_custkey"), F.sum("o_totalprice")
    g = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), (total * F.when(k % 3 == 0, 1.07).otherwise(1)).alias("total"),
        (F.max("o_totalprice") / 1000).alias("top"), (F.avg("o_totalprice") * F.when(k % 5 == 0, 0.5).otherwise(1)).alias("mean"))
    said = F.format_string("Customer#%d placed %d orders worth %.4f in total; the largest was %.5fk, the mean $%.7f, rank 2nd of 12345.",
                           "o_custkey", "n", "total", "top", "mean")
    return g.select("o_custkey", said.alias("text"), F.lit("Who ranks second of 12345?").alias("question"))


def result_rows(t):
    return t.orders.select("o_custkey", "o_totalprice", "o_orderpriority")


@query("fth_1_claim_check", _CHECK_SQL + """
SELECT s.o_custkey, CAST(count(b.pos) AS BIGINT) AS n_unsupported, CASE WHEN count(b.pos) > 0 THEN
 'Narrative mentions numbers not supported by the result table: ' || string_agg(b.raw, ', ' ORDER BY b.pos) END AS warning
FROM s LEFT JOIN bad b ON b.o_custkey = s.o_custkey GROUP BY 1""")
def _(t):
    # The customer number in "Customer#7" is written like any number; it counts as asked about.
    s = summaries(t).withColumn("question", F.concat("question", F.lit(" customer "), "o_custkey"))
    return claims.check(s, "o_custkey", "text", result_rows(t), "question")


@query("jn_11_tolerance_join", _CHECK_SQL + "SELECT o_custkey, raw FROM bad")
def _(t):
    s = summaries(t).withColumn("question", F.concat("question", F.lit(" customer "), "o_custkey"))
    found = claims.mentions(s, "o_custkey", "text", "question")
    return claims.unsupported(found, claims.candidates(result_rows(t), "o_custkey"), "o_custkey").select("o_custkey", "raw")
