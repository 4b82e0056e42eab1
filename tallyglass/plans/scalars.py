"""Scalar functions (FN)."""

from pyspark.sql import functions as F

from tallyglass import fixed
from tallyglass.functions import features, numbers, personal, text
from tallyglass.plans import sqltext as S
from tallyglass.plans.common import ratio
from tallyglass.plans.registry import query


@query("fn_1_date_parts", """
SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, strftime(ts, '%Y-%m') AS ym,
       CAST(hour(ts) AS INTEGER) AS h, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow FROM events""")
def _(t):
    return t.events.select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"),
                           F.date_format("ts", "yyyy-MM").alias("ym"), F.hour("ts").alias("h"), F.dayofweek("ts").alias("dow"))


@query("fn_2_quarter", """
SELECT o_orderkey, CAST((month(o_orderdate) + 2) // 3 AS INTEGER) AS quarter FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", F.quarter("o_orderdate").alias("quarter"))


@query("fn_3_timestamp_difference", """
SELECT o_orderstatus, CAST(count(*) FILTER (WHERE date_diff('second', o_orderdate, l_shipdate) > 7200) AS BIGINT) AS late,
       CAST(max(date_diff('second', o_orderdate, l_shipdate)) AS BIGINT) AS longest_s
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    s = F.timestamp_diff("SECOND", "o_orderdate", "l_shipdate")
    return j.groupBy("o_orderstatus").agg(F.count_if(s > 7200).alias("late"), F.max(s).alias("longest_s"))


@query("fn_4_month_prefix", """
SELECT substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS m, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def _(t):
    return t.orders.groupBy(F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("m")).agg(F.count("*").alias("n"))


@query("fn_5_lenient_casts", """
SELECT doc_id, TRY_CAST(text AS INTEGER) AS number,
       TRY_CAST(replace(source, 'src', '') AS INTEGER) AS source_number,
       strftime(TRY_CAST(CASE WHEN doc_id % 2 = 0 THEN '2024-02-' || lpad(CAST(doc_id % 35 AS VARCHAR), 2, '0') ELSE text END
         AS DATE), '%Y-%m-%d') AS day FROM documents""")
def _(t):
    d = F.col("doc_id")
    day = F.when(d % 2 == 0, F.concat(F.lit("2024-02-"), F.lpad((d % 35).cast("string"), 2, "0"))).otherwise(F.col("text"))
    return t.documents.select(
        "doc_id", F.col("text").try_cast("int").alias("number"),
        F.replace("source", F.lit("src"), F.lit("")).try_cast("int").alias("source_number"),
        F.date_format(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), "yyyy-MM-dd").alias("day"))


@query("fn_6_canonical_value", f"""
SELECT o_orderkey, {S.plain_decimal('o_totalprice')} AS price, {S.plain_decimal('o_orderkey')} AS id,
       CASE WHEN o_totalprice > 200000 THEN 'True' ELSE 'False' END AS large,
       CASE WHEN o_orderkey % 2 = 0 THEN {S.plain_decimal("CAST(o_custkey || '.50' AS DOUBLE)")} ELSE o_orderpriority END AS mixed
FROM orders""")
def _(t):
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_custkey", F.lit(".50"))).otherwise(F.col("o_orderpriority"))
    return t.orders.select(
        "o_orderkey", numbers.canonical(F.col("o_totalprice"), "double").alias("price"),
        numbers.canonical(F.col("o_orderkey"), "bigint").alias("id"),
        numbers.canonical(F.col("o_totalprice") > 200000, "boolean").alias("large"),
        numbers.canonical(mixed, "string").alias("mixed"))


@query("fn_7_literal", """
SELECT doc_id, '''' || replace(CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END, '''', '''''') || ''''
  AS shown FROM documents""")
def _(t):
    return t.documents.select("doc_id", numbers.literal(F.col("text")).alias("shown"))


@query("fn_8_split_identifier", f"""
SELECT page_id, CAST(len({S.words('html')}) AS INTEGER) AS n, md5(array_to_string({S.words('html')}, ' ')) AS words_md5 FROM pages""")
def _(t):
    w = text.words(F.col("html"))
    return t.pages.select("page_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("words_md5"))


@query("fn_9_light_stem", f"""
SELECT DISTINCT w, {S.stem('w')} AS stem FROM (SELECT unnest({S.words('text')}) AS w FROM documents)""")
def _(t):
    w = t.documents.select(F.explode(text.words(F.col("text"))).alias("w")).distinct()
    return w.select("w", text.stem(F.col("w")).alias("stem"))


@query("fn_10_tokenize", f"""
SELECT doc_id, CAST(len({S.tokens('text')}) AS INTEGER) AS n, md5(array_to_string({S.tokens('text')}, ' ')) AS tokens_md5
FROM documents""")
def _(t):
    d = t.documents.select("doc_id", text.tokens(F.col("text")).alias("toks"))
    return d.select("doc_id", F.size("toks").alias("n"), F.md5(F.array_join("toks", " ")).alias("tokens_md5"))


@query("fn_11_char_ngrams", f"""
SELECT item_id, CAST(len({S.trigrams('text')}) AS INTEGER) AS n,
       md5(array_to_string(list_sort({S.trigrams('text')}), '|')) AS grams_md5 FROM benchmark""")
def _(t):
    g = F.array_sort(text.trigrams(F.col("text")))
    return t.benchmark.select("item_id", F.size(g).alias("n"), F.md5(F.array_join(g, "|")).alias("grams_md5"))


@query("fn_12_word_spans", f"""
WITH w AS (SELECT item_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_''.&/-]+') AS w FROM benchmark),
r AS (SELECT item_id, n, i, list_slice(w, i, i + n - 1) AS p FROM w, (SELECT unnest([1, 2, 3, 4]) AS n),
      LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
s AS (SELECT item_id, trim(array_to_string(p, ' '), '.,?') AS span FROM r
      WHERE len(list_filter(p, lambda x : lower(x) NOT IN ({S.STOP_LIST}))) > 0)
SELECT item_id, span, CAST(count(*) AS BIGINT) AS n FROM s WHERE length(span) > 2 GROUP BY 1, 2""")
def _(t):
    s = t.benchmark.select("item_id", F.explode(text.spans(F.col("text"))).alias("span"))
    return s.groupBy("item_id", "span").agg(F.count("*").alias("n"))


@query("fn_13_numbers_in_prose")
def _(t):
    n = t.documents.select("doc_id", F.posexplode(numbers.numbers(F.col("text"))).alias("pos", "n"))
    return n.select("doc_id", "pos", "n.value", "n.decimals", "n.raw")


@query("fn_14_luhn", """
WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 AS VARCHAR), 16, '4') AS num FROM orders),
d AS (SELECT o_orderkey, i, CAST(substr(num, CAST(17 - i AS INTEGER), 1) AS INTEGER) AS v FROM n, (SELECT unnest(range(1, 17)) AS i))
SELECT o_orderkey, sum(CASE WHEN i % 2 = 0 THEN CASE WHEN v > 4 THEN v * 2 - 9 ELSE v * 2 END ELSE v END) % 10 = 0 AS valid
FROM d GROUP BY o_orderkey""")
def _(t):
    num = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 16, "4")
    return t.orders.select("o_orderkey", personal.luhn_ok(num).alias("valid"))


@query("fn_15_cost_format", """
WITH b AS (SELECT doc_id, CAST(n_chars * n_chars * 3001 AS DOUBLE) AS b FROM documents)
SELECT doc_id, CASE WHEN b / 1073741824 >= 0.1 THEN format('{:,.2f} GiB', b / 1073741824)
       ELSE format('{:,.0f} MiB', b / 1048576) END || ' scanned (' ||
       CASE WHEN b / 1099511627776 * 6.25 >= 0.0001 THEN format('~${:,.4f}', b / 1099511627776 * 6.25) ELSE '< $0.0001' END || ')'
       AS cost FROM b""")
def _(t):
    b = (F.col("n_chars") * F.col("n_chars") * 3001).cast("double")
    return t.documents.select("doc_id", numbers.cost_text(b).alias("cost"))


_CUES_SQL = ", ".join(f"CAST(regexp_matches(text, '(?i){rx}') AS DOUBLE) AS {name}" for name, rx in fixed.DIFFICULTY_CUES.items())


@query("fn_16_question_features", f"""
SELECT item_id, round(ln(1 + len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x : x <> ''))), 6) AS log_len,
       {_CUES_SQL} FROM benchmark""")
def _(t):
    f = features.wording(F.col("text"))
    return t.benchmark.select("item_id", *[(ratio(c) if n == "log_len" else c).alias(n) for n, c in f.items()])


@query("fn_17_stable_ids", """
SELECT c_custkey, substr(sha256(c_name || '|' || c_mktsegment), 1, 16) AS visitor, md5(c_name) AS name_md5 FROM customer""")
def _(t):
    key = F.substring(F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256), 1, 16)
    return t.customer.select("c_custkey", key.alias("visitor"), F.md5("c_name").alias("name_md5"))
