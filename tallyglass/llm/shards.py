"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import fanout, keep, row_id, row_key, rows_of, running, source_key, table, unit

NAME = "op6_shards"
N_SHARDS = 16
SEED = 11


def assign(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """One narrow row per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard, source_rank.

    Rows are shuffled by a seeded hash within each source; the row of rank r of n gets the fractional rank
    (2r + 1) / 2n; rows are sorted by it and the sequence is cut into runs whose lengths differ by one row at most.
    So each shard holds each source in proportion. Law `rows`.

    Ranks are exact and never need one task per source: slices of the hash (then of the fractional rank) are counted
    first, and a window orders only the rows of one slice.

    Null texts have size 1 and the checksum of the empty text; null sources are one source, after the others; a null
    doc_id is hashed as its text; repeated rows each get a slot of their own, and three of them stand a third of the
    sequence apart; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return _placed(docs, n_shards, seed).drop("_key")


def _placed(docs: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """The rows of `assign` with `_key`, which rows of one doc_id and text share."""
    spark = docs.sparkSession
    slices = fanout(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    h, u = unit(seed, row_id())
    rows = docs.select(
        "doc_id", row_key().alias("_key"), source_key().alias("_src"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), h.alias("_h"), u.alias("_u"), F.lit(1).cast("long").alias("_one"),
    )
    # further copies of a row (some epochs of it, as a rule) begin a third of the sequence on, and two thirds
    copy = F.row_number().over(Window.partitionBy("_key").orderBy("_src")) - 1
    on = F.col("_u") + copy / 3 + F.floor(copy / 3) * 0.1
    rows = rows.withColumn("_k", F.floor((on - F.floor(on)) * slices)).drop("_u")
    rows = keep(rows, "sizes")
    counts = rows.groupBy("_src").agg(F.count("*").alias("_n"))
    ranked = running(rows, ["_src"], "_k", ["_h", "doc_id", "text_crc32"], "_one", "_r").join(counts, "_src")
    frac = (2 * F.col("_r") + 1) / (2 * F.col("_n"))
    ranked = ranked.withColumn("_f", frac).withColumn("_k", F.floor(F.col("_f") * slices)).withColumn("_all", F.lit(0))
    placed = running(ranked, ["_all"], "_k", ["_f", "_src", "_h", "doc_id", "text_crc32"], "_one", "_g")
    total = rows.agg(F.count("*").alias("_total"))
    first = f"((shard * _total + {n_shards - 1}) div {n_shards})"  # where the run of a shard begins
    return (
        placed.crossJoin(total)  # one row
        .withColumn("shard", F.expr(f"_g * {n_shards} div _total").cast("int"))
        .withColumn("slot", F.expr(f"_g - {first}"))
        .select(
            "doc_id", "_key", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
            F.lit(None).cast("int").alias("grown_shard"), F.col("_r").alias("source_rank"),
        )
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """The documents with their shard and slot. Whole texts are shuffled once, by doc_id and text.

    Null, empty and repeated values are treated as in `assign`; rows of one doc_id and text take the slots of such rows in
    any order, rows that share a doc_id only take each their own. `shard` and `slot` replace columns of those names.
    """
    places = _placed(docs, n_shards, seed).select("_key", F.struct("shard", "slot").alias("_p"))
    places = places.groupBy("_key").agg(F.sort_array(F.collect_list("_p")).alias("_ps"))  # copies of one row
    own = rows_of(docs.drop("shard", "slot")).withColumn("_own", F.xxhash64("_row.doc_id", "_row.text"))
    numbered = own.withColumn("_i", F.row_number().over(Window.partitionBy("_own").orderBy(F.xxhash64("_row"))))
    joined = numbered.join(places, F.col("_own") == F.col("_key"))
    place = F.element_at("_ps", F.col("_i"))
    return joined.select("_row.*", place["shard"].alias("shard"), place["slot"].alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


# DuckDB has no crc32, so it is folded over the bytes with the usual table of the reflected polynomial 0xEDB88320.
SQL = f"""
WITH step AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || list_transform(range(8), lambda x: x::BIGINT),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
base AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
           strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS hx,
           md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'n' || md5(coalesce(text, '')))) AS h FROM documents),
sums AS (
    SELECT b.* EXCLUDE (hx), xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, 2 * (size - 1), 2), lambda p:
               (instr('0123456789ABCDEF', hx[p]) - 1) * 16 + instr('0123456789ABCDEF', hx[p + 1]) - 1),
               lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) AS crc
    FROM base b, step),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id, crc) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM sums),
placed AS (
    SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, src, h, doc_id, crc) - 1 AS g, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (g * {N_SHARDS} // total)::INT AS shard,
       (g - ((g * {N_SHARDS} // total) * total + {N_SHARDS - 1}) // {N_SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, r::BIGINT AS source_rank
FROM placed
"""
