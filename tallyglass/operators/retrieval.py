"""Text search: BM25, hashed vectors, vector top-k, rank fusion, catalog search."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass import fixed
from tallyglass.functions import text as tx
from tallyglass.operators import lexical

DIM = 512


def top_ranks(scores: DataFrame, k: int) -> DataFrame:
    """query, doc, rank (from 0) of the k best, ties by doc.

    Copies of a document have equal scores up to the order of a float sum, so
    scores that agree to nine places are ties.
    """
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), F.col("doc"))
    return scores.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def pad_unmatched(scores: DataFrame, queries: DataFrame, qkey: str, docs: DataFrame, dkey: str, k: int, db: str | None = None) -> DataFrame:
    """Add zero scores so that every query has k documents, where there are so many outside its own database.

    A query with m matches lacks k - m, and at most m of the k lowest ids are
    matched: the k lowest ids of other databases always suffice.
    """
    own = lambda: F.col(db).cast("string") if db else F.lit(None).cast("string")
    d = docs.select(F.col(dkey).alias("doc"), own().alias("_db")).where("doc IS NOT NULL")
    low = lambda of: F.row_number().over(Window.partitionBy(of).orderBy("doc"))
    # k rows of each database, and of these k for each database that asks
    first = d.withColumn("_r", low("_db")).where(F.col("_r") <= k).drop("_r")
    q = queries.select(F.col(qkey).alias("query"), own().alias("_own"))
    askers = q.select("_own").distinct()
    pairs = askers.crossJoin(first)
    if db:
        pairs = pairs.where(~F.col("_db").eqNullSafe(F.col("_own")))
    lists = pairs.withColumn("_r", low("_own")).where(F.col("_r") <= k).groupBy(F.col("_own").alias("_o")).agg(F.collect_list("doc").alias("_ids"))
    zero = q.join(lists, F.col("_own").eqNullSafe(F.col("_o"))).select("query", F.explode("_ids").alias("doc"), F.lit(0.0).alias("score"))
    return scores.select("query", "doc", "score").unionByName(zero).groupBy("query", "doc").agg(F.max("score").alias("score"))


#: Texts whose features a task holds at once, and features whose place a worker remembers.
TEXTS, KNOWN = 1000, 1_000_000


def _place(feature: str, dim: int) -> tuple[int, float]:
    """Slot and sign of a feature: the low bits are in the first bytes, the top bit in the eighth."""
    h = hashlib.md5(feature.encode()).digest()
    return (h[0] + 256 * h[1]) % dim, 1.0 if h[7] >= 128 else -1.0


def _grams(text: str | None) -> np.ndarray:
    """The distinct trigrams of a padded text (none of a null), each as one number of three code points."""
    x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:])


def _rows_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are not zero throughout, and their offsets, slots and sums."""
    row, slot = np.nonzero(w)
    n = np.bincount(row, minlength=len(w))
    return n > 0, np.concatenate([[0], np.cumsum(n[n > 0])]).astype(np.int32), slot.astype(np.int32), w[row, slot]


def _listed(start, values, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(values, kind))


def _hashed_sums(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """id, _s: lists of (dims, sums) of its texts, added up per batch first, so that an id of many rows keeps few lists."""
    d = df.select(F.col(key).alias("id"), tx.tokens(F.col(text)).alias("w"), tx.padded(F.col(text)).alias("c"))
    known = {}

    def sums(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                b = batch.slice(i, TEXTS)
                ids = b.column("id").dictionary_encode(null_encoding="encode")
                code, total = ids.indices.to_numpy(zero_copy_only=False), np.zeros(len(ids.dictionary) * dim)
                words = b.column("w").flatten().dictionary_encode()
                counts = b.column("w").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                grams = [_grams(x) for x in b.column("c").to_pylist()]
                some, which = np.unique(np.concatenate(grams), return_inverse=True)
                letters = np.stack([some >> 42, some >> 21, some], axis=1) & 0x1FFFFF
                names = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                for names, owner, which in (([f"w:{x}" for x in words.dictionary.to_pylist()], np.repeat(code, counts), words.indices.to_numpy(zero_copy_only=False)),
                                            ([f"c:{names[j:j + 3]}" for j in range(0, len(names), 3)], np.repeat(code, [len(x) for x in grams]), which)):
                    if len(known) > KNOWN:
                        known.clear()
                    known.update((x, _place(x, dim)) for x in names if x not in known)
                    at = np.array([known[x] for x in names], float).reshape(-1, 2)
                    total += np.bincount(owner * dim + at[which, 0].astype(np.int64), at[which, 1], len(total))
                some, start, slot, w = _rows_of(total.reshape(-1, dim))
                yield pa.RecordBatch.from_arrays([ids.dictionary.filter(pa.array(some)), _listed(start, slot, pa.int32()), _listed(start, w, pa.float64())], ["id", "dims", "sums"])

    kind = d.schema["id"].dataType.simpleString()
    s = d.mapInArrow(sums, f"id {kind}, dims array<int>, sums array<double>")
    return s.groupBy("id").agg(F.collect_list(F.struct("dims", "sums")).alias("_s"))


def _unit(sums: DataFrame, dim: int, dense: bool) -> DataFrame:
    """The columns of `sums`, with _s replaced by dims and weights of unit length, or by vec of `dim` entries; none if all are zero."""
    others = [c for c in sums.columns if c != "_s"]
    flat = sums.select(*others, F.flatten(F.col("_s.dims")).alias("dims"), F.flatten(F.col("_s.sums")).alias("sums"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                b = batch.slice(i, TEXTS)
                row = np.repeat(np.arange(b.num_rows), b.column("dims").value_lengths().to_numpy(zero_copy_only=False))
                slot, s = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("dims", "sums"))
                w = np.bincount(row * dim + slot, s, b.num_rows * dim).reshape(-1, dim)
                norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
                w = np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)
                if dense:
                    some = norm[:, 0] > 0
                    out = [_listed(np.arange(some.sum() + 1) * dim, w[some].reshape(-1), pa.float64())]
                else:
                    some, start, slot, w = _rows_of(w)
                    out = [_listed(start, slot, pa.int32()), _listed(start, w, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(b.column(c).filter(pa.array(some)) for c in others), *out], [*others, *(["vec"] if dense else ["dims", "weights"])])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields if f.name in others)
    return flat.mapInArrow(run, shape + (", vec array<double>" if dense else ", dims array<int>, weights array<double>"))


def hashed_weights(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """id, dim, weight: signed hashed words (each time) and trigrams (once), unit length.

    Features are hashed where the texts lie, each distinct one once; a list of sums per text is all that is shuffled.
    """
    u = _unit(_hashed_sums(df, key, text, dim), dim, dense=False)
    return u.select("id", F.explode(F.arrays_zip("dims", "weights")).alias("_w")).select("id", F.col("_w.dims").alias("dim"), F.col("_w.weights").alias("weight"))


def embed(df: DataFrame, key: str, text: str, beside: Column | None = None) -> DataFrame:
    """id, vec: the weights of an id as one array of DIM entries. `beside`, a named column of df, is joined on before vectors are made."""
    s = _hashed_sums(df, key, text, DIM)
    if beside is not None:
        s = s.join(df.select(F.col(key).alias("id"), beside), "id")
    return _unit(s, DIM, dense=True)


QUERY_BLOCK = 2048
QUERY_STEP = 64
CORPUS_BLOCK = 20_000


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, floor: float | None = None, by: str | None = None,
                sizes: tuple[int, int] | None = None, apart: str | None = None) -> DataFrame:
    """query, doc, score, rank: the k largest dot products per query, exact: every pair of blocks is multiplied.

    The choice for small corpora and for measuring; `vectors.search` reads an index instead.
    Both sides are (id, vec), optionally with a column `by` that must agree, or `apart` that must not.
    Ids are hashed into blocks of bounded size; each pair of blocks is one matrix
    product that keeps k rows per query, and the survivors meet in one window.
    No task holds more than one block of each side, however skewed the data.
    `sizes` are the row counts of both sides where the caller has them cheaply.
    """
    nq, nc = sizes or (queries.count(), corpus.count())
    a, b = max(1, -(-nq // QUERY_BLOCK)), max(1, -(-nc // CORPUS_BLOCK))
    group = F.col(by).cast("string") if by else F.lit("")
    other = F.coalesce(F.concat(F.lit("="), F.col(apart).cast("string")), F.lit("")) if apart else F.lit("")
    q = queries.select(F.col("id").alias("qid"), F.col("vec").cast("array<double>").alias("qvec"), group.alias("grp"),
                       other.alias("own"), F.pmod(F.xxhash64("id"), F.lit(a)).cast("int").alias("qb"),
                       F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("cb"))
    c = corpus.select(F.col("id").alias("doc"), F.col("vec").cast("array<double>").alias("vec"), group.alias("grp"),
                      other.alias("own"), F.pmod(F.xxhash64("id"), F.lit(b)).cast("int").alias("cb"),
                      F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("qb"))
    schema = T.StructType([T.StructField("query", queries.schema["id"].dataType), T.StructField("doc", corpus.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "doc": [], "score": []}).astype({"score": "float64"})
        right = right.sort_values("doc", kind="stable")
        docs, owner, out, y = right["doc"].to_numpy(), right["own"].to_numpy(), [], np.stack(right["vec"].to_numpy())
        for i, (qid, own) in enumerate(zip(left["qid"].to_numpy(), left["own"].to_numpy())):
            if i % QUERY_STEP == 0:  # a few MB of products at a time
                m = np.stack(left["qvec"].iloc[i : i + QUERY_STEP].to_numpy()) @ y.T
            row = np.round(m[i % QUERY_STEP], 9)
            if apart:
                row[owner == own] = -np.inf
            if floor is not None:
                keep = np.flatnonzero(row >= floor)
            elif len(row) > k:
                # Everything that ties with the k-th stays; the window settles it.
                keep = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
            else:
                keep = np.arange(len(row))
            keep = keep[row[keep] > -np.inf]
            keep = keep[np.argsort(-row[keep], kind="stable")][:k]
            out.append(pd.DataFrame({"query": qid, "doc": docs[keep], "score": row[keep]}))
        return pd.concat(out, ignore_index=True)

    pairs = q.groupBy("grp", "qb", "cb").cogroup(c.groupBy("grp", "qb", "cb")).applyInPandas(best, schema)
    return top_ranks(pairs, k)


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """query, doc, score = sum of 1/(k + rank + 1) over (query, doc, rank) lists."""
    every = rankings[0].select("query", "doc", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query", "doc", "rank"))
    return every.groupBy("query", "doc").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def hybrid(docs: DataFrame, dkey: str, dtext: str, queries: DataFrame, qkey: str, qtext: str, depth: int, db: str | None = None,
           index: lexical.Index | None = None) -> DataFrame:
    """query, doc, score: BM25 and hashed-vector rankings of `depth`, fused.

    A document counts in a list only within its first `depth` ranks, so the fused order is that of the whole lists for
    documents inside both. Documents of the query's own `db` enter neither list.
    """
    index = index or lexical.build(docs, dkey, dtext, db)
    scores = lexical.top_k(index, queries, qkey, qtext, depth, db)
    words = top_ranks(pad_unmatched(scores, queries, qkey, docs, dkey, depth, db), depth)
    vec = lambda d, key, text: embed(d, key, text, (F.col(db) if db else F.lit("")).alias("db"))
    # Every text has a trigram, so the counts of the inputs are those of the vectors.
    near = vector_topk(vec(queries, qkey, qtext), vec(docs, dkey, dtext), depth, sizes=(queries.count(), docs.count()), apart="db" if db else None)
    return rrf([words, near])


def search(docs: DataFrame, dkey: str, dtext: str, queries: DataFrame, qkey: str, qtext: str, k: int, depth: int, db: str | None = None,
           index: lexical.Index | None = None) -> DataFrame:
    """The k best documents per query, never from the query's own database."""
    fused = hybrid(docs, dkey, dtext, queries, qkey, qtext, depth, db, index)
    return top_ranks(fused, k).select("query", "doc", "rank", "score")


def evaluation_leaks(items: DataFrame, key: str) -> DataFrame:
    """Items whose id belongs to an evaluation set: they must not enter the memory."""
    hit = F.lit(False)
    for p in fixed.EVALUATION_ID_PREFIXES:
        hit = hit | F.col(key).startswith(p)
    return items.where(hit)


def guard_memory(items: DataFrame, key: str) -> DataFrame:
    """The items, or an error in the job if one of them is an evaluation item."""
    hit = F.lit(False)
    for p in fixed.EVALUATION_ID_PREFIXES:
        hit = hit | F.col(key).startswith(p)
    fail = F.raise_error(F.concat(F.lit("refusing to add evaluation example "), F.col(key)))
    return items.withColumn(key, F.when(hit, fail).otherwise(F.col(key)))


def nearest_cached(questions: DataFrame, cached: DataFrame, threshold: float = 0.95, exact: bool = False) -> DataFrame:
    """questions (id, text, version) against cached (id, text, version, cost_usd): best hit of the same version.

    The cache is searched through a vector index, which misses nothing at or above the threshold; `exact` compares with
    every cached question of the version.
    """
    from tallyglass.operators import vectors
    vec = lambda d: embed(d, "id", "text", F.col("version"))
    if exact:
        best = vector_topk(vec(questions), vec(cached), 1, floor=threshold, by="version", sizes=(questions.count(), cached.count()))
    else:
        best = vectors.search(vectors.build(vec(cached), by="version"), vec(questions), 1, floor=threshold, by="version")
    hit = best.select(F.col("query").alias("id"), F.col("doc").alias("cached_id"), F.col("score").alias("similarity"))
    cost = cached.select(F.col("id").alias("cached_id"), "cost_usd")
    return questions.select("id", "version").join(hit, "id", "left").join(cost, "cached_id", "left").select(
        "id", "version", "cached_id", "similarity", F.coalesce("cost_usd", F.lit(0.0)).alias("usd_saved"))


def cache_report(hits: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.col("cached_id").isNotNull()
    return hits.groupBy(*keys).agg(F.count_if(ok).alias("hits"), F.count_if(~ok).alias("misses"),
                                   F.try_divide(F.count_if(ok), F.count("*")).alias("hit_rate"), F.round(F.sum("usd_saved"), 6).alias("usd_saved"))


# ---- catalogs ----

def column_documents(catalog: DataFrame) -> DataFrame:
    """table, column, key, text: the searchable text of each column."""
    samples = F.when(F.col("type") == "string", F.array_join(F.slice(F.coalesce("samples", F.array().cast("array<string>")), 1, 3), " ")).otherwise("")
    desc = F.coalesce(F.col("description"), F.lit("")) if "description" in catalog.columns else F.lit("")
    key = F.concat_ws(".", "table", "column")
    return catalog.select("table", "column", key.alias("key"), tx.strip(F.concat_ws(" ", "table", "column", desc, samples)).alias("text"))


def rank_columns(catalog: DataFrame, questions: DataFrame, qkey: str, qtext: str, n_columns: int) -> DataFrame:
    """query, doc (table.column), rank over all columns of one catalog.

    `n_columns` is the catalog's size; every column is ranked for each question.
    """
    docs = column_documents(catalog)
    return top_ranks(hybrid(docs, "key", "text", questions, qkey, qtext, depth=n_columns), n_columns)


def bridges(kept: DataFrame, fks: DataFrame) -> DataFrame:
    """Tables with references into two kept tables that are not linked themselves.

    kept: query, table. fks: table, column, ref_table, ref_column.
    """
    edge = fks.select("table", "ref_table").distinct()
    target = edge.join(kept.select("query", F.col("table").alias("ref_table")), "ref_table")
    target = target.join(kept, ["query", "table"], "left_anti")
    a = target.select("query", "table", F.col("ref_table").alias("a"))
    b = target.select("query", "table", F.col("ref_table").alias("b"))
    pair = a.join(b, ["query", "table"]).where("a < b")
    linked = edge.select(F.least("table", "ref_table").alias("a"), F.greatest("table", "ref_table").alias("b")).distinct()
    return pair.join(linked, ["a", "b"], "left_anti").select("query", "table").distinct()


def prune(selected: DataFrame, catalog: DataFrame, fks: DataFrame) -> DataFrame:
    """query, table, column kept: the selection, bridge tables, and all join columns.

    selected: query, table, column. catalog: table, column, is_key.
    """
    kept = selected.select("query", "table").distinct()
    tables = kept.unionByName(bridges(kept, fks)).distinct()
    keys = catalog.where("is_key").select("table", "column").join(tables, "table").select("query", "table", "column")
    refs = fks.join(tables, "table").join(tables.select("query", F.col("table").alias("ref_table")), ["query", "ref_table"])
    out = selected.select("query", "table", "column").unionByName(keys)
    out = out.unionByName(refs.select("query", "table", "column"))
    out = out.unionByName(refs.where("ref_column <> ''").select("query", F.col("ref_table").alias("table"), F.col("ref_column").alias("column")))
    return out.join(catalog.select("table", "column"), ["table", "column"], "left_semi").select("query", "table", "column").distinct()


def recall(gold: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: column recall, strict recall, table recall. Queries without gold columns are skipped.

    gold: query, table, column. kept: keys, query, table, column.
    """
    levels = kept.select(*keys).distinct() if keys else None
    g = gold.crossJoin(levels) if keys else gold
    j = g.join(kept.withColumn("_hit", F.lit(1)), [*keys, "query", "table", "column"], "left")
    kt = kept.select(*keys, "query", "table").distinct().withColumn("_thit", F.lit(1))
    t = g.select(*keys, "query", "table").distinct().join(kt, [*keys, "query", "table"], "left")
    cols = j.groupBy(*keys, "query").agg((F.count("_hit") / F.count("*")).alias("col_recall"))
    tabs = t.groupBy(*keys, "query").agg((F.count("_thit") / F.count("*")).alias("table_recall"))
    per = cols.join(tabs, [*keys, "query"])
    return per.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("col_recall").alias("column_recall"),
                                  F.avg((F.col("col_recall") == 1).cast("double")).alias("strict_recall"),
                                  F.avg("table_recall").alias("table_recall"))
