"""BM25 search over a written index: documents in shards, postings in blocks that carry the most a block can score."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions import text as tx
from tallyglass.session import checkpoint_root

K1, B = 1.5, 0.75
SHARD_DOCS = 1024
BLOCK = 64
QUERY_BLOCK = 512
#: Sums of floats in another order differ by less.
ROOM = 1e-7


@dataclass(frozen=True)
class Index:
    """Row kinds of `rows`: a shard's documents (token null: ids, groups, lengths in `docs`) and a token's block in a shard."""

    rows: DataFrame  # shard, token, lo, hi, n, most_tf, least_dl, docs, tfs, ids, groups, total
    n_docs: int
    shards: int

    @property
    def shape(self) -> DataFrame:
        """One row: n_docs, avgdl. Documents without a token count in both."""
        s = self.rows.where("token IS NULL").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("_t"))
        return s.select(F.lit(self.n_docs).cast("long").alias("n_docs"), (F.col("_t") / max(1, self.n_docs)).alias("avgdl"))

    @property
    def terms(self) -> DataFrame:
        """token, df, idf, avgdl."""
        df = self.rows.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return df.crossJoin(F.broadcast(self.shape)).select("token", "df", idf.alias("idf"), "avgdl")  # one row


def token_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, token per occurrence; stems and stop words are plain expressions after the explode."""
    w = df.select(*keys, F.explode(tx.raw_words(F.col(text))).alias("_w")).select(*keys, F.lower("_w").alias("_w"))
    w = w.select(*keys, tx.stem(F.col("_w")).alias("token"))
    return w.where(~tx.is_stopword(F.col("token")))


def pack(rows: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one shard from its (doc, grp, token, tf) rows, in order of document, and the row of its documents."""
    ids, at = np.unique(rows["doc"].to_numpy(), return_inverse=True)
    tf = rows["tf"].to_numpy(np.int64)
    dl = np.bincount(at, tf, len(ids)).astype("<i4")
    groups = np.full(len(ids), None, object)
    groups[at] = rows["grp"].astype(object).where(rows["grp"].notna(), None).to_numpy()
    code, names = pd.factorize(rows["token"])
    order = np.lexsort((at, code))
    code, at, tf = code[order], at[order].astype("<i4"), tf[order].astype("<i4")
    first = np.concatenate([[True], code[1:] != code[:-1]])
    place = np.arange(len(code)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    start = np.flatnonzero(place % BLOCK == 0)
    end = np.append(start[1:], len(code))
    blocks = pd.DataFrame({
        "token": names.astype(object)[code[start]], "lo": at[start], "hi": at[end - 1], "n": end - start,
        "most_tf": np.maximum.reduceat(tf, start), "least_dl": np.minimum.reduceat(dl[at], start),
        "docs": [at[a:b].tobytes() for a, b in zip(start, end)], "tfs": [tf[a:b].tobytes() for a, b in zip(start, end)]})
    head = pd.DataFrame({"token": [None], "lo": [0], "hi": [len(ids) - 1], "n": [len(ids)], "docs": [dl.tobytes()], "ids": [list(ids)],
                         "groups": [list(groups)], "total": [int(dl.sum())], "most_tf": [0], "least_dl": [0]})
    return pd.concat([head, blocks], ignore_index=True)


def build(docs: DataFrame, key: str, text: str, group: str | None = None, shard_docs: int = SHARD_DOCS, path: str | None = None) -> Index:
    """Writes the index once, to `path` or below the shared folder. Rows without a key are left out.

    Texts are dealt to shards of about `shard_docs` documents by one shuffle; words are counted and packed where they
    lie. A document belongs to one shard, so a query's scores in it are complete there.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(key).isNotNull())
    n = docs.count()
    shards = max(1, -(-n // shard_docs))
    d = docs.select(F.col(key).alias("doc"), F.col(text).alias("_t"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int")).repartition(2 * shards, "shard")
    tf = token_rows(d, ["shard", "doc", "grp"], "_t").groupBy("shard", "doc", "grp", "token").agg(F.count("*").alias("tf"))
    kind = d.schema["doc"].dataType.simpleString()
    cols = f"token string, lo int, hi int, n long, most_tf int, least_dl int, docs binary, tfs binary, ids array<{kind}>, groups array<string>, total long"

    def shard(k, rows):
        out = pack(rows).reindex(columns=["token", "lo", "hi", "n", "most_tf", "least_dl", "docs", "tfs", "ids", "groups", "total"])
        for c in ("token", "tfs", "ids", "groups", "total"):
            out[c] = out[c].astype(object).where(out[c].notna(), None)
        out.insert(0, "shard", k[0])
        return out

    path = path or f"{checkpoint_root(spark).rstrip('/')}/lexical-{uuid.uuid4().hex}"
    tf.groupBy("shard").applyInPandas(shard, "shard int, " + cols).write.mode("overwrite").parquet(path)
    return Index(spark.read.schema("shard int, " + cols).parquet(path), n, shards)


def best_of_shard(terms: list[tuple[float, list[tuple]]], norm: np.ndarray, k: int | None, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of a shard that may be among the k best, their full scores, and how many blocks were read.

    terms: (weight, blocks) with blocks (lo, hi, bound, docs, tfs). The best block of each term gives a first sum per
    document, and the k-th of them a threshold. What all blocks together can give a document is known from their
    bounds, so documents below the threshold, and blocks that hold none but such, are passed over. Without a k all are read.
    """
    def add(acc, w, block):
        at, tf = np.frombuffer(block[3], "<i4"), np.frombuffer(block[4], "<i4").astype(np.float64)
        acc[at] += w * tf * (K1 + 1) / (tf + norm[at])

    first, most = np.zeros(len(norm)), np.zeros(len(norm))
    for w, blocks in terms:
        add(first, w, max(blocks, key=lambda b: b[2]))
        for lo, hi, bound, *_ in blocks:
            most[lo : hi + 1] += w * bound
    sure = first[allowed & (first > 0)]
    least = np.partition(sure, len(sure) - k)[len(sure) - k] if k is not None and len(sure) > k else 0.0
    alive = allowed & (most >= least - ROOM)
    score, read = np.zeros(len(norm)), 0
    for w, blocks in terms:
        for b in blocks:
            if alive[b[0] : b[1] + 1].any():
                add(score, w, b)
                read += 1
    at = np.flatnonzero(alive & (score > 0))
    return at, score[at], read


def top_k(index: Index, queries: DataFrame, key: str, text: str, k: int, own: str | None = None) -> DataFrame:
    """query, doc, score, rank (from 0) of the k best matches per query, by scores; ties to nine places are settled by doc."""
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc")
    return scores(index, queries, key, text, k, own).withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def scores(index: Index, queries: DataFrame, key: str, text: str, k: int | None = None, own: str | None = None) -> DataFrame:
    """query, doc, score of every match, or of all that can be among the k best; repeated query words count repeatedly.

    Queries go to every shard with the blocks of their words; each shard gives a row per match, or k rows per query at
    most, and nothing else is shuffled. Documents of the query's own group (`own`, as the index's group) are left out before anything is ranked.
    Scores that agree to nine places are ties, settled by doc.
    """
    spark = queries.sparkSession
    mine = (F.col(own).cast("string") if own else F.lit(None).cast("string")).alias("own")
    deal = max(1, -(-queries.count() // QUERY_BLOCK))
    q = token_rows(queries.select(F.col(key).alias("query"), F.col(text).alias("_t"), mine).where("query IS NOT NULL"), ["query", "own"], "_t")
    q = q.groupBy("query", "own", "token").agg(F.count("*").alias("qtf")).withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(deal)).cast("int"))
    asked = q.join(index.terms, "token").select("query", "own", "qb", "token", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl")
    asked = asked.groupBy("qb", "avgdl").agg(F.collect_list(F.struct("query", "own", "token", "w")).alias("terms"))  # QUERY_BLOCK queries
    left = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))))
    wanted = q.select(F.col("qb").alias("_qb"), F.col("token").alias("_asked")).distinct()
    heads = index.rows.where("token IS NULL").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    right = index.rows.where("token IS NOT NULL").join(wanted, F.col("token") == F.col("_asked")).withColumn("qb", F.col("_qb")).select(heads.columns).unionByName(heads)
    kinds = f"query {queries.schema[key].dataType.simpleString()}, doc {index.rows.schema['ids'].dataType.elementType.simpleString()}, score double"
    grouped = bool(own)

    def evaluate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "doc": [], "score": []}
        head = right[right["token"].isna()]
        if len(left) and len(head):
            head, avgdl = head.iloc[0], left["avgdl"].iloc[0]
            ids, groups = np.array(head["ids"], object), np.array(head["groups"], object)
            norm = K1 * (1 - B + B * np.frombuffer(head["docs"], "<i4") / avgdl)
            lists = {}
            for token, lo, hi, tf, dl, docs, tfs in right[right["token"].notna()][["token", "lo", "hi", "most_tf", "least_dl", "docs", "tfs"]].itertuples(index=False):
                lists.setdefault(token, []).append((lo, hi, tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)), docs, tfs))
            queries = {}
            for row in left["terms"].iloc[0]:
                if row["token"] in lists:
                    queries.setdefault((row["query"], row["own"]), []).append((row["w"], lists[row["token"]]))
            for (query, mine), terms in queries.items():
                allowed = groups != mine if grouped else np.ones(len(ids), bool)
                at, score, _ = best_of_shard(terms, norm, k, allowed)
                best = at[o := np.lexsort((at, -np.round(score, 9)))[:k]]
                out["query"] += [query] * len(best)
                out["doc"] += ids[best].tolist()
                out["score"] += score[o].tolist()
        return pd.DataFrame(out)

    return left.groupBy("shard", "qb").cogroup(right.groupBy("shard", "qb")).applyInPandas(evaluate, kinds)
