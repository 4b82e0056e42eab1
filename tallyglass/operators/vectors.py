"""Vector search over a written index: vectors in lists around centroids, as many lists probed as a stated recall asks for."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.retrieval import top_ranks, vector_topk
from tallyglass.session import checkpoint_root

#: Vectors that centroids are fitted on and queries that the number of probes is fitted on, at most.
SAMPLE = 50_000
TRIALS = 256
#: Lists at most; below that, the square root of the number of vectors.
LISTS = 4096
#: Angles that a task holds at once.
ANGLES = 1 << 18
#: Vectors of an index that may be sent to every task; no more than centroids are.
SENT = LISTS
#: Vectors of a list that one task scores.
CHUNK = 20_000


@dataclass(frozen=True)
class VectorIndex:
    """Every vector stands in one list; `probes` lists are read for a query."""

    rows: DataFrame  # id, vec, by, list, away (angle to the centroid), size (length)
    centroids: np.ndarray
    probes: int
    radius: np.ndarray  # widest angle of each list
    largest: np.ndarray  # longest vector of each list


def _direction(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _sampled(df: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """Rows whose hashed id falls into the share that `most` is of n: about `most` rows, the same in every run."""
    return df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, -(-n // most)))) == 0)


def fit(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Directions of the lists, by k-means on the directions of a bounded sample."""
    x = _direction(x)
    c = x[np.unique(np.linspace(0, len(x) - 1, lists).astype(int))] if len(x) else np.zeros((1, 1))
    for _ in range(rounds if len(x) else 0):
        at = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where((total != 0).any(axis=1, keepdims=True), _direction(total), c)
    return c


def _plain(vecs: DataFrame, by: str | None) -> DataFrame:
    group = (F.col(by).cast("string") if by else F.lit("")).alias("by")
    return vecs.where("id IS NOT NULL AND vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec"), group)


def _nearest(vecs: DataFrame, centroids: np.ndarray, probes: int, near=None) -> DataFrame:
    """id, vec, by, list, place, away, size: the `probes` nearest lists of every vector, from place 0.

    `near`, a function of the lengths and the angles to all lists, tells instead which lists are wanted.
    """
    shared = vecs.sparkSession.sparkContext.broadcast(centroids)  # LISTS rows at most

    # A block's angles to all lists stay within a few MB, however many lists there are.
    step = max(1, ANGLES // len(centroids))

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), step):
                p = batch.iloc[i : i + step]
                x = np.stack(p["vec"].to_numpy())
                size = np.sqrt((x * x).sum(axis=1))
                away = np.arccos(np.clip(_direction(x) @ shared.value.T, -1, 1))
                order = np.argsort(away, axis=1, kind="stable")
                place = np.broadcast_to(np.arange(order.shape[1], dtype=np.int32), order.shape)
                wanted = place < probes if near is None else np.take_along_axis(near(size, away), order, axis=1)
                row = np.repeat(np.arange(len(p)), wanted.sum(axis=1))
                out = p.iloc[row].copy()
                out["list"], out["place"] = order[wanted].astype(np.int32), place[wanted]
                out["away"], out["size"] = np.take_along_axis(away, order, axis=1)[wanted], size[row]
                yield out

    return vecs.select("id", "vec", "by").mapInPandas(run, f"id {vecs.schema['id'].dataType.simpleString()}, vec array<double>, by string, list int, place int, away double, size double")


def build(corpus: DataFrame, by: str | None = None, lists: int | None = None, recall: float = 0.95, k: int = 10,
          sample: int = SAMPLE, path: str | None = None) -> VectorIndex:
    """Writes (id, vec) into lists, all rows of it; rows without id or vector are left out.

    Centroids are fitted on at most `sample` vectors. The number of probes is the least with which `recall` of the true
    k nearest of at most TRIALS hashed vectors are found, true ones being taken from an exact search over all rows.
    """
    spark = corpus.sparkSession
    plain = _plain(corpus, by)
    n = plain.count()
    lists = lists or max(1, min(LISTS, round(n**0.5)))
    some = _sampled(plain, n, sample, 1).select("id", "vec").toPandas().sort_values("id")
    centroids = fit(np.stack(some["vec"].to_numpy()) if len(some) else np.zeros((0, 1)), lists)
    path = path or f"{checkpoint_root(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    placed = _nearest(plain, centroids, 1).drop("place")
    placed.repartition(F.col("list"), F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // (CHUNK * len(centroids))))))).write.mode("overwrite").partitionBy("list").parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    radius, largest = np.zeros(len(centroids)), np.zeros(len(centroids))
    for r in rows.groupBy("list").agg(F.max("away").alias("r"), F.max("size").alias("m")).collect():  # LISTS rows at most
        radius[r["list"]], largest[r["list"]] = r["r"], r["m"]
    index = VectorIndex(rows, centroids, len(centroids), radius, largest)
    return replace(index, probes=probes_for(index, recall, k, n))


def probes_for(index: VectorIndex, recall: float, k: int, n: int) -> int:
    """The least number of lists that hold `recall` of the true neighbours, other than itself, of a bounded sample of vectors."""
    trial = _sampled(index.rows.select("id", "vec", "by"), n, TRIALS, 2)
    true = vector_topk(trial, index.rows.select("id", "vec", "by"), k + 1, by="by", sizes=(max(1, trial.count()), n)).where("query <> doc")
    where = _nearest(trial, index.centroids, len(index.centroids)).select(F.col("id").alias("query"), "list", "place")
    lists = index.rows.select(F.col("id").alias("doc"), "list")
    found = true.join(lists, "doc").join(where, ["query", "list"]).groupBy("place").agg(F.count("*").alias("n")).toPandas().sort_values("place")  # LISTS rows at most
    if not len(found):
        return len(index.centroids)
    share = found["n"].cumsum() / found["n"].sum()
    return int(found["place"].to_numpy()[np.searchsorted(share.to_numpy(), recall - 1e-12)]) + 1


def search(index: VectorIndex, queries: DataFrame, k: int, floor: float | None = None, by: str | None = None, probes: int | None = None) -> DataFrame:
    """query, doc, score, rank: of the vectors in the probed lists the k largest dot products, scored exactly.

    With a `floor` above zero nothing is missed: a product of at least the floor bounds the angle between query and
    vector, so by the triangle inequality a list is probed wherever its centroid lies within that and its radius.
    Each list is cut into chunks of bounded size; a query goes to the chunks of its lists only, and leaves each of them
    with k rows at most. With `by`, both sides must agree in it (as the index was built).
    """
    probes = probes or index.probes
    kinds = f"query {queries.schema['id'].dataType.simpleString()}, doc {index.rows.schema['id'].dataType.simpleString()}, score double"
    sizes = index.rows.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_c"))  # LISTS rows at most
    radius, largest, near = index.radius, index.largest, None
    if floor is not None and floor > 0:
        def near(size, away):
            cosine = floor / np.maximum(size[:, None] * largest[None], 1e-300)
            return (cosine <= 1 + 1e-9) & (away <= np.arccos(np.minimum(cosine, 1)) + radius[None] + 1e-6)

    asked = _plain(queries, by)
    if index.rows.limit(SENT + 1).count() <= SENT:
        return top_ranks(_search_sent(index, asked, k, floor, probes, near, kinds), k)
    q = _nearest(asked, index.centroids, probes, near).join(sizes, "list")
    q = q.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), "by", "list", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("chunk"))
    c = index.rows.select("id", "vec", "by", "list").join(sizes, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), "_c").cast("int")).select("id", "vec", "by", "list", "chunk")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "doc": [], "score": []})]
        if len(left) and len(right):
            right = right.sort_values("id", kind="stable")
            docs, y = right["id"].to_numpy(), np.stack(right["vec"].to_numpy())
            for i in range(0, len(left), 1024):
                x = left.iloc[i : i + 1024]
                m = np.round(np.stack(x["qvec"].to_numpy()) @ y.T, 9)
                out.append(_first(m, x["qid"].to_numpy(), docs, k, floor))
        return pd.concat(out, ignore_index=True) if len(out) == 1 else pd.concat(out[1:], ignore_index=True)

    pairs = q.groupBy("list", "chunk", "by").cogroup(c.groupBy("list", "chunk", "by")).applyInPandas(best, kinds)
    return top_ranks(pairs, k)


def _first(m: np.ndarray, asked: np.ndarray, docs: np.ndarray, k: int, floor: float | None) -> pd.DataFrame:
    """query, doc, score of the k largest of each row, ties by the order of docs; nothing below the floor, no score of -inf."""
    low = -np.inf if floor is None else floor
    if k == 1:
        at = m.argmax(axis=1)[:, None]
    else:
        at = np.argsort(-m, axis=1, kind="stable")[:, :k]
    score = np.take_along_axis(m, at, axis=1)
    row, place = np.nonzero((score >= low) & (score > -np.inf))
    return pd.DataFrame({"query": asked[row], "doc": docs[at[row, place]], "score": score[row, place]})


def _search_sent(index: VectorIndex, asked: DataFrame, k: int, floor: float | None, probes: int, near, kinds: str) -> DataFrame:
    """The search over an index of at most SENT vectors: every task gets it, so no query is shuffled.

    As in a larger index, a query meets the vectors of its lists only.
    """
    held = index.rows.select("id", "vec", "by", "list").toPandas().sort_values("id", kind="stable")  # SENT rows at most
    group = held["by"].to_numpy()
    parts = {}
    for g in pd.unique(group[pd.notna(group)]):
        of = held[group == g]
        parts[g] = (of["id"].to_numpy(), np.stack(of["vec"].to_numpy()), of["list"].to_numpy())
    shared = asked.sparkSession.sparkContext.broadcast((index.centroids, parts))
    step = max(1, ANGLES // max(1, len(held), len(index.centroids)))

    def run(batches):
        centroids, parts = shared.value
        for batch in batches:
            for g, of in batch.groupby("by"):
                if g not in parts:
                    continue
                docs, y, lists = parts[g]
                for i in range(0, len(of), step):
                    p = of.iloc[i : i + step]
                    x = np.stack(p["vec"].to_numpy())
                    away = np.arccos(np.clip(_direction(x) @ centroids.T, -1, 1))
                    if near is None:
                        wanted = np.zeros(away.shape, bool)
                        np.put_along_axis(wanted, np.argsort(away, axis=1, kind="stable")[:, :probes], True, axis=1)
                    else:
                        wanted = near(np.sqrt((x * x).sum(axis=1)), away)
                    m = np.where(wanted[:, lists], np.round(x @ y.T, 9), -np.inf)
                    yield _first(m, p["id"].to_numpy(), docs, k, floor)

    return asked.select("id", "vec", "by").mapInPandas(run, kinds)


def recall_report(index: VectorIndex, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """One row: queries, lists, probes, and the share of the exact k best that the index finds."""
    both = lambda d: _plain(d, by)
    n = index.rows.count()
    true = vector_topk(both(queries), index.rows.select("id", "vec", "by"), k, by="by", sizes=(max(1, queries.count()), n)).select("query", "doc")
    hit = search(index, queries, k, by=by).select("query", "doc", F.lit(1).alias("_hit"))
    return true.join(hit, ["query", "doc"], "left").agg(
        F.count_distinct("query").alias("n_queries"), F.count("*").alias("n_true"), (F.count("_hit") / F.count("*")).alias("recall")).select(
        "n_queries", "n_true", F.lit(len(index.centroids)).alias("lists"), F.lit(index.probes).alias("probes"), "recall")
