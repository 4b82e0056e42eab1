"""Benchmark decontamination by winnowing: selected k-gram fingerprints, a join, and extension of the hits."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import words as W
from tallyglass.llm.common import merged, row_key, rows_of, table

NAME = "op5_winnow"
#: Words of a window; a shorter item is one window.
WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20


def split(span: int) -> tuple[int, int]:
    """k and w with k + w - 1 = span: any shared run of `span` words shares the fingerprint picked from its w k-grams."""
    k = (span + 1) // 2
    return k, span - k + 1


def fingerprints(h: np.ndarray, first: np.ndarray, span: int):
    """Winnowing: of each run of w successive k-grams of a text the one with the smallest hash, rightmost in a tie.

    Gives (fingerprint, word it begins at) without repeats, by position. Texts of fewer than `span` words give none.
    """
    k, w = split(span)
    g, at, gf = W.grams(h, first, k)
    if len(g) < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, pos = g[: len(g) - w + 1].copy(), np.arange(len(g) - w + 1)
    for j in range(1, w):
        nxt = g[j : len(g) - w + 1 + j]
        less = nxt <= low
        low = np.where(less, nxt, low)
        pos = np.where(less, np.arange(j, len(g) - w + 1 + j), pos)
    end = np.repeat(gf[1:], np.diff(gf))[: len(pos)]  # runs must not leave the text
    pos = np.unique(pos[np.arange(len(pos)) + w <= end])
    return g[pos], at[pos]


def _hashes(text_column):
    for i, buf, offs in W.blocks(text_column):
        yield (i, *W.word_hashes(W.lower(buf), offs, W.ALNUM))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Fingerprints of the items: (fp, span, item_id, item_words as packed hashes, at)."""
    def run(batches):
        for batch in batches:
            for i, h, first in _hashes(batch.column(1)):
                out = []
                for r in range(len(first) - 1):
                    own = h[first[r] : first[r + 1]]
                    if not len(own):
                        continue
                    span = min(WINDOW, len(own))
                    fp, at = fingerprints(own, np.array([0, len(own)]), span)
                    out += [(int(f), span, i + r, own.tobytes(), int(a)) for f, a in zip(fp.astype(np.int64), at, strict=True)]
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), batch.column(0).take(pa.array(c[2])), pa.array(c[3], pa.binary()), pa.array(c[4], pa.int32())],
                        ["fp", "span", "item_id", "item_words", "item_at"],
                    )

    items = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(run, "fp long, span int, item_id string, item_words binary, item_at int")


def document_fingerprints(docs: DataFrame, spans: list[int]) -> DataFrame:
    """(row, fp, span) of all documents, without repeats within a text; `row` is the row's key."""
    def run(batches):
        for batch in batches:
            for i, h, first in _hashes(batch.column(1)):
                for span in spans:
                    fp, at = fingerprints(h, first, span)
                    if len(fp):
                        row = i + np.searchsorted(first, at, "right") - 1
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(fp.astype(np.int64)), pa.array(np.full(len(fp), span, np.int32))], ["row", "fp", "span"])

    return docs.select(row_key().alias("row"), "text").mapInArrow(run, "row long, fp long, span int")


def covered(h: np.ndarray, items: list[tuple]) -> tuple[np.ndarray, list[str]]:
    """Words of a document that lie in an occurrence of an item's window, and the items that have one.

    items: (item_id, its word hashes, {span: {fingerprint: positions}}). A fingerprint that both sides picked aligns
    them; the equal words around it on that alignment are one hit, which counts if it is as long as the span.
    """
    hit = np.zeros(len(h) + 1, np.int64)
    first = np.array([0, len(h)])
    picked: dict[int, tuple] = {}
    found = []
    for item_id, own, span, fps, ats in items:
        if span not in picked:
            fp, at = fingerprints(h, first, span)
            order = np.argsort(fp, kind="stable")
            picked[span] = fp[order], at[order]
        fp, at = picked[span]
        lo, hi = np.searchsorted(fp, fps, "left"), np.searchsorted(fp, fps, "right")
        shifts = np.unique(np.concatenate([at[a:b] - i for a, b, i in zip(lo, hi, ats, strict=True)] or [np.zeros(0, np.int64)]))
        some = False
        for shift in shifts:
            a, b = max(0, -shift), min(len(own), len(h) - shift)
            same = np.concatenate([[False], own[a:b] == h[a + shift : b + shift], [False]])
            turn = np.flatnonzero(same[1:] != same[:-1])
            for s, e in zip(turn[::2], turn[1::2], strict=True):
                if e - s >= span:
                    some = True
                    hit[a + shift + s] += 1
                    hit[a + shift + e] -= 1
        if some:
            found.append(item_id)
    return np.cumsum(hit[:-1]) > 0, sorted(set(found))


def _judge(candidates, texts):
    """For every row: words, words hit, items found. Rows without candidates cost a count only."""
    n_words, n_hit, found = [], [], []
    for i, h, first in _hashes(texts):
        n_words.append(np.diff(first))
        hits = np.zeros(len(first) - 1, np.int64)
        for r in range(len(first) - 1):
            own = candidates[i + r].as_py()
            names = []
            if own:
                items = [(x["item_id"], np.frombuffer(x["item_words"], np.uint64), x["span"], np.array([y["fp"] for y in x["at"]], np.int64).astype(np.uint64), np.array([y["item_at"] for y in x["at"]], np.int64)) for x in own]
                inside, names = covered(h[first[r] : first[r + 1]], items)
                hits[r] = np.count_nonzero(inside)
            found.append(names)
        n_hit.append(hits)
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *n_words]), np.concatenate([z, *n_hit]), found


def candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_id, items): for each row key that shares a fingerprint with the benchmark, the items it shares any with."""
    known = item_windows(benchmark)
    spans = sorted(r.span for r in known.select("span").distinct().collect())  # 13 values at most
    if not spans:
        return docs.sparkSession.createDataFrame([], "_id bigint, items array<struct<item_id:string,item_words:binary,span:int,at:array<struct<fp:bigint,item_at:int>>>>")
    per_item = known.groupBy("item_id", "item_words", "span").agg(F.sort_array(F.collect_list(F.struct("fp", "item_at"))).alias("at"))
    # prints are joined without a hint: Spark broadcasts the benchmark's side where its measured size allows
    pairs = document_fingerprints(docs, spans).join(known.select("fp", "span", "item_id", "item_words").distinct(), ["fp", "span"])
    pairs = pairs.groupBy(F.col("row").alias("_id"), "item_id", "item_words", "span").agg(F.lit(1).alias("_"))
    items = F.struct("item_id", "item_words", "span", "at")
    return pairs.join(per_item, ["item_id", "item_words", "span"]).groupBy("_id").agg(F.sort_array(F.collect_list(items)).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Documents and items are winnowed alike, prints are joined, and each hit is extended word by word on both sides; a
    run of at least 13 equal words (or a whole shorter item) is an occurrence of its windows. Winnowing picks a print
    from every run of that length, so none is missed.

    Null and empty texts have no words and no hits; items without words or id match nothing; rows are judged
    each by their own text, also those that repeat a doc_id or have none; empty tables give no rows, or rows without
    hits. Other columns are ignored, whatever their names.
    """
    def run(batches):
        for batch in batches:
            n_words, n_hit, found = _judge(batch.column(2), batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words.astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string()),
                    pa.array((n_hit > 0) & (ONE_IN * n_hit >= n_words)), pa.array(found, pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text", row_key().alias("_key")).join(candidates(docs, benchmark), F.col("_key") == F.col("_id"), "left")
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return joined.select("doc_id", "text", "items").mapInArrow(run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that aren't contaminated, whole and unchanged."""
    def run(batches):
        for batch in batches:
            n_words, n_hit, _ = _judge(batch.column(1), batch.column(0).field("text"))
            yield batch.select(["_row"]).filter(pa.array((n_hit == 0) | (ONE_IN * n_hit < n_words)))

    rows = rows_of(docs)
    joined = rows.select("_row", F.xxhash64("_row.doc_id", "_row.text").alias("_key")).join(candidates(docs, benchmark), F.col("_key") == F.col("_id"), "left").select("_row", "items")
    return joined.mapInArrow(run, joined.select("_row").schema).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return merged(got.drop("items"))


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH items AS (
    SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS ws FROM benchmark WHERE item_id IS NOT NULL),
spans AS (SELECT *, least({WINDOW}, len(ws)) AS span FROM items WHERE len(ws) > 0),
wins AS (
    SELECT DISTINCT item_id, span, array_to_string(ws[i:i + span - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(ws) - span + 2)) AS i FROM spans)),
base AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS ws FROM documents),
places AS (
    SELECT rid, span, i, array_to_string(ws[i:i + span - 1], ' ') AS win
    FROM (SELECT rid, ws, span, unnest(range(1, len(ws) - span + 2)) AS i FROM base, (SELECT DISTINCT span FROM spans))),
hits AS (SELECT rid, i, wins.span AS span, item_id FROM places JOIN wins USING (span, win)),
words AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + span)) AS j FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM base LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""
