"""Quality rules: base heuristics and a hashed n-gram likelihood ratio between trusted texts and the whole corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import words as W
from tallyglass.llm.common import table

NAME = "op7_quality"
#: Buckets of the two multinomials; the model is two arrays of this length.
BUCKETS = 1 << 16
#: Added to the target count of every bucket and to the count that the corpus lets expect, so that buckets seen a few
#: times say nothing either way and documents outside the trusted set aren't held against for words of their own.
SMOOTHING = 20.0
#: A document stays if its mean log ratio per n-gram, in nats, is at least this.
THRESHOLD = -0.15
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOLS = W.table_of(b"#*$%&|<>")


def _hashed(buf, offs):
    """Buckets of a block's words and word pairs, and how many belong to each text."""
    h, first = W.word_hashes(buf, offs)
    pairs, _, pair_first = W.grams(h, first, 2)
    return (h % np.uint64(BUCKETS)).astype(np.int32), first, (pairs % np.uint64(BUCKETS)).astype(np.int32), pair_first


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled 1."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_trusted")).distinct()


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, raw, target): hashed n-gram counts of all documents and of the trusted ones.

    Every task folds its documents into two arrays and hands on what is not zero.
    """
    def fold(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for i, buf, offs in W.blocks(batch.column(0)):
                h, first, pairs, pair_first = _hashed(buf, offs)
                own = good[i : i + len(offs) - 1]
                raw += np.bincount(h, minlength=BUCKETS) + np.bincount(pairs, minlength=BUCKETS)
                for x, f in ((h, first), (pairs, pair_first)):
                    target += np.bincount(x[np.repeat(own, np.diff(f))], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    # merged at every size, so no side must fit in memory; rows without an id match nothing and would all meet in one task
    marked = docs.filter("doc_id is not null").select("text", "doc_id").join(trusted(labels).hint("merge"), F.col("doc_id") == F.col("_trusted"), "left")
    marked = marked.select("text", F.col("_trusted").isNotNull().alias("good")).union(docs.filter("doc_id is null").select("text", F.lit(False)))
    parts = marked.mapInArrow(fold, "bucket int, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(folded: DataFrame) -> np.ndarray:
    """The weight of each bucket: log of its target count over what its corpus count lets expect, both smoothed; 0 everywhere without trusted texts."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in folded.collect():  # BUCKETS rows at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log(target + SMOOTHING) - np.log(raw * (target.sum() / raw.sum()) + SMOOTHING)


def repeated_words(h: np.ndarray, first: np.ndarray, k: int = 5) -> np.ndarray:
    """For each text the number of words inside k-word windows that occur in it twice or more."""
    out = np.zeros(len(first) - 1, np.int64)
    g, at, gf = W.grams(h, first, k)
    if not len(g):
        return out
    doc = np.repeat(np.arange(len(first) - 1), np.diff(gf))
    # short keys sort fast and show which texts may repeat anything; only those are looked at with whole hashes
    bits = max(1, int(len(first)).bit_length())
    key = np.sort((doc.astype(np.uint64) << np.uint64(64 - bits)) | (g >> np.uint64(bits)))
    some = np.unique((key[1:][key[1:] == key[:-1]] >> np.uint64(64 - bits)).astype(np.int64))
    for d in some:
        own, where = g[gf[d] : gf[d + 1]], at[gf[d] : gf[d + 1]] - first[d]
        _, inverse, n = np.unique(own, return_inverse=True, return_counts=True)
        hit = where[n[inverse] > 1]
        cover = np.zeros(first[d + 1] - first[d] + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, np.minimum(hit + k, len(cover) - 1), -1)
        out[d] = np.count_nonzero(np.cumsum(cover[:-1]))
    return out


def duplicate_lines(buf: np.ndarray, offs: np.ndarray, prefix: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text the number of lines that hold a word and equal an earlier line of the text."""
    out = np.zeros(len(offs) - 1, np.int64)
    breaks = np.flatnonzero(buf == 10)
    begin = np.concatenate([offs[:-1], breaks + 1])
    begin.sort()
    begin = begin[begin <= len(buf)]
    doc = np.searchsorted(offs, begin, "right") - 1
    # a line starts after a break, so the break that ends a text starts an empty line beyond it: that one has no word
    end = np.minimum(np.append(begin[1:], len(buf)), offs[np.minimum(doc + 1, len(offs) - 1)])
    stop = np.where((end > begin) & (buf[np.maximum(end - 1, 0)] == 10), end - 1, end) if len(buf) else end
    full = np.searchsorted(starts, begin) < np.searchsorted(starts, stop)
    begin, stop, doc = begin[full], stop[full], doc[full]
    if not len(begin):
        return out
    h = W.span_hash(prefix, begin, stop)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[again], minlength=len(out)).astype(np.int64)


def measure(column, weights: np.ndarray) -> dict[str, np.ndarray]:
    """The base figures and the mean log ratio of every text of a column."""
    parts = []
    for _, buf, offs in W.blocks(column):
        starts, ends, first = W.spans(buf, offs)
        prefix = W.prefix_hash(buf)
        h = W.span_hash(prefix, starts, ends)
        pairs, _, pf = W.grams(h, first, 2)
        n_words = np.diff(first)
        total = np.zeros(len(n_words))
        for x, f in ((h, first), (pairs, pf)):
            c = np.concatenate([[0.0], np.cumsum(weights[(x % np.uint64(BUCKETS)).astype(np.int32)])])
            total += c[f[1:]] - c[f[:-1]]
        parts.append((
            n_words, W.sums((buf & 0xC0 != 0x80) & W.PLAIN[buf], offs), W.sums(_SYMBOLS[buf], offs),
            duplicate_lines(buf, offs, prefix, starts), repeated_words(h, first),
            np.where(n_words > 0, total / np.maximum(1, n_words + np.diff(pf)), 0.0),
        ))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio")
    return {k: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i, k in enumerate(names)}


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ratio,
    base_failed, kept.

    Words and word pairs are hashed into BUCKETS multinomial cells, once over all documents and once over the trusted
    ones; a document's score is the mean log ratio of its cells. It is kept if the base rules pass and the score is at
    least THRESHOLD: no draw is made, so equal texts fare alike.

    Null and empty texts have no words and fail the base rules; repeated rows are scored each; without trusted
    documents every ratio is 0; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(log_ratios(counts(docs, labels)))  # BUCKETS numbers
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for batch in batches:
            m = measure(batch.column(1), weights.value)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
            ratio = np.round(m["log_ratio"], 9)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(m[c].astype(np.int64)) for c in columns], pa.array(ratio), pa.array(failed), pa.array(~failed & (ratio >= THRESHOLD))],
                ["doc_id", *columns, "log_ratio", "base_failed", "kept"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in columns)}, log_ratio double, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that `score` keeps, whole and unchanged, judged where they are read: no shuffle of texts."""
    weights = docs.sparkSession.sparkContext.broadcast(log_ratios(counts(docs, labels)))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            m = measure(batch.column(at), weights.value)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
            yield batch.filter(pa.array(~failed & (np.round(m["log_ratio"], 9) >= THRESHOLD)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
