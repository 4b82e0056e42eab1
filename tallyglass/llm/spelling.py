"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import words as W
from tallyglass.llm.common import keep, table

NAME = "op12_spelling"
#: Words have at least so many code points and occurrences.
SHORTEST = 6
SEEN = 5
#: Where this divides the checksum of document and run, one letter of the run is dropped.
DROP = 199
#: A variant's form is at least so many times as frequent.
RATIO = 5
#: Words that a cell of the upper tree is meant to hold, and the sample of the vocabulary that its splits are fitted on.
CELL = 16_000
SAMPLE_WORDS = 100_000
LEAF = 48
_BLOCK = 4 << 20
_LETTER = W.table_of(range(97, 123))  # after lower-casing
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more
_DIGIT = np.array([(lambda c: [c := (c >> 1) ^ (0xEDB88320 if c & 1 else 0) for _ in range(8)][-1])(i) for i in range(256)], np.uint32)


def letter_runs(buf: np.ndarray, offs: np.ndarray):
    """Starts, ends and code points of the maximal letter runs of lower-cased texts."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    lead = buf == _LEAD
    m = _LETTER[buf] | lead
    m[1:] |= lead[:-1]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    gap = np.concatenate([[True], ~m[:-1]])
    starts = np.flatnonzero(m & (gap | edge[:-1]))
    gap = np.concatenate([~m[1:], [True]])
    ends = np.flatnonzero(m & (gap | edge[1:])) + 1
    wide = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, ends - starts - (wide[ends] - wide[starts])


def checksums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of the spans, each carried on from the checksum of what stands before it; all spans step together."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long_ = int(np.searchsorted(-size[order], -64, "right"))
    out = np.empty(len(starts), np.uint32)
    for i in order[:long_]:
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(state[i]))
    rest = order[long_:]
    c, at, left = state[rest] ^ np.uint32(0xFFFFFFFF), starts[rest], size[rest]
    for j in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -j, "left"))  # spans longer than j stand first
        c[:k] = _DIGIT[(c[:k] ^ buf[at[:k] + j]) & np.uint32(255)] ^ (c[:k] >> np.uint32(8))
    out[rest] = c ^ np.uint32(0xFFFFFFFF)
    return out


def count_words(docs: DataFrame, shortest: int = SHORTEST, seen: int = SEEN) -> DataFrame:
    """(word, n): the runs of all texts, some with a letter dropped, that are long and frequent enough.

    Runs are folded to counts within blocks of a few MB before anything is shuffled.
    """
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, buf, offs in W.blocks(batch.column(1), _BLOCK):
                buf = W.lower(buf)
                s, e, n = letter_runs(buf, offs)
                take = n >= shortest
                s, e, n = s[take], e[take], n[take]
                doc = np.searchsorted(offs, s, "right") - 1
                first = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids[i : i + len(offs) - 1]], np.uint32)
                h = checksums(buf, s, e, first[doc]) if len(s) else np.zeros(0, np.uint32)
                hit = h % DROP == 0
                short = []
                for a, b, k, x in zip(s[hit].tolist(), e[hit].tolist(), n[hit].tolist(), h[hit].tolist(), strict=True):
                    if k > shortest:
                        w, j = buf[a:b].tobytes().decode(), x % k
                        short.append(w[:j] + w[j + 1 :])
                s, e = s[~hit], e[~hit]
                inside = np.zeros(len(buf) + 1, np.int8)
                inside[s] += 1
                inside[e] -= 1
                data = buf[np.cumsum(inside[:-1], dtype=np.int8) > 0]
                at = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
                whole = pa.Array.from_buffers(pa.string(), len(s), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
                counts = pc.value_counts(pa.concat_arrays([whole, pa.array(short, pa.string())]))
                yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["word", "n"])

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= seen)


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each: all are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each of the 256 letters stands in each word."""
    out = np.zeros((len(codes), 256), np.int32)
    at = np.arange(len(codes))
    for j in range(codes.shape[1]):
        np.add.at(out, (at, codes[:, j]), 1)
    return out


def split(counts: np.ndarray):
    """The letter that spreads most and the count up to which words go left; none if all are alike."""
    if len(counts) < 2:
        return None
    d = int(np.argmax(counts.var(axis=0)))
    c = counts[:, d]
    if c.min() == c.max():
        return None
    return d, int(min(np.median(c), c.max() - 1))


def upper_tree(words: list[str], parts: int) -> list[dict[int, tuple[int, int]]]:
    """Boxes (letter -> least and most count) that part the words of a length: a k-d tree's leaves, fitted on a sample."""
    c = letter_counts(letters(words))
    open_, boxes = [(np.arange(len(c)), {})], []
    while open_ and len(open_) + len(boxes) < parts:
        open_.sort(key=lambda x: len(x[0]))
        at, box = open_.pop()
        cut = split(c[at])
        if cut is None:
            boxes.append(box)
            continue
        d, t = cut
        lo, hi = box.get(d, (0, 1 << 30))
        left = c[at, d] <= t
        open_ += [(at[left], box | {d: (lo, t)}), (at[~left], box | {d: (t + 1, hi)})]
    return boxes + [b for _, b in open_]


def outside(counts: np.ndarray, boxes: list[dict[int, tuple[int, int]]]) -> np.ndarray:
    """L1 distance of each word from each box."""
    far = np.zeros((len(counts), len(boxes)), np.int32)
    for i, box in enumerate(boxes):
        for d, (lo, hi) in box.items():
            far[:, i] += np.maximum(lo - counts[:, d], 0) + np.maximum(counts[:, d] - hi, 0)
    return far


def range_search(tree: np.ndarray, asked: np.ndarray, radius: int, common: int):
    """Yields index pairs (asked, tree) of words that have `common` letters in common.

    Descends a k-d tree; at each node only those go on whose L1 distance from the node's box is within the radius.
    """
    levels = [(d, v) for d in np.flatnonzero(tree.max(axis=0)) for v in range(1, int(tree[:, d].max()) + 1)]
    dims = np.array([d for d, _ in levels], int)
    least = np.array([v for _, v in levels], int)
    unary = lambda c: (c[:, dims] >= least).astype(np.float32)
    stack = [(np.arange(len(tree)), np.arange(len(asked)), np.zeros(len(asked), np.int32), {})]
    while stack:
        at, who, far, box = stack.pop()
        if not len(who):
            continue
        cut = split(tree[at]) if len(at) > LEAF else None
        if cut is None:
            for i in range(0, len(who), 1 << 16):
                for j in range(0, len(at), 1 << 10):
                    q, p = np.nonzero(unary(asked[who[i : i + (1 << 16)]]) @ unary(tree[at[j : j + (1 << 10)]]).T == common)
                    yield who[i + q], at[j + p]
            continue
        d, t = cut
        lo, hi = box.get(d, (0, 1 << 30))
        c, left = asked[who, d], tree[at, d] <= t
        base = far - np.maximum(lo - c, 0) - np.maximum(c - hi, 0)
        for side, a, b in ((left, lo, t), (~left, t + 1, hi)):
            now = base + np.maximum(a - c, 0) + np.maximum(c - b, 0)
            ok = now <= radius
            stack.append((at[side], who[ok], now[ok], box | {d: (a, b)}))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a and b differ by one replaced letter (equal lengths), or by one that b has more."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    same = lambda x, y: np.where((x == y).all(axis=1), n, np.argmin(x == y, axis=1))
    return same(a, b[:, :n]) + same(a[:, ::-1], b[:, :0:-1]) >= n


def best(rank: np.ndarray, who: np.ndarray, other: np.ndarray, n: np.ndarray, top: np.ndarray) -> None:
    """Counts the near words of `who` into n and keeps the smallest rank among them in top."""
    np.add.at(n, who, 1)
    np.minimum.at(top, who, rank[other])


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE_WORDS) -> DataFrame:
    """(word, n_near, near_n, near): how many words are one edit away, and the most frequent (then smallest) of them.

    One edit moves the letter counts by 1 in L1 if a letter comes or goes, by 2 if one is replaced, so for each pair of
    lengths (k, k) and (k, k + 1) a range search of radius 2 or 1 over the words of length k finds all candidates, and
    the order of their letters decides. Lengths of many words are cut into the boxes of an upper tree, fitted on at most
    `sample` words: a word is at home in one box and asks in every box within its radius; each box searches on its own.
    """
    spark = words.sparkSession
    # lengths with more words than a cell holds: at most one per `cell` words
    crowded = {r.k: r["count"] for r in words.groupBy(F.char_length("word").alias("k")).count().filter(F.col("count") > cell).collect()}
    trees = {}
    if crowded:
        step = -(-sum(crowded.values()) // sample)
        some = words.filter(F.char_length("word").isin(list(crowded)) & (F.pmod(F.xxhash64("word"), F.lit(step)) == 0)).select("word").toPandas()["word"]
        for k, own in some.groupby(some.str.len()):
            trees[int(k)] = upper_tree(own.tolist(), -(-crowded[int(k)] // cell))
    shared = spark.sparkContext.broadcast(trees)  # a few letters per box, a box per `cell` words

    def route(batches):
        boxes_of = shared.value
        for batch in batches:
            w, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            size = np.array([len(x) for x in w], np.int64)
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                counts = letter_counts(letters([w[i] for i in at])) if k in boxes_of or k - 1 in boxes_of else None
                for tree, radius in ((k, 2), (k - 1, 1)):
                    boxes = boxes_of.get(int(tree), [{}])
                    far = outside(counts, boxes) if len(boxes) > 1 else np.zeros((len(at), 1), np.int32)
                    row, box = np.nonzero(far <= radius)
                    role = np.full(len(row), 2) if tree < k else (far[row, box] > 0).astype(int)  # 0: at home
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), tree, np.int32)), pa.array(box.astype(np.int32)), pa.array(role.astype(np.int32)), batch.column(0).take(pa.array(at[row])), pa.array(n[at[row]])], ["size", "box", "role", "word", "n"])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)  # a word's rank is its place
        role, w = rows["role"].to_numpy(), rows["word"].tolist()
        home, counted, top = np.flatnonzero(role == 0), np.zeros(len(w), np.int64), np.full(len(w), len(w))
        rank = np.arange(len(w))
        if len(home):
            codes = letters([w[i] for i in home])
            tree = letter_counts(codes)
            used = np.flatnonzero(tree.any(axis=0))
            for longer in (False, True):
                every = np.flatnonzero(role == 2) if longer else np.flatnonzero(role < 2)
                for i in range(0, len(every), 1 << 14):
                    who = every[i : i + (1 << 14)]
                    own = letters([w[j] for j in who])
                    k = codes.shape[1]
                    for q, p in range_search(tree[:, used], letter_counts(own)[:, used], 2 - longer, k - (not longer)):
                        ok = one_edit(codes[p], own[q])
                        best(rank, who[q[ok]], home[p[ok]], counted, top)
                        if longer:  # the shorter one asks nowhere else for longer ones
                            best(rank, home[p[ok]], who[q[ok]], counted, top)
        some = np.flatnonzero(counted)
        near = rows.iloc[top[some]]
        return pd.DataFrame({"word": rows["word"].to_numpy()[some], "n_near": counted[some], "near_n": near["n"].to_numpy(), "near": near["word"].to_numpy()})

    parts = words.mapInArrow(route, "size int, box int, role int, word string, n long").groupBy("size", "box").applyInPandas(search, "word string, n_near long, near_n long, near string")
    best_of = F.min(F.struct((-F.col("near_n")).alias("_n"), "near"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best_of.alias("_b")).select("word", "n_near", (-F.col("_b._n")).alias("near_n"), F.col("_b.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the end of the chain of forms. Each round doubles the steps taken.

    A form is RATIO times as frequent as its variant, so chains have no rings and some 27 steps at most.
    """
    at = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = keep(at.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_m")), "roots")
        if moved.filter("_m").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(docs: DataFrame, shortest: int = SHORTEST, seen: int = SEEN, ratio: int = RATIO, cell: int = CELL) -> DataFrame:
    """One row per word of the texts: word, n, n_near, form, form_n, root.

    Null and empty texts have no words; a null doc_id is written as an empty one; repeated rows count each; very long
    runs are words like others; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    words = keep(count_words(docs, shortest, seen), "words")
    found = words.join(near_words(words, cell), "word", "left")
    has = F.col("near_n") >= ratio * F.col("n")
    found = keep(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "variants")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


# crc32 is folded over the bytes of document and run; near words share what is left when one letter is taken from either.
SQL = f"""
WITH RECURSIVE step AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || list_transform(range(8), lambda x: x::BIGINT),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
runs AS (
    SELECT doc_id, run, count(*) AS k FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
        FROM documents WHERE text IS NOT NULL) WHERE length(run) >= {SHORTEST} GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs),
sums AS (
    SELECT run, k, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(hx), 2), lambda p:
               (instr('0123456789ABCDEF', hx[p]) - 1) * 16 + instr('0123456789ABCDEF', hx[p + 1]) - 1),
               lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) AS h
    FROM bytes, step),
words AS (
    SELECT word, sum(k)::BIGINT AS n FROM (
        SELECT k, CASE WHEN h % {DROP} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM sums)
    WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(k) >= {SEEN}),
cuts AS (SELECT word, n, length(word) AS size, p, word[:p - 1] || word[p + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
    SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.p = b.p AND a.size = b.size AND a.word <> b.word
    UNION SELECT a.cut, a.word, a.n FROM cuts a JOIN words w ON w.word = a.cut
    UNION SELECT a.word, w.word, w.n FROM cuts a JOIN words w ON w.word = a.cut),
top AS (SELECT word, count(*) AS n_near, first(struct_pack(near, n) ORDER BY n DESC, near) AS b FROM near GROUP BY word),
found AS (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= {RATIO} * w.n THEN b.near END AS form,
           CASE WHEN b.n >= {RATIO} * w.n THEN b.n END AS form_n
    FROM words w LEFT JOIN top USING (word)),
chain AS (
    SELECT word, word AS at FROM found
    UNION SELECT c.word, f.form FROM chain c JOIN found f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, e.at AS root
FROM found f JOIN (SELECT c.word, c.at FROM chain c JOIN found g ON c.at = g.word WHERE g.form IS NULL) e USING (word)
"""
