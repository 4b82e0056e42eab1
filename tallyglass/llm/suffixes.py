"""Exact substring dedup by a distributed merge sort of front-coded suffixes.

Every string of SPAN bytes has an anchor: of its K-byte grams the one with the smallest hash. Equal strings have it at
the same place, so only suffixes that begin at anchors are sorted, with the bytes before the anchor as payload. The
strings with one anchor are a block: they begin at successive bytes, and two equal blocks (same bytes) are settled alike.

1. Texts are packed into files of the shared folder, and later steps read the packs they need by name.
2. Anchors met once in all packs are dropped: packs send a short hash of each and get one bit back.
3. Equal blocks are folded to the first document, by their hashes. Blocks whose anchor has one content only are done.
4. The rest become suffixes: each pack sorts its own, cuts the sorted run at splitters of the whole suffix space and
   sends front-coded pieces (length of the prefix shared with the suffix before, then the rest).
5. A loser tree merges the pieces of a range. It keeps for each contender how much of the last winner it shares, so
   bytes known to be equal are never compared again, and the merged sequence comes with its common prefix lengths.
6. In that sequence the suffixes that share enough bytes stand together, for each distance of a string's start from the
   anchor; strings that also share the bytes before the anchor are equal, and all but the first document's are marked.
7. Packs turn marks into removed bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import words as W
from tallyglass.llm.common import keep, merged, scratch, table
from tallyglass.llm.files import Output, Ranges

NAME = "op1_suffixes"
SPAN = 50
GRAM = 24
#: Bytes of text in a pack; a longer document is a pack of its own.
PACK_BYTES = 6 << 20
#: Blocks of a pack whose suffixes are sampled for the splitters.
SAMPLE = 64
NOTHING, WHOLE, SORT = 0, 1, 2


def anchors(buf: np.ndarray, offs: np.ndarray, usable: np.ndarray):
    """Blocks of the texts: (first start, last start, anchor, text number), by position.

    The smallest gram of a window is found by doubling: minima of 1, 2, 4, ... neighbours. The low bits of a hash are
    its place, so the minimum tells where it stands and ties go to the left.
    """
    w, n = SPAN - GRAM + 1, len(buf) - SPAN + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    p, s = W.prefix_hash(buf), np.arange(len(buf) - GRAM + 1)
    bits = np.uint64((1 << max(1, int(len(buf)).bit_length())) - 1)
    m = (W.span_hash(p, s, s + GRAM) & ~bits) | s.astype(np.uint64)
    size = 1
    while 2 * size <= w:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    if size < w:
        m = np.minimum(m[: size - w], m[w - size :])
    ok = np.repeat(usable, np.diff(offs))[:n] & (np.arange(n) + SPAN <= np.repeat(offs[1:], np.diff(offs))[:n])
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none, none
    a = (m[at] & bits).astype(np.int64)
    doc = np.searchsorted(offs, at, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
    return at[new], at[np.append(new[1:], len(at)) - 1], a[new], doc[new]


def usable(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).is_valid().to_numpy(zero_copy_only=False)


class Pack:
    """A pack's texts and blocks, with what the blocks' hashes say about them."""

    def __init__(self, batch: pa.RecordBatch, length: np.ndarray, before: np.ndarray):
        self.buf, self.offs = W.strings(batch.column(1))
        self.ids = batch.column(0)
        # blocks follow each other without gaps from the start of a text to its last whole string
        strings = np.where(usable(batch), np.maximum(np.diff(self.offs) - SPAN + 1, 0), 0)
        past, done = np.concatenate([[0], np.cumsum(strings)]), np.cumsum(length) - length
        text = np.searchsorted(past, done, "right") - 1
        self.start = self.offs[text] + done - past[text]
        self.end = self.start + length - 1
        self.anchor = self.end + before
        p = W.prefix_hash(self.buf)
        self.key = W.span_hash(p, self.anchor, self.anchor + GRAM)
        self.content = W.span_hash(p, self.start, self.end + SPAN)
        self.row = np.searchsorted(self.offs, self.start, "right") - 1
        self.doc = self.ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[self.row]
        self.keys, self.which, n = np.unique(self.key, return_inverse=True, return_counts=True)
        self.several = n > 1

    @staticmethod
    def save(batch: pa.RecordBatch, folder: str) -> tuple[str, int, list[int]]:
        """Writes (doc_id, text) rows with their blocks; the uri, the number of blocks and sampled suffixes."""
        buf, offs = W.strings(batch.column(1))
        s, e, a, _ = anchors(buf, offs, usable(batch))
        out = Output(folder, ".pack")
        sink = pa.BufferOutputStream()
        blocks = pa.RecordBatch.from_arrays([pa.array((e - s + 1).astype(np.uint8)), pa.array((a - e).astype(np.uint8))], ["length", "before"])
        for part in (batch, blocks):
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(part)
        out.write(sink.getvalue())
        pick = a[:: max(1, len(a) // SAMPLE)][:SAMPLE]
        return out.close(), len(s), [heads(buf, x) for x in pick]

    @staticmethod
    def load(uri: str) -> Pack:
        r = Ranges(uri)
        data = pa.BufferReader(r.read(0, r.size))
        r.close()
        (batch,), (blocks,) = list(pa.ipc.open_stream(data)), list(pa.ipc.open_stream(data))
        return Pack(batch, *(blocks.column(i).to_numpy().astype(np.int64) for i in range(2)))

    def buckets(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Edges of the buckets in sorted keys: a bucket is a range of the keys' upper halves."""
        return np.searchsorted((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))

    def entries(self, bits: list, n: int) -> None:
        """Folds the blocks whose anchors are repeated to one entry per anchor and content, of the first document."""
        repeated = self.several.copy()
        edge = self.buckets(self.keys, n)
        for b, data in bits:
            lo, hi = edge[b], edge[b + 1]
            repeated[lo:hi] |= np.unpackbits(np.frombuffer(data, np.uint8), count=hi - lo).astype(bool)
        at = np.flatnonzero(repeated[self.which])
        at = at[np.lexsort((self.doc[at], self.content[at], self.key[at]))]
        k, c = self.key[at], self.content[at]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(at) else np.zeros(0, bool)
        self.blocks, self.entry = at, np.cumsum(new) - 1  # every block's entry
        self.first = at[new]  # the block that stands for the entry


def heads(buf: np.ndarray, at: int) -> int:
    """The first 7 bytes of a suffix as a number that sorts as they do."""
    return int.from_bytes(buf[at : at + 7].tobytes(), "big")


def pack_documents(docs: DataFrame) -> DataFrame:
    """(uri, blocks, sample), one row per pack."""
    folder = scratch(docs.sparkSession, "packs")

    def run(batches):
        done = []
        for batch in batches:
            text = pa.array(batch.column(1)).fill_null("").cast(pa.large_binary())
            _, offs = W.strings(text)
            i, n = 0, batch.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + PACK_BYTES, "right")) - 1)
                part = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), text.slice(i, j - i)], ["doc_id", "text"])
                done.append(Pack.save(part, folder))
                i = j
        if done:
            uri, n, sample = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(uri), pa.array(n, pa.int64()), pa.array(sample, pa.list_(pa.int64()))], ["uri", "blocks", "sample"])

    return keep(docs.select("doc_id", "text").mapInArrow(run, "uri string, blocks long, sample array<long>"), "packs")


def repeated_anchors(packs: DataFrame, n: int) -> DataFrame:
    """(uri, bucket, data): for the pack's sorted anchors in the bucket, a bit for each that other packs have too."""
    def send(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                p = Pack.load(uri)
                edge = p.buckets(p.keys, n)
                short = p.keys.astype(np.uint32)  # the lower half; the bucket stands for the upper one
                rows = [(b, short[lo:hi].tobytes()) for b, lo, hi in zip(range(n), edge[:-1], edge[1:], strict=True) if hi > lo]
                if rows:
                    b, data = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(b)), pa.array(b, pa.int32()), pa.array(data, pa.binary())], ["uri", "bucket", "data"])

    def answer(_, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint32) for x in rows["data"]]
        every = np.sort(np.concatenate(parts))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        place = [np.searchsorted(twice, x) if len(twice) else np.zeros(len(x), np.int64) for x in parts]
        bits = [np.packbits(twice[np.minimum(i, len(twice) - 1)] == x if len(twice) else np.zeros(len(x), bool)).tobytes() for i, x in zip(place, parts, strict=True)]
        return pd.DataFrame({"uri": rows["uri"], "bucket": rows["bucket"], "data": bits})

    schema = "uri string, bucket int, data binary"
    spread = packs.select("uri").repartition("uri")
    return keep(spread.mapInArrow(send, schema).groupBy("bucket").applyInPandas(lambda k, x: answer(k, x), schema), "anchors")


def _by_pack(rows: pd.DataFrame, kind: str) -> list:
    own = rows[rows["kind"] == kind]
    return list(zip(own["bucket"], own["data"], strict=True))


def _flags(**frames: DataFrame) -> DataFrame:
    out = None
    for kind, df in frames.items():
        own = df.select("uri", F.lit(kind).alias("kind"), "bucket", "data")
        out = own if out is None else out.union(own)
    return out


def first_documents(bits: DataFrame, n: int) -> DataFrame:
    """(uri, bucket, data): for the pack's entries in the bucket, a byte each.

    WHOLE: an earlier document has the block. SORT: the first document with this content, but there are other contents
    around the same anchor, and not all of one document. NOTHING: no earlier document has any of the block's strings.
    """
    def send(rows: pd.DataFrame) -> pd.DataFrame:
        uri = rows["uri"].iloc[0]
        p = Pack.load(uri)
        p.entries(_by_pack(rows, "bits"), n)
        k, c, d = p.key[p.first], p.content[p.first], p.doc[p.first]
        edge = p.buckets(k, n)
        own = [(uri, b, k[lo:hi].tobytes(), c[lo:hi].tobytes(), d[lo:hi].tobytes()) for b, lo, hi in zip(range(n), edge[:-1], edge[1:], strict=True) if hi > lo]
        return pd.DataFrame(own, columns=["uri", "bucket", "keys", "contents", "docs"])

    def answer(_, rows: pd.DataFrame) -> pd.DataFrame:
        k, c = (np.concatenate([np.frombuffer(x, np.uint64) for x in rows[name]]) for name in ("keys", "contents"))
        d = np.concatenate([np.frombuffer(x, np.int64) for x in rows["docs"]])
        size = [len(x) // 8 for x in rows["docs"]]
        order = np.lexsort((d, c, k))
        k, c, d = k[order], c[order], d[order]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        new = new_key | np.concatenate([[True], c[1:] != c[:-1]])
        content, key = np.cumsum(new) - 1, np.cumsum(new_key) - 1
        first = d[np.flatnonzero(new)][content]
        at = np.flatnonzero(new_key)
        mixed = np.minimum.reduceat(first, at)[key] != np.maximum.reduceat(first, at)[key]
        out = np.empty(len(k), np.uint8)
        out[order] = np.where(d > first, WHOLE, np.where(mixed, SORT, NOTHING))
        cut = np.concatenate([[0], np.cumsum(size)])
        return pd.DataFrame({"uri": rows["uri"], "bucket": rows["bucket"], "data": [out[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]})

    sent = _flags(bits=bits).groupBy("uri").applyInPandas(send, "uri string, bucket int, keys binary, contents binary, docs binary")
    return keep(sent.groupBy("bucket").applyInPandas(lambda key, x: answer(key, x), "uri string, bucket int, data binary"), "firsts")


def statuses(p: Pack, firsts: list) -> np.ndarray:
    """The byte of every entry; entries and buckets are both in the order of the anchors' hashes."""
    return np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(x, np.uint8) for _, x in sorted(firsts)]])


def front_code(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sorted, padded strings to the lengths shared with the row before, and the bytes that are not."""
    width = text.shape[1]
    differ = text[1:] != text[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.concatenate([[0], np.minimum(shared, np.minimum(size[1:], size[:-1]))]).astype(np.uint8) if len(text) else np.zeros(0, np.uint8)
    column = np.arange(width)
    return lcp, text[(column >= lcp[:, None]) & (column < size[:, None])]


class Run:
    """A front-coded run, decoded as the merge proceeds."""

    __slots__ = ("lcp", "size", "data", "n", "i", "at", "text", "base")

    def __init__(self, lcp: bytes, size: bytes, data: bytes, base: int):
        self.lcp, self.size, self.data, self.n, self.base = lcp, size, data, len(lcp), base
        self.i, self.at, self.text = -1, 0, b""

    def step(self) -> int:
        """To the next string; what it shares with the one before, or -1 at the end."""
        self.i += 1
        if self.i == self.n:
            return -1
        h = self.lcp[self.i]
        more = self.size[self.i] - h
        self.text = self.text[:h] + self.data[self.at : self.at + more]
        self.at += more
        return h


def merge(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of all runs' strings, and what each shares with the one before it in that order.

    A loser tree over the runs. Each contender carries the length it shares with the string last taken: of two, the one
    that shares more comes first, and no byte is looked at; if both share as much they are compared from there on, and
    the loser keeps what it shares with the winner. The winner's successor enters with the length its own run states.
    """
    k = 1
    while k < len(runs):
        k *= 2
    done = [False] * len(runs) + [True] * (k - len(runs))
    shared = [0] * k
    for r, run in enumerate(runs):
        done[r] = run.step() < 0
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if done[a]:
            return b, a
        if done[b]:
            return a, b
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        s, t = runs[a].text, runs[b].text
        n = min(len(s), len(t))
        bits = int.from_bytes(s[x:n], "big") ^ int.from_bytes(t[x:n], "big")
        h = n - (bits.bit_length() + 7) // 8
        if (s[h] < t[h]) if h < n else len(s) <= len(t):
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    level = list(range(k))  # the first round, from the leaves up
    node = k
    while node > 1:
        node //= 2
        nxt = []
        for i in range(node):
            w, losers[node + i] = play(level[2 * i], level[2 * i + 1])
            nxt.append(w)
        level = nxt
    winner = level[0]
    order, lcp = [], []
    while not done[winner]:
        run = runs[winner]
        order.append(run.base + run.i)
        lcp.append(shared[winner])
        h = run.step()
        done[winner] = h < 0
        shared[winner] = max(h, 0)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return np.array(order, np.int64), np.array(lcp, np.int64)


def repeats(lcp: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For suffixes in merged order a mask of the strings that a smaller doc has: bit o for the one that begins o bytes
    before the anchor.

    `left` holds the bytes before the anchor, nearest first; `low` and `high` the least and largest o of the block.
    """
    masks = np.zeros(len(lcp), np.uint32)
    h = np.zeros(len(lcp), np.uint64)
    for o in range(left.shape[1] + 1):
        if o:
            h = W.mix(h * np.uint64(3) + left[:, o - 1].astype(np.uint64) + np.uint64(1))
        at = np.flatnonzero((low <= o) & (o <= high))
        if not len(at):
            continue
        group = np.cumsum(lcp < SPAN - o)[at]
        order = np.lexsort((doc[at], h[at], group))
        g, x, d = group[order], h[at][order], doc[at][order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
        first = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        masks[at[order[d > first]]] |= np.uint32(1 << o)
    return masks


def merged_suffixes(bits: DataFrame, firsts: DataFrame, splitters: list[int], n: int) -> DataFrame:
    """(uri, bucket, data): for entries of the pack (numbers and masks, packed) the strings that an earlier document has."""
    wide = SPAN - GRAM
    cuts = np.array(splitters, np.int64)
    columns = ["uri", "part", "lcp", "size", "tails", "left", "low", "high", "doc", "entry"]

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        uri = rows["uri"].iloc[0]
        p = Pack.load(uri)
        p.entries(_by_pack(rows, "bits"), n)
        e = np.flatnonzero(statuses(p, _by_pack(rows, "firsts")) == SORT)
        own = p.first[e]
        a, s, t = p.anchor[own], p.start[own], p.end[own]
        size, high = t + SPAN - a, a - s
        padded = np.concatenate([np.zeros(wide, np.uint8), p.buf, np.zeros(SPAN + 8, np.uint8)])
        column = np.arange(SPAN + 6)
        text = np.where(column < size[:, None], padded[a[:, None] + wide + column], 0).astype(np.uint8)
        keys = text.view(">u8").astype(np.uint64)
        order = np.lexsort((size, *keys.T[::-1]))
        e, a, size, high, text, own = e[order], a[order], size[order], high[order], text[order, :SPAN], own[order]
        left = padded[a[:, None] + wide - 1 - np.arange(wide)]
        left = np.where(np.arange(wide) < high[:, None], left, 0).astype(np.uint8)
        low = (a - p.end[own]).astype(np.uint8)
        head = (keys[order, 0] >> np.uint64(8)).astype(np.int64) if len(order) else np.zeros(0, np.int64)
        edge = np.searchsorted(np.searchsorted(cuts, head, "right"), np.arange(len(cuts) + 2))
        out = []
        for r, lo, hi in zip(range(len(cuts) + 1), edge[:-1], edge[1:], strict=True):
            if hi > lo:
                lcp, tails = front_code(text[lo:hi], size[lo:hi])
                out.append((uri, r, lcp.tobytes(), size[lo:hi].astype(np.uint8).tobytes(), tails.tobytes(), left[lo:hi].tobytes(), low[lo:hi].tobytes(), high[lo:hi].astype(np.uint8).tobytes(), p.doc[own[lo:hi]].tobytes(), e[lo:hi].astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=columns)

    def combine(_, rows: pd.DataFrame) -> pd.DataFrame:
        counts = [len(x) for x in rows["lcp"]]
        base = np.concatenate([[0], np.cumsum(counts)])
        order, lcp = merge([Run(a, b, c, int(i)) for a, b, c, i in zip(rows["lcp"], rows["size"], rows["tails"], base, strict=False)])
        low, high, left = (np.frombuffer(b"".join(rows[x]), np.uint8) for x in ("low", "high", "left"))
        doc = np.frombuffer(b"".join(rows["doc"]), np.int64)
        masks = np.zeros(len(order), np.uint32)
        masks[order] = repeats(lcp, left.reshape(-1, wide)[order], low[order].astype(np.int64), high[order].astype(np.int64), doc[order])
        data = []
        for i, entry in enumerate(rows["entry"]):
            m, e = masks[base[i] : base[i + 1]], np.frombuffer(entry, np.uint32)
            data.append(np.concatenate([e[m > 0], m[m > 0]]).astype(np.uint32).tobytes())
        return pd.DataFrame({"uri": rows["uri"], "bucket": rows["part"], "data": data})

    sent = _flags(bits=bits, firsts=firsts).groupBy("uri").applyInPandas(send, "uri string, part int, lcp binary, size binary, tails binary, left binary, low binary, high binary, doc binary, entry binary")
    return keep(sent.groupBy("part").applyInPandas(lambda k, x: combine(k, x), "uri string, bucket int, data binary"), "marks")


def covered(p: Pack, status: np.ndarray, marks: list) -> np.ndarray:
    """Which bytes of a pack to remove."""
    mask = np.zeros(len(p.first), np.uint32)
    for _, data in marks:
        x = np.frombuffer(data, np.uint32)
        mask[x[: len(x) // 2]] |= x[len(x) // 2 :]
    whole = (status[p.entry] == WHOLE) | (p.doc[p.blocks] > p.doc[p.first][p.entry])
    delta = np.zeros(len(p.buf) + 1, np.int32)
    b = p.blocks[whole]
    np.add.at(delta, p.start[b], 1)
    np.add.at(delta, p.end[b] + SPAN, -1)
    some = ~whole & (mask[p.entry] > 0)
    b, m = p.blocks[some], mask[p.entry[some]]
    for o in range(SPAN - GRAM + 1):
        at = p.anchor[b[(m >> np.uint32(o)) & 1 == 1]] - o
        np.add.at(delta, at, 1)
        np.add.at(delta, at + SPAN, -1)
    return np.cumsum(delta[:-1]) > 0


def removed_bytes(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    A byte goes if a string of 50 bytes over it also begins in a document with a smaller doc_id; strings are judged on
    the texts as given and never reach over a document.

    Null and short texts lose nothing; rows that share a doc_id don't count as earlier for each other; a null doc_id
    neither loses bytes nor takes any; an empty table gives no rows. Other columns are ignored, whatever their names.
    doc_id must be an integer.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = pack_documents(docs)
    bits = repeated_anchors(packs, n)
    firsts = first_documents(bits, n)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.percentile_approx("s", F.lit([i / ranges for i in range(1, ranges)]), F.lit(100_000)) if ranges > 1 else None
    found = packs.select(F.explode("sample").alias("s")).agg(at.alias("cuts")).first().cuts if ranges > 1 else None
    marks = merged_suffixes(bits, firsts, sorted(set(found or [])), n)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        p = Pack.load(rows["uri"].iloc[0])
        p.entries(_by_pack(rows, "bits"), n)
        gone = covered(p, statuses(p, _by_pack(rows, "firsts")), _by_pack(rows, "marks"))
        out = []
        ids = p.ids.to_pylist()
        for r in range(len(p.offs) - 1):
            lo, hi = p.offs[r], p.offs[r + 1]
            g = gone[lo:hi]
            left = p.buf[lo:hi][~g].tobytes()
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (len(g) > 0 and g[0]))
            out.append((ids[r], int(hi - lo), int(np.count_nonzero(g)), spans, hashlib.sha256(left).hexdigest(), left))
        done = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        return done.astype({"doc_id": "Int64"})

    listed = packs.select("uri", F.lit(0).alias("bucket"), F.lit(b"").alias("data"))  # packs without any anchor too
    flags = _flags(packs=listed, bits=bits, firsts=firsts, marks=marks)
    return flags.groupBy("uri").applyInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(removed_bytes(table(spark, sf_dir, "documents")).drop("kept"))


# Texts as hex digits, two a byte: a string of SPAN bytes is 2 * SPAN of them.
SQL = f"""
WITH base AS (
    SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
starts AS (
    SELECT rid, doc_id, p, s FROM (
        SELECT rid, doc_id, p, substr(hx, 2 * p + 1, {2 * SPAN}) AS s
        FROM (SELECT *, unnest(range(0, greatest(n - {SPAN - 1}, 0))) AS p FROM base WHERE doc_id IS NOT NULL))),
firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
marked AS (SELECT rid, p FROM starts JOIN firsts USING (s) WHERE doc_id > first),
runs AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS k
         FROM (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= {SPAN} THEN 0 ELSE 1 END AS fresh FROM marked)),
gone AS (SELECT rid, min(p) AS a, max(p) + {SPAN} AS e FROM runs GROUP BY rid, k),
edges AS (
    SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS lo, a AS hi FROM gone
    UNION ALL SELECT rid, coalesce(max(e), 0), any_value(n) FROM base LEFT JOIN gone USING (rid) GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(hx, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS hx FROM edges JOIN base USING (rid) GROUP BY rid),
counts AS (SELECT rid, count(*) AS spans, sum(e - a) AS removed FROM gone GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.hx)) AS kept_sha256
FROM base JOIN kept USING (rid) LEFT JOIN counts USING (rid)
"""
