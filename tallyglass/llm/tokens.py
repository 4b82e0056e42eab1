"""Token ids in bit-packed files: the fewest bits that hold the vocabulary, in blocks that can be read alone."""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import keep, scratch, table
from tallyglass.llm.files import Output, Ranges

NAME = "op9_tokens"
END_ID = 1
#: Ids in a block; each block begins at a byte of its own.
BLOCK = 1 << 12
#: A file is closed after so many ids.
FILE_IDS = 1 << 26
#: Words whose ids a Python worker remembers, in two halves.
CACHE_WORDS = 600_000
#: Unknown words that are encoded in one string; longer strings cost more for each word.
JOINED = 16
CHUNK_CHARS = 1 << 20
_MAGIC = b"BITPACK1"
_SENTINEL = "\x01"
_FIELDS = "<8sIIQQQQQ"
#: A stop or comma before a blank that doesn't follow a letter or digit. It begins with what is rare, so most is skipped.
_GLUED = re.compile(r"[.,](?<![a-z0-9\xdf-\xf6\xf8-\xff][.,]) ")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, lowest bit first, whole bytes at the end."""
    if bits == 16:  # what the general form gives
        return ids.astype("<u2").tobytes()
    spread = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    b = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (b.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Encoder:
    """Ids of texts by a tokenizer that drops white space, word by word, with the ids of known words remembered.

    Such a tokenizer treats what lies between two blanks by itself, so ids of words are ids of the text. Unknown words
    are encoded together, parted by a sentinel.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (max(self.tokenizer.get_vocab_size(), END_ID + 1) - 1).bit_length())
        self.dtype = "<u2" if self.bits <= 16 else "<u4"
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.cache, self.older = {"": b""}, {}
        self.sentinel = self._ids(_SENTINEL)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        if len(self.sentinel) != 1:
            return {w: np.array(self._ids(w), self.dtype).tobytes() for w in words}
        alone = [w for w in words if _SENTINEL in w]
        words = [w for w in words if _SENTINEL not in w]
        out |= {w: np.array(self._ids(w), self.dtype).tobytes() for w in alone}
        parts = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([f" {_SENTINEL} ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.sentinel[0])
            if len(cuts) != len(part) - 1:
                raise ValueError("words can't be told apart")
            data, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
            edges = [-1, *cuts.tolist(), len(ids)]
            for w, a, b in zip(part, edges, edges[1:], strict=False):
                out[w] = data[(a + 1) * width : b * width]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, the end id last."""
        split = [plain(t).split(" ") for t in texts]
        new = set().union(*split).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS // 2:  # the older half is forgotten, but for its words that are met again
            self.cache, self.older = {"": b""}, self.cache
            new = set().union(*split).difference(self.cache)
        known = self.cache
        met = self.older.keys() & new
        known.update({w: self.older[w] for w in met})
        new -= met
        if new:
            known.update(self._encode(sorted(new)))
        get = known.__getitem__
        return [b"".join(map(get, ws)) + self.end for ws in split]


def plain(text: str) -> str:
    """The text with fewer distinct words and the same ids, where that is certain.

    A Latin-1 text is already composed, so lower case may come first; and a full stop or comma between a letter or digit
    and a blank is a token of its own, so it may stand apart. Other texts only lose their line breaks.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ")
    if "<|" in text:
        return text.replace("\n", " ")
    text = text.lower().replace("\n", " ") + " "
    if _GLUED.search(text):
        return text
    return text.replace(". ", " . ").replace(", ", " , ")


def encoder(path: str) -> Encoder:
    """One per Python worker, which serves many tasks."""
    held = sys.modules.setdefault("_llm_token_encoders", types.ModuleType("_llm_token_encoders"))
    if getattr(held, "path", None) != path:
        held.path, held.encoder = path, Encoder(path)
    return held.encoder


def tokenize(docs: DataFrame, path: str, cuts: list[int]) -> DataFrame:
    """(part, doc_id, ids): ids as packed 16 or 32 bit integers, the end id last; part counts the cuts up to doc_id."""
    edges = np.array(cuts, np.int64)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            start, size, lens = 0, 0, batch.column(1)
            texts: list = []
            part = np.where(batch.column(0).is_valid(), np.searchsorted(edges, batch.column(0).fill_null(0).to_numpy(), "right"), 0).astype(np.int32)
            for i in range(batch.num_rows):
                t = lens[i].as_py() or ""
                texts.append(t)
                size += len(t)
                if size >= CHUNK_CHARS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(part[start : i + 1]), batch.column(0).slice(start, len(texts)), pa.array(enc.encode(texts), pa.binary())], ["part", "doc_id", "ids"])
                    start, size, texts = i + 1, 0, []

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "part int, doc_id long, ids binary")


class Writer:
    """One file: blocks of packed ids, then block offsets, doc_ids, their validity and starts, then a fixed trailer."""

    def __init__(self, folder: str, bits: int):
        self.out, self.bits = Output(folder, ".ids"), bits
        self.blocks, self.rest, self.ids, self.starts, self.n = [], [], [], [0], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.n += len(ids)
        self.starts.append(self.n)
        self.rest.append(ids)
        if sum(map(len, self.rest[-1:])) and self.n - len(self.blocks) * BLOCK >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.rest])
        for i in range(0, len(ids) if last else len(ids) - BLOCK + 1, BLOCK):
            self.blocks.append(self.out.size)
            self.out.write(pack(ids[i : i + BLOCK], self.bits))
        self.rest = [] if last else [ids[len(ids) - len(ids) % BLOCK :]]

    def close(self):
        self._flush(True)
        at = self.out.size
        self.out.write(np.array(self.blocks, "<u8").tobytes())
        self.out.write(np.array([x or 0 for x in self.ids], "<i8").tobytes())
        self.out.write(np.array([x is not None for x in self.ids], np.uint8).tobytes())
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(struct.pack(_FIELDS, _MAGIC, self.bits, BLOCK, len(self.blocks), len(self.ids), self.n, at, 0))
        return self.out.close(), len(self.ids), self.n


class Reader:
    """Random access to one file: ids(first, last) reads and unpacks only the blocks they stand in."""

    def __init__(self, uri: str):
        self.file = Ranges(uri)
        size = struct.calcsize(_FIELDS)
        magic, self.bits, self.block, n_blocks, n_docs, self.n, at, _ = struct.unpack(_FIELDS, self.file.read(self.file.size - size, size))
        if magic != _MAGIC:
            raise ValueError("not a file of packed ids")
        index = self.file.read(at, self.file.size - size - at)
        self.blocks = np.append(np.frombuffer(index, "<u8", n_blocks), at).astype(np.int64)
        p = 8 * n_blocks
        ids = np.frombuffer(index, "<i8", n_docs, p)
        valid = np.frombuffer(index, np.uint8, n_docs, p + 8 * n_docs)
        self.doc_ids = pa.array(ids, mask=valid == 0)
        self.starts = np.frombuffer(index, "<u8", n_docs + 1, p + 9 * n_docs).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block + 1
        data = self.file.read(int(self.blocks[a]), int(self.blocks[b] - self.blocks[a]))
        width = (self.block * self.bits + 7) // 8
        out = []
        if self.block * self.bits % 8 == 0:  # full blocks leave no gaps: one array operation for all
            out.append(unpack(data, self.bits, min(self.n, b * self.block) - a * self.block))
        else:
            for i in range(a, b):
                out.append(unpack(data[(i - a) * width : (i - a + 1) * width], self.bits, min(self.n - i * self.block, self.block)))
        return np.concatenate(out)[first - a * self.block : last - a * self.block]


def write(docs: DataFrame, path: str) -> DataFrame:
    """Tokenizes, writes the files in ascending doc_id order, and returns their list: (part, file, uri, n_docs, n_ids).

    Ranges of doc_id are cut first, from that column alone, so texts are encoded once and only ids are shuffled; each
    range is sorted and written by itself. Null doc_ids come first.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.lit([i / n for i in range(1, n)]), F.lit(100_000))).first()[0]  # n numbers
    folder = scratch(spark, "tokens")

    def run(batches):
        enc = encoder(path)
        w, k, at = None, 0, None
        done = []
        for batch in batches:
            for part, doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if w and (part != at or w.n >= FILE_IDS):
                    done.append((at, k, *w.close()))
                    w, k = None, k + 1
                w, at = w or Writer(folder, enc.bits), part
                w.add(doc_id, np.frombuffer(data.as_buffer(), enc.dtype).astype(np.uint32))
        if w:
            done.append((at, k, *w.close()))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "file", "uri", "n_docs", "n_ids"), x, strict=True)) for x in done], pa.schema([("part", pa.int32()), ("file", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # ties of doc_id by their ids, so that reruns agree
    ids = tokenize(docs, path, sorted(set(cuts or []))).withColumn("_c", F.crc32("ids"))
    ordered = ids.repartition("part").sortWithinPartitions("part", "doc_id", "_c").select("part", "doc_id", "ids")
    return keep(ordered.mapInArrow(run, "part int, file int, uri string, n_docs long, n_ids long"), "files")


def read(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32. Reads about a million ids at a time."""
    before = F.sum("n_ids").over(Window.partitionBy(F.lit(0)).orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.select("uri", F.coalesce(before, F.lit(0)).cast("long").alias("base"))  # one row per file

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = Reader(uri)
                i, n = 0, len(r.doc_ids)
                while i < n:
                    j = max(i + 1, int(np.searchsorted(r.starts, r.starts[i] + (1 << 20), "right")) - 1)
                    s = r.starts[i : j + 1]
                    data = memoryview(r.ids(int(s[0]), int(s[-1])).astype("<u4").tobytes())
                    at = ((s - s[0]) * 4).tolist()
                    crc = [zlib.crc32(data[a:b]) for a, b in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([r.doc_ids.slice(i, j - i), pa.array(s[:-1] + base), pa.array(np.diff(s)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j
                r.file.close()

    # evenly, a few files to a task: one task and one output file for each would start many processes at local file systems
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Writes the documents' ids and reads the files back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts give the end id alone; repeated rows are written each; null doc_ids come first; an empty table
    gives no files and no rows. Other columns are ignored, whatever their names. `path` is the tokenizer's file, to be
    found under the same path on every node; it must drop white space, as the cache of words rests on that.
    """
    return read(write(docs, path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
