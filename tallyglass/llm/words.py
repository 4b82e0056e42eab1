"""Words, n-grams and their hashes for whole Arrow batches of texts, in numpy: one pass of array operations, no row loop.

Texts are handled as UTF-8 bytes. A null text is an empty one. Batches are cut into blocks of a few MB (a longer text
is a block of its own), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93


def table_of(pattern_bytes, invert=False) -> np.ndarray:
    """A 256-entry lookup of bytes."""
    t = np.zeros(256, bool)
    t[list(pattern_bytes)] = True
    return ~t if invert else t


#: Bytes of words: all but \x20 and \x09-\x0D.
PLAIN = table_of([0x20, *range(0x09, 0x0E)], invert=True)
#: Bytes of words of letters, digits and all that is not ASCII.
ALNUM = table_of([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return _LOWER[buf]


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if a.null_count:
        a = pc.fill_null(a, b"" if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else "")
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    _, offsets, data = a.buffers()
    n = len(a)
    if offsets is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[a.offset : a.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def blocks(column, limit: int = BLOCK_BYTES):
    """(first row, bytes, offsets) of runs of rows of at most `limit` bytes, one row at least."""
    buf, offs = strings(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray = PLAIN):
    """Starts and ends of the words, and for each text the number of its first word (n + 1 entries)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = table[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GRAM))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash: n + 1 values, from which the hash of any substring follows."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_letters()[buf] * _powers(len(buf), _BASE), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end): equal substrings have equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * _powers(len(prefix), _INVERSE)[starts])


def word_hashes(buf, offs, table=PLAIN):
    """Hashes of the words in order, and the number of each text's first word."""
    starts, ends, first = spans(buf, offs, table)
    return span_hash(prefix_hash(buf), starts, ends), first


def grams(h: np.ndarray, first: np.ndarray, k: int):
    """Hashes of all k-word windows within a text, the word each begins at, and each text's first window."""
    n = len(h)
    if n < k:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, np.zeros(len(first), np.int64)
    g = h[: n - k + 1].copy()
    for j in range(1, k):
        g = g * np.uint64(_GRAM) + h[j : n - k + 1 + j]
    end = np.repeat(first[1:], np.diff(first))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= end)
    return mix(g[at]), at, np.searchsorted(at, first)


def sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return np.diff(c[offs])
