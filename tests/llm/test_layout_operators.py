"""Mixing, shards, token files and archives on small tables."""

import base64
import hashlib
import io
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import files, mixing, shards, tokens, warc
from tallyglass.llm.graph import components

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def mixture(n=90):
    return [(i, " ".join(["w"] * (i * 7 % 23)), ["a", "b", "c", None, "hot", "hot", "hot"][i % 7]) for i in range(n)] + [(500, None, "a"), (501, "", "empty"), (502, "w w", "b")]


def targets_by_steps(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixture_meets_its_targets(make):
    rows = mixture()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_steps(sizes)
    source = {i: s for i, t, s in rows}
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], abs=1e-5)
        assert 0 <= r.taken <= 3 * r.size and (r.copies > 0) == (r.taken > 0) == (r.position is not None)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(make(rows, 7)).collect()), key=str)


def test_position_inverts_the_schedule(spark):
    for i, knots in enumerate(mixing.SCHEDULES):
        shares = [k / 20 for k in range(21)]
        got = spark.createDataFrame([(x,) for x in shares], "s double").select(mixing.position(F.col("s"), F.lit(i))).collect()
        grid = np.linspace(0, 1, 200_001)
        weight = np.interp(grid, [t for t, _ in knots], [w for _, w in knots])
        used = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        used /= used[-1]
        assert [r[0] for r in got] == pytest.approx(np.interp(shares, used, grid), abs=1e-4)


def test_mixed_documents_repeat_by_copies(clash):
    rows = mixture(40)
    df = clash(rows)
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.copies
    got = mixing.mixed_documents(df)
    assert Counter(r.doc_id for r in got.collect()) == +want and got.columns == df.columns


def test_shards_are_even_and_stratified(make):
    rows = [(i, "x" * (i % 9), ["a", "b", None, "hot", "hot", "hot"][i % 6]) for i in range(500)] + [(3, "x", "a")] * 4 + [(900, None, "a")]
    got = shards.assign(make(rows), 16).collect()
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(per) == list(range(16)) and all(sorted(x) == list(range(len(x))) for x in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    text = dict((i, t or "") for i, t, _ in rows if i != 3)
    source = {i: s for i, _, s in rows}
    for r in got:
        if r.doc_id != 3:
            assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    for s in {source[i] for i in source}:
        n = Counter(r.shard for r in got if source[r.doc_id] == s)
        assert max(n[k] for k in range(16)) - min(n[k] for k in range(16)) <= 2
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, shards.assign(make(rows, 5), 16).collect()), key=str)


def test_sharded_documents_keep_every_row(clash):
    rows = [(i % 50, "x" * (i % 3)) for i in range(120)]
    df = clash(rows)
    got = shards.shard_documents(df, 4)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(rows)
    assert len({(r.shard, r.slot) for r in got.collect()}) == 120 and set(df.columns) == set(got.columns)


def test_bits_pack_and_unpack():
    rng = np.random.default_rng(1)
    for bits in range(1, 33):
        ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
        data = tokens.pack(ids, bits)
        assert len(data) == (1001 * bits + 7) // 8 and (tokens.unpack(data, bits, 1001) == ids).all()


@pytest.mark.parametrize("bits", [5, 16, 17])
def test_token_file_is_read_anywhere(tmp_path, bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, int(n)).astype(np.uint32) for n in [0, 1, 5000, 300_000, 0, 4096, 7]]
    w = tokens.Writer(f"file://{tmp_path}", bits)
    for i, d in enumerate(docs):
        w.add(i if i else None, d)
    uri, n_docs, n = w.close()
    every = np.concatenate(docs)
    r = tokens.Reader(uri)
    assert (n_docs, n) == (7, len(every)) and r.doc_ids.to_pylist() == [None, 1, 2, 3, 4, 5, 6]
    for i, d in enumerate(docs):
        assert (r.ids(int(r.starts[i]), int(r.starts[i + 1])) == d).all()
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(every) + 1, 2).tolist())
        assert (r.ids(a, b) == every[a:b]).all()


def texts():
    import random

    rng = random.Random(4)
    parts = ["The", "the", "é", "é", "word", ".", ",", " ", "  ", "'s", "'ll", "\n", "\t", "\x01", "<|endoftext|>", "<|ENDOFTEXT|>", "7", "ß", "İ", "Σ", " ", "\x1f", "|", "ﬁ", "日本", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]


def test_tokens_equal_the_library(make, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    rows = [*enumerate(texts()), (900, None), (901, "")]
    start, want = 0, []
    for i, t in sorted(rows):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tokens.encode_documents(make(rows), PATH).collect()
    assert sorted(tuple(r) for r in got) == want


def test_words_met_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 60)
    enc, seen = tokens.Encoder(PATH), []
    whole = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda ws: seen.extend(ws) or whole(ws))
    for k in range(20):  # ten words stand in every text, ten in this one alone
        got = enc.encode([" ".join([f"often{i}" for i in range(10)] + [f"once{k}x{i}" for i in range(10)])])[0]
        alone = [enc._ids(f"often{i}") for i in range(10)] + [enc._ids(f"once{k}x{i}") for i in range(10)]
        assert np.frombuffer(got, enc.dtype).tolist() == [*sum(alone, []), tokens.END_ID]
        assert len(enc.cache) + len(enc.older) <= 60
    assert sorted(w for w in seen if w.startswith("often")) == [f"often{i}" for i in range(10)] and len(seen) == 210


def test_a_stop_or_comma_is_glued_unless_a_letter_or_digit_is_before_it():
    plainly = re.compile(r"(?:[^a-z0-9\xdf-\xf6\xf8-\xff]|^)[.,] ")
    for c in map(chr, range(256)):
        for t in (f"{c}. b", f"a{c}, b", f"{c}.b", f"a. {c}, b", f"{c}"):
            assert bool(tokens._GLUED.search(t)) == bool(plainly.search(t))


def test_token_files_are_read_by_a_task_for_each_shuffle_partition(make):
    n = int(make([]).sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = tokens.write(make([(i, f"a {i}") for i in range(40 * n)]), PATH)
    got = tokens.read(files)
    assert files.count() > n and got.rdd.getNumPartitions() == n
    assert sorted(r.doc_id for r in got.collect()) == list(range(40 * n))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    monkeypatch.setattr(warc, "READ_BYTES", 900)
    rows = [(i, f"http://h/{i}", None if i % 9 == 0 else "<p>é</p>" * (i % 13) + "\r\n\r\nx") for i in range(80)] + [(100, None, ""), (101, "a b\nc", "\x00" * 9000)]
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    got = {r.page_id: r for r in warc.archive_pages(pages(spark, rows)).collect()}
    assert sorted(got) == sorted(i for i, _, _ in rows)
    for i, _, h in rows:
        b, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        own = first[h or ""] == i
        assert (r.record_type, r.refers_to, r.payload) == (("response", None, b) if own else ("revisit", first[h or ""], None))


def test_small_payloads_are_never_revisits(spark):
    got = warc.archive_pages(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), 3).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: None, 4: 3}


def test_repeated_page_ids_have_roles_by_payload(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (2, "v", "a"), (2, "u", "b"), (3, "u", "a"), (3, "u", "b"), (3, "u", None), (4, "u", "")]
    got = Counter((r.page_id, r.payload, r.payload_digest, r.refers_to) for r in warc.archive_pages(pages(spark, rows)).collect())
    d = {x: warc.digest32(x.encode()) for x in ("a", "b", "")}
    assert got == {(1, b"a", d["a"], None): 1, (2, None, d["a"], 1): 3, (2, b"b", d["b"], None): 1, (3, None, d["a"], 1): 1, (3, None, d["b"], 2): 1, (3, b"", d[""], None): 1, (4, None, d[""], 3): 1}


def test_archives_open_with_a_common_library(spark):
    uris = [r.uri for r in warc.write(pages(spark, [(i, "http://h/", f"page {i}") for i in range(9)])).collect()]
    n = 0
    for uri in uris:
        with files.resolve(uri)[0].open_input_file(files.resolve(uri)[1]) as f:
            z = zipfile.ZipFile(io.BytesIO(f.read()))
        assert z.testzip() is None and set(z.namelist()) == {warc.DATA, warc.INDEX}
        n += len(z.read(warc.INDEX).splitlines())
    assert n == 9


class Held:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def read(self, at, n):
        return self.data[at : at + n]


def test_directories_of_other_writers_are_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 not the end"
        z.writestr(zipfile.ZipInfo("a/b"), b"abc" * 50)
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"xyz")
        z.writestr("packed", b"q" * 500, zipfile.ZIP_DEFLATED)
    got = warc.members(Held(out.getvalue()))
    data = out.getvalue()
    assert {n: m[3] for n, m in got.items()} == {"a/b": 0, "big": 0, "packed": 8}
    assert data[got["a/b"][0] :][:150] == b"abc" * 50 and data[got["big"][0] :][: got["big"][1]] == b"xyz"


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        warc.members(Held(b"nothing here" * 10))


def test_unfinished_files_have_no_name(tmp_path):
    out = files.Output(f"file://{tmp_path}", ".x")
    out.write(b"abc")
    assert not [x for x in tmp_path.iterdir() if x.suffix == ".x"]
    assert fs.FileSystem.from_uri(out.close())[0] and len([x for x in tmp_path.iterdir() if x.suffix == ".x"]) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 300), (200, 300), (7, 7), (400, 401), (401, 400)] + [(500, 600 + k) for k in range(50)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 300: 100, 401: 400, **{600 + k: 500 for k in range(50)}}
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_copies_stand_apart_and_reruns_agree(spark, make):
    rng = np.random.default_rng(2)
    rows = [(int(i) if rng.random() < 0.8 else None, f"text {rng.integers(0, 400)} " + "w " * int(rng.integers(1, 9)), f"s{rng.integers(0, 3)}") for i in rng.integers(0, 300, 900)]
    rows += rows[:40]
    first, again = (Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_documents(make(rows, n)).collect()) for n in (3, 7))
    assert first == again and max(first.values()) > 1
    slots = Counter()
    for n in (2, 5):
        got = shards.shard_documents(make(rows, n)).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
        slots[frozenset((r.doc_id, r.text, r.shard, r.slot) for r in got)] += 1
    assert len(slots) == 1
    thrice = [(i, f"document {i}", "s") for i in range(500) for _ in range(3)]
    got = shards.shard_documents(make(thrice)).collect()
    place = {}
    for r in got:
        place.setdefault(r.doc_id, []).append(r.shard * 1500 // 16 + r.slot)
    assert min(b - a for v in place.values() for a, b in zip(sorted(v), sorted(v)[1:])) > 1500 / 4
