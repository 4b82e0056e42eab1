"""Metric join, hard negatives and spelling variants against plain versions, on odd rows too."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import metric, negatives, spelling

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def clash(df, names):
    return df.withColumns({n: F.lit(1) for n in names})


def cosine(x, y):
    dot = lambda a, b: math.fsum(p * q for p, q in zip(a, b, strict=True))
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def linked(rows, limit):
    """(vec_id, n_links, component_id) of every row, by trying all pairs."""
    ok = [i is not None and lb is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lb in rows]
    links = {i: [] for i in range(len(rows))}
    for i, (_, v, lb) in enumerate(rows):
        for j in range(i):
            if ok[i] and ok[j] and rows[j][2] == lb and len(rows[j][1]) == len(v) and cosine(v, rows[j][1]) >= limit:
                links[i].append(j)
                links[j].append(i)
    out, least = [], {}
    for i in range(len(rows)):
        if i not in least:
            seen, todo = {i}, [i]
            while todo:
                todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            least |= dict.fromkeys(seen, min(ids, default=None))
        out.append((rows[i][0], len(links[i]), least[i]))
    return Counter(out)


def f32(v):
    return [float(np.float32(x)) for x in v]


def near_rows(seed, n=160, dim=6):
    """Families of near copies, chains, exact copies and strangers under three labels, one of them with most rows."""
    r = np.random.default_rng(seed)
    rows, base = [], r.normal(size=(12, dim))
    for i in range(n):
        v = base[r.integers(12)] + r.normal(size=dim) * r.choice([0.0, 0.1, 0.25, 1.0])
        rows.append((i, f32(v * r.choice([1, 3, 0.01])), int(r.choice([0, 0, 0, 1, 2]))))
    return rows + [(n + k, rows[k % 7][1], rows[k % 7][2]) for k in range(30)]


@pytest.mark.parametrize(("cell", "most"), [(8192, 256), (10, 8), (12, 1), (25, 3)])
def test_metric_join(spark, cell, most):
    rows = near_rows(cell + most)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = metric.join(df, 0.93, cell, most).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == linked(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_metric_join_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [NAN, 1.0], 1), (7, [INF, 1.0], 1), (8, [], 1),
            (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, -1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, -0.0], 1), (12, [1e-30, 0.0], 1), (13, [1e30, 0.0], 1), (14, [1.0, 0.0], 2)]
    df = clash(spark.createDataFrame(rows, VECTORS), ("node", "part", "vec", "m", "cell", "alpha", "i", "j", "u", "v", "_g", "kept"))
    got = metric.join(df, 0.93, 3, 2).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == linked(rows, 0.93)
    assert metric.join(spark.createDataFrame([], VECTORS)).collect() == []
    wide = spark.createDataFrame([(1, [1e300, 1e300], "a"), (2, [1e300, 1.1e300], "a")], "vec_id int, embedding array<double>, label string")
    assert [(r.vec_id, r.n_links, r.component_id) for r in metric.join(wide).sort("vec_id").collect()] == [(1, 1, 1), (2, 1, 1)]


def test_limit_of_the_metric_join_is_kept_to_the_last_bit(spark):
    angles = [0.0, math.acos(0.93) - 1e-6, math.acos(0.93) + 1e-6]
    rows = [(i, [math.cos(a), math.sin(a)], 1) for i, a in enumerate(angles)]
    got = metric.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).sort("vec_id").collect()
    assert [r.n_links for r in got] == [1, 2, 1]


def mined(rows):
    use = []
    for i, v, lb in rows:
        if i is not None and lb is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, tuple(math.floor(256 * x) for x in v), (lb + 1) % 10 if i % 7 == 0 else lb))
    out = []
    for a in {r for r in use if r[0] % 50 == 0}:
        score = lambda r: sum(x * y for x, y in zip(a[1], r[1], strict=True))  # noqa: B023, E731
        ranked = sorted(((-score(r), r[0], r[2]) for r in use if r[0] != a[0] and len(r[1]) == len(a[1])))
        for p, pid, _ in [r for r in ranked if r[2] == a[2]][:5]:
            some = [(s, i) for s, i, lb in ranked if lb != a[2] and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a[0], pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(some)]
    return Counter(out)


def vector_rows(seed, n=700, dim=5, scale=1.0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(9, dim))
    return [(int(i), f32((base[r.integers(9)] + r.normal(size=dim) * 0.7) * scale), int(r.choice([0, 0, 0, 1, 2, 9]))) for i in range(n)]


@pytest.mark.parametrize(("pack", "per_slice", "lists", "scale"), [(1024, 1 << 16, 8, 1.0), (3, 40, 2, 1.0), (2, 64, 3, 0.02), (5, 100, 8, 1e4), (4, 100, 2, 1e12)])
def test_hard_negatives(spark, pack, per_slice, lists, scale):
    rows = vector_rows(pack, scale=scale)
    got = negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(4), pack, per_slice, lists).collect()
    clipped = Counter({(*k[:4], *(max(-(1 << 63), min((1 << 63) - 1, s)) for s in k[4:])): n for k, n in mined(rows).items()})
    assert Counter(map(tuple, got)) == clipped and got


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (50, [0.0, 0.0], 2), (100, None, 1), (150, [1.0, None], 1), (200, [NAN, 1.0], 1), (250, [1.0], 1), (300, [], 3), (301, [], 3), (302, [], 4),
            (None, [1.0, 1.0], 1), (1, [1.0, 1.0], None), (2, [0.9, 1.0], 2), (3, [1.0, 0.9], 2), (4, [0.9, 1.0], 2), (4, [0.9, 1.0], 2), (5, [0.5, 0.6], 2), (6, [0.7, 0.7], 2), (50, [0.3, -0.4], 2), (7, [INF, 1.0], 2), (8, [-1.0, -1.0], 2)]
    df = clash(spark.createDataFrame(rows, VECTORS), ("anchor", "uri", "at", "size", "n", "dim", "kind", "cluster", "part", "places", "rows", "p", "score"))
    assert Counter(map(tuple, negatives.mine(df, 2, 3, 2).collect())) == mined(rows)
    assert negatives.mine(spark.createDataFrame([], VECTORS)).collect() == []


def spelled(docs, seen=5, ratio=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= seen}
    less = lambda w: {(w[:i], w[i + 1 :]) for i in range(len(w))}
    cuts = {w: less(w) for w in n}
    near = {w: [v for v in n if v != w and (len(v) == len(w) and cuts[v] & cuts[w] or v in {a + b for a, b in cuts[w]} or w in {a + b for a, b in cuts[v]})] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


@pytest.mark.parametrize("cell", [16_000, 25])
def test_spelling_variants(spark, make, cell):
    r = random.Random(cell)
    letters = "abcdeéÿ×"
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 9))) for _ in range(60)]

    def word():
        w = base[min(int(r.expovariate(0.08)), 59)]
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters[:3]) + w[i:], w[:i] + r.choice(letters[:3]) + w[i + 1 :]])
        return w.upper().replace("É", "é") if r.random() < 0.1 and w.isascii() else w

    docs = [(i, r.choice([" ", "-", "1", "Ā", "\n"]).join(word() for _ in range(200))) for i in range(60)] + [(60, "aaaaaabb " * 99 + "aaaaaabc " * 20 + "aaaaaacc " * 6)]
    got = spelling.variants(make(docs), ratio=2, cell=cell).collect()
    want = spelled(docs, ratio=2)
    assert {(x.word, x.n, x.n_near, x.form, x.form_n, x.root) for x in got} == want and len(got) == len(want)
    assert any(x[3] and x[5] != x[3] for x in want)


def test_spelling_of_odd_rows(spark, make):
    long_ = "ab" * 1500
    docs = [(None, "letters Letters LETTERS"), (None, None), (1, ""), (1, "letters letters"), (1, "letters letters"), (2, "lettres " * 3 + "letterss"), (3, long_ + " x " + long_[1:] + "A"), (4, " ".join([long_] * 4)), (5, "ŉlettersƀ Ünïcödé ÜNÏCÖDÉ"), (6, "bétters " * 40), (7, "\x00betters" * 5)]
    df = make(docs).withColumns({c: F.lit(1) for c in ("word", "n", "size", "box", "role", "root", "form", "near")})
    got = spelling.variants(df).collect()
    assert {(x.word, x.n, x.n_near, x.form, x.form_n, x.root) for x in got} == spelled(docs)
    assert spelling.variants(make([])).collect() == []


def test_checksums_equal_the_library():
    r = random.Random(3)
    words = [bytes(r.randrange(97, 123) for _ in range(r.choice([1, 2, 5, 30, 64, 65, 300]))) for _ in range(200)]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    first = np.array([zlib.crc32(b"%d:" % i) for i in range(200)], np.uint32)
    got = spelling.checksums(buf, ends - [len(w) for w in words], ends, first)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + w) for i, w in enumerate(words)]


def test_spelling_of_a_text_of_several_megabytes(spark, make):
    run = "ab" * 40_000
    text = (run + " " + run[1:] + "a ") * 30 + "letters " * 100_000 + "lettres " * 7
    got = spelling.variants(make([(1, text)])).collect()
    assert {x.word: (x.n, x.n_near) for x in got} == {run: (30, 0), run[1:] + "a": (30, 0), "letters": (100_000, 0), "lettres": (7, 0)}
