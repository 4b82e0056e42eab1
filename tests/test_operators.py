"""Operators against brute force and hand-computed cases."""

import math
from fractions import Fraction
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.functions import tails
from tallyglass.operators import (anomaly, charts, claims, cluster, compare, evaluate, forecast, history, lexical, logs, metrics, paired, pareto, router,
                                  privacy, profile, quality, retrieval, sampling, stats, summary, ties, values, vectors)
from tallyglass.session import cut
from tallyglass.sources import layout


def numbers_frame(spark, xs, parts=1):
    return spark.createDataFrame([(float(x),) for x in xs], "x double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 16])
def test_exact_quantiles_through_the_bracket(spark, parts):
    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.lognormal(size=4000), np.full(2500, 1.25), rng.normal(size=3000)]).round(3)
    df = numbers_frame(spark, xs, parts).withColumn("k", F.lit("a"))
    got = summary.exact_quantiles(df, ["k"], "x", {"a": 0.25, "b": 0.5, "c": 0.95}, accuracy=200).first()
    assert [got["a"], got["b"], got["c"]] == pytest.approx(np.quantile(xs, [0.25, 0.5, 0.95]).tolist(), abs=1e-12)


def test_fences(spark):
    r = stats.outliers(numbers_frame(spark, [*range(1, 10), 1000])).first()
    assert r["n_outliers"] == 1 and r["upper_fence"] < 1000
    assert stats.outliers(numbers_frame(spark, range(1, 21))).first()["n_outliers"] == 0
    assert stats.outliers(numbers_frame(spark, [1, 2])).count() == 0
    flat = stats.outliers(numbers_frame(spark, [5] * 5)).first()
    assert flat["n_outliers"] == 0 and flat["lower_fence"] == flat["upper_fence"] == 5


def test_skewness(spark):
    rng = np.random.default_rng(42)
    normal, heavy = rng.normal(size=200), rng.lognormal(size=200)
    assert stats.skewness(numbers_frame(spark, normal)).first()["verdict"] == "symmetric"
    h = stats.skewness(numbers_frame(spark, heavy)).first()
    assert h["verdict"] == "high" and h["p_value"] < 0.01
    assert stats.skewness(numbers_frame(spark, [7.0] * 20)).first()["verdict"] == "undefined"


def test_tails(spark):
    # I_x(a, b) against closed forms: I_x(1, 1) = x, I_x(2, 1) = x^2, I_x(1/2, 1/2) = 2/pi asin(sqrt x).
    assert tails.incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)
    assert tails.incomplete_beta(2, 1, 0.3) == pytest.approx(0.09)
    assert tails.incomplete_beta(0.5, 0.5, 0.7) == pytest.approx(2 / math.pi * math.asin(math.sqrt(0.7)))
    d = spark.createDataFrame([(1, 9), (0, 0), (5, 5)], "a int, b int").select(tails.binomial_two_sided("a", "b").alias("p"))
    assert [r.p for r in d.collect()] == pytest.approx([22 / 1024, 1.0, 1.0])


def test_paired_statistics(spark):
    rows = [(True, False)] * 2 + [(False, True)] * 10 + [(True, True)] * 30 + [(False, False)] * 8
    r = paired.paired_test(spark.createDataFrame(rows, "base boolean, this boolean")).first()
    assert (r["only_base"], r["only_this"]) == (2, 10) and r["delta"] == pytest.approx(8 / 50)
    assert r["delta_lo"] < r["delta"] < r["delta_hi"] and r["mcnemar_p"] == pytest.approx(2 * (1 + 12 + 66) / 4096)
    rates = paired.rates(spark.createDataFrame([(i < 70,) for i in range(100)], "ok boolean").withColumn("k", F.lit(1)), ["k"], "ok").first()
    draws = np.random.default_rng(0).binomial(100, 0.7, size=10_000) / 100
    assert [rates["lo"], rates["hi"]] == pytest.approx(np.quantile(draws, [0.025, 0.975]).tolist())


def test_effect_size_and_correlation(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in (3, 4, 5, 6)], "g string, v double")
    r = stats.effect_size(d, "g", "v", "a", "b").first()
    assert r["d"] == pytest.approx(-2 / math.sqrt(5 / 3), abs=1e-4) and r["magnitude"] == "large"
    c = stats.correlation_test(spark.createDataFrame([(float(i), float(2 * i), 1.0) for i in range(10)], "a double, b double, k double"))
    got = {(x["column_a"], x["column_b"]): x for x in c.collect()}
    assert got["a", "b"]["r"] == 1.0 and got["a", "b"]["significant"] and got["a", "k"]["r"] is None


def test_median_gap_and_rolling_count(spark):
    rng = random.Random(5)
    ts = sorted(rng.choice(range(0, 40 * 86400)) * 1_000_000 for _ in range(400)) + [0, 0]
    d = spark.createDataFrame([(i, "k", x) for i, x in enumerate(ts)], "u int, k string, us long").withColumn("ts", F.timestamp_micros("us")).repartition(5)
    want = float(np.median(np.diff(sorted(ts)))) / 1e6
    assert history.median_gap(d, ["k"], "ts").first()["median_gap_s"] == pytest.approx(want)
    got = {r["u"]: r["used"] for r in history.rolling_count(d, "k", "ts", "u").collect()}
    assert got == {i: sum(0 <= x - y < 86_400_000_000 for y in ts) for i, x in enumerate(ts)}


def test_last_turns_over_slices(spark):
    turns = [i for i in range(60) if i % 7]
    d = spark.createDataFrame([("c", i, f"t{i}") for i in turns], "c string, turn int, said string").repartition(4)
    got = {r["turn"]: [x["text"] for x in r["context"]] for r in history.last_turns(d, "c", "turn", "said", 3, per_slice=5).collect()}
    assert got == {x: [f"t{y}" for y in turns[max(0, i - 3):i]] for i, x in enumerate(turns)}


def test_frontier(spark):
    rng = random.Random(2)
    pts = [("s", i, rng.randrange(50), rng.randrange(50)) for i in range(300)]
    d = spark.createDataFrame(pts, "s string, p int, cost int, score int").repartition(6)
    want, best = set(), -1
    for _, p, c, e in sorted(pts, key=lambda x: (x[2], -x[3], x[1])):
        if e > best:
            want.add(p)
            best = e
    assert {r["p"] for r in pareto.frontier(d, "s", "cost", "score", "p").collect()} == want


def test_similarity_join_finds_every_pair(spark):
    rng = random.Random(4)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(2, 8))) for _ in range(80)})
    d = spark.createDataFrame([(w,) for w in words], "w string")

    def grams(s):
        p = f"  {s} "
        return {p[i:i + 3] for i in range(len(p) - 2)}

    want = {(a, b) for a in words for b in words if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.5}
    got = values.similar(d.select(F.col("w").alias("l")), d.select(F.col("w").alias("r")), 0.5)
    assert {(r["l"], r["r"]) for r in got.collect()} == want


def test_similarity_join_spreads_a_gram_that_every_text_has(spark):
    """20,000 texts of one template: all share its grams, almost none are similar."""
    d = spark.range(20_000).select(F.concat(F.lit("item no. "), F.md5(F.col("id").cast("string"))).alias("w"))
    a, b = values.postings(d.select(F.col("w").alias("l")), d.select(F.col("w").alias("r")), 0.2, block=500)
    met = a.groupBy("key").agg(F.count("*").alias("l")).join(b.groupBy("key").agg(F.count("*").alias("r")), "key")
    r = met.agg(F.max("l"), F.max("r"), F.count("*")).first()
    # Blocks are dealt by a hash: no key holds twice its share, though some grams stand in thousands of prefixes.
    assert r[0] <= 1000 and r[1] <= 1000
    hot = b.select("key.gram", "key.class", "text").distinct().groupBy("gram", "class").count().agg(F.max("count")).first()[0]
    assert hot > 1000


@pytest.mark.parametrize("score", [0.2, 0.5, 0.75, 1.0])
def test_similarity_join_is_whole_with_tiny_blocks(spark, monkeypatch, score):
    rng = random.Random(int(score * 10))
    words = sorted({"ab" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(120)} | {"", "  ", "A B", "a b"})
    d = spark.createDataFrame([(w,) for w in words], "w string")
    whole = values.postings
    monkeypatch.setattr(values, "postings", lambda left, right, s: whole(left, right, s, block=3))
    rows = [tuple(r) for r in values.similar(d.select(F.col("w").alias("l")), d.select(F.col("w").alias("r")), score).collect()]

    def grams(s):
        p = f"  {s.lower().strip()} "
        return {p[i:i + 3] for i in range(len(p) - 2)}

    want = {(x, y) for x in words for y in words if grams(x) and grams(y) and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= score}
    assert len(rows) == len(set(rows)) and {(x, y) for x, y, _s in rows} == want


def test_value_matching(spark):
    inv = spark.createDataFrame([("Germany",), ("France",)], "country string")
    art = spark.createDataFrame([("Led Zeppelin",), ("Queen",)], "name string")
    ix = values.value_index({"invoice": inv, "artist": art})
    q = spark.createDataFrame([(1, "total billed to germany"), (2, "albums by Led Zepelin"), (3, "What is the total?")], "id int, q string")
    got = {(r["question"], r["value"], r["score"]) for r in values.match_values(q, "id", "q", ix).collect()}
    assert (1, "Germany", 1.0) in got and any(x[:2] == (2, "Led Zeppelin") and x[2] >= 0.75 for x in got) and all(x[0] != 3 for x in got)


def test_hybrid_search_and_leaks(spark):
    docs = spark.createDataFrame([(1, "How many singers do we have?", "concert"), (2, "List all airports", "flight"), (3, "Count the singers in the show", "music")],
                                 "id int, text string, db string")
    q = spark.createDataFrame([(1, "How many singers exist?", "none"), (2, "How many singers exist?", "concert")], "id int, text string, db string")
    got = {}
    for r in retrieval.search(docs, "id", "text", q, "id", "text", 2, 50, "db").orderBy("rank").collect():
        got.setdefault(r["query"], []).append(r["doc"])
    assert set(got[1]) == {1, 3} and got[2][0] == 3
    ids = spark.createDataFrame([("spider-dev-12",), ("bird-minidev-3",), ("chk_001",), ("user-1",)], "id string")
    assert retrieval.evaluation_leaks(ids, "id").count() == 3
    with pytest.raises(Exception, match="refusing"):
        retrieval.guard_memory(ids, "id").collect()


def test_bm25_matches_the_formula(spark):
    docs = {1: "red bolt red", 2: "blue gear", 3: "red gear gear wheel"}
    d = spark.createDataFrame(list(docs.items()), "id int, text string")
    q = spark.createDataFrame([(7, "red gear red")], "id int, text string")
    got = {r["doc"]: r["score"] for r in lexical.top_k(lexical.build(d, "id", "text", shard_docs=1), q, "id", "text", 5).collect()}
    toks = {k: v.split() for k, v in docs.items()}
    avg = sum(map(len, toks.values())) / 3
    for k, ws in toks.items():
        s = 0.0
        for w in "red gear red".split():
            f, df = ws.count(w), sum(w in x for x in toks.values())
            if f:
                s += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ws) / avg))
        assert got.get(k, 0.0) == pytest.approx(s)


def test_one_day_of_one_key_is_spread_over_slices(spark):
    r = random.Random(8)
    rows = [(i, "hot" if i % 10 else r.choice(["a", "b", None]), 1_700_000_000_000_000 + (r.randrange(3600) * 1_000_000 if i % 10 else r.randrange(10**12))) for i in range(3000)]
    d = spark.createDataFrame(rows, "u long, k string, us long").withColumn("ts", F.timestamp_micros("us"))
    per = {}
    for _, k, us in rows:
        per.setdefault(k, []).append(us)
    got = {x["k"]: x["median_gap_s"] for x in history.median_gap(d, ["k"], "ts", per_slice=100).collect()}
    assert got == pytest.approx({k: float(np.median(np.diff(sorted(v)))) / 1e6 for k, v in per.items()})
    day = 600_000_000
    got = {x["u"]: x["used"] for x in history.rolling_count(d, "k", "ts", "u", day, per_slice=100).collect()}
    assert got == {u: sum(us - day < o <= us for o in per[k]) for u, k, us in rows}
    depth = history.sliced(d.select("k", "us").distinct(), ["k", "us"], 100).groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert depth < 400
    assert history.rolling_count(d.limit(0), "k", "ts", "u").count() == history.median_gap(d.limit(0), ["k"], "ts").count() == 0


@pytest.mark.parametrize("accuracy", [100, 50_000])
def test_quantiles_of_groups_of_every_size(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    groups = {n: np.round(rng.normal(size=n), rng.integers(0, 4)) for n in [*range(1, 40), 97, 250, 1001, 5000, 20_000]}
    df = spark.createDataFrame([(n, float(x)) for n, v in groups.items() for x in v], "k int, v double").repartition(7)
    probs = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.95, "g": 1.0}
    for r in summary.exact_quantiles(df, ["k"], "v", probs, accuracy).collect():
        assert [r[c] for c in probs] == pytest.approx(np.quantile(groups[r["k"]], list(probs.values())).tolist()), r["k"]


def test_numbers_within_keys_over_slices(spark):
    rows = [(i, "hot" if i % 9 else f"k{i % 4}", (i * 7919) % 101) for i in range(1500)]
    d = spark.createDataFrame(rows, "u long, k string, size int")
    got = {r["u"]: r["rank"] for r in history.numbered(d, ["k"], [F.desc("size"), "u"], "rank", 60).collect()}
    per = {}
    for u, k, size in sorted(rows, key=lambda r: (-r[2], r[0])):
        per.setdefault(k, []).append(u)
    assert got == {u: i for v in per.values() for i, u in enumerate(v)}


def test_interval_ends_equal_plain_sums():
    ends = lambda dist: tuple(next(v for v, c in zip(sorted(dist), np.cumsum([float(dist[k]) for k in sorted(dist)])) if c >= q - 1e-12) for q in (0.025, 0.975))
    for n in (1, 2, 7, 40):
        for k in range(n + 1):
            p = Fraction(k, n)
            assert tails.binomial_ends(n, k) == pytest.approx(ends({i / n: math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)}))
    for w, s, b in ((1, 0, 0), (0, 3, 0), (2, 3, 4), (0, 5, 6), (9, 0, 9), (1, 30, 2)):
        n, dist = w + s + b, {0: Fraction(1)}
        for _ in range(n):
            new = {}
            for d, m in dist.items():
                for step, c in ((-1, w), (0, s), (1, b)):
                    new[d + step] = new.get(d + step, 0) + m * Fraction(c, n)
            dist = {d: m for d, m in new.items() if m}
        assert tails.difference_ends(w, s, b) == pytest.approx(ends({d / n: m for d, m in dist.items()}))
    lo, hi = tails.binomial_ends(10**8, 30_000_000)
    assert lo == pytest.approx(0.3 - 1.95996 * math.sqrt(0.21 / 10**8), abs=2e-8) and hi == pytest.approx(0.3 + 1.95996 * math.sqrt(0.21 / 10**8), abs=2e-8)


def test_lexical_top_k_over_shards_and_groups(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=np.arange(40, 0, -1) / 820)), f"g{i % 4}" if i % 5 else None) for i in range(300)]
    rows += [(300 + i, rows[7][1], "g1") for i in range(5)] + [(400, None, "g1"), (None, "w1 w2", "g1")]
    asked = [(i, " ".join(rng.choice(words, 6)), f"g{i % 4}" if i % 3 else None) for i in range(20)] + [(20, None, "g1"), (21, "unknown", "g1")]
    d, q = spark.createDataFrame(rows, "id long, text string, db string"), spark.createDataFrame(asked, "id int, text string, db string")
    docs = {i: ((t or "").split(), g) for i, t, g in rows if i is not None}
    n, avg = len(docs), sum(len(w) for w, _ in docs.values()) / len(docs)
    df = {w: sum(w in x for x, _ in docs.values()) for w in words}
    for own in (None, "db"):
        got = {}
        for r in lexical.top_k(lexical.build(d, "id", "text", own, shard_docs=40), q, "id", "text", 7, own).collect():
            got.setdefault(r["query"], []).append((r["rank"], r["doc"]))
        want = {}
        for i, text, g in asked:
            score = {}
            for k, (ws, dg) in docs.items():
                if own and dg == g:
                    continue
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in (text or "").split() if w in ws)
                if s:
                    score[k] = s
            if score:
                want[i] = list(enumerate(sorted(score, key=lambda k: (-round(score[k], 9), k))[:7]))
        assert {k: sorted(v) for k, v in got.items()} == want
    plan = lexical.top_k(lexical.build(d, "id", "text"), q, "id", "text", 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapCoGroupsInPandas") > plan.index("Window") and "sum(" not in plan.split("FlatMapCoGroupsInPandas")[0]


def test_blocks_that_cannot_reach_the_best_are_not_read():
    n = 4096
    tf = np.ones(n, "<i4")
    tf[:64] = 50
    norm = np.full(n, 1.5)
    block = lambda a, b, t: (a, b - 1, float(t[a:b].max()) * 2.5 / (t[a:b].max() + 1.5), np.arange(a, b, dtype="<i4").tobytes(), t[a:b].tobytes())
    lists = [(1.0, [block(i, i + 64, tf) for i in range(0, n, 64)]), (2.0, [block(0, 64, tf)])]
    at, score, read = lexical.best_of_shard(lists, norm, 5, np.ones(n, bool))
    assert set(at) == set(range(64)) and read == 2 and score[0] == pytest.approx(3 * 50 * 2.5 / 51.5)
    assert lexical.best_of_shard(lists, norm, n, np.ones(n, bool))[2] == 65


def test_vector_index_keeps_its_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    x = base[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    rows = [(i, r.tolist(), i % 2) for i, r in enumerate(x)] + [(3000, None, 0), (3001, [0.0] * 16, 1), (None, [1.0] * 16, 1)]
    c = spark.createDataFrame(rows, "id long, vec array<double>, side int")
    ix = vectors.build(c, by="side", recall=0.95, k=10, sample=500)
    assert ix.rows.count() == ix.rows.select("id").distinct().count() == 3001
    q = c.where("id % 50 = 0 AND vec IS NOT NULL")
    assert vectors.recall_report(ix, q, 10, by="side").first()["recall"] >= 0.9 and ix.probes < len(ix.centroids)
    got = vectors.search(ix, q, 10, by="side", probes=len(ix.centroids)).collect()
    assert all(r["query"] % 2 == r["doc"] % 2 for r in got)
    for i in range(0, 3000, 500):
        own = np.arange(i % 2, 3000, 2)
        assert {r["doc"] for r in got if r["query"] == i} == set(own[np.argsort(-(x[own] @ x[i]))[:10]].tolist())
    assert vectors.search(ix, q, 3, floor=1e9, by="side").count() == 0
    high = vectors.search(ix, q, 5000, floor=20.0, by="side").collect()
    assert {(r["query"], r["doc"]) for r in high} == {(i, int(j)) for i in range(0, 3000, 50) for j in np.flatnonzero((np.round(x @ x[i], 9) >= 20) & (np.arange(3000) % 2 == i % 2))}
    none = vectors.build(c.limit(0), by="side")
    assert vectors.search(none, q, 3, by="side").count() == 0


def test_vector_top_k_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 20)
    rng = np.random.default_rng(0)
    c, q = rng.normal(size=(150, 8)), rng.normal(size=(7, 8))
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id int, vec array<double>")
    got = {}
    for r in retrieval.vector_topk(frame(q), frame(c), 5).orderBy("rank").collect():
        got.setdefault(r["query"], []).append(r["doc"])
    assert got == {i: np.argsort(-(c @ q[i]), kind="stable")[:5].tolist() for i in range(7)}


def test_bridge_tables(spark):
    cat = spark.createDataFrame([("playlist", "id", True), ("playlist", "name", False), ("track", "id", True), ("track", "name", False), ("track", "composer", False),
                                 ("link", "playlist_id", True), ("link", "track_id", True), ("link", "note", False)], "table string, column string, is_key boolean")
    fks = spark.createDataFrame([("link", "playlist_id", "playlist", "id"), ("link", "track_id", "track", "id")], "table string, column string, ref_table string, ref_column string")
    sel = spark.createDataFrame([(1, "playlist", "name"), (1, "track", "name")], "query int, table string, column string")
    got = {(r["table"], r["column"]) for r in retrieval.prune(sel, cat, fks).collect()}
    assert got == {("playlist", "name"), ("playlist", "id"), ("track", "name"), ("track", "id"), ("link", "playlist_id"), ("link", "track_id")}


def test_drift_alerts(spark):
    def frame(cur):
        rows = [(i * 3600, i % 10 < 8, 3.0, 0.001) for i in range(24, 24 * 8)] + [(i * 600, *cur(i)) for i in range(100)]
        d = spark.createDataFrame(rows, "age int, passed boolean, latency_s double, cost_usd double").withColumn("k", F.lit(1))
        return d.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("age")))

    bad = logs.drift(frame(lambda i: (i % 10 < 4, 6.0, 0.003)), ["k"]).first()
    assert bad["status"] == "alert" and len(bad["alerts"]) == 3
    assert logs.drift(frame(lambda i: (i % 10 < 8, 3.0, 0.001)), ["k"]).first()["status"] == "ok"
    few = frame(lambda i: (True, 3.0, 0.001)).where("age > 86400 OR age < 3000")
    assert logs.drift(few, ["k"]).first()["status"] == "insufficient data"


def test_claims(spark):
    r = spark.createDataFrame([(1, "A", 1234567.0), (1, "B", 2012.5)], "id int, name string, v double")
    t = spark.createDataFrame([(1, "A made about 1.2M, B 2,012.5; share 45.3%. Top 2 of 77 in 2024.", "how about 2024?")], "id int, text string, q string")
    got = claims.check(t, "id", "text", r, "q").first()
    assert got["n_unsupported"] == 2 and got["warning"].endswith("45.3%, 77")


def test_verdicts(spark):
    c = spark.createDataFrame([(5, 0.05, 300.0, 2.0, 100.0, 10.0), (100, 0.9, None, None, None, None)],
                              "sample_size int, correlation double, pct_change double, base_value double, ci_width double, forecast double")
    a, b = quality.validate_claims(c).collect()
    assert (a["confidence"], a["status"], len(a["warnings"])) == (0, "rejected", 4)
    assert (b["confidence"], b["status"], b["warnings"]) == (90, "validated", [])
    empty = quality.validate_result(spark.createDataFrame([], "a int"), "none").first()
    assert empty["status"] == "rejected" and empty["confidence"] == 20
    dup = quality.validate_result(spark.createDataFrame([(1, None), (1, None)], "a int, b double"), "dup").first()
    assert dup["confidence"] == 90 - 15 - 5 and dup["duplicates"] == 1


def test_compare(spark):
    g = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (2, "b", None)], "x int, y string, z double")
    same = lambda a, b, **k: compare.results_equal(a, b, **k).first()["match"]
    assert same(g, g.select("z", "x", "y")) and not same(g, g.distinct()) and compare.set_equal(g, g.distinct()).first()["match"]
    assert same(g, g.withColumn("w", F.lit(9)), extra_columns=True) and not same(g, g.withColumn("w", F.lit(9)))
    assert same(g, g.select(F.col("x").cast("double"), "y", "z")) and not same(g, g.select("x", "y", F.col("z").cast("string")))
    assert same(g, g.select(F.col("x").cast("double"), "y", F.col("z").cast("string")), lenient=True)
    near = g.withColumn("z", F.col("z") + 0.00001)
    assert not same(g, near) and same(g, near, lenient=True) and not compare.set_equal(g, near).first()["match"]


def test_samples(spark):
    d = spark.createDataFrame([(i, "abc"[i % 7 % 3]) for i in range(500)], "id int, s string").repartition(9)
    a = sampling.stratified(d, "id", "s", 61)
    assert a.count() == 61 and {r["id"] for r in a.collect()} == {r["id"] for r in sampling.stratified(d.coalesce(1), "id", "s", 61).collect()}
    s = sampling.held_out_groups(d, "s", 0.05)
    assert s.where("split = 'val'").select("s").distinct().count() == 1 and s.count() == 500


def test_ties(spark):
    d = spark.createDataFrame([(1,), (2,), (2,), (3,)], "v int")
    assert ties.limit_tie(d, ["v"], ["v"], 2).first()["tie"] and not ties.limit_tie(d, ["v"], ["v"], 3).first()["tie"]
    assert not ties.limit_tie(d, ["v"], ["v"], 4).first()["tie"]


def test_profile_roles_and_keys(spark):
    rows = [(f"2024-01-{i % 28 + 1:02d}", "ABC"[i % 3], float(i) * 1.5, i % 9, i) for i in range(100)]
    df = spark.createDataFrame(rows, "Date string, Category string, Revenue double, Quantity int, Customer_ID int")
    got = {r["column"]: r for r in profile.profile(df).collect()}
    assert {c: r["role"] for c, r in got.items()} == {"Date": "time_axis", "Category": "dimension", "Revenue": "measure", "Quantity": "measure", "Customer_ID": "identifier"}
    assert got["Category"]["top_values"] == ["A", "B", "C"] and got["Date"]["date_frequency"] == "daily"
    c = spark.createDataFrame([(1, 7), (2, 8)], "c_custkey long, c_nationkey int")
    o = spark.createDataFrame([(1, 1), (1, 9)], "o_orderkey long, o_custkey long")
    rep = {r["rule"]: r["violations"] for r in profile.key_report({"customer": c, "orders": o}).collect()}
    assert rep["unique o_orderkey"] == 1 and rep["o_custkey -> customer.c_custkey"] == 1


def test_detection_thresholds(spark):
    two = spark.createDataFrame([("a@b.co",), ("c@d.co",), ("x",)], "v string")
    one = spark.createDataFrame([("a@b.co",), ("x",), ("y",), ("z",)], "v string")
    assert [r["kind"] for r in privacy.detect({"t": two}).collect()] == ["EMAIL"] and privacy.detect({"t": one}).count() == 0


def test_forecast_follows_a_trend_with_season(spark):
    season = [0, 3, -2, 5, 1, -4, -3]
    d = spark.createDataFrame([("s", i, 10.0 + 0.5 * i + season[i % 7]) for i in range(70)], "k string, i int, v double")
    d = d.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i") * 86400))
    f = forecast.holt_winters(forecast.regularize(d, "k", "ts", "v"), "k", 7).orderBy("step").collect()
    want = [10.0 + 0.5 * (70 + h) + season[(70 + h) % 7] for h in range(7)]
    assert [r["forecast"] for r in f] == pytest.approx(want, abs=0.8) and f[0]["freq"] == "D" and str(f[0]["period"]) == "2024-03-11"


def test_clusters_and_anomalies(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(0, 0.3, (50, 2)), rng.normal(8, 0.3, (50, 2))])
    d = spark.createDataFrame([tuple(map(float, p)) for p in pts], "a double, b double")
    rows, prof, _ = cluster.kmeans(d, ["a", "b"], max_k=5, tries=1)
    assert prof.count() >= 2 and "Cluster" in rows.columns and sum(r["size"] for r in prof.collect()) == 100
    q = spark.createDataFrame([(float(x),) for x in [*range(10, 30), 999, -50]], "Quantity double")
    bad = anomaly.detect(q)
    assert {r["Quantity"] for r in bad.collect()} == {999.0, -50.0} and anomaly.rate(q, bad).first()["anomaly_rate"] == pytest.approx(9.09)
    assert cluster.elbow([100.0, 20.0, 15.0, 12.0]) == 3


def test_charts_and_metrics(spark, t):
    m = spark.createDataFrame([(70000.0, 50.0), (1.0, 2.0)], "sales double, profit double")
    assert charts.scale_spread(m, ["sales", "profit"]).first()["separate_panels"]
    broken = metrics.MetricLayer((metrics.Metric("bad", "sum(nothing)", "x"),), {"lineitem.nope": "?"})
    assert len(broken.validate(t.lineitem)) == 2 and metrics.SALES.validate(t.lineitem.crossJoin(t.orders.limit(1)).crossJoin(t.customer.limit(1))) == []


def test_scores_of_a_failed_case(spark):
    from tallyglass.plans.evaluation import cases
    from tallyglass.tables import Tables
    c = evaluate.scorecard(evaluate.case_scores(cases(Tables(spark, "/root/testdata/sf0.001"))))
    r = c.where("error IS NOT NULL").select("weighted_score", "passed").distinct().collect()
    assert [tuple(x) for x in r] == [(0.0, False)]


def test_cut_keeps_rows(spark):
    d = spark.range(10).withColumn("x", F.col("id") * 2)
    assert cut(d).agg(F.sum("x")).first()[0] == 90


def test_router_scores_do_not_depend_on_other_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.random() * 10, rng.random() < 0.4) for i in range(300)]
    d = spark.createDataFrame(rows, "id int, a double, b double, failed boolean")
    r = router.fit(d, ["a", "b"], "failed")
    every = {x["id"]: x["p_fail"] for x in router.p_fail(r, d).collect()}
    part = {x["id"]: x["p_fail"] for x in router.p_fail(r, d.where("id < 40")).collect()}
    assert part == {i: every[i] for i in range(40)} and len(set(every.values())) > 100


def test_value_index_keeps_wide_columns_and_long_values(spark):
    d = spark.range(6000).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("n")).unionAll(spark.range(1).select(F.repeat(F.lit("long "), 40).alias("n")))
    assert values.value_index({"t": d}).count() == 6001


def test_short_series_are_reported(spark):
    s = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-02", 2.0)] + [("b", f"2024-01-{d:02d}", float(d)) for d in range(1, 12)], "k string, t string, v double")
    got = forecast.holt_winters(forecast.regularize(s.withColumn("t", F.to_timestamp("t")), "k", "t", "v"), "k")
    assert {(r["k"], r["status"]) for r in got.collect()} == {("a", "too short"), ("b", "ok")}


def test_shares_come_for_any_number_of_categories(spark):
    d = spark.range(12).select(F.col("id").alias("c"), F.lit(1.0).alias("v"))
    assert {(round(r["share"], 6), r["pie_ok"]) for r in charts.shares(d, "c", "v").collect()} == {(round(1 / 12, 6), False)}


def test_ten_equal_columns_give_one_pairing(spark):
    g = spark.range(50).select(F.col("id").alias("k"), *[(F.col("id") % 3).alias(f"v{i}") for i in range(10)])
    p = g.select(*reversed(g.columns))
    sg, sp = compare.spelled(g), compare.spelled(p)
    gs, ps = compare._signatures(sg)[1], compare._signatures(sp)[1]
    alike = [i for i, x in enumerate(gs) if gs.count(x) > 1], [i for i, x in enumerate(ps) if ps.count(x) > 1]
    assert len(compare.pairings(gs, ps, compare._pair_signatures(sg, alike[0]), compare._pair_signatures(sp, alike[1]))) == 1
    assert compare.results_equal(g, p).first()[0]


def test_columns_with_the_same_values_are_told_apart_by_pairs(spark):
    """Three columns hold 0..8 in other orders: only the pairing that keeps rows together is equal, and a broken row is found."""
    rows = [(i, (i * 2) % 9, (i * 4) % 9) for i in range(9)]
    g = spark.createDataFrame(rows, "a int, b int, c int")
    assert compare.results_equal(g, spark.createDataFrame([(c, a, b) for a, b, c in rows], "x int, y int, z int")).first()[0]
    swapped = [(a, b, rows[(i + 1) % 9][2]) for i, (a, b, _c) in enumerate(rows)]
    assert not compare.results_equal(g, spark.createDataFrame(swapped, "x int, y int, z int")).first()[0]
    wide = spark.createDataFrame([(7, c, a, a, b) for a, b, c in rows], "n int, x int, y int, y2 int, z int")
    assert compare.results_equal(g, wide, extra_columns=True).first()[0]
    assert not compare.results_equal(g, wide.drop("x"), extra_columns=True).first()[0]


def test_pairs_agree_but_triples_do_not(spark):
    """Every two columns agree as pairs, the rows do not: the verdict is on whole rows."""
    even = [(a, b, (a + b) % 2) for a in (0, 1) for b in (0, 1)]
    odd = [(a, b, (a + b + 1) % 2) for a in (0, 1) for b in (0, 1)]
    g, p = spark.createDataFrame(even, "a int, b int, c int"), spark.createDataFrame(odd, "a int, b int, c int")
    assert not compare.results_equal(g, p).first()[0] and compare.results_equal(g, g).first()[0]


def test_scan_cost_follows_the_columns(spark, t, tmp_path):
    import glob

    import pyarrow.parquet as pq
    d = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("long"), F.array(F.struct(F.col("id").alias("x"))).alias("nested"), (F.col("id") % 2).alias("half"))
    path = str(tmp_path / "t")
    d.repartition(3).write.partitionBy("half").parquet(path)
    want = {}
    for f in glob.glob(path + "/half=1/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                x = meta.row_group(g).column(c)
                want[x.path_in_schema.split(".")[0]] = want.get(x.path_in_schema.split(".")[0], 0) + x.total_compressed_size
    cost = lambda cols: layout.scan_estimate(spark, path, F.col("half") == 1, columns=cols).first()
    assert {c: cost([c])["bytes"] for c in want} == want
    every = cost(list(want))
    assert every["bytes"] == sum(want.values()) < layout.scan_estimate(spark, path, F.col("half") == 1).first()["bytes"] and cost([])["bytes"] == 0
    assert layout.scan_estimate(spark, path, F.col("half") == 5, columns=["id"]).first()["bytes"] == 0
