"""Near-duplicate join: adaptive multi-match prefixes over 5-word shingles, exact verification, connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import words as W
from tallyglass.llm.common import keep, keep_dealt, merged, row_key, rows_of, table
from tallyglass.llm.graph import components

NAME = "op8_jaccard"
SHINGLE = 5
#: Documents link if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A shingle in at least so many distinct sets of one batch is counted as frequent.
FREQUENT = 5
#: The most frequent shingles that are ranked by their counts; all others rank before them.
RANKED = 1 << 17
#: Prefixes ask for at most so many shared shingles.
MAX_MATCHES = 12
#: Cost of verifying a pair, in posting entries read.
VERIFY_COST = 30.0
#: Rounds in which each document tries one partner, before all that is left is tried.
PROBES = 2
#: Shingles beyond the pivot's that a pair must share within the part of them that is looked up, if it needs so many.
REST_MATCHES = 4


def shingle_sets(column):
    """(row, sorted distinct 64-bit shingle hashes) of every text; empty without words."""
    for i, buf, offs in W.blocks(column):
        h, first = W.word_hashes(W.lower(buf), offs)
        g, _, gf = W.grams(h, first, SHINGLE)
        for r in range(len(first) - 1):
            if gf[r + 1] > gf[r]:
                s = np.sort(g[gf[r] : gf[r + 1]])
                yield i + r, s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:  # fewer words than a shingle has: the whole sequence is one
                own = h[first[r] : first[r + 1]]
                x = np.uint64(len(own))
                for y in own:
                    x = W.mix(np.array([x], np.uint64) * np.uint64(3) + y)[0]
                yield i + r, np.array([x], np.uint64)[: len(own)]


def set_id(s: np.ndarray) -> int:
    """63 bits of a set; equal sets have equal ids."""
    return int(W.mix(np.array([W.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0] >> np.uint64(1))


def profile(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: (doc_id, n_shingles, set, key) per document row, and (token, seen) for frequent shingles of a batch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, ids, sets, tokens = batch.num_rows, [], set(), []
            size = np.zeros(n, np.int64)
            for r, s in shingle_sets(batch.column(1)):
                size[r] = len(s)
                ids.append(set_id(s) if len(s) else None)
                if len(s) and ids[-1] not in sets:
                    sets.add(ids[-1])
                    tokens.append(s)
            none = lambda k, t: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(ids, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), batch.column(2)], ["doc_id", "n_shingles", "set", "token", "seen", "key"])
            t = np.sort(np.concatenate([np.zeros(0, np.uint64), *tokens]))
            edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            seen = np.diff(np.append(edge, len(t)))
            often = edge[seen >= FREQUENT]
            k = len(often)
            yield pa.RecordBatch.from_arrays([none(k, batch.schema.field(0).type), none(k, pa.int64()), none(k, pa.int64()), pa.array(t[often].view(np.int64)), pa.array(seen[seen >= FREQUENT]), none(k, pa.int64())], ["doc_id", "n_shingles", "set", "token", "seen", "key"])

    return docs.select("doc_id", "text", row_key().alias("key")).mapInArrow(run, f"doc_id {kind}, n_shingles long, set long, token long, seen long, key long")


def ranked_tokens(found: DataFrame) -> np.ndarray:
    """The most frequent shingles with their counts, by hash: RANKED rows at most."""
    top = found.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(RANKED)
    p = top.toPandas()
    out = np.zeros(len(p), [("token", np.uint64), ("seen", np.int64)])
    out["token"], out["seen"] = p["token"].to_numpy(np.int64).view(np.uint64), p["seen"]
    return np.sort(out, order="token")


def frequency(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The counts of shingles; 0 for those that are not ranked."""
    if not len(known):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(known["token"], s), len(known) - 1)
    return np.where(known["token"][at] == s, known["seen"][at], 0)


def prefix(s: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a set, rarest shingles first, and the number of shared shingles it asks for.

    A partner shares at least T = ceil(0.75 n) of the n shingles, so of the first n - T + l at least l. Longer prefixes
    cost entries but let fewer partners through: entries + VERIFY_COST * partners / l is least for the l taken. Two
    documents that ask for different numbers must share the smaller of them, as both prefixes hold the shorter one.
    """
    n = len(s)
    least = -(-PERCENT * n // 100)
    order = np.lexsort((s, seen)) if seen.any() else np.arange(n)
    most = min(MAX_MATCHES, least)
    partners = np.cumsum(seen[order][: n - least + most])
    matches = np.arange(1, most + 1)
    cost = partners[n - least + matches - 1] * (1 + VERIFY_COST / matches) + matches
    take = int(matches[np.argmin(cost)])
    return order[: n - least + take], take


def postings(docs: DataFrame, ranked: np.ndarray, buckets: int) -> DataFrame:
    """(token, node, n, matches) for all prefix shingles that stand in two sets or more, or are ranked as frequent.

    lo, hi and least are the smallest and largest n and the smallest matches of a shingle's list; 0 for ranked ones.

    Entries travel packed by bucket of the shingle, with half of its hash (the bucket adds bits of the other half; two
    shingles that fall together only let a pair through to be verified). A bucket drops what one set alone has. Ranked
    shingles need no such test: their entries are dealt by set, so no bucket fills up with one shingle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranked)  # RANKED entries at most
    entry = [("token", "<u4"), ("node", "<i8"), ("ask", "<u4"), ("part", "<i4")]

    def run(batches):
        known = shared.value
        for batch in batches:
            done, light, hot = set(), [], []
            for _, s in shingle_sets(batch.column(0)):
                node = set_id(s) if len(s) else None
                if node is None or node in done:
                    continue
                done.add(node)
                seen = frequency(s, known)
                p, take = prefix(s, seen)
                t = s[p]
                e = np.zeros(len(p), entry)
                e["token"], e["node"], e["ask"] = t & np.uint64(0xFFFFFFFF), node, len(s) * 16 + take
                e["part"] = (t >> np.uint64(32)) % np.uint64(buckets)
                light.append(e[seen[p] == 0])
                hot.append(e[seen[p] > 0])
            for kind, parts in ((False, light), (True, hot)):
                e = np.concatenate([np.zeros(0, entry), *parts])
                if not len(e):
                    continue
                deal = e["node"] % buckets if kind else e["part"]
                order = np.argsort(deal.astype(np.int32), kind="stable")
                e, deal = e[order], deal[order]
                edge = np.searchsorted(deal, np.arange(buckets + 1))
                some = np.flatnonzero(edge[1:] > edge[:-1])
                cut = lambda c: pa.array([e[c][edge[i] : edge[i + 1]].tobytes() for i in some], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([kind] * len(some)), cut("token"), cut("node"), cut("ask"), cut("part") if kind else pa.nulls(len(some), pa.binary())], ["bucket", "hot", "tokens", "nodes", "asks", "parts"])

    def shared_only(bucket: int, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, own in rows.groupby("hot"):
            get = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in own[c]])  # noqa: B023, E731
            part = get("parts", "<i4") if kind else np.int64(bucket)
            t = (part.astype(np.int64) << 32) | get("tokens", "<u4").astype(np.int64)
            d, a = get("nodes", "<i8"), get("asks", "<u4").astype(np.int64)
            order = np.lexsort((d, t))
            t, d, a = t[order], d[order], a[order]
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])  # a set may come from several batches
            t, d, a = t[new], d[new], a[new]
            if not kind:
                same = t[1:] == t[:-1]
                some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
                t, d, a = t[some], d[some], a[some]
            n, m = (a // 16).astype(np.int32), (a % 16).astype(np.int32)
            bounds = np.zeros((3, len(t)), np.int32)
            if not kind and len(t):  # the whole list is here
                edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                k = np.diff(np.append(edge, len(t)))
                bounds[:] = [np.repeat(f.reduceat(x, edge), k) for f, x in ((np.minimum, n), (np.maximum, n), (np.minimum, m))]
            out.append(pd.DataFrame({"token": t, "node": d, "n": n, "matches": m, "lo": bounds[0], "hi": bounds[1], "least": bounds[2]}))
        return pd.concat(out)

    packed = docs.select("text").mapInArrow(run, "bucket int, hot boolean, tokens binary, nodes binary, asks binary, parts binary")
    lists = packed.groupBy("bucket").applyInPandas(lambda k, p: shared_only(int(k[0]), p), "token long, node long, n int, matches int, lo int, hi int, least int")
    return keep(lists, "postings")


def asked(nu, mu, nv, mv):
    """Shared prefix shingles without which two sets of nu and nv shingles can't link.

    Of the two prefixes one ends first; all that both sets share up to there stands in both prefixes, and beyond it the
    set has T - l shingles left. So the shared ones plus the larger rest must reach the overlap that PERCENT asks for.
    The multi-match rule, at least the smaller l, holds besides.
    """
    rest = lambda n, m: F.ceil(F.col(n) * PERCENT / 100) - F.col(m)
    overlap = F.ceil((F.col(nu) + F.col(nv)) * PERCENT / (100 + PERCENT))
    return F.greatest(F.least(mu, mv).cast("long"), overlap - F.greatest(rest(nu, mu), rest(nv, mv)))


def promising(lists: DataFrame) -> DataFrame:
    """Posting entries of the sets that may still link, with `share`, the part of a set's shingles that are in lists.

    Whoever links with a set is in a list with it, so its size lies between the least and the largest of that list. What
    `asked` asks for rises up to equal sizes and falls from there, so its least value is at the ends of that range; a set
    that has fewer entries in all can't reach it with anyone. (Rounding moves the ends by less than two.)
    """
    hot, lists = lists.filter("hi = 0").drop("lo", "hi", "least"), lists.withColumnsRenamed({"lo": "_lo", "hi": "_hi", "least": "_m"})
    of_token = hot.groupBy("token").agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"), F.min("matches").alias("_m"))
    each = lists.filter("_hi > 0").unionByName(hot.join(of_token, "token"))
    each = each.withColumn("_lo", F.greatest("_lo", F.ceil(F.col("n") * PERCENT / 100).cast("int"))).withColumn("_hi", F.least("_hi", F.floor(F.col("n") * 100 / PERCENT).cast("int")))
    need = F.least(asked("n", "matches", "_lo", "_m"), asked("n", "matches", "_hi", "_m")) - 2
    sets = each.groupBy("node").agg(F.count("*").alias("_has"), F.min(need).alias("_need"), F.min("n").alias("_n")).filter("_has >= _need")
    left = lists.join(sets.select("node", (F.col("_has") / F.col("_n")).alias("share")), "node")
    return keep(left.select("token", "node", "n", "matches", "share"), "promising")


def squeezed(column):
    """Texts as zstd frames behind their length, as binary values; a null one is empty."""
    codec = pa.Codec("zstd")
    for i, buf, offs in W.blocks(column):
        cut = [buf[offs[r] : offs[r + 1]].tobytes() for r in range(len(offs) - 1)]
        yield pa.array([len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in cut], pa.binary())


def squeezed_sets(column):
    """As `shingle_sets`, of squeezed texts; a few MB of them are open at a time."""
    codec, first, cut, size = pa.Codec("zstd"), 0, [], 0
    for r, x in enumerate(column):
        x = x.as_py()
        n = int.from_bytes(x[:8], "little")
        if cut and size + n > W.BLOCK_BYTES:
            yield from ((first + i, s) for i, s in shingle_sets(pa.array(cut, pa.binary())))
            first, cut, size = r, [], 0
        cut.append(codec.decompress(x[8:], n, asbytes=True))
        size += n
    if cut:
        yield from ((first + i, s) for i, s in shingle_sets(pa.array(cut, pa.binary())))


class Texts:
    """One text for each set in the lists, squeezed and dealt once into buckets: a step that asks for some moves ids alone."""

    def __init__(self, docs: DataFrame, found: DataFrame, lists: DataFrame):
        def run(batches):
            for batch in batches:
                texts = pa.chunked_array(squeezed(batch.column(1)), pa.binary()).combine_chunks()
                yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["_key", "text"])

        # rows that share a doc_id have each their own text
        first = found.filter("set is not null").groupBy(F.col("set").alias("node")).agg(F.min("key").alias("_wanted"))
        self.names = keep(first.join(lists.select("node").distinct(), "node", "left_semi"), "names")
        rows = docs.select(row_key().alias("_key"), "text").mapInArrow(run, "_key long, text binary")
        rows = rows.join(self.names, F.col("_key") == F.col("_wanted"), "left_semi")
        self.rows = keep_dealt(rows.dropDuplicates(["_key"]), "_key", "texts")

    def of(self, nodes: DataFrame) -> DataFrame:
        """Rows of distinct nodes, whatever else they have, with `text`."""
        return nodes.join(self.names, "node").join(self.rows, F.col("_wanted") == F.col("_key")).select(*nodes.columns, "text")


def verify(pairs: DataFrame, texts: Texts, once: bool = False) -> DataFrame:
    """Of pairs (u, v) of nodes those whose shingle sets link, by their whole texts. `once`: no u stands in two pairs."""
    def run(batches):
        for batch in batches:
            keep_at = [100 * m >= PERCENT * (len(a) + len(b) - m) for (_, a), (_, b) in zip(squeezed_sets(batch.column(2)), squeezed_sets(batch.column(3)), strict=True) for m in [len(np.intersect1d(a, b, assume_unique=True))]]
            mask = pa.array(keep_at, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    pairs = keep(pairs.select("u", "v"), "pairs")
    if once:
        a = texts.of(pairs.select(F.col("u").alias("node"), "v")).toDF("u", "v", "a")
    else:
        a = pairs.join(texts.of(pairs.select("u").distinct().toDF("node")).toDF("u", "a"), "u")
    b = texts.of(pairs.select("v").distinct().toDF("node")).toDF("v", "b")
    return a.join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Posting entries with their component, without shingles whose sets are all in one."""
    if labels is None:  # no links yet
        return lists.withColumn("root", F.col("node"))
    named = lists.join(labels.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = named.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("token")
    return keep(named.join(mixed, "token"), "open")


def rivals(open_: DataFrame) -> DataFrame:
    """Posting entries of the sets that may link outside their component, with the size classes `ok` of such partners.

    For each set and class of sizes (steps of 2 %) the shingles are counted whose lists hold a set of that class in
    another component. Fewer than `asked` for any size of the class met there, and no set of the class can link. A list
    gives a set one row per class, so this stays linear where pairs would not.
    """
    each = open_.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.02))).cast("int"))
    classes = each.groupBy("token", F.col("size").alias("_s")).agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.min("n").alias("_lo"), F.max("n").alias("_hi"), F.min("matches").alias("_m"))
    met = each.join(classes, "token").filter((100 * F.col("_hi") >= PERCENT * F.col("n")) & (PERCENT * F.col("_lo") <= 100 * F.col("n")) & ((F.col("_a") != F.col("root")) | (F.col("_b") != F.col("root"))))
    need = F.least(asked("n", "matches", "_lo", "_m"), asked("n", "matches", "_hi", "_m")) - 2
    ok = met.groupBy("node", "_s").agg(F.count("*").alias("_c"), F.min(need).alias("_need")).filter("_c >= _need").groupBy("node").agg(F.collect_set("_s").alias("ok"))  # some 30 classes at most
    left = each.join(ok, "node")
    mixed = left.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("token")
    return keep(left.join(mixed, "token"), "rivals")


def needed(nu, nv):
    """Shared shingles with which two sets of nu and nv shingles link."""
    return F.ceil((F.col(nu) + F.col(nv)) * PERCENT / (100 + PERCENT))


def past_pivots(left: DataFrame, texts: Texts, ranked: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Posting entries with `cap`, and the pairs (u, v) that caps leave out of the lists but that may link.

    Large families hold many sets that fall just short of a link, too near for prefixes to tell. So each set x is held
    against one pivot c, of the sets with the largest shared part in its lists the one that it meets most often. With
    any y it shares at most what it shares with c, and what y has of x's other shingles. Where y is so large (beyond
    `cap`) that the former can't be enough, y must have some of the latter: these few shingles, looked up among all
    shingles of the sets in lists, find every such y, and the lists themselves need not pair the two.

    Of m other shingles a y of which k are needed has at least l among the first m - k + l, rarest first. k grows with
    y's size, so each shingle is looked up for sizes up to its own `most` only, and the frequent ones for few.
    """
    shared = left.sparkSession.sparkContext.broadcast(ranked)  # RANKED entries at most
    entries = left.select("token", "node", "root", "n", "share")
    lead = entries.groupBy("token").agg(F.max(F.struct("share", "node")).alias("_l")).select("token", F.col("_l.node").alias("pivot"))
    met = entries.join(lead, "token").filter("node <> pivot").groupBy("node", "root", "n", "pivot").agg(F.count("*").alias("_c"))
    chosen = met.groupBy("node", "root", "n").agg(F.max(F.struct("_c", "pivot")).alias("_p")).select("node", "root", "n", F.col("_p.pivot").alias("pivot"))

    def rest(batches):
        known = shared.value
        for batch in batches:
            heads, tokens, most = [], [], []
            for (r, x), (_, c) in zip(squeezed_sets(batch.column(3)), squeezed_sets(batch.column(4)), strict=True):
                other = np.setdiff1d(x, c, assume_unique=True)
                n, m = len(x), len(other)
                other = other[np.lexsort((other, frequency(other, known)))]
                # sizes of partners that need no more shingles than these, without the others and from each of them on
                largest = (n - m + np.append(0, m - np.arange(m) + REST_MATCHES - 1)) * (100 + PERCENT) // PERCENT - n
                asks = largest[1:] >= max(-(-PERCENT * n // 100), largest[0] + 1)
                heads.append((r, n - m, largest[0], int(asks.sum())))
                tokens.append(other[asks].view(np.int64))
                most.append(largest[1:][asks])
            if heads:
                k = np.array([h[3] + 1 for h in heads])  # one row without a shingle for each set
                row, both, cap = (np.repeat(np.array([h[i] for h in heads]), k) for i in range(3))
                first = np.cumsum(k) - k
                token, size = np.zeros(int(k.sum()), np.int64), np.zeros(int(k.sum()), np.int32)
                place = np.ones(len(token), bool)
                place[first] = False
                token[place], size[place] = np.concatenate(tokens), np.concatenate(most)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(row)) for i in range(3)], pa.array(both.astype(np.int32)), pa.array(cap.astype(np.int32)), pa.array(size), pa.array(token, mask=~place)], ["u", "ru", "nu", "both", "cap", "most", "token"])

    def whole(batches):
        for batch in batches:
            for r, s in squeezed_sets(batch.column(3)):
                n = len(s)
                yield pa.RecordBatch.from_arrays([*[pa.repeat(batch.column(i)[r], n) for i in range(3)], pa.array(s.view(np.int64))], ["v", "rv", "nv", "token"])

    chosen = keep(chosen, "chosen")
    pivots = texts.of(chosen.select("pivot").distinct().toDF("node")).toDF("pivot", "_t")
    probes = keep(texts.of(chosen).join(pivots, "pivot").select("node", "root", "n", "text", "_t").mapInArrow(rest, "u long, ru long, nu int, both int, cap int, most int, token long"), "probes")
    index = texts.of(entries.select("node", "root", "n").distinct()).mapInArrow(whole, "v long, rv long, nv int, token long")
    near = 100 * F.least("nu", "nv") >= PERCENT * F.greatest("nu", "nv")
    pairs = probes.filter("token is not null").join(index, "token").filter((F.col("ru") != F.col("rv")) & near & (F.col("nv") > F.col("cap")) & (F.col("nv") <= F.col("most")))
    enough = F.least(F.lit(REST_MATCHES), needed("nu", "nv") - F.col("both"))
    pairs = pairs.groupBy("u", "nu", "both", "v", "nv").agg(F.count("*").alias("_c")).filter(F.col("_c") >= enough).select("u", "v")
    # the largest partner that the shingles shared with the pivot may be enough for
    caps = probes.filter("token is null").select(F.col("u").alias("node"), "cap")
    return left.join(caps, "node", "left"), pairs


def links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node of u's component, over set ids.

    Large groups of near copies would make pairs of all with all. So each set first tries one partner: of the leaders
    of its shingles the one met most often, if that is often enough to be worth a try. The leader of a shingle is first
    the set with the largest part of its shingles shared, which is nearest to what the group was copied from, then one
    picked by a hash. What links falls into components, and shingles whose sets are all in one component need no more
    pairs. What is left after these rounds is tried in full, by the multi-match rule.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = ranked_tokens(found)
    lists = promising(postings(docs, ranked, buckets))
    texts = Texts(docs, found, lists)
    near = 100 * F.least("nu", "nv") >= PERCENT * F.greatest("nu", "nv")
    labels = None
    for round_ in range(PROBES):
        open_ = _labelled(lists, labels)
        rank = F.xxhash64("node", F.lit(round_)) if round_ % 2 else -F.col("share")
        order = F.struct(rank.alias("_h"), "node", "root", "n", "matches")
        leader = open_.groupBy("token").agg(F.min(order).alias("_l"))
        tries = open_.join(leader, "token").filter(F.col("root") != F.col("_l.root"))
        tries = tries.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("matches").alias("mu"), F.col("_l.node").alias("v"), F.col("_l.n").alias("nv"), F.col("_l.matches").alias("mv")).filter(near)
        tries = tries.groupBy("u", "nu", "mu", "v", "nv", "mv").agg(F.count("*").alias("_c")).filter(2 * F.col("_c") >= asked("nu", "mu", "nv", "mv"))
        pairs = tries.groupBy("u").agg(F.max(F.struct("_c", "v")).alias("_b")).select("u", F.col("_b.v").alias("v"))
        new = verify(pairs, texts, once=True)
        labels = components(new if labels is None else labels.union(new))  # labels hold all that earlier links reached
    left, more = past_pivots(rivals(rivals(_labelled(lists, labels)).drop("size", "ok")), texts, ranked)
    ends = ("node", "root", "n", "matches", "size", "ok", "cap")
    a, b = (left.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ends]) for x in "uv")
    a, b = (d.withColumnsRenamed({f"node_{x}": x, f"n_{x}": f"n{x}", f"matches_{x}": f"m{x}"}) for d, x in ((a, "u"), (b, "v")))
    may = F.array_contains("ok_u", F.col("size_v")) & F.array_contains("ok_v", F.col("size_u"))
    may &= F.coalesce(F.col("nv") <= F.col("cap_u"), F.lit(True)) & F.coalesce(F.col("nu") <= F.col("cap_v"), F.lit(True))
    pairs = a.join(b, "token").filter((F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & near & may)
    pairs = pairs.groupBy("u", "nu", "mu", "v", "nv", "mv").agg(F.count("*").alias("_c")).filter(F.col("_c") >= asked("nu", "mu", "nv", "mv")).select("u", "v")
    both = pairs.union(more.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()
    new = verify(both, texts)
    return components(new if labels is None else labels.union(new))


def join(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id.

    Documents with equal sets fall together first; the others meet through prefixes of their sets, and every pair that
    is let through is verified on the whole sets. component_id is the smallest doc_id reachable by links.

    Texts without words, and null ones, link with nothing; rows that share a doc_id link as the texts they have, and
    if those differ the id may stand in two components; a null doc_id links with nothing and has a null component; an
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    found = keep(profile(docs), "sets")
    rows = found.filter("token is null").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set")).alias("set"))
    nodes = rows.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("_first"))
    labels = links(docs.filter("doc_id is not null"), found.filter("token is not null or doc_id is not null"))
    named = nodes.join(labels, F.col("set") == F.col("u"), "left").select("set", "_first", F.coalesce("v", "set").alias("root"))
    smallest = named.groupBy("root").agg(F.min("_first").alias("_least"))
    done = named.join(smallest, "root").select(F.col("set").alias("_set"), "_least")
    return rows.join(done, F.col("set") == F.col("_set"), "left").select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """Of each component of rows the one with the smallest doc_id; rows without words stay, once for each doc_id and text.

    Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, stay or go each by their own text.
    Ids come before null ones; of equal ids that with the smallest hash of its row stays, in every run the same.
    """
    found = keep(profile(docs), "sets")
    me = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "key").alias("_me")
    rows = found.filter("set is not null").select("set", "key", me)
    named = rows.groupBy("set").agg(F.min("_me").alias("_me")).join(links(docs, found), F.col("set") == F.col("u"), "left")
    stay = named.groupBy(F.coalesce("v", "set").alias("root")).agg(F.min("_me").alias("_me")).select(F.col("_me.key").alias("key"))
    gone = rows.select("key").join(stay, "key", "left_anti").distinct().select(F.col("key").alias("_gone"))
    # nothing tells rows apart that have neither words nor an id
    bare = F.col("_row.doc_id").isNull() & (F.translate(F.coalesce("_row.text", F.lit("")), " \t\n\x0b\f\r", "") == "")
    every = rows_of(docs)
    left = every.filter(~bare).withColumn("_key", F.xxhash64("_row.doc_id", "_row.text")).join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    once = left.groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return once.select("_row").union(every.filter(bare)).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(join(table(spark, sf_dir, "documents")))
