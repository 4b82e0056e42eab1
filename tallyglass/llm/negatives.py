"""Hard negatives: clusters of anchors share candidate lists sorted by an angular bound, walked until no better one can follow."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import keep, scratch, table
from tallyglass.llm.files import Output, Ranges

NAME = "op13_negatives"
#: Rows whose vec_id is divisible by this are anchors; by SHIFTED, get the next label.
ANCHORS = 50
SHIFTED = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Anchors on which the cluster centres are fitted, at most; centres at most, and anchors for each centre.
SAMPLE_ANCHORS = 20_000
CENTRES = 64
MEMBERS = 64
#: Anchors that walk together, vectors of one list, lists that one task walks in turn.
PACK = 1024
SLICE = 1 << 16
LISTS = 8
STEP = 512
_NONE = -(1 << 62)
_PLACE = "uri string, at long, size long, n long, dim int, kind string"


def whole(column: pa.Array) -> list:
    """floor(SCALE * x) of each value as doubles; None where it is null or holds null or non-finite components."""
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        data = np.floor(SCALE * flat)
    offs = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    ok = column.is_valid().to_pylist()
    return [data[a:b] if v and np.isfinite(data[a:b]).all() else None for a, b, v in zip(offs, offs[1:], ok, strict=False)]


def narrow(x: np.ndarray) -> str:
    """The smallest type that holds the values exactly."""
    top = np.abs(x).max(initial=0)
    return "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where no sum can leave them, else in Python's integers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return a @ b.T
    big = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return big(a) @ big(b).T


def labelled(vecs: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) of the rows that may take part, with the shifted labels."""
    label = F.when(F.pmod("vec_id", F.lit(SHIFTED)) == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    some = vecs.filter("vec_id is not null and label is not null and embedding is not null")
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), label.cast("long").alias("label"))


class Packed:
    """Blocks of (ids, labels, vectors) of one length in a file."""

    def __init__(self, folder: str):
        self.out = Output(folder, ".vec")

    def add(self, ids, labels, x: np.ndarray) -> dict:
        kind, at = narrow(x), self.out.size
        for block in (np.asarray(ids, "<i8"), np.asarray(labels, "<i8"), x.astype(kind)):
            self.out.write(block.tobytes())
        return {"uri": self.out.uri, "at": at, "size": self.out.size - at, "n": len(x), "dim": x.shape[1], "kind": kind}

    def close(self):
        self.out.close()


def load(place: dict):
    r = Ranges(place["uri"])
    data, n = r.read(place["at"], place["size"]), place["n"]
    r.close()
    x = np.frombuffer(data, place["kind"], offset=16 * n).reshape(n, place["dim"]).astype(np.float64)
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n), x


def slices(rows: DataFrame, per_slice: int) -> DataFrame:
    """Writes all vectors once, in blocks by length, and returns where they are."""
    folder = scratch(rows.sparkSession, "slices")

    def run(batches):
        out, held, done = None, {}, []

        def flush(dim):
            nonlocal out
            out = out or Packed(folder)
            ids, labels, x = zip(*held.pop(dim), strict=True)
            done.append(out.add(np.concatenate(ids), np.concatenate(labels), np.concatenate(x)))

        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = whole(batch.column(1))
            size = np.array([-1 if v is None else len(v) for v in x], np.int64)
            for dim in np.unique(size[size >= 0]).tolist():
                at = np.flatnonzero(size == dim)
                for i in range(0, len(at), per_slice):
                    some = at[i : i + per_slice]
                    held.setdefault(dim, []).append((ids[some], labels[some], np.array([x[j] for j in some]).reshape(len(some), dim)))
                    if sum(len(h[0]) for h in held[dim]) >= per_slice:
                        flush(dim)
        for dim in list(held):
            flush(dim)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist(done, pa.schema([("uri", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("kind", pa.string())]))

    return keep(rows.mapInArrow(run, _PLACE), "slices")


def anchors(rows: DataFrame) -> DataFrame:
    """(anchor, anchor_id, label, dim, vec): anchor names id, label and content; repeated rows are one anchor."""
    def run(batches):
        for batch in batches:
            x = whole(batch.column(1))
            ok = pa.array([v is not None for v in x], pa.bool_())
            some = [v for v in x if v is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(2).filter(ok), pa.array([len(v) for v in some], pa.int32()), pa.array([v.astype("<f8").tobytes() for v in some], pa.binary())], ["anchor_id", "label", "dim", "vec"])

    found = rows.filter(F.col("vec_id") % ANCHORS == 0).mapInArrow(run, "anchor_id long, label long, dim int, vec binary")
    name = F.concat_ws("|", "anchor_id", "label", F.md5("vec")).alias("anchor")
    return keep(found.select(name, "*").dropDuplicates(["anchor"]), "anchors")


def direction(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    y = np.divide(x, top, out=np.zeros_like(x), where=top > 0)
    n = np.sqrt((y * y).sum(axis=1, keepdims=True))
    return np.divide(y, n, out=np.zeros_like(y), where=n > 0)


def centres(found: DataFrame, total: int, dim: int) -> np.ndarray:
    """Cluster centres of the anchors of one length, by a few rounds of spherical k-means on a bounded sample."""
    step = -(-total // SAMPLE_ANCHORS)
    some = found.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("anchor"), F.lit(step)) == 0)).select("anchor", "vec").toPandas().sort_values("anchor")
    x = direction(np.frombuffer(b"".join(some["vec"]), "<f8").reshape(len(some), dim))
    if not len(x):
        return np.zeros((1, dim))
    c = x[np.linspace(0, len(x) - 1, max(1, min(CENTRES, total // MEMBERS, len(x)))).astype(int)]
    for _ in range(8):
        at = (x @ c.T).argmax(axis=1)
        c = direction(np.stack([x[at == k].sum(axis=0) if (at == k).any() else c[k] for k in range(len(c))]))
    return c


def packs(found: DataFrame, extra: list[str], per_pack: int) -> DataFrame:
    """Anchors dealt to clusters, and within a cluster to packs of a bounded number: one row (pack, dim, and arrays) each."""
    count = {r.dim: r["count"] for r in found.groupBy("dim").count().collect()}  # one row per vector length
    shared = found.sparkSession.sparkContext.broadcast({d: centres(found, n, d) for d, n in count.items()})  # CENTRES of each length at most

    def nearest(batches):
        for batch in batches:
            dims = batch.column(1).to_pylist()
            at = [int((direction(np.frombuffer(v, "<f8")[None]) @ shared.value[d].T).argmax()) for d, v in zip(dims, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32())], ["_anchor", "cluster"])

    dealt = found.select("anchor", "dim", "vec").mapInArrow(nearest, "_anchor string, cluster int")
    dealt = found.join(dealt, F.col("anchor") == F.col("_anchor")).drop("_anchor")
    many = dealt.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / per_pack).cast("int").alias("_p"))
    dealt = dealt.join(many, ["dim", "cluster"]).withColumn("part", F.pmod(F.xxhash64("anchor"), "_p"))
    row = F.struct("anchor", "anchor_id", "label", "vec", *extra)
    return dealt.groupBy("dim", "cluster", "part").agg(F.collect_list(row).alias("rows"))  # about per_pack rows each


def units(packed: DataFrame, places: DataFrame, lists: int) -> DataFrame:
    """Every pack with every group of slices of its length: (pack, places), one row for each task's work."""
    n = places.groupBy("dim").agg(F.ceil(F.count("*") / lists).cast("int").alias("_n"))
    group = F.pmod(F.xxhash64("uri", "at"), "_n").alias("g")
    grouped = places.join(n, "dim").groupBy("dim", group).agg(F.collect_list(F.struct("uri", "at", "size", "n", "dim", "kind")).alias("places"))
    return packed.join(grouped, "dim")


def walk(rows: list[dict], places: list[dict], most: int, floor: np.ndarray, cap: np.ndarray, same: bool):
    """Best candidates of each member in these lists: (member, band, id, score), `most` of a band.

    Each list is sorted once, by the norm times the cosine of the least angle that any member can have to the vector:
    its angle to the members' mean less the widest angle of a member. Members walk it together; one stops where, in all
    its bands, what may follow is below the band or below all that the band already holds. Bands are whole numbers
    floor..cap, one column for each; best scores come first, then smallest ids.
    """
    u = np.stack([np.frombuffer(r["vec"], "<f8") for r in rows])
    me, label = np.array([r["anchor_id"] for r in rows]), np.array([r["label"] for r in rows])
    bands = floor.shape[1]
    to_unit = direction(u)
    centre = direction(to_unit.sum(axis=0, keepdims=True))[0]
    wide = np.arccos(np.clip(to_unit @ centre, -1, 1)).max() + 1e-7
    length = np.sqrt((u * u).sum(axis=1))
    worst = floor.copy()  # of what a full band holds, the last
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, floor.dtype))
    for place in places:
        ids, labels, x = load(place)
        size = np.sqrt((x * x).sum(axis=1))
        apart = np.arccos(np.clip(direction(x) @ centre, -1, 1))
        bound = size * np.cos(np.minimum(np.maximum(apart - wide, 0), np.pi))
        bound = np.where(size > 0, bound + 1e-6 * size, 0)
        order = np.argsort(-bound, kind="stable")
        i, step, going = 0, STEP, np.arange(len(u))
        while i < len(order):
            ahead = bound[order[i]] * length[going]
            going = going[(ahead[:, None] * (1 + np.sign(ahead[:, None]) * 1e-9) + 1e-3 >= worst[going].astype(np.float64)).any(axis=1)]
            if not len(going):
                break
            at = order[i : i + step]
            s = dots(u[going], x[at])
            ok = (label[going][:, None] == labels[at]) == same
            ok &= me[going][:, None] != ids[at]
            new = []
            for b in range(bands):
                r, c = np.nonzero(ok & (s >= worst[going, b][:, None]) & (s <= cap[going, b][:, None]))
                new.append((going[r], np.full(len(r), b), ids[at[c]], s[r, c].astype(floor.dtype)))
            row, band, cand, score = (np.concatenate([h, *n]) for h, n in zip(held, zip(*new, strict=True), strict=True))
            keep_ = np.lexsort((cand, -score, band, row))
            row, band, cand, score = row[keep_], band[keep_], cand[keep_], score[keep_]
            group = row * bands + band
            first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
            place_ = np.arange(len(group)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(group) else np.zeros(0, int)
            top = place_ < most
            held = row[top], band[top], cand[top], score[top]
            last = place_ == most - 1
            worst[row[last], band[last]] = np.maximum(worst[row[last], band[last]], score[last])
            i, step = i + len(at), min(2 * step, 8 * STEP)
    return held


def spread(df: DataFrame) -> DataFrame:
    """Deals the work out one task for each few rows; AQE merges no partitions of a given number."""
    n = df.count()
    return df.repartition(max(1, min(n, 64 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))), F.xxhash64("cluster", "part", F.col("places")[0]["uri"], F.col("places")[0]["at"]))


def mine(vecs: DataFrame, per_pack: int = PACK, per_slice: int = SLICE, lists: int = LISTS) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors are written once, in slices; each pack of anchors of one cluster walks every slice, first for its positives,
    then for the negatives between LOW and HIGH percent of their scores. What the slices give is merged per anchor.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; vectors of different
    lengths never meet; zero vectors and empty ones score 0. Equal rows are one anchor, but each of them is a candidate;
    rows that share a vec_id but differ are anchors of their own, and none is a candidate of its own id. Scores are
    exact; one beyond 64 bits is told as the nearest 64-bit number. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    rows = labelled(vecs)
    places, found = slices(rows, per_slice), anchors(rows)
    clip = lambda s: np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in s], np.int64)
    kind = np.dtype(np.int64)

    def positives(batches):
        for p in batches:
            for own, where in zip(p["rows"], p["places"], strict=True):
                own, where = [r if isinstance(r, dict) else r.asDict() for r in own], [r if isinstance(r, dict) else r.asDict() for r in where]
                big = any(w["kind"] == "<f8" for w in where)
                shape = (len(own), 1)
                t = object if big else kind
                row, _, cand, score = walk(own, where, POSITIVES, np.full(shape, -(1 << 200) if big else _NONE, t), np.full(shape, 1 << 200 if big else -_NONE, t), True)
                if len(row):  # empty columns have no type of their own
                    yield pd.DataFrame({"anchor": [own[i]["anchor"] for i in row], "positive_id": cand, "score": [str(int(s)) for s in score]})

    number = F.col("score").cast("decimal(38,0)")
    first = units(packs(found, [], per_pack), places, lists)
    first = spread(keep(first, "units")).select("rows", "places").mapInPandas(positives, "anchor string, positive_id long, score string")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    chosen = first.withColumn("score", number).withColumn("p", F.row_number().over(best)).filter(F.col("p") <= POSITIVES)
    chosen = keep(chosen.select("anchor", "p", "positive_id", F.col("score").cast("string").alias("score")), "positives")

    def negatives(batches):
        for p in batches:
            for own, where in zip(p["rows"], p["places"], strict=True):
                own, where = [r if isinstance(r, dict) else r.asDict() for r in own], [r if isinstance(r, dict) else r.asDict() for r in where]
                big = any(w["kind"] == "<f8" for w in where)
                lo, hi = [[-_NONE] * POSITIVES for _ in own], [[0] * POSITIVES for _ in own]  # nothing is in a band without a positive
                for a, b, r in zip(lo, hi, own, strict=True):
                    for s in r["scores"]:
                        s = s if isinstance(s, dict) else s.asDict()
                        a[s["p"] - 1], b[s["p"] - 1] = -(-LOW * int(s["score"]) // 100), HIGH * int(s["score"]) // 100
                t = object if big else kind
                row, band, cand, score = walk(own, where, NEGATIVES, np.array(lo, t), np.array(hi, t), False)
                if len(row):
                    yield pd.DataFrame({"anchor": [own[i]["anchor"] for i in row], "p": band + 1, "negative_id": cand, "score": [str(int(s)) for s in score]})

    scored = found.join(chosen.groupBy("anchor").agg(F.collect_list(F.struct("p", "score")).alias("scores")), "anchor")  # POSITIVES each
    second = units(packs(scored, ["scores"], per_pack), places, lists)
    second = spread(keep(second, "units")).select("rows", "places").mapInPandas(negatives, "anchor string, p int, negative_id long, score string")
    best = Window.partitionBy("anchor", "p").orderBy(F.desc("score"), "negative_id")
    some = second.withColumn("score", number).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEGATIVES)
    top = lambda c: F.greatest(F.least(c, F.lit((1 << 63) - 1).cast("decimal(38,0)")), F.lit(-(1 << 63)).cast("decimal(38,0)")).cast("long")
    out = some.withColumnRenamed("score", "_n").join(chosen.withColumnRenamed("score", "_s"), ["anchor", "p"]).join(found.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", top(F.col("_s").cast("decimal(38,0)")).alias("positive_score"), top(F.col("_n")).alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
           list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % {ANCHORS} = 0 AND a.vec_id <> b.vec_id),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
