"""Embedding near-duplicates: an exact range join in the angular metric over cells around pivots."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm.common import keep, table
from tallyglass.llm.graph import components

NAME = "op11_metric"
#: Vectors of one label link at this cosine or more.
COSINE = 0.93
#: Vectors that a cell is meant to hold, and the most that one task compares with as many others.
CELL = 8192
#: Pivots of one label at most; cells beyond that grow and are compared block by block.
PIVOTS = 256
#: Vectors among which the pivots of a label are chosen, for each pivot.
CHOICES = 16
#: Room for rounding: angles are right to far less, cosines this near to the limit are summed exactly.
ROOM = 1e-7
CLOSE = 1e-9


def vectors(column: pa.Array) -> tuple[list, np.dtype]:
    """Each value as a numpy row, None where it is null, empty, zero or holds null or non-finite components."""
    flat = column.flatten()
    kind = np.dtype("<f4") if pa.types.is_float32(flat.type) else np.dtype("<f8")
    data = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).astype(kind)
    offs = np.concatenate([[0], np.cumsum(np.array([0 if v is None else v for v in pc.list_value_length(column).to_pylist()], np.int64))])
    out = []
    for a, b, ok in zip(offs, offs[1:], column.is_valid().to_pylist(), strict=False):
        v = data[a:b] + kind.type(0)  # no negative zero
        out.append(v if ok and np.isfinite(v).all() and v.any() else None)
    return out, kind


def unit(blobs, kind: np.dtype) -> np.ndarray:
    """Packed vectors of one length as rows of length 1, in double precision."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    dot = lambda a, b: math.fsum((a * b).tolist())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def prepare(vecs: DataFrame) -> DataFrame:
    """(vec_id, node, part, vec): node names the content (128 bits), part the label and length; both null without links."""
    kind = vecs.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, _ = vectors(batch.column(1))
            parts = [f"{lb}|{len(v)}" if v is not None and lb is not None and i is not None else None for v, lb, i in zip(rows, batch.column(2).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            blobs = [v.tobytes() if p else None for v, p in zip(rows, parts, strict=True)]
            nodes = [hashlib.blake2b(p.encode() + b"\0" + b, digest_size=16).hexdigest() if p else None for p, b in zip(parts, blobs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.string()), pa.array(parts, pa.string()), pa.array(blobs, pa.binary())], ["vec_id", "node", "part", "vec"])

    number = "array<float>" if isinstance(vecs.schema["embedding"].dataType.elementType, T.FloatType) else "array<double>"
    return vecs.select("vec_id", F.col("embedding").cast(number).alias("embedding"), F.col("label").cast("string").alias("label")).mapInArrow(run, f"vec_id {kind}, node string, part string, vec binary")


def choose(x: np.ndarray, k: int) -> np.ndarray:
    """k of the rows, each the farthest from those chosen before; fewer if the rest equal them."""
    taken, near = [0], angle(x @ x[0])
    while len(taken) < k and near.max() > ROOM:
        taken.append(int(np.argmax(near)))
        near = np.minimum(near, angle(x @ x[taken[-1]]))
    return x[taken]


def pivots(items: DataFrame, kind: np.dtype, cell: int, most: int) -> dict[str, np.ndarray]:
    """Pivots of the parts that hold more than one cell's vectors: `most` of a part, one for each `cell` vectors at most."""
    crowded = {r.part: r["count"] for r in items.groupBy("part").count().filter(F.col("count") > cell).collect()}  # one for each `cell` vectors at most
    if not crowded:
        return {}
    wanted = {p: min(most, -(-n // cell)) for p, n in crowded.items()}
    step = items.sparkSession.createDataFrame([(p, -(-n // (CHOICES * wanted[p]))) for p, n in crowded.items()], "part string, step long")
    some = items.join(step, "part").filter(F.pmod(F.xxhash64("node"), "step") == 0).select("part", "node", "vec").toPandas().sort_values("node")
    return {p: choose(unit(own["vec"], kind), wanted[p]) for p, own in some.groupby("part")}


def compare(rows: pd.DataFrame, kind: np.dtype, cosine: float) -> pd.DataFrame:
    """(node, weight, root): for each home vector how many vectors it links with, and the smallest node linked here.

    Both sides are sorted by their angle to the pivot; a link joins angles that differ by no more than its own, so each
    strip of home vectors meets only the others in its band.
    """
    limit = math.acos(cosine) + ROOM
    home, others = (rows[rows["home"] == h].sort_values(["alpha", "node"], ignore_index=True) for h in (True, False))
    if not len(home) or not len(others):
        return pd.DataFrame({"node": [], "weight": np.zeros(0, np.int64), "root": []}, dtype=object)
    x, y = unit(home["vec"], kind), unit(others["vec"], kind)
    a, b, m = home["alpha"].to_numpy(), others["alpha"].to_numpy(), others["m"].to_numpy(np.float64)
    linked = np.zeros((len(x), len(y)), bool)
    for i in range(0, len(x), 512):
        lo, hi = np.searchsorted(b, a[i] - limit), np.searchsorted(b, a[i : i + 512][-1] + limit, "right")
        c = x[i : i + 512] @ y[lo:hi].T
        linked[i : i + 512, lo:hi] = c >= cosine
        for p, q in zip(*np.nonzero(np.abs(c - cosine) < CLOSE), strict=True):
            linked[i + p, lo + q] = exact_cosine(x[i + p], y[lo + q]) >= cosine
    weight = np.concatenate([linked[i : i + 512] @ m for i in range(0, len(x), 512)])
    hn, on = home["node"].to_numpy(), others["node"].to_numpy()
    root_h, root_o = np.full(len(x), None, object), np.full(len(y), None, object)
    open_ = linked.any(axis=1)
    for r in range(len(x)):
        if not open_[r]:
            continue
        rows_, cols_ = np.zeros(len(x), bool), np.zeros(len(y), bool)
        front = np.array([r])
        while len(front):
            rows_[front] = True
            new = np.flatnonzero(linked[front].any(axis=0) & ~cols_)
            cols_[new] = True
            front = np.flatnonzero(linked[:, new].any(axis=1) & ~rows_)
        open_[rows_] = False
        least = min(hn[rows_].min(), on[cols_].min())
        root_h[rows_], root_o[cols_] = least, least
    reached = np.flatnonzero([r is not None and r != n for r, n in zip(root_o, on, strict=True)])
    node, root = np.concatenate([hn, on[reached]]), np.concatenate([root_h, root_o[reached]])
    return pd.DataFrame({"node": pd.Series(node, dtype=object), "weight": np.concatenate([weight, np.zeros(len(reached))]).astype(np.int64), "root": pd.Series(root, dtype=object)})


def cells(items: DataFrame, kind: np.dtype, cosine: float, cell: int, most: int) -> DataFrame:
    """(part, cell, i, j, home, node, m, alpha, vec): what each task compares, homes with all that may be near them.

    A vector's home is the cell of its nearest pivot, at angle h. With t the angle of a link, a vector linked with a
    member of another cell lies, by the triangle inequality, within h + 2 t of that cell's pivot, and within t of the
    cell's radius; so it is copied to the cells where both hold. A cell with more members than one task takes is cut
    into blocks, and each pair of blocks is a task.
    """
    shared = items.sparkSession.sparkContext.broadcast(pivots(items, kind, cell, most))  # PIVOTS of a part at most, one for each CELL vectors
    limit = math.acos(cosine) + ROOM

    def place(batches):
        for batch in batches:
            part = batch.column(1).to_pylist()
            n = len(part)
            home, alpha, near, far = np.zeros(n, np.int32), np.zeros(n), [[]] * n, [[]] * n
            own = pd.Series(range(n)).groupby(part)
            for p, at in own:
                if p in shared.value:
                    a = angle(unit(batch.column(3).take(pa.array(at.to_numpy())).to_pylist(), kind) @ shared.value[p].T)
                    h = a.argmin(axis=1)
                    for i, row, k in zip(at, a, h, strict=True):
                        home[i], alpha[i] = k, row[k]
                        some = np.flatnonzero((row <= row[k] + 2 * limit) & (np.arange(len(row)) != k))
                        near[i], far[i] = some.tolist(), row[some].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(alpha), pa.array(near, pa.list_(pa.int32())), pa.array(far, pa.list_(pa.float64()))], [*batch.schema.names, "cell", "alpha", "near", "far"])

    placed = keep(items.select("node", "part", "m", "vec").mapInArrow(place, "node string, part string, m long, vec binary, cell int, alpha double, near array<int>, far array<double>"), "placed")
    homes = placed.groupBy("part", "cell").agg(F.count("*").alias("_h"), F.max("alpha").alias("_r"))
    guests = placed.select("node", "part", "m", "vec", F.explode(F.arrays_zip("near", "far")).alias("_g")).select("node", "part", "m", "vec", F.col("_g.near").alias("cell"), F.col("_g.far").alias("alpha"))
    guests = guests.join(homes, ["part", "cell"]).filter(F.col("alpha") <= F.col("_r") + limit)
    visits = guests.groupBy("part", "cell").agg(F.count("*").alias("_v"))
    blocks = homes.join(visits, ["part", "cell"], "left").select("part", "cell", F.ceil(F.col("_h") / cell).cast("int").alias("_a"), F.ceil((F.col("_h") + F.coalesce("_v", F.lit(0))) / cell).cast("int").alias("_b"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ("part", "cell", "node", "m", "alpha", "vec", "_a", "_b")
    own = placed.select(*cols[:-2]).join(blocks, ["part", "cell"]).select(*cols)
    members = own.unionByName(guests.select(*cols[:-2]).join(blocks, ["part", "cell"]).select(*cols))
    out = lambda df: df.select("part", "cell", "i", "j", "home", "node", "m", "alpha", "vec")
    asking = own.withColumns({"i": deal(F.col("_a")), "home": F.lit(True)}).select("*", every("_b").alias("j"))
    asked = members.withColumns({"j": deal(F.col("_b")), "home": F.lit(False)}).select("*", every("_a").alias("i"))
    return out(asking).unionByName(out(asked))


def join(vecs: DataFrame, cosine: float = COSINE, cell: int = CELL, most: int = PIVOTS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal content are one node with a weight. Every other pair that may link meets in a task through its
    cell; the number of links is counted there, and of the links only one per node and task leaves it, to the
    smallest node that its group reaches there.

    Null vectors, those of no or zero components, or with null or non-finite ones, and rows of a null label link with
    nothing, nor do vectors of different lengths; a row with a null vec_id links with nothing and has a null component;
    rows that share a vec_id count each as a vector; an empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    kind = np.dtype("<f4") if isinstance(vecs.schema["embedding"].dataType.elementType, T.FloatType) else np.dtype("<f8")
    rows = keep(prepare(vecs), "vectors")
    items = keep(rows.filter("node is not null").groupBy("node").agg(F.first("part").alias("part"), F.first("vec").alias("vec"), F.count("*").alias("m"), F.min("vec_id").alias("first_id")), "nodes")
    met = cells(items, kind, cosine, cell, most).groupBy("part", "cell", "i", "j").applyInPandas(lambda p: compare(p, kind, cosine), "node string, weight long, root string")
    met = keep(met, "met")
    counts = met.groupBy("node").agg((F.sum("weight") - 1).alias("n_links"))  # a vector meets itself once
    labels = components(met.filter("root is not null").select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = items.select("node", "first_id").join(labels, F.col("node") == F.col("u"), "left").select("node", "first_id", F.coalesce("v", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("_least"))
    done = named.join(least, "root").join(counts, "node").select(F.col("node").alias("_node"), "n_links", "_least")
    out = rows.join(done, F.col("node") == F.col("_node"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("_least", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT r.u AS vec_id, coalesce(n, 0)::BIGINT AS n_links, min(r.v) AS component_id, min(r.v) = r.u AS kept
FROM reach r LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) USING (u)
GROUP BY r.u, n
"""
