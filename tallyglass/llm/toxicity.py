"""Toxicity: a factorization machine over hashed terms, trained here on labelled documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import words as W
from tallyglass.llm.common import table

NAME = "op3_toxicity"
#: Cells that terms are hashed into.
BUCKETS = 1 << 20
#: At most about so many labelled rows train the model, picked by a hash of the doc_id.
TRAINING_ROWS = 30_000
#: Terms that the model takes for their own sake: those whose share of toxic documents is farthest from the average.
MAX_TERMS = 1 << 15
MIN_DOCUMENTS = 5
MIN_DEVIATION = 3.0
#: Of the terms in most documents so many are tried in pairs; a pair enters whose share of toxic documents is so many
#: deviations off what its two terms tell apart.
PAIR_TERMS = 1024
PAIR_DEVIATION = 5.0
FACTORS = 4
EPOCHS = 25
BATCH = 128
RATE = 0.1
L2 = 2e-3
SEED = 5


def terms(column):
    """For every text the distinct cells of its terms: (cells in order, first entry of each text).

    Terms are lower-case words and the first four and six bytes of longer ones, so that an ending not seen in training
    doesn't hide a stem.
    """
    cells, firsts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for _, buf, offs in W.blocks(column):
        low = W.lower(buf)
        starts, ends, first = W.spans(low, offs, W.ALNUM)
        prefix = W.prefix_hash(low)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        keys = [(doc << 20) | (W.span_hash(prefix, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)]
        for n in (4, 6):
            long = ends - starts > n
            cell = W.mix(W.span_hash(prefix, starts[long], starts[long] + n) + np.uint64(n)) % np.uint64(BUCKETS)
            keys.append((doc[long] << 20) | cell.astype(np.int64))
        both = np.concatenate(keys)
        both.sort()
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        cells.append(both & (BUCKETS - 1))
        firsts.append(np.searchsorted(both >> 20, np.arange(1, len(offs))) + firsts[-1][-1])
    return np.concatenate(cells), np.concatenate(firsts)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most about TRAINING_ROWS labelled documents that are not held out."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    )
    share = min(1.0, 0.95 * TRAINING_ROWS / max(1, known.count()))
    if share < 1.0:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # bounded by TRAINING_ROWS rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_toxic").cast("int").alias("toxic"))


def held_out(col):
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def pick_terms(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells whose documents are toxic more often, or more rarely, than chance would have it; and those in most documents."""
    def fold(batches):
        seen, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
        n = bad = 0
        for batch in batches:
            label = np.asarray(batch.column(1), np.int64)
            cells, first = terms(batch.column(0))
            seen += np.bincount(cells, minlength=BUCKETS).astype(np.int32)
            toxic += np.bincount(cells[np.repeat(label, np.diff(first)) == 1], minlength=BUCKETS).astype(np.int32)
            n, bad = n + len(label), bad + int((label == 1).sum())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], n).astype(np.int64)), pa.array(np.append(toxic[at], bad).astype(np.int64))], ["cell", "seen", "toxic"])

    folded = rows.select("text", "toxic").mapInArrow(fold, "cell int, seen long, toxic long").groupBy("cell").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    total = folded.filter("cell = -1").collect()
    if not total or not total[0].seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = total[0].toxic / total[0].seen
    off = F.abs(F.col("toxic") - base * F.col("seen")) / F.sqrt(F.col("seen") * F.lit(max(base * (1 - base), 1e-9)) + 1)
    best = folded.filter((F.col("cell") >= 0) & (F.col("seen") >= MIN_DOCUMENTS) & (off >= MIN_DEVIATION)).orderBy(off.desc(), "cell").limit(MAX_TERMS)
    often = folded.filter((F.col("cell") >= 0) & (F.col("seen") >= MIN_DOCUMENTS)).orderBy(F.desc("seen"), "cell").limit(PAIR_TERMS)
    cells = lambda d: np.array(sorted(r.cell for r in d.select("cell").collect()), np.int64)
    return cells(best), cells(often)  # MAX_TERMS and PAIR_TERMS at most


def interacting(lists: list[np.ndarray], labels: np.ndarray, n_terms: int) -> np.ndarray:
    """The terms (numbers below n_terms) of pairs that tell more, or something else, than their terms one by one.

    For terms a and b that tell nothing about each other the pair's share of toxic documents would be share(a) +
    share(b) - average. Pairs are counted by matrix products over blocks of documents.
    """
    seen, toxic = np.zeros((n_terms, n_terms), np.float32), np.zeros((n_terms, n_terms), np.float32)
    for i in range(0, len(lists), 2048):
        own = lists[i : i + 2048]
        x = np.zeros((len(own), n_terms), np.float32)
        x[np.repeat(np.arange(len(own)), [len(o) for o in own]), np.concatenate(own)] = 1
        seen += x.T @ x
        bad = x[labels[i : i + 2048] == 1]
        toxic += bad.T @ bad
    n, base = np.diag(seen).astype(np.float64), labels.mean() if len(labels) else 0.0
    share = np.divide(np.diag(toxic), n, out=np.full(n_terms, base), where=n > 0)
    told = np.clip(share[:, None] + share[None] - base, 0, 1)
    off = np.abs(toxic - seen * told) / np.sqrt(seen * max(base * (1 - base), 1e-9) + 1)
    np.fill_diagonal(off, 0)
    return np.flatnonzero(((off >= PAIR_DEVIATION) & (seen >= MIN_DOCUMENTS)).any(axis=1))


def _narrow(cells, first, picked):
    """Only picked cells, by their number in `picked`."""
    at = np.searchsorted(picked, cells)
    keep = picked[np.minimum(at, len(picked) - 1)] == cells if len(picked) else np.zeros(len(cells), bool)
    c = np.concatenate([[0], np.cumsum(keep)])
    return at[keep], c[first]


def _among(at: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The sorted numbers `at` that are among the sorted `kept`, as places there."""
    place = np.searchsorted(kept, at)
    ok = kept[np.minimum(place, len(kept) - 1)] == at if len(kept) else np.zeros(len(at), bool)
    return place[ok]


def _sum(values, first):
    """Sums of the rows of `values` that belong to each text."""
    c = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return c[first[1:]] - c[first[:-1]]


def raw_score(model, at, first):
    """w0 + the terms' weights + half of (squared sum - sum of squares) of the terms' factors: all pairs in linear time."""
    s = _sum(np.concatenate([model["w"][at][:, None], model["v"][at], model["v"][at] ** 2], axis=1), first)
    k = model["v"].shape[1]
    return model["w0"] + s[:, 0] + 0.5 * (s[:, 1 : k + 1] ** 2 - s[:, k + 1 :]).sum(axis=1), s[:, 1 : k + 1]


def fit(lists: list[np.ndarray], labels: np.ndarray, n_terms: int) -> dict:
    """Logistic loss by AdaGrad in mini-batches, in a seeded order."""
    rng = np.random.default_rng(SEED)
    n = len(labels)
    rate = (labels.sum() + 0.5) / (n + 1)
    model = {"w0": float(np.log(rate / (1 - rate))), "w": np.zeros(n_terms), "v": rng.normal(0, 0.05, (n_terms, FACTORS))}
    if not n_terms or labels.min(initial=1) == labels.max(initial=0):
        return model
    g0, gw, gv = 1.0, np.full(n_terms, 1e-2), np.full((n_terms, FACTORS), 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            own = order[i : i + BATCH]
            at = np.concatenate([lists[r] for r in own])
            first = np.concatenate([[0], np.cumsum([len(lists[r]) for r in own])])
            s, fsum = raw_score(model, at, first)
            error = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - labels[own]) / len(own)
            model["w0"] -= RATE * error.sum() / np.sqrt(g0 := g0 + error.sum() ** 2)
            if not len(at):
                continue
            e = np.repeat(error, np.diff(first))
            used, back = np.unique(at, return_inverse=True)
            grad_w = np.bincount(back, e, len(used)) + L2 / 100 * model["w"][used]
            each = e[:, None] * (np.repeat(fsum, np.diff(first), axis=0) - model["v"][at])
            grad_v = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(FACTORS)], axis=1) + L2 / 100 * model["v"][used]
            gw[used] += grad_w**2
            gv[used] += grad_v**2
            model["w"][used] -= RATE * grad_w / np.sqrt(gw[used])
            model["v"][used] -= RATE * grad_v / np.sqrt(gv[used])
    return model


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """A model on at most about TRAINING_ROWS documents. Their picked terms are fitted in one task.

    Terms are picked that deviate alone, and those of pairs that deviate together: the machine can learn a pair only from
    texts in which it sees both of its terms.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, labels)
    picked, often = pick_terms(rows)
    every = np.union1d(picked, often)
    shared = spark.sparkContext.broadcast(every)  # MAX_TERMS + PAIR_TERMS at most

    def narrow(batches):
        for batch in batches:
            at, first = _narrow(*terms(batch.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(at.astype(np.int32)))], ["doc_id", "toxic", "terms"])

    def learn(batches):
        ids, labelled, lists = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            labelled += batch.column(1).to_pylist()
            flat, offs = np.asarray(batch.column(2).flatten()), np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            lists += [flat[offs[i] : offs[i + 1]] for i in range(len(offs) - 1)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], labelled[i], len(lists[i])))
        lists, toxic = [lists[i] for i in order], np.array([labelled[i] for i in order], np.int64)
        tried = np.searchsorted(shared.value, often)
        pairs = tried[interacting([_among(x, tried) for x in lists], toxic, len(tried))]
        kept = np.union1d(np.searchsorted(shared.value, picked), pairs)
        m = fit([_among(x, kept) for x in lists], toxic, len(kept))
        cut = [pa.array([x.tobytes()], pa.binary()) for x in (shared.value[kept].astype("<i8"), m["w"], m["v"])]
        yield pa.RecordBatch.from_arrays([pa.array([m["w0"]]), *cut], ["w0", "picked", "w", "v"])

    narrowed = rows.mapInArrow(narrow, "doc_id string, toxic int, terms array<int>")
    got = narrowed.repartition(1).mapInArrow(learn, "w0 double, picked binary, w binary, v binary").collect()  # one task: bounded rows
    if not got:
        return {"picked": np.zeros(0, np.int64), "w0": 0.0, "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    return {"picked": np.frombuffer(got[0].picked, "<i8"), "w0": got[0].w0, "w": np.frombuffer(got[0].w), "v": np.frombuffer(got[0].v).reshape(-1, FACTORS)}


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    The machine learns a weight for each picked term (see `train`) and, through its factors, one for each pair of terms that stand in
    the same text. Rows whose crc32 of the doc_id is a multiple of 5 are never learned from; labels, language, source
    and doc_id are no inputs of a score.

    Null and empty texts get the score of a text without terms; a null doc_id counts as an empty text for the checksum;
    repeated rows are scored each; without labels every score is 0.5; an empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # MAX_TERMS * (FACTORS + 2) numbers

    def run(batches):
        for batch in batches:
            m = model.value
            at, first = _narrow(*terms(batch.column(2)), m["picked"])
            p = np.round(1 / (1 + np.exp(-np.clip(raw_score(m, at, first)[0], -30, 30))), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
