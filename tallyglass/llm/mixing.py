"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import fanout, keep, row_id, row_key, rows_of, running, source_key, table, unit

NAME = "op2_mixing"
SEED = 7
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Weight schedules as knots (time, weight) over training time 0 to 1, given to the sources in turn as WEIGHTS are:
#: the first fades out, the second is steady, the third comes in late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))


def count_words(col="text"):
    return F.regexp_count(F.coalesce(F.col(col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _segments(knots):
    """A schedule as straight pieces with the integral before and after each, scaled to 1 in all."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        if t1 < t0 or min(w0, w1) < 0:
            raise ValueError("knots must rise in time, with weights of at least 0")
        pieces.append((t0, t1, w0, w1, area, area + (w0 + w1) * (t1 - t0) / 2))
        area = pieces[-1][-1]
    if area <= 0:
        raise ValueError("a schedule must weigh more than 0")
    return [(t0, t1, w0 / area, w1 / area, a0 / area, a1 / area) for t0, t1, w0, w1, a0, a1 in pieces]


def position(share, turn, schedules=SCHEDULES):
    """Training time at which a source has used `share` of its demand: the inverse of the integral of its schedule.

    Within a straight piece the integral is quadratic: w0 x + (w1 - w0) x^2 / 2d = share - a0, solved for x in the
    form without cancellation.
    """
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        t = None
        for t0, t1, w0, w1, a0, a1 in reversed(_segments(knots)):
            d = t1 - t0
            if not d:
                continue
            rest = F.greatest(share - F.lit(a0), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / d) * rest, F.lit(0.0)))
            x = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (F.lit(w0) + root))
            here = F.least(F.lit(t0) + x, F.lit(t1))
            t = here if t is None else F.when(share < F.lit(a1), here).otherwise(t)
        out = F.when(turn == F.lit(i), t).otherwise(out)
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources: rows (_src, source_size) become (_src, source_size, _turn, target).

    The sources share the sum of all sizes by weight; a target above max_epochs times its source's size stops there,
    and what is left goes to the others by weight. Sources sorted by cap per weight are capped as a prefix, so one
    pass of running sums finds the level at which the rest stand.
    """
    everything = Window.partitionBy(F.lit(0))
    turn = F.pmod(F.row_number().over(everything.orderBy("_src")) - 1, F.lit(len(weights)))
    s = sizes.withColumn("_turn", turn.cast("int"))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_turn") + 1))
    s = s.withColumn("_cap", F.col("source_size") * float(max_epochs)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = everything.orderBy("_ratio", "_src")
    past = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("_level", (total - past) / left)
    free = F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))
    # the level of the first source that is not capped
    s = s.withColumn("_level", F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_level"), F.col("_cap")))
    return s.select("_src", "source_size", "_turn", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES, seed: int = SEED) -> DataFrame:
    """One narrow row per document row: doc_id, size, source_size, target, taken, copies, position; sorted by position.

    Within a source, documents stand in seeded order, and the same order is gone through again for each epoch. The
    source's demand for words along training time is the integral of its weight schedule, scaled to its target; the
    copy of a document that begins at word c of the source's sequence trains at the time when the demand reaches c.
    Copies that begin before the target are taken, the one that crosses it in part: a source's `taken` add up to its
    target, rounded. `copies` counts the copies taken at least in part; `position` is the first one's time, null if
    there is none, and rows are range-sorted by it.

    Null and empty texts have size 0 and are never taken; a null source is one source, after the others; a null doc_id is
    hashed as its text; repeated rows are documents of their own; an empty table gives no rows. The numbering of sources
    uses windows over one row per source: meant for thousands of sources, not for a source per host.
    """
    return _planned(docs, weights, max_epochs, schedules, seed).drop("_key")


def _planned(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES, seed: int = SEED) -> DataFrame:
    """The rows of `mix` with `_key`, which rows of one doc_id and text share."""
    if len(weights) != len(schedules):
        raise ValueError("one schedule per weight")
    h, u = unit(seed, row_id())
    rows = docs.select("doc_id", row_key().alias("_key"), source_key().alias("_src"), count_words().alias("size"), h.alias("_h"), F.floor(u * fanout(docs.sparkSession)).alias("_k"))
    rows = keep(rows, "sizes")
    goal = targets(rows.groupBy("_src").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    placed = running(rows, ["_src"], "_k", ["_h", "doc_id", "size", "_key"], "size", "_c").join(goal, "_src")
    words = F.round("target").cast("long")
    starts = [F.col("_c") + e * F.col("source_size") for e in range(max_epochs)]
    parts = [F.least(F.greatest(words - s, F.lit(0)), F.col("size")) for s in starts]
    taken = sum(parts[1:], parts[0])
    copies = sum([F.when(p > 0, 1).otherwise(0) for p in parts[1:]], F.when(parts[0] > 0, 1).otherwise(0))
    share = F.col("_c") / F.col("target")
    out = placed.select(
        "doc_id", "_key", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"),
        F.when((F.col("target") > 0) & (parts[0] > 0), F.round(position(share, F.col("_turn"), schedules), 9)).alias("position"),
    )
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row as often as its copies, whole (the copy that crosses a target included);
    columns as before.

    Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, are taken each as its own; equal
    rows take the numbers of copies of such rows in any order. Null and empty texts are never taken; an empty table gives
    no rows. Reruns agree, whatever the partitioning.
    """
    plan = _planned(docs, **options).filter("copies > 0")
    plan = plan.groupBy("_key").agg(F.sort_array(F.collect_list("copies"), False).alias("_copies"))  # repeated rows of one text
    own = rows_of(docs).withColumn("_own", F.xxhash64("_row.doc_id", "_row.text"))
    numbered = own.withColumn("_i", F.row_number().over(Window.partitionBy("_own").orderBy(F.xxhash64("_row"))))
    kept = numbered.join(plan, F.col("_own") == F.col("_key")).filter(F.col("_i") <= F.size("_copies"))
    times = F.element_at("_copies", F.col("_i"))
    return kept.withColumn("_e", F.explode(F.sequence(F.lit(1), times))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _position_sql(share, turn):
    whens = []
    for i, knots in enumerate(SCHEDULES):
        for t0, t1, w0, w1, a0, a1 in _segments(knots):
            rest = f"greatest({share} - {a0!r}::DOUBLE, 0.0::DOUBLE)"
            x = (f"CASE WHEN {rest} <= 0 THEN 0.0 ELSE 2 * {rest} / ({w0!r}::DOUBLE + sqrt(greatest({w0 * w0!r}::DOUBLE + "
                 f"{2 * (w1 - w0) / (t1 - t0)!r}::DOUBLE * {rest}, 0.0::DOUBLE))) END")
            last = t1 == knots[-1][0]
            whens.append(f"WHEN {turn} = {i}" + ("" if last else f" AND {share} < {a1!r}::DOUBLE") + f" THEN least({t0!r}::DOUBLE + {x}, {t1!r}::DOUBLE)")
    return "CASE " + " ".join(whens) + " END"


_TAKEN = [f"least(greatest(words - (c + {e} * source_size), 0), size)" for e in range(MAX_EPOCHS)]

SQL = f"""
WITH base AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
           md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'n' || md5(coalesce(text, '')))) AS h FROM documents),
sources AS (
    SELECT src, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY src) - 1) % {len(WEIGHTS)} AS turn FROM base GROUP BY src),
caps AS (
    SELECT *, list_extract({list(map(float, WEIGHTS))}::DOUBLE[], turn + 1) AS w, source_size * {float(MAX_EPOCHS)}::DOUBLE AS cap FROM sources),
levels AS (
    SELECT *, cap / w AS ratio,
           (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
goal AS (
    SELECT src, source_size, turn, round(least(cap, coalesce(w * (SELECT arg_min(level, (ratio, src)) FROM levels WHERE level <= ratio), cap)), 6) AS target FROM levels),
placed AS (
    SELECT base.*, source_size, turn, target, round(target)::BIGINT AS words,
           (coalesce(sum(size) OVER (PARTITION BY base.src ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS c
    FROM base JOIN goal USING (src))
SELECT doc_id, size::BIGINT AS size, source_size, target, ({" + ".join(_TAKEN)})::BIGINT AS taken,
       ({" + ".join(f"({x} > 0)::INT" for x in _TAKEN)})::INT AS copies,
       CASE WHEN target > 0 AND {_TAKEN[0]} > 0 THEN round({_position_sql("(c / target)", "turn")}, 9) END AS position
FROM placed
"""
