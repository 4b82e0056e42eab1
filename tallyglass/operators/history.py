"""Per-key history: gaps, last turns, rolling counts.

A key may hold a third of all rows, and a day of it as many, so nothing here sorts a whole key in one task: rows are cut
into slices of equal depth, in order of key and time, and neighbouring slices of a key are stitched by one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.session import cut

DAY_US = 86_400_000_000
#: Rows that one slice is meant to hold.
SLICE_ROWS = 1_000_000


def micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def sliced(df: DataFrame, order: list, per_slice: int | None = None) -> DataFrame:
    """The rows with `_slice`, which grows with `order`: slices of about `per_slice` rows, however the keys are spread.

    Spark's range partitioning samples the splitters; their number follows the number of rows. Rows of equal order share a
    slice, so callers fold them first. The result is written once, as every reader must see the same slices.
    """
    kept = cut(df)
    n = max(1, -(-kept.count() // (per_slice or SLICE_ROWS)))
    return cut(kept.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()))


def before(df: DataFrame, keys: list[str], value) -> DataFrame:
    """keys, _slice, _before: an aggregate of the slices before each slice of a key, from one row per slice."""
    return df.select(*keys, "_slice", value.over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))


def numbered(df: DataFrame, keys: list[str], order: list, out: str, per_slice: int | None = None) -> DataFrame:
    """The rows with their place (from 0) among those of their keys. `order` must leave no ties, as slices end between rows."""
    s = sliced(df, [*keys, *order], per_slice)
    starts = before(s.groupBy(*keys, "_slice").agg(F.count("*").alias("_n")), keys, F.sum("_n"))
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return _same(s.withColumn("_i", F.row_number().over(w) - 1), starts, [*keys, "_slice"]).select(
        *df.columns, (F.coalesce("_before", F.lit(0)) + F.col("_i")).cast("long").alias(out))


def _same(a: DataFrame, b: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """A null-safe join on equally named columns; b's are dropped."""
    c = b.withColumnsRenamed({x: f"_r_{x}" for x in cols})
    on = F.lit(True)
    for x in cols:
        on = on & a[x].eqNullSafe(c[f"_r_{x}"])
    return a.join(c, on, how).drop(*[f"_r_{x}" for x in cols])


def gaps(df: DataFrame, keys: list[str], ts: str, weight: str | None = None, per_slice: int | None = None) -> DataFrame:
    """(keys, gap_us, copies): the consecutive differences of the sorted times.

    Equal times give gaps of zero, counted and not listed. Each slice is sorted on its own; the gap between slices comes
    from their edges alone.
    """
    n = F.col(weight) if weight else F.lit(1)
    t = df.where(F.col(ts).isNotNull()).select(*keys, micros(ts).alias("_t"), n.alias("_w"))
    seen = sliced(t.groupBy(*keys, "_t").agg(F.sum("_w").alias("_n")), [*keys, "_t"], per_slice)
    w = Window.partitionBy(*keys, "_slice").orderBy("_t")
    inner = seen.select(*keys, (F.col("_t") - F.lag("_t").over(w)).alias("gap_us")).where("gap_us IS NOT NULL")
    edges = seen.groupBy(*keys, "_slice").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    # One row per key and slice that it has rows in.
    we = Window.partitionBy(*keys).orderBy("_slice")
    outer = edges.select(*keys, (F.col("_lo") - F.lag("_hi").over(we)).alias("gap_us")).where("gap_us IS NOT NULL")
    zeros = seen.where("_n > 1").groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("copies"))
    zeros = zeros.select(*keys, F.lit(0).cast("long").alias("gap_us"), "copies")
    moved = inner.unionByName(outer).groupBy(*keys, "gap_us").agg(F.count("*").alias("copies"))
    return moved.unionByName(zeros)


def median_gap(df: DataFrame, keys: list[str], ts: str, weight: str | None = None, per_slice: int | None = None) -> DataFrame:
    """The median gap in seconds per key, exact."""
    g = gaps(df, keys, ts, weight, per_slice)
    q = weighted_median(g, keys, "gap_us", "copies", per_slice)
    return q.select(*keys, (F.col("median") / 1e6).alias("median_gap_s"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, per_slice: int | None = None) -> DataFrame:
    """Median of values that stand for `weight` equal copies each.

    Values are ranked inside slices of equal depth; only the totals of a key's slices are summed in one window.
    """
    v = sliced(df.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(weight).alias("_c")), [*keys, "_v"], per_slice)
    totals = v.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_t"))
    starts = before(totals, keys, F.sum("_t"))
    sizes = totals.groupBy(*keys).agg(F.sum("_t").alias("_n"))
    j = _same(_same(v, starts, [*keys, "_slice"]), sizes, keys)
    w = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_end", F.coalesce("_before", F.lit(0)) + F.sum("_c").over(w))
    half = (F.col("_n") - 1) / 2
    at = lambda r: F.min(F.when(F.col("_end") > r, F.col("_v")))
    return j.groupBy(*keys).agg(at(F.floor(half)).alias("_a"), at(F.ceil(half)).alias("_z")).select(
        *keys, ((F.col("_a") + F.col("_z")) / 2).alias("median"))


def last_turns(df: DataFrame, conv: str, turn: str, text: str, k: int = 3, per_slice: int = 1000) -> DataFrame:
    """Each turn with the k turns before it, oldest first and numbered from 1.

    Conversations are cut into slices of turn numbers; a slice also receives the
    last k turns of the slices before it, so a long one spreads over many tasks.
    """
    item = F.struct(F.col(turn).alias("turn"), F.col(text).alias("text"))
    rows = df.select(*df.columns, item.alias("_item"), F.floor(F.col(turn) / per_slice).alias("_slice"))
    back = Window.partitionBy(conv, "_slice").orderBy(F.desc(turn))
    tails = (rows.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") <= k)
             .groupBy(conv, "_slice").agg(F.array_sort(F.collect_list("_item")).alias("_tail")))
    # k slices back hold at least k turns: the frame stays bounded.
    ahead = Window.partitionBy(conv).orderBy("_slice").rowsBetween(-k, -1)
    carry = F.flatten(F.collect_list("_tail").over(ahead))
    carry = tails.select(conv, "_slice", F.when(F.size(carry) > k, F.slice(carry, -k, k)).otherwise(carry).alias("_carry"))
    own = Window.partitionBy(conv, "_slice").orderBy(turn).rowsBetween(-k, -1)
    rows = rows.withColumn("_own", F.collect_list("_item").over(own)).join(carry, [conv, "_slice"])
    prior = F.concat("_carry", "_own")
    prior = F.when(F.size(prior) > k, F.slice(prior, -k, k)).otherwise(prior)
    numbered = F.transform(prior, lambda x, i: F.struct((i + 1).alias("no"), x["turn"].alias("turn"), x["text"].alias("text")))
    return rows.select(*df.columns, numbered.alias("context"))


def rolling_count(df: DataFrame, key: str, ts: str, uid: str, window_us: int = DAY_US, per_slice: int | None = None) -> DataFrame:
    """Rows of the same key in the window that ends at each row (now - t < window); rows of one instant see each other.

    The count is a difference of two ranks: the rows up to the instant, less those up to one window before it. Ranks are
    running counts inside slices plus the totals of the slices before. For the second, the moments asked about are merged
    among the instants, in order, and each takes the rank of the last instant at or before it. Only folded instants are
    sorted; whole rows are joined to their count once. Rows without a time are left out.
    """
    t = df.withColumn("_t", micros(ts)).where("_t IS NOT NULL")
    seen = sliced(t.groupBy(F.col(key).alias("_k"), "_t").agg(F.count("*").alias("_n")), ["_k", "_t"], per_slice)
    starts = before(seen.groupBy("_k", "_slice").agg(F.sum("_n").alias("_s")), ["_k"], F.sum("_s"))
    up_to = Window.partitionBy("_k", "_slice").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    ranks = _same(seen, starts, ["_k", "_slice"]).select("_k", "_t", (F.coalesce("_before", F.lit(0)) + F.sum("_n").over(up_to)).alias("_rank"))
    none = F.lit(None).cast("long")
    asked = ranks.select("_k", (F.col("_t") - window_us).alias("_t"), none.alias("_rank"), F.col("_rank").alias("_now"), F.col("_t").alias("_of"))
    merged = sliced(ranks.select("_k", "_t", "_rank", none.alias("_now"), none.alias("_of")).unionByName(asked), ["_k", "_t"], per_slice)
    carried = before(merged.groupBy("_k", "_slice").agg(F.max("_rank").alias("_m")), ["_k"], F.max("_m"))
    past = F.coalesce(F.max("_rank").over(up_to), "_before", F.lit(0))
    found = _same(merged, carried, ["_k", "_slice"]).withColumn("used", F.col("_now") - past).where("_of IS NOT NULL").select("_k", "_of", "used")
    return t.join(found, t[key].eqNullSafe(found["_k"]) & (F.col("_t") == F.col("_of"))).select(*df.columns, "used")
