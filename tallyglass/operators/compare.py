"""Do two result tables say the same thing?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import numbers


def spelled(df: DataFrame, lenient: bool = False) -> DataFrame:
    """Columns c0..cn as text; NULL stays NULL.

    Equal values have equal texts. With `lenient`, so have values that read alike: numeric text and numbers, to four places.
    """
    spell = numbers.canonical if lenient else numbers.raw
    return df.select(*[spell(F.col(f"`{f.name}`"), f.dataType.simpleString()).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])


def _signatures(df: DataFrame) -> tuple[int, list[tuple]]:
    """Row count and one multiset signature per column: a single row, read to pick column pairings."""
    cols = df.columns
    h = lambda c: F.xxhash64(F.coalesce(c, F.lit("\0null")))
    row = df.agg(F.count("*").alias("n"), *[F.struct(F.sum(h(c).cast("decimal(38,0)")), F.bit_xor(h(c))).alias(c) for c in cols]).first()
    return row["n"], [tuple(row[c]) for c in cols]


def _verdict(spark, value: bool) -> DataFrame:
    return spark.range(1).select(F.lit(value).alias("match"))


def _pair_signatures(df: DataFrame, cols: list[int]) -> tuple[dict, set]:
    """Of each two columns: a multiset signature of their value pairs, and whether they are the same in every row."""
    pairs = [(i, j) for i in cols for j in cols if i < j]
    if not pairs:
        return {}, set()
    sig = lambda a, b: F.xxhash64(F.coalesce(a, F.lit("\0null")), F.coalesce(b, F.lit("\0null")))
    out = []
    for i, j in pairs:
        x, y = F.col(f"c{i}"), F.col(f"c{j}")
        out.append(F.struct(F.sum(sig(x, y).cast("decimal(38,0)")).alias("s"), F.sum(sig(y, x).cast("decimal(38,0)")).alias("t"),
                            F.bool_and(x.eqNullSafe(y)).alias("same")).alias(f"p{i}_{j}"))
    row = df.agg(*out).first()
    signs = {}
    for i, j in pairs:
        r = row[f"p{i}_{j}"]
        signs[i, j], signs[j, i] = r["s"], r["t"]
    return signs, {(i, j) for i, j in pairs if row[f"p{i}_{j}"]["same"]}


def pairings(gold_sig: list, pred_sig: list, gold_pairs=({}, set()), pred_pairs=({}, set())) -> list[tuple[int, ...]]:
    """Choices of a distinct predicted column for each gold column with the same values.

    Where several columns have the same values, those of every two must agree as well, and columns that are the same in every
    row are taken in order, as swapping them changes nothing. So ten equal columns give one choice.
    """
    options = [[j for j, p in enumerate(pred_sig) if p == g] for g in gold_sig]
    (gp, _gold_same), (pp, pred_same) = gold_pairs, pred_pairs
    out = []

    def fits(chosen: list[int], j: int) -> bool:
        i = len(chosen)
        for a, b in enumerate(chosen):
            if (a, i) in gp and (b, j) in pp and gp[a, i] != pp[b, j]:
                return False
        # Of columns alike in every row, the first that is free.
        return all(k in chosen for k in options[i] if (k, j) in pred_same)

    def grow(chosen: list[int]) -> None:
        if len(chosen) == len(options):
            out.append(tuple(chosen))
            return
        for j in options[len(chosen)]:
            if j not in chosen and fits(chosen, j):
                grow([*chosen, j])

    grow([])
    return out


def same_rows(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: equal as multisets. Copies are counted with signs, so one shuffle decides."""
    both = gold.withColumn("_s", F.lit(1)).unionByName(pred.withColumn("_s", F.lit(-1)))
    diff = both.groupBy(*gold.columns).agg(F.sum("_s").alias("_s")).where("_s <> 0")
    return diff.agg((F.count("*") == 0).alias("match"))


def results_equal(gold: DataFrame, pred: DataFrame, position: str | None = None, extra_columns: bool = False, lenient: bool = False) -> DataFrame:
    """One row `match`: equal up to the order of columns (and, with extra_columns, a choice of them).

    Values are compared as they are, or with `lenient` by what they read as. With `position` both frames carry the row
    number under that name and order counts.
    """
    spark = gold.sparkSession
    g = spelled(gold.drop(position) if position else gold, lenient)
    p = spelled(pred.drop(position) if position else pred, lenient)
    ng, gs = _signatures(g)
    np_, ps = _signatures(p)
    if ng == 0 and np_ == 0:
        return _verdict(spark, True)
    if ng != np_ or (len(gs) != len(ps) and not extra_columns) or len(ps) < len(gs):
        return _verdict(spark, False)
    out = None
    unclear = {p for p in ps if ps.count(p) > 1} & set(gs)
    several = [_pair_signatures(d, [i for i, x in enumerate(sig) if x in unclear]) for d, sig in ((g, gs), (p, ps))]
    for perm in pairings(gs, ps, *several):
        names = [f"c{i}" for i in range(len(perm))]
        if position:
            a = _placed(gold, position, lenient)
            b = _placed(pred, position, lenient).select("_p", *[F.col(f"c{j}").alias(n) for n, j in zip(names, perm)])
            one = same_rows(a, b)
        else:
            one = same_rows(g, p.select(*[F.col(f"c{j}").alias(n) for n, j in zip(names, perm)]))
        out = one if out is None else out.unionByName(one)
    return _verdict(spark, False) if out is None else out.agg(F.bool_or("match").alias("match"))


def _placed(df: DataFrame, position: str, lenient: bool) -> DataFrame:
    fields = [f for f in df.schema.fields if f.name != position]
    spell = numbers.canonical if lenient else numbers.raw
    return df.select(F.col(position).alias("_p"), *[spell(F.col(f"`{f.name}`"), f.dataType.simpleString()).alias(f"c{i}") for i, f in enumerate(fields)])


def set_equal(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row `match`: the same set of rows, copies ignored."""
    if len(gold.columns) != len(pred.columns):
        return _verdict(gold.sparkSession, False)
    both = spelled(gold).withColumn("_g", F.lit(1)).unionByName(spelled(pred).withColumn("_g", F.lit(0)))
    cols = [c for c in both.columns if c != "_g"]
    lone = both.groupBy(*cols).agg(F.min("_g").alias("a"), F.max("_g").alias("b")).where("a = b")
    return lone.agg((F.count("*") == 0).alias("match"))
