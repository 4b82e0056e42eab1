"""Stored values mentioned in questions: exact, then by trigram similarity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions import text as tx
from tallyglass.operators.present import text_columns
from tallyglass.operators.profile import union
from tallyglass.session import beside, cut

MIN_SCORE = 0.75


def value_index(frames: dict[str, DataFrame]) -> DataFrame:
    """table, column, value: every distinct text value of two characters or more."""
    cells = union([d.select(*text_columns(d)).unpivot([], text_columns(d), "column", "value").select(F.lit(t).alias("table"), "column", "value")
                   for t, d in frames.items() if text_columns(d)])
    return cells.where("value IS NOT NULL AND length(value) > 1").distinct()


def prefix(grams, score: float):
    """Any set as similar as `score` shares one of the first |x| - ceil(score |x|) + 1 grams of a common order."""
    n = F.size(grams)
    return F.slice(grams, 1, n - F.ceil(n * score - 1e-9).cast("int") + 1)


#: Postings of one side that meet in one task: longer lists are dealt into blocks, each block meets each block of the other side.
BLOCK = 2_000

#: Questions whose spans are taken by one task.
QUESTIONS = 2_000


def size_class(n, score: float):
    """Sizes in classes so wide that a similar set lies in the same class or one beside it."""
    if score >= 1:
        return n.cast("long")
    return F.floor(F.log(n.cast("double")) / (-math.log(score) * (1 + 1e-9) + 1e-9))


def postings(left: DataFrame, right: DataFrame, score: float = MIN_SCORE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides as rows (key, text, grams, at): a row per prefix gram, keyed so that similar texts meet and no key holds many.

    Grams are ordered by how many texts of both sides have them, rarest first. A key is a gram, a size class of the right side
    (the left side asks in three classes), and a pair of blocks: a gram's list in a class is dealt over as many blocks as it holds
    times `block` rows, on either side, so that a gram which every text has is worked off by many tasks.
    """
    a = left.select(F.col("l").alias("text"), tx.trigrams(F.col("l")).alias("grams")).where("size(grams) > 0")
    b = right.select(F.col("r").alias("text"), tx.trigrams(F.col("r")).alias("grams")).where("size(grams) > 0")
    # A set larger than every similar set of the other side could be is not looked at further.
    largest = a.agg(F.max(F.size("grams")).alias("_most"))
    b = b.join(largest, F.size("grams") * score <= F.col("_most") + 1e-9).drop("_most")
    every = a.select(F.explode("grams").alias("gram")).unionAll(b.select(F.explode("grams").alias("gram")))
    count = every.groupBy("gram").agg(F.count("*").alias("_n"))

    def listed(d):
        cells = d.select("text", F.explode("grams").alias("gram")).join(count, "gram")
        s = F.array_sort(F.collect_list(F.struct("_n", "gram")))  # the grams of one text
        return cells.groupBy("text").agg(F.transform(s, lambda x: x["gram"]).alias("grams"))

    def spread(d, classes):
        first = prefix(F.col("grams"), score)
        return cut(listed(d).select("text", "grams", F.explode(classes).alias("class"), first.alias("_first"))
                   .select("text", "grams", "class", F.posexplode("_first").alias("at", "gram")))

    c = size_class(F.size("grams"), score)
    a = spread(a, F.array(c - 1, c, c + 1) if score < 1 else F.array(c))
    b = spread(b, F.array(c))
    lists = a.groupBy("gram", "class").agg(F.count("*").alias("_l")).join(b.groupBy("gram", "class").agg(F.count("*").alias("_r")), ["gram", "class"])
    lists = cut(lists.select("gram", "class", F.ceil(F.col("_l") / block).alias("_l"), F.ceil(F.col("_r") / block).alias("_r")))

    def keyed(d, own, other, order):
        d = d.join(lists, ["gram", "class"]).withColumn("_own", F.pmod(F.xxhash64("text"), F.col(own)))
        d = d.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return d.select(F.struct("gram", "class", *[F.col(x).alias(n) for x, n in zip(order, ("l", "r"))]).alias("key"), "text", "grams", "at")

    return keyed(a, "_l", "_r", ("_own", "_other")), keyed(b, "_r", "_l", ("_other", "_own"))


def similar(left: DataFrame, right: DataFrame, score: float = MIN_SCORE) -> DataFrame:
    """l, r, score of every pair with trigram Jaccard >= score, from distinct texts (l) and (r).

    Two sets this similar share a gram of both prefixes. Of the grams a pair shares only the first of the common order makes a
    row, so pairs are never shuffled to drop repeats; sizes and the places of that gram bound the overlap before it is counted.
    """
    a, b = postings(left, right, score)
    a, b = a.select("key", F.col("text").alias("l"), F.col("grams").alias("ga"), F.col("at").alias("ia")), b.select(
        "key", F.col("text").alias("r"), F.col("grams").alias("gb"), F.col("at").alias("ib"))
    na, nb = F.size("ga"), F.size("gb")
    need = (na + nb) * (score / (1 + score)) - 1e-9
    met = (nb >= na * score - 1e-9) & (na >= nb * score - 1e-9) & (F.least(na - F.col("ia"), nb - F.col("ib")) >= need)
    pair = a.join(b, (a["key"] == b["key"]) & met)
    pair = pair.where(~F.arrays_overlap(F.slice("ga", 1, F.col("ia")), F.slice("gb", 1, F.col("ib"))))
    both = F.size(F.array_intersect("ga", "gb"))
    return pair.select("l", "r", (both / (na + nb - both)).alias("score")).where(F.col("score") >= score)


def reachable(left: DataFrame, right: DataFrame, score: float = MIN_SCORE) -> DataFrame:
    """The texts (r) of which so many trigrams stand in any of the texts (l) as each similar one would have to share."""
    known = beside(left.select(F.explode(tx.trigrams(F.col("l"))).alias("gram")).distinct())
    cells = right.select("r", tx.trigrams(F.col("r")).alias("_g")).select("r", F.size("_g").alias("_n"), F.explode("_g").alias("gram"))
    return cells.join(known, "gram").groupBy("r", "_n").agg(F.count("*").alias("_c")).where(F.col("_c") >= F.col("_n") * score - 1e-9).select("r")


def match_values(questions: DataFrame, qkey: str, qtext: str, index: DataFrame, limit: int = 8) -> DataFrame:
    """question, table, column, value, span, score, rank: at most `limit` hints per question.

    Questions repeat their spans, so each distinct span is matched once, and the questions are joined to what it found.
    Values with more trigrams than a set similar to any span can have, such as whole documents, leave the index before
    it is made distinct: one number, the largest trigram count of a span, goes through the driver for it.
    """
    q = cut(questions.select(F.col(qkey).alias("question"), F.col(qtext).alias("_text")))
    # Spans cost far more than the bytes of a question tell, so Spark does not pick the number of tasks by these.
    tasks = min(q.count() // QUESTIONS + 1, 64 * int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = q.repartition(tasks).select("question", F.posexplode(tx.spans(F.col("_text"))).alias("pos", "span")).withColumn("_low", F.lower("span"))
    asked = cut(s.select("_low").distinct())
    most = asked.select(F.max(F.size(tx.trigrams(F.col("_low"))))).first()[0] or 0
    low = F.lower("value")
    grams, head = (F.size(tx.trigrams(c)) for c in (F.col("_low"), F.substring(tx.strip(low), 1, 8 * most)))
    # The head of a long text has no more grams than all of it, but for the two at its own end: most texts are settled by it.
    # Short ones are counted once they are distinct.
    v = cut(index.where((F.length("value") <= 8 * most) | ((head - 2) * MIN_SCORE <= most)))
    v = cut(v.withColumn("_low", low).where(grams * MIN_SCORE <= most))
    exact = asked.join(v, "_low").select("_low", "table", "column", "value", F.lit(1.0).alias("score"))
    # A span that is a stored value is not compared further.
    known = v.select("_low").distinct()
    texts = cut(asked.join(known, "_low", "left_anti").select(F.col("_low").alias("l")))
    near = similar(texts, cut(reachable(texts, known.select(F.col("_low").alias("r")))))
    fuzzy = (near.select(F.col("l"), F.col("r").alias("_low"), "score").join(v, "_low")
             .select(F.col("l").alias("_low"), "table", "column", "value", "score"))
    every = s.join(beside(exact.unionByName(fuzzy)), "_low")
    best = every.groupBy("question", "table", "column", "value").agg(
        F.min_by(F.struct("span", "score"), F.struct(-F.col("score"), F.col("pos"))).alias("_b"))
    best = best.select("question", "table", "column", "value", "_b.span", F.round("_b.score", 3).alias("score"))
    w = Window.partitionBy("question").orderBy(F.desc("score"), F.desc(F.length("span")), "table", "column", "value")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def hint(table="table", column="column", value="value", span="span"):
    return F.format_string('"%s"."%s" contains \'%s\' (question: "%s")', table, column, F.replace(value, F.lit("'"), F.lit("''")), span)
