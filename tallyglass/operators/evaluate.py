"""Runs, cases and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass import fixed
from tallyglass.operators import paired
from tallyglass.operators.profile import union
from tallyglass.session import beside


def run_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """items: match, error, attempts, cost_usd, latency_s per item. One row per key."""
    g = items.groupBy(*keys).agg(
        F.count_if(F.col("error").isNotNull()).alias("n_error"), F.avg("attempts").alias("mean_attempts"),
        F.count_if(F.col("match") & (F.col("attempts") > 1)).alias("repaired"),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd_total"), F.avg("cost_usd").alias("cost_usd_mean"))
    r = paired.rates(items, keys, "match").drop("passes").withColumnRenamed("point", "ex")
    return r.join(g, keys).join(paired.percentiles(items, keys, "latency_s"), keys, "left")


def ablation(runs: DataFrame, items: DataFrame) -> DataFrame:
    """runs: benchmark, run, position, baseline (may be NULL). items: benchmark, run, item, match.

    Each run against its baseline, else against the first run of its benchmark.
    """
    first = runs.groupBy("benchmark").agg(F.min_by("run", "position").alias("_first"))
    plan = runs.join(first, "benchmark").select("benchmark", "run", F.coalesce("baseline", "_first").alias("baseline"))
    rates = paired.rates(items, ["benchmark", "run"], "match").withColumnRenamed("point", "ex")
    # A row per benchmark and run; each may have a large share of the items.
    todo = beside(plan.where("run <> baseline"))
    this = items.join(todo, ["benchmark", "run"]).select("benchmark", "run", "baseline", "item", F.col("match").alias("this"))
    base = items.select("benchmark", F.col("run").alias("baseline"), "item", F.col("match").alias("base"))
    tests = paired.paired_test(this.join(base, ["benchmark", "baseline", "item"]), ["benchmark", "run"])
    return plan.join(rates, ["benchmark", "run"]).join(tests, ["benchmark", "run"], "left")


def by_tag(items: DataFrame, tags: str, matched: str) -> DataFrame:
    return paired.rates(items.select(F.explode(tags).alias("tag"), matched), ["tag"], matched)


def label_summary(labels: DataFrame, category: str) -> DataFrame:
    """category, n, share, known."""
    lab = labels.where(F.length(F.trim(F.coalesce(category, F.lit("")))) > 0).select(F.trim(category).alias("category"))
    g = lab.groupBy("category").agg(F.count("*").alias("n"))
    return g.crossJoin(g.agg(F.sum("n").alias("_t"))).select(
        "category", "n", (F.col("n") / F.col("_t")).alias("share"), F.col("category").isin(*fixed.FAILURE_CATEGORIES).alias("known"))


def _score(name: str, score: Column, passed: Column, weight: Column | float) -> Column:
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    return F.struct(F.lit(name).alias("name"), score.cast("double").alias("score"), passed.alias("passed"), w.alias("weight"))


def _share(needles: Column, hay: Column) -> Column:
    low = F.lower(F.coalesce(hay, F.lit("")))
    return F.size(F.filter(needles, lambda k: F.contains(low, F.lower(k)))) / F.size(needles)


def case_scores(cases: DataFrame) -> DataFrame:
    """Adds scores: array<struct<name, score, passed, weight>> to rows with

    tags, error, sql, must_contain, first_row, top_value, n_rows, row_min, row_max, chart_type, charts,
    narrative, must_mention, must_not_mention, confidence, min_confidence, expect_empty, expect_warning, n_warnings.
    Fixed values: the weights and pass marks of each score.
    """
    one, yes = F.lit(1.0), F.lit(True)
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    as01 = lambda b: F.when(b, 1.0).otherwise(0.0)
    chaos = F.array_contains("tags", "chaos")
    no_sql, no_text = F.coalesce(F.length("sql"), F.lit(0)) == 0, F.coalesce(F.length("narrative"), F.lit(0)) == 0

    kw = _share(F.col("must_contain"), F.col("sql"))
    keywords = (F.when(none(F.col("must_contain")), _score("sql_keywords", one, yes, 0.5))
                .when(no_sql, _score("sql_keywords", F.lit(0.0), F.lit(False), 1.0))
                .otherwise(_score("sql_keywords", kw, kw >= 0.75, 1.0)))
    target = F.lower(F.trim("top_value"))
    hit = F.exists("first_row", lambda c: F.contains(F.lower(F.trim(c)), target))
    top = (F.when(F.col("top_value").isNull(), _score("top_value", one, yes, 0.5))
           .when(F.col("n_rows") == 0, _score("top_value", F.lit(0.0), F.lit(False), 1.5))
           .otherwise(_score("top_value", as01(hit), hit, 1.5)))
    ok = (F.coalesce(F.col("n_rows") >= F.col("row_min"), yes)) & (F.coalesce(F.col("n_rows") <= F.col("row_max"), yes))
    rows = (F.when(F.col("row_min").isNull() & F.col("row_max").isNull(), _score("row_count", one, yes, 0.3))
            .otherwise(_score("row_count", as01(ok), ok, 0.5)))
    kind = F.element_at(F.split(F.lower(F.coalesce("chart_type", F.lit(""))), r"\."), -1)
    fit = F.array_contains(F.transform("charts", F.lower), kind)
    chart = (F.when(none(F.col("charts")), _score("chart_type", one, yes, 0.3))
             .otherwise(_score("chart_type", as01(fit), fit, 0.7)))
    said = _share(F.col("must_mention"), F.col("narrative"))
    mention = (F.when(none(F.col("must_mention")), _score("narrative_keywords", one, yes, 0.3))
               .when(no_text, _score("narrative_keywords", F.lit(0.0), F.lit(False), 1.0))
               .otherwise(_score("narrative_keywords", said, said >= 0.5, 1.0)))
    conf = F.coalesce("confidence", F.lit(0))
    sure = conf >= F.col("min_confidence")
    trust = (F.when(F.col("min_confidence").isNull(), _score("confidence", one, yes, 0.3))
             .otherwise(_score("confidence", F.when(sure, 1.0).otherwise(F.greatest(F.lit(0.0), conf / F.greatest("min_confidence", F.lit(1)))), sure, 0.5)))
    empty = F.when(F.col("expect_empty"), _score("expect_empty", as01(F.col("n_rows") == 0), F.col("n_rows") == 0, 1.5))
    clean = no_text | (_share(F.col("must_not_mention"), F.col("narrative")) == 0)
    banned = F.when(~none(F.col("must_not_mention")), _score("narrative_no_hallucinate", as01(clean), clean, F.when(no_text, 1.0).otherwise(1.5)))
    warned = F.col("n_warnings") > 0
    warn = F.when(F.col("expect_warning"), _score("expect_warning", as01(warned), warned, 1.0))
    ran = _score("execution", one, yes, 2.0)
    failed = F.array(_score("execution", F.lit(0.0), F.lit(False), F.when(chaos, 1.0).otherwise(2.0)))
    every = F.array_compact(F.array(ran, keywords, top, rows, chart, mention, trust, empty, banned, warn))
    return cases.withColumn("scores", F.when(F.col("error").isNotNull(), failed).otherwise(every))


def scorecard(scored: DataFrame) -> DataFrame:
    """Adds weighted_score and passed."""
    add = lambda f: F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + f(s))
    return scored.withColumn("weighted_score", add(lambda s: s["score"] * s["weight"]) / add(lambda s: s["weight"])).withColumn(
        "passed", F.col("error").isNull() & F.forall("scores", lambda s: s["passed"]))


def aggregate_cards(cards: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, kind, name, n, score: overall, pass rate, latency, then averages by dimension and tag."""
    k = list(keys)
    head = cards.groupBy(*k).agg(F.count("*").alias("n"), F.avg("weighted_score").alias("overall_score"),
                                 F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("duration_s").alias("avg_latency_seconds"))
    head = head.unpivot([*k, "n"], ["overall_score", "pass_rate", "avg_latency_seconds"], "name", "score").withColumn("kind", F.lit("overall"))
    dim = (cards.select(*k, F.explode("scores").alias("s")).groupBy(*k, F.col("s.name").alias("name"))
           .agg(F.count("*").alias("n"), F.avg("s.score").alias("score")).withColumn("kind", F.lit("dimension")))
    tag = (cards.select(*k, F.explode("tags").alias("name"), "weighted_score").groupBy(*k, "name")
           .agg(F.count("*").alias("n"), F.avg("weighted_score").alias("score")).withColumn("kind", F.lit("tag")))
    return union([x.select(*k, "kind", "name", "n", F.round("score", 3).alias("score")) for x in (head, dim, tag)])


def model_matrix(cards: DataFrame, model: str, models: list[str]) -> DataFrame:
    """One row per dimension, one column per model."""
    d = cards.select(model, F.explode("scores").alias("s")).select(model, F.col("s.name").alias("dimension"), F.col("s.score").alias("score"))
    return d.groupBy("dimension").pivot(model, models).agg(F.round(F.avg("score"), 3))


def latest(history: DataFrame, series: str, ts: str) -> DataFrame:
    """The newest record of every series."""
    cols = [c for c in history.columns if c != series]
    return history.groupBy(series).agg(F.max_by(F.struct(*cols), ts).alias("_r")).select(series, "_r.*")


def series_label(benchmark: Column, evidence: Column, split_by_evidence: str = "bird") -> Column:
    note = F.when(F.coalesce(evidence, F.lit(False)), " (evidence)").otherwise(" (no evidence)")
    return F.when(benchmark == split_by_evidence, F.concat(benchmark, note)).otherwise(benchmark)
