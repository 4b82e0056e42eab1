"""Regular calendars and Holt-Winters forecasts, many series in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.operators import history

DAY = 86_400.0
# Season lengths by frequency.
SEASONS = {"D": 7, "W": 52, "MS": 12, "YS": 1}
GRID = tuple((a, b, g) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.01, 0.1, 0.3) for g in (0.05, 0.2, 0.5))


def frequency(df: DataFrame, key: str, date: str) -> DataFrame:
    """key, freq from the median gap."""
    d = F.col("median_gap_s") / DAY
    name = F.when(d <= 2, "D").when(d <= 8, "W").when(d <= 35, "MS").otherwise("YS")
    return history.median_gap(df, [key], date).select(key, name.alias("freq"))


def regularize(df: DataFrame, key: str, date: str, value: str, how: str = "sum") -> DataFrame:
    """key, freq, period, value on a full calendar; gaps take the last value before them.

    Rows of one period are combined first, so duplicates are no problem and the
    calendar bounds what follows.
    """
    d = df.where(F.col(date).isNotNull() & F.col(value).isNotNull()).select(key, F.col(date).alias("_d"), F.col(value).cast("double").alias("_v"))
    f = frequency(df.where(F.col(value).isNotNull()).select(key, date), key, date)
    unit = {"D": "day", "W": "week", "MS": "month", "YS": "year"}
    d = d.join(f, key)
    start = None
    for k, u in unit.items():
        t = F.date_trunc(u, "_d").cast("date")
        start = F.when(F.col("freq") == k, t) if start is None else start.when(F.col("freq") == k, t)
    agg = {"sum": F.sum, "avg": F.avg, "max": F.max}[how]
    per = d.withColumn("period", start).groupBy(key, "freq", "period").agg(agg("_v").alias("_v"))
    step = {"D": "interval 1 day", "W": "interval 7 days", "MS": "interval 1 month", "YS": "interval 1 year"}
    seq = None
    for k, s in step.items():
        q = F.sequence(F.col("a"), F.col("b"), F.expr(s))
        seq = F.when(F.col("freq") == k, q) if seq is None else seq.when(F.col("freq") == k, q)
    cal = per.groupBy(key, "freq").agg(F.min("period").alias("a"), F.max("period").alias("b")).select(key, "freq", F.explode(seq).alias("period"))
    w = Window.partitionBy(key).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return cal.join(per, [key, "freq", "period"], "left").select(key, "freq", "period", F.last("_v", True).over(w).alias("value"))


def _fold(y, m, a, b, g, keep_fit: bool):
    """One pass of additive smoothing over an array; m = 1 means no season.

    The search only needs the squared error; the fitted values are kept for the winner.
    """
    zero = F.lit(0.0)
    seasonal = m > 1
    head = F.slice(y, 1, m)
    second = F.slice(y, m + 1, m)
    mean = lambda x: F.aggregate(x, zero, lambda s, v: s + v) / F.size(x)
    level0 = F.when(seasonal, mean(head)).otherwise(y[0])
    trend0 = F.when(seasonal, (mean(second) - mean(head)) / m).otherwise(y[1] - y[0])
    season0 = F.when(seasonal, F.transform(head, lambda v: v - mean(head))).otherwise(F.array(zero))
    start = F.struct(level0.alias("l"), trend0.alias("t"), season0.alias("s"), zero.alias("sse"),
                     F.array().cast("array<double>").alias("fit"))

    def step(st, v):
        # The season queue is rotated: its head is the season of this period.
        s = st["s"][0]
        fit = st["l"] + st["t"] + s
        level = a * (v - s) + (1 - a) * (st["l"] + st["t"])
        trend = b * (level - st["l"]) + (1 - b) * st["t"]
        season = F.when(seasonal, g * (v - level) + (1 - g) * s).otherwise(zero)
        rest = F.slice(st["s"], 2, F.size(st["s"]) - 1)
        return F.struct(level.alias("l"), trend.alias("t"), F.concat(rest, F.array(season)).alias("s"),
                        (st["sse"] + (v - fit) * (v - fit)).alias("sse"), (F.concat(st["fit"], F.array(fit)) if keep_fit else st["fit"]).alias("fit"))

    return F.aggregate(y, start, step)


def holt_winters(series: DataFrame, key: str, periods: int = 12, grid=GRID) -> DataFrame:
    """key, freq, step, period, forecast, lower, upper, mape, rmse, status.

    A series of fewer than four points has one row with status 'too short' and no forecast.

    The arrays are calendar-bounded. Every parameter set is a row, so the search
    runs in parallel; the smallest squared error wins.
    """
    item = F.struct("period", "value")
    every = series.groupBy(key, "freq").agg(F.array_sort(F.collect_list(item)).alias("_a"))
    s = every.where("size(_a) >= 4")
    s = s.withColumn("_y", F.transform("_a", lambda x: x["value"])).withColumn("_last", F.element_at("_a", -1)["period"])
    season = F.lit(1)
    for k, m in SEASONS.items():
        season = F.when((F.col("freq") == k) & (F.size("_y") >= 2 * m), m).otherwise(season)
    s = s.withColumn("_m", season)
    params = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(g)).alias("g")) for a, b, g in grid])
    g = s.withColumn("_p", F.explode(params)).repartition(F.col(key), F.col("_p"))
    g = g.withColumn("_sse", _fold(F.col("_y"), F.col("_m"), F.col("_p.a"), F.col("_p.b"), F.col("_p.g"), False)["sse"])
    best = g.groupBy(key, "freq").agg(F.min_by(F.struct("_y", "_last", "_m", "_p"), F.struct("_sse", "_p")).alias("_b")).select(key, "freq", "_b.*")
    best = best.withColumn("_f", _fold(F.col("_y"), F.col("_m"), F.col("_p.a"), F.col("_p.b"), F.col("_p.g"), True))
    best = best.withColumn("_e", F.zip_with("_y", F.col("_f.fit"), lambda y, f: y - f))
    n = F.size("_e")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    sd = lambda x: F.sqrt(total(F.transform(x, lambda v: (v - total(x) / F.size(x)) * (v - total(x) / F.size(x)))) / (F.size(x) - 1))
    best = best.withColumn("_se", sd(F.col("_e"))).withColumn("_sy", sd(F.col("_y")))
    spread = F.when(F.col("_se") > 0, F.col("_se")).when(F.col("_sy") > 0, F.col("_sy") * 0.1).otherwise(1.0)
    k = F.least(n, F.lit(periods))
    ys, es = F.slice("_y", n - k + 1, k), F.slice("_e", n - k + 1, k)
    mape = total(F.zip_with(ys, es, lambda y, e: F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16)))) / k * 100
    rmse = F.sqrt(total(F.transform(es, lambda e: e * e)) / k)
    best = best.withColumn("_sd", spread).withColumn("mape", F.round(mape, 2)).withColumn("rmse", F.round(rmse, 2))
    h = best.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    y = F.col("_f.l") + F.col("step") * F.col("_f.t") + F.get(F.col("_f.s"), F.pmod(F.col("step") - 1, F.size(F.col("_f.s"))))
    when = (F.when(F.col("freq") == "D", F.date_add("_last", F.col("step"))).when(F.col("freq") == "W", F.date_add("_last", F.col("step") * 7))
            .when(F.col("freq") == "MS", F.add_months("_last", F.col("step"))).otherwise(F.add_months("_last", F.col("step") * 12)))
    out = h.select(key, "freq", "step", when.alias("period"), y.alias("forecast"), (y - 1.96 * F.col("_sd")).alias("lower"),
                   (y + 1.96 * F.col("_sd")).alias("upper"), "mape", "rmse", F.lit("ok").alias("status"))
    short = every.where("size(_a) < 4").select(key, "freq", F.lit("too short").alias("status"))
    return out.unionByName(short, allowMissingColumns=True)
