"""Timing of headline queries: prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Besides the queries on
the given tables, the four shapes of the published baseline run on a generated
table (BENCH_ROWS rows, 10 million by default), cached in Parquet for the run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "jn_2_region_revenue", "agg_2_grouped", "agg_10_statistical", "jn_4_dimension_in_two_roles", "jn_5_left_outer_zero_groups",
    "win_3_rank_top_per_partition", "win_6_rolling_day_count", "golden_best_brand_per_region", "golden_never_bought_a_type",
    "warehouse_range_aggregates", "warehouse_revenue_by_region", "prf_3_top_values", "st_1_tukey_outliers", "ml_5_iqr_anomalies",
    "txt_1_instruction_like", "pii_6_free_text", "fth_1_claim_check", "ret_1_bm25_index", "log_6_drift_windows", "ev_11_case_scorecard",
)
REPS = int(os.environ.get("BENCH_REPS", "2"))


def timed(make, reps: int = REPS) -> float:
    """Median seconds of `reps` runs after one warm-up; every row is produced, none is kept."""
    def once() -> float:
        t0 = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    once()
    return statistics.median(once() for _ in range(reps))


def main() -> None:
    from pyspark.sql import functions as F

    from tallyglass.plans import load_all
    from tallyglass.session import get_session
    from tallyglass.sources import synthetic
    from tallyglass.tables import Tables

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rows = int(os.environ.get("BENCH_ROWS", "10000000"))
    spark = get_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry, tables, out = load_all(), Tables(spark, sf), {}
    for key in HEADLINE:
        out[key] = round(timed(lambda k=key: registry[k].build(tables)), 4)
        print(key, out[key], file=sys.stderr, flush=True)

    folder = tempfile.mkdtemp(prefix="run-bench-")
    t0 = time.perf_counter()
    synthetic.orders(spark, rows).write.parquet(f"{folder}/orders")
    load = time.perf_counter() - t0
    o = spark.read.parquet(f"{folder}/orders")
    shapes = {
        "group_by_sum": lambda: o.groupBy("region").agg(F.sum("amount").alias("s")).orderBy(F.desc("s")),
        "filtered_count": lambda: o.where("category = 'cat_7' AND amount > 50").agg(F.count("*").alias("n")),
        "monthly_trend": lambda: o.groupBy(F.substring("order_date", 1, 7).alias("m")).agg(F.sum("amount").alias("s")).orderBy("m"),
        "top_10_categories": lambda: o.groupBy("category").agg(F.avg("amount").alias("a")).orderBy(F.desc("a")).limit(10),
    }
    for name, make in shapes.items():
        out[f"generated_{name}"] = round(timed(make, 5), 4)
    out["generated_load"] = round(load, 4)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out,
                      "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus), "generated_rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
