"""Rows outside the fences of any numeric column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.operators import stats
from tallyglass.operators.present import numeric_columns


def detect(df: DataFrame, cols: list[str] | None = None, threshold: float = 1.5, exact: bool = True) -> DataFrame:
    """The flagged rows with anomaly_reason. Fences travel as one row."""
    cols = cols or numeric_columns(df)
    f = stats.fences(df, cols, threshold, exact).where("q1 <> q3")
    one = f.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.struct("lo", "hi"))).alias(f"_f_{c}") for c in cols])
    j = df.crossJoin(one)
    out = {c: (F.col(c) < F.col(f"_f_{c}.lo")) | (F.col(c) > F.col(f"_f_{c}.hi")) for c in cols}
    said = [F.when(o, F.format_string(f"{c} outside [%.2f, %.2f]; ", F.col(f"_f_{c}.lo"), F.col(f"_f_{c}.hi"))).otherwise("") for c, o in out.items()]
    return j.select(*df.columns, F.concat(*said).alias("anomaly_reason")).where("anomaly_reason <> ''")


def rate(df: DataFrame, flagged: DataFrame) -> DataFrame:
    n = df.agg(F.count("*").alias("total_records"))
    return n.crossJoin(flagged.agg(F.count("*").alias("total_anomalies"))).select(
        "total_anomalies", "total_records", F.round(100.0 * F.col("total_anomalies") / F.greatest("total_records", F.lit(1)), 2).alias("anomaly_rate"))
