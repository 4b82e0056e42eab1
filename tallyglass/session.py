"""Session settings shared by the batch and streaming jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "tallyglass", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local runs; on a cluster the submit settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (local runs, tests) is a folder made here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    root = tempfile.mkdtemp(prefix=f"tallyglass-{os.getpid()}-")
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Rows that a side table may have to be sent to every task.
SENT_ROWS = 50_000


def beside(df, most: int | None = None):
    """A table of few rows, written once and marked to be sent to every task that joins it; one of more is left to Spark.

    Joins on a handful of keys would otherwise sort all rows of a key in one task.
    """
    from pyspark.sql import functions as F
    most = SENT_ROWS if most is None else most
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept


def cut(df):
    """Cut the lineage of a result that several later jobs read."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)
