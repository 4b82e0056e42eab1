"""Scans: CSV, Parquet, JSON logs, table registration, catalogs of other systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.text import table_name

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """With a header. A schema avoids the extra pass that type inference takes."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json_log(spark: SparkSession, path: str, schema: T.StructType, run_id: str | None = None, since=None) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    d = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    d = d.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if run_id is not None:
        d = d.where(F.col("run_id") == run_id)
    return d if since is None else d.where(F.col("ts") >= since)


def register(frames: dict[str, DataFrame]) -> str:
    """Temp views under the given names; the first one is the primary table and its name is returned."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return next(iter(frames))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length: one row per file of a table; names and sizes only, no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")


def file_tables(spark: SparkSession, path: str) -> DataFrame:
    """file_name, table: the table name each data file stands for."""
    f = listing(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    return f.select("file_name", table_name(F.regexp_replace("file_name", r"\.[^.]*$", "")).alias("table"))


def read_database(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple | None = None,
                  partitions: int = 32, **options: str) -> DataFrame:
    """A table of another database over JDBC, split by a numeric column (the driver jar must be on the class path)."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column and bounds:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
             .option("numPartitions", partitions))
    return r.load()


def user_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """name, is_temporary of the tables a session can see: catalog metadata only."""
    rows = [(t.name, t.isTemporary) for t in (spark.catalog.listTables(database) if database else spark.catalog.listTables())]
    return spark.createDataFrame(rows, "name string, is_temporary boolean")


def flatten_types(df: DataFrame) -> DataFrame:
    """Dates to timestamps, decimals to doubles, times of day and intervals to text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DayTimeIntervalType, T.YearMonthIntervalType)) or f.dataType.typeName().startswith("time("):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)
