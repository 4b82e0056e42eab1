"""Sources and sinks (SRC, LOG-10)."""

from pyspark.sql import functions as F

from tallyglass.functions.text import table_name
from tallyglass.operators.profile import union
from tallyglass.plans.common import money, revenue
from tallyglass.plans.registry import query
from tallyglass.sources import files, layout, sinks


@query("src_1_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = sinks.scratch(t.spark, "customer-csv")
    t.customer.write.option("header", True).csv(path)
    return files.read_csv(t.spark, path, t.customer.schema)


@query("src_2_parquet_scan", "SELECT l_returnflag, round(sum(l_extendedprice), 4) AS total FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def _(t):
    d = files.read_parquet(t.spark, t.file("lineitem"))
    return d.where("l_quantity > 45").groupBy("l_returnflag").agg(money(F.sum("l_extendedprice")).alias("total"))


@query("src_3_table_registration", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def _(t):
    first = files.register({"workspace_nation": t.nation, "workspace_region": t.region})
    return t.spark.sql(f"SELECT n_regionkey, count(*) AS n FROM {first} GROUP BY n_regionkey")


@query("src_4_table_names", """SELECT doc_id, trim(regexp_replace(lower(regexp_replace(source || ' Report-' || lang || '.v2.CSV', '\\.[^.]*$', '')), '[^\\p{L}\\p{N}]', '_', 'g'), '_') AS name FROM documents""")
def _(t):
    f = F.concat("source", F.lit(" Report-"), "lang", F.lit(".v2.CSV"))
    return t.documents.select("doc_id", table_name(F.regexp_replace(f, r"\.[^.]*$", "")).alias("name"))


@query("src_4_file_listing")
def _(t):
    return union([files.file_tables(t.spark, t.file(n)) for n in ("orders", "lineitem", "events")])


@query("src_5_existing_tables", "SELECT 'shop_' || n AS name, c AS rows FROM (SELECT 'orders' AS n, count(*) AS c FROM orders UNION ALL SELECT 'part', count(*) FROM part)")
def _(t):
    files.register({"shop_orders": t.orders, "shop_part": t.part})
    seen = files.user_tables(t.spark).where(F.col("name").isin("shop_orders", "shop_part")).select("name")
    n = union([t.spark.table(x).agg(F.count("*").alias("rows")).select(F.lit(x).alias("name"), "rows") for x in ("shop_orders", "shop_part")])
    return seen.join(n, "name")


def lake_paths(t):
    """The events as a partitioned, clustered copy and a flat one; one of each per session and source."""
    cache = t.spark.__dict__.setdefault("_tallyglass_lake", {})
    if t.path not in cache:
        path = sinks.scratch(t.spark, "events-by-date")
        layout.clustered_copy(t.events, path, "ts", "user_id")
        flat = sinks.scratch(t.spark, "events-flat")
        t.events.withColumn("event_date", F.to_date("ts")).write.parquet(flat)
        cache[t.path] = (path, flat)
    return cache[t.path]


def lake(t):
    return tuple(t.spark.read.parquet(p) for p in lake_paths(t))


@query("src_6_warehouse_scan", """SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events
 WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1""")
def _(t):
    d, _flat = lake(t)
    d = d.where(F.col("event_date").between("2024-01-08", "2024-01-14"))
    return d.groupBy("user_id").agg(F.count("*").alias("n"), money(F.sum("value")).alias("total"))


@query("src_7_json_log_scan", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 50 > 0")
def _(t):
    path = sinks.scratch(t.spark, "events-json")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    broken = F.when(F.col("event_id") % 50 > 0, line).when(F.col("event_id") % 100 == 0, "").otherwise(F.concat(F.lit("{broken "), line))
    t.events.select(broken.alias("value")).write.text(path)
    return files.read_json_log(t.spark, path, t.events.select("event_id", "user_id", "event_type", "value").schema)


@query("src_11_partitioned_copy", "SELECT strftime(ts, '%Y-%m-%d') AS event_date, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def _(t):
    d, _flat = lake(t)
    return d.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("src_11_clean_dimension", "SELECT n_name, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    twice = t.nation.unionAll(t.nation)
    dim = layout.clean_dimension(twice, ["n_nationkey", "n_name"])
    return t.customer.join(dim, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))


def estimates(t):
    d, flat = lake_paths(t)
    week, everything = F.col("event_date").between("2024-01-08", "2024-01-14"), F.col("event_date").isNotNull()
    out = []
    for tag, p in (("date range", week), ("whole period", everything)):
        for name, frame in (("partitioned", d), ("flat", flat)):
            # A flat copy cannot skip files by date: what it reads does not depend on the predicate.
            e = layout.scan_estimate(t.spark, frame, p if name == "partitioned" else F.lit(True), confirm_bytes=200_000, max_bytes=50_000_000_000)
            out.append(e.select(F.lit(tag).alias("tag"), F.lit(name).alias("layout"), "*"))
    return union(out)


@query("src_12_scan_cost")
def _(t):
    return estimates(t)


@query("src_12_scan_cost_by_column")
def _(t):
    """Two columns of a table cost what their chunks take; all columns, nearly the files."""
    d, _flat = lake_paths(t)
    every = F.lit(True)
    out = []
    for tag, path, columns in (("events: value", d, ["value"]), ("events: all", d, t.events.columns),
                               ("lineitem: price and ship date", t.file("lineitem"), ["l_extendedprice", "l_shipdate"]),
                               ("lineitem: all", t.file("lineitem"), t.lineitem.columns), ("documents: text", t.file("documents"), ["text"]),
                               ("documents: source", t.file("documents"), ["source"])):
        out.append(layout.scan_estimate(t.spark, path, every, 200_000, 50_000_000_000, columns).select(F.lit(tag).alias("tag"), "*"))
    return union(out)


@query("log_10_partition_savings")
def _(t):
    return layout.savings(estimates(t), "tag")


@query("src_13_append_sink", "SELECT r_name, CAST(2 * count(*) AS BIGINT) AS n FROM region GROUP BY 1")
def _(t):
    path = sinks.scratch(t.spark, "appended")
    sinks.append(t.region, path)
    sinks.append(t.region, path)
    return t.spark.read.parquet(path).groupBy("r_name").agg(F.count("*").alias("n"))


@query("src_14_snapshot_sink", """SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY 1""")
def _(t):
    path = sinks.scratch(t.spark, "summary")
    s = t.lineitem.groupBy("l_returnflag").agg(money(F.sum(revenue())).alias("revenue"))
    for _round in range(2):
        sinks.snapshot(s, path, "json")
    return sinks.newest_first(t.spark.read.schema(s.schema).json(path), "revenue")


@query("src_15_type_flattening", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day, round(o_totalprice, 2) AS price FROM orders""")
def _(t):
    d = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    f = files.flatten_types(d)
    return f.select("o_orderkey", F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("day"), "price")
