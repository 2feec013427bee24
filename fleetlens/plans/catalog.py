"""Queries over sources, sinks and plain listings."""

from pyspark.sql import functions as F

from fleetlens.operators import catalog as op
from fleetlens.operators import storage, workload
from fleetlens.plans.registry import query
from fleetlens.plans.storage import variants
from fleetlens.session import scratch
from fleetlens.sources import sinks, snapshots

AS_OF = "2001-08-01 00:00:00"


@query(
    "l_orderkey:i l_shipdate:t",
    "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'",
)
def snapshot_scan(t):
    return snapshots.snapshot_scan(
        t.spark, t.root, "lineitem.parquet", columns=["l_orderkey", "l_shipdate"], since="2000-01-01 00:00:00", date_column="l_shipdate"
    )


@query(
    "variant:s database_name:s end_time:t storage_in_megabytes:i plan_handle:i usecounts:i event_id:i",
    """
    SELECT 'trend' AS variant, database_name, end_time, storage_in_megabytes, NULL AS plan_handle, NULL AS usecounts, NULL AS event_id FROM resource_stats
    UNION ALL SELECT * FROM (SELECT 'top', NULL, NULL, NULL, plan_handle, usecounts, NULL FROM cached_plans ORDER BY usecounts DESC, plan_handle LIMIT 20)
    UNION ALL SELECT 'kinds', NULL, NULL, NULL, NULL, usecounts, NULL FROM (SELECT DISTINCT usecounts FROM cached_plans)
    UNION ALL SELECT 'trace', database_name, NULL, NULL, NULL, NULL, event_id FROM trace WHERE event_class = 104
    """,
)
def catalog_listing(t):
    return variants(
        trend=op.named_listing("storage_trend", t.resource_stats),
        top=op.catalog_listing(t.cached_plans, ["plan_handle", "usecounts"], order=[F.col("usecounts").desc(), F.col("plan_handle")], top=20),
        kinds=op.catalog_listing(t.cached_plans, ["usecounts"], distinct=True),
        trace=op.named_listing("trace_browse", t.trace, columns=["database_name", "event_id"], predicate=F.col("event_class") == 104,
                               order=[F.col("event_id")]),
    )


@query(
    "server_name:s database_name:s object_id:i name:s fill_factor:i schema_id:i",
    """
    SELECT 's1' AS server_name, 'sales' AS database_name, object_id, name, NULL AS fill_factor, schema_id FROM tables
    UNION ALL SELECT 's1', 'crm', object_id, name, fill_factor, NULL FROM indexes
    """,
)
def fleet_union(t):
    return snapshots.fleet_union([
        ("s1", "sales", t.tables.select("object_id", "name", "schema_id")),
        ("s1", "crm", t.indexes.select("object_id", "name", "fill_factor")),
        ("s1", "TempDB", t.index_props.select("object_id", "name")),
    ])


@query(
    "event_id:i event_name:s start_time:t spid:i",
    "SELECT t.event_id, e.name AS event_name, start_time, spid FROM trace t JOIN trace_events e ON e.trace_event_id = t.event_class",
)
def trace_scan(t):
    path = scratch(t.spark, "trace")
    t.trace.repartition(4).write.parquet(path)
    return snapshots.trace_scan(t.spark, path, t.trace_events)


@query("report:s format:s outcome:s error:s row_count:i", """
    SELECT 'disk_latency' AS report, 'parquet' AS format, 'Succeeded' AS outcome, NULL AS error, (SELECT COUNT(*) FROM io_stats) AS row_count
    UNION ALL SELECT 'growth', 'csv', 'Succeeded', NULL, (SELECT COUNT(*) FROM files)
    UNION ALL SELECT 'usage', 'json', 'Succeeded', NULL, (SELECT COUNT(*) FROM (SELECT DISTINCT sku, database_name FROM resource_stats))
    """)
def report_batch(t):
    out = scratch(t.spark, "reports")
    reports = {
        "disk_latency": storage.disk_latency(t.io_stats),
        "growth": storage.growth_setting_text(t.files),
        "usage": workload.resource_summary(t.resource_stats, ("avg_cpu_centi",), ("avg_data_io",)),
    }
    formats = {"disk_latency": "parquet", "growth": "csv", "usage": "json"}
    log = sinks.report_batch(t.spark, reports, out, formats)
    counts = None
    for name, kind in formats.items():
        reader = t.spark.read.format(kind)
        rows = (reader.option("header", "true") if kind == "csv" else reader).load(f"{out}/{name}")
        part = rows.agg(F.count(F.lit(1)).alias("row_count")).withColumn("report", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    return log.join(counts, "report", "left")


@query("o_orderkey:i o_custkey:i copies:i", "SELECT o_orderkey, o_custkey, 2 * COUNT(*) AS copies FROM orders GROUP BY o_orderkey, o_custkey")
def bulk_append(t):
    path = scratch(t.spark, "append")
    orders = t.base("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    for _ in range(2):
        sinks.bulk_append(orders, path, partition_by=["o_orderpriority"])
    return t.spark.read.parquet(path).groupBy("o_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "variant:s session_id:i sql_handle:i text:s",
    """
    SELECT 'inner' AS variant, session_id, r.sql_handle, text FROM requests r JOIN sql_text s ON s.sql_handle = r.sql_handle
    UNION ALL SELECT 'outer', session_id, r.sql_handle, text FROM requests r LEFT JOIN (SELECT * FROM sql_text WHERE length(text) > 500) s ON s.sql_handle = r.sql_handle
    """,
)
def sql_text_lookup(t):
    long_text = t.sql_text.filter(F.length("text") > 500)
    return variants(inner=op.sql_text_lookup(t.requests, t.sql_text), outer=op.sql_text_lookup(t.requests, long_text, outer=True))


@query(
    "id:i database_name:s start_time:t",
    f"SELECT id, database_name, start_time FROM command_log WHERE NOT (start_time < TIMESTAMP '{AS_OF}' - INTERVAL 42 DAY)",
)
def retention_prune(t):
    return sinks.retention_prune(t.command_log, "start_time", AS_OF)
