"""Queries over indexes, objects, files, buffer pool and plan cache."""

from pyspark.sql import functions as F

from fleetlens.operators import dependencies
from fleetlens.operators import storage as op
from fleetlens.plans.registry import check_ratio, query


def variants(**frames):
    """Stack variants of one report under a label."""
    out = None
    for label, df in frames.items():
        part = df.withColumn("variant", F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


_DETAIL = """
    SELECT {variant} AS variant, s.name AS schema_name, t.name AS table_name, p.index_id, i.name AS index_name, type_desc,
      avg_fragmentation_in_percent, page_count, fill_factor
    FROM index_phys p JOIN indexes i ON i.object_id = p.object_id AND i.index_id = p.index_id
    JOIN tables t ON t.object_id = p.object_id JOIN schemas s ON s.schema_id = t.schema_id
"""


@query(
    "variant:s schema_name:s table_name:s index_id:i index_name:s type_desc:s avg_fragmentation_in_percent:i page_count:i fill_factor:i",
    _DETAIL.format(variant="'all_rows'") + " UNION ALL " + _DETAIL.format(variant="'fragmented'")
    + " WHERE avg_fragmentation_in_percent > 0 AND i.name IS NOT NULL",
)
def index_physical_detail(t):
    args = (t.index_phys, t.indexes, t.tables, t.schemas)
    return variants(
        all_rows=op.index_physical_detail(*args),
        fragmented=op.index_physical_detail(*args, min_frag=0, named_only=True),
    )


@query(
    "object_id:i index_id:i avg_fragmentation_in_percent:s page_count:i",
    """
    SELECT object_id, index_id, CAST(avg_fragmentation_in_percent AS VARCHAR) AS avg_fragmentation_in_percent, page_count
    FROM index_phys WHERE avg_fragmentation_in_percent > 50 AND page_count > 100
    """,
)
def index_fragmentation_alert(t):
    staged = t.index_phys.withColumn("avg_fragmentation_in_percent", F.col("avg_fragmentation_in_percent").cast("string"))
    return op.index_fragmentation_alert(staged)


@query(
    "object_id:i index_id:i name:s",
    """
    SELECT object_id, index_id, name FROM indexes i
    WHERE NOT EXISTS (SELECT 1 FROM index_usage u WHERE u.object_id = i.object_id AND u.index_id = i.index_id)
    """,
)
def indexes_unused(t):
    return op.indexes_unused(t.indexes, t.index_usage)


@query(
    "table_name:s index_name:s last_user_seek:t last_user_scan:t",
    """
    SELECT t.name AS table_name, i.name AS index_name, MAX(last_user_seek) AS last_user_seek, MAX(last_user_scan) AS last_user_scan
    FROM index_usage u JOIN indexes i ON i.object_id = u.object_id AND i.index_id = u.index_id
    JOIN index_keys k ON k.object_id = u.object_id AND k.index_id = i.index_id
    JOIN tables t ON t.object_id = u.object_id
    WHERE t.name LIKE 'T%1%' GROUP BY t.name, u.object_id, i.name
    """,
)
def index_last_usage(t):
    return op.index_last_usage(t.index_usage, t.indexes, t.index_keys, t.tables, "T%1%")


@query(
    "index_group_handle:i index_handle:i improvement_measure:d create_index_statement:s",
    """
    SELECT index_group_handle, g.index_handle,
      avg_total_user_cost::DOUBLE * (avg_user_impact::DOUBLE / 100.0::DOUBLE) * (user_seeks + user_scans)::DOUBLE AS improvement_measure,
      'CREATE INDEX [missing_index_' || index_group_handle || '_' || g.index_handle || '_T' || g.index_handle || '] ON ' || statement
      || ' (' || COALESCE(equality_columns, '')
      || CASE WHEN equality_columns IS NOT NULL AND inequality_columns IS NOT NULL THEN ',' ELSE '' END
      || COALESCE(inequality_columns, '') || ')' || COALESCE(' INCLUDE (' || included_columns || ')', '') AS create_index_statement
    FROM mi_groups g JOIN mi_stats s ON s.group_handle = g.index_group_handle JOIN mi_details d ON d.index_handle = g.index_handle
    WHERE avg_total_user_cost::DOUBLE * (avg_user_impact::DOUBLE / 100.0::DOUBLE) * (user_seeks + user_scans)::DOUBLE > 10
    """,
)
def missing_index_advice(t):
    return op.missing_index_advice(t.mi_groups, t.mi_stats, t.mi_details)


_HINTS = """
    SELECT o_custkey % 4 AS edition, o_orderkey AS plan_handle, 'select ' || o_custkey AS sql_text, o_custkey % 100 AS impact_pct,
      o_custkey % 90 AS cached_plan_size_kb, o_orderkey % 40 AS compile_time_ms, o_orderkey % 30 AS compile_cpu_ms,
      o_orderkey % 70 AS compile_memory_kb, '[db1].[dbo].[T' || o_custkey || ']' AS object,
      'CREATE NONCLUSTERED INDEX [IX' || CASE WHEN o_orderkey % 4 <> 0 THEN '_a' || (o_orderkey % 7) || '_b' || (o_orderkey % 5) ELSE '' END
      || CASE WHEN o_orderkey % 4 <> 1 THEN '_q' || (o_orderkey % 3) ELSE '' END
      || CASE WHEN o_orderkey % 3 = 0 THEN '_z@' || (o_custkey % 9) ELSE '' END || '] ON [db1].[dbo].[T' || o_custkey || ']('
      || CASE WHEN o_orderkey % 4 <> 0 THEN '[a' || (o_orderkey % 7) || '],[b' || (o_orderkey % 5) || ']' ELSE '' END
      || CASE WHEN o_orderkey % 4 > 1 THEN ',' ELSE '' END
      || CASE WHEN o_orderkey % 4 <> 1 THEN '[q' || (o_orderkey % 3) || ']' ELSE '' END || ')'
      || CASE WHEN o_orderkey % 3 = 0 THEN ' INCLUDE ([z' || (o_custkey % 9) || '])' ELSE '' END
      || CASE WHEN o_custkey % 4 = 3 THEN ' WITH (ONLINE = ON);' ELSE ';' END AS missing_index_creation,
      o_orderdate AS creation_time, o_orderkey % 100 + 1 AS execution_count, o_orderkey * 7 / 1000.0 AS total_worker_time_ms,
      o_custkey * 11 / 1000.0 AS last_elapsed_time_ms
    FROM orders WHERE o_orderpriority <> '5-LOW'
"""


@query(
    "edition:i plan_handle:i sql_text:s impact_pct:d cached_plan_size_kb:i compile_time_ms:i compile_cpu_ms:i compile_memory_kb:i "
    "object:s missing_index_creation:s creation_time:t execution_count:i total_worker_time_ms:d last_elapsed_time_ms:d",
    _HINTS,
)
def missing_index_from_plans(t):
    return op.missing_index_from_plans(t.plan_stats, t.spread("showplans"), "edition")


_PIVOT = ", ".join(f"COALESCE(MIN(CASE WHEN keyno = {n} THEN col END), '') AS col{n}" for n in range(1, 17))


@query(
    "object_id:i index_id:i table_name:s schema_name:s index_name:s fill_factor:i is_disabled:i cl:s size_mb:i alloc_count:i "
    "disable_text:s rebuild_text:s " + " ".join(f"col{n}:s" for n in range(1, 17)),
    f"""
    WITH keyed AS (
      SELECT object_id, index_id, {_PIVOT},
        MIN(CASE WHEN keyno = 1 THEN type_name || CASE WHEN type_name IN ('varchar', 'nchar') THEN '(' || max_length || ')' ELSE '' END END) AS key_type,
        MIN(CASE WHEN keyno = 1 THEN COALESCE(default_definition, CASE WHEN is_identity = 1 THEN 'IDENTITY' END) END) AS key_mark
      FROM typed_keys GROUP BY object_id, index_id),
    splits AS (
      SELECT object_id, index_id, SUM(COALESCE(leaf_allocation_count, 0) + COALESCE(nonleaf_allocation_count, 0)) AS n
      FROM operational_stats GROUP BY object_id, index_id)
    SELECT k.* EXCLUDE (key_type, key_mark), t.name AS table_name, s.name AS schema_name, COALESCE(p.name, '!! HEAP !!') AS index_name,
      fill_factor, is_disabled, used_pages * 8 // 1024 AS size_mb, COALESCE(n, 0) AS alloc_count,
      CASE WHEN k.index_id = 1 THEN 'CL: ' || COALESCE(key_type, '') || ' ' || COALESCE(key_mark, '') ELSE 'NC' END AS cl,
      'ALTER INDEX ' || COALESCE(p.name, '') || ' ON ' || s.name || '.' || t.name || ' DISABLE;' AS disable_text,
      'ALTER INDEX ' || COALESCE(p.name, '') || ' ON ' || s.name || '.' || t.name || ' REBUILD;' AS rebuild_text
    FROM keyed k JOIN index_props p ON p.object_id = k.object_id AND p.index_id = k.index_id
    JOIN tables t ON t.object_id = k.object_id JOIN schemas s ON s.schema_id = t.schema_id
    LEFT JOIN splits x ON x.object_id = k.object_id AND x.index_id = k.index_id
    """,
)
def index_key_pivot(t):
    return op.index_key_pivot(t.typed_keys, t.index_props, t.tables, t.schemas, op.index_alloc_counts(t.operational_stats))


@query(
    "object_id:i index_id:i alloc_count:i",
    """
    SELECT object_id, index_id, SUM(COALESCE(leaf_allocation_count, 0) + COALESCE(nonleaf_allocation_count, 0)) AS alloc_count
    FROM operational_stats GROUP BY object_id, index_id
    """,
)
def index_alloc_counts(t):
    return op.index_alloc_counts(t.operational_stats)


_ROLLUP = """
    SELECT '{label}' AS variant, s.name AS schema_name, t.name AS table_name, COALESCE(i.name, '') AS index_name,
      SUM(total_pages) AS total_pages, SUM(used_pages) AS used_pages, SUM(data_pages) AS data_pages,
      SUM(total_pages) * 8 // 1024 AS total_mb, SUM(used_pages) * 8 // 1024 AS used_mb, SUM(data_pages) * 8 // 1024 AS data_mb,
      COALESCE({agg}(z.mb), 0) AS indexes_mb
    FROM tables t JOIN indexes i ON i.object_id = t.object_id JOIN alloc_units a ON a.container_id = i.partition_id
    JOIN schemas s ON s.schema_id = t.schema_id
    LEFT JOIN (SELECT object_id, 8 * SUM(used_pages) // 1024 AS mb FROM indexes i JOIN alloc_units a ON a.container_id = i.partition_id
               WHERE index_id > 1 GROUP BY object_id) z ON z.object_id = t.object_id
    WHERE i.index_id <= 1 GROUP BY s.name, t.name, i.object_id, i.index_id, i.name
"""


@query(
    "variant:s schema_name:s table_name:s index_name:s total_pages:i used_pages:i data_pages:i total_mb:i used_mb:i data_mb:i indexes_mb:i",
    _ROLLUP.format(label="once", agg="MAX") + " UNION ALL " + _ROLLUP.format(label="per_unit", agg="SUM"),
)
def table_size_rollup(t):
    args = (t.tables, t.indexes, t.alloc_units, t.schemas)
    return variants(once=op.table_size_rollup(*args), per_unit=op.table_size_rollup(*args, reference_fanout=True))


@query(
    "database_id:i database:s mb_allocated:i mb_used:i mb_empty:i",
    """
    SELECT b.database_id, d.name AS database, COUNT(*) * 8 // 1024 AS mb_allocated,
      SUM(8192 - free_space_in_bytes) // 1048576 AS mb_used, SUM(free_space_in_bytes) // 1048576 AS mb_empty
    FROM buffer_desc b LEFT JOIN databases d ON d.database_id = b.database_id GROUP BY b.database_id, d.name
    """,
)
def buffer_pool_by_database(t):
    return op.buffer_pool_by_database(t.buffer_desc, t.databases)


@query(
    "object_id:i index_id:i index_name:s dirty_pages:i clean_pages:i total_mem_mb:d free_space_mb:d free_space_pct:d",
    f"""
    SELECT p.object_id, p.index_id, i.name AS index_name, dirty_pages, clean_pages,
      {check_ratio('(dirty_pages + clean_pages) * 8', '1024', 6)} AS total_mem_mb,
      {check_ratio('free', '1048576', 6)} AS free_space_mb,
      {check_ratio('(free // 1024) * 100', '(dirty_pages + clean_pages) * 8', 1)} AS free_space_pct
    FROM (SELECT allocation_unit_id, COUNT(*) FILTER (is_modified = 1) AS dirty_pages, COUNT(*) FILTER (is_modified <> 1) AS clean_pages,
            CAST(SUM(free_space_in_bytes) AS BIGINT) AS free FROM buffer_desc GROUP BY allocation_unit_id) b
    JOIN au_map a ON a.allocation_unit_id = b.allocation_unit_id JOIN partitions p ON p.partition_id = a.container_id
    JOIN indexes i ON i.object_id = p.object_id AND i.index_id = p.index_id WHERE p.object_id > 100
    """,
)
def buffer_pool_by_index(t):
    return op.buffer_pool_by_index(t.buffer_desc, t.au_map, t.partitions, t.indexes)


@query(
    "stolen_mb:i plan_cache_mb:i buffer_pool_mb:i",
    """
    SELECT (SELECT cntr_value // 1024 FROM perf_counters WHERE counter_name LIKE 'Stolen%') AS stolen_mb,
      (SELECT SUM(pages_kb) // 1024 FROM cache_counters WHERE type LIKE 'CACHESTORE%') AS plan_cache_mb,
      (SELECT COUNT(*) * 8 // 1024 FROM buffer_desc) AS buffer_pool_mb
    """,
)
def memory_distribution(t):
    return op.memory_distribution(t.perf_counters, t.cache_counters, t.buffer_desc)


def _bucket(variant, name, where, full):
    more = ", SUM(refcounts) AS all_ref_objects, SUM(usecounts) // COUNT(*) AS avg_usecount" if full else ", NULL AS all_ref_objects, NULL AS avg_usecount"
    return f"SELECT '{variant}' AS variant, '{name}' AS bucket, COUNT(*) AS plan_count, SUM(size_in_bytes) // 1048576 AS size_mb{more} FROM cached_plans WHERE {where}"


@query(
    "variant:s bucket:s plan_count:i size_mb:i all_ref_objects:i avg_usecount:i",
    " UNION ALL ".join([
        _bucket("three", "One_call", "usecounts = 1", False), _bucket("three", "Two_calls", "usecounts = 2", False),
        _bucket("three", "More_than_two", "usecounts >= 3", False), _bucket("two", "single_use", "usecounts = 1", True),
        _bucket("two", "reused", "usecounts > 1", True), _bucket("empty", "One_call", "usecounts = 1 AND usecounts <> 1", False),
        _bucket("empty", "Two_calls", "usecounts = 2", False), _bucket("empty", "More_than_two", "usecounts >= 3", False),
    ]),
)
def plan_cache_reuse(t):
    return variants(
        three=op.plan_cache_reuse(t.cached_plans), two=op.plan_cache_reuse(t.cached_plans, "1/>1"),
        empty=op.plan_cache_reuse(t.cached_plans.filter(F.col("usecounts") != 1)),
    )


@query(
    "table_name:s schema_name:s kind:s index_name:s index_id:i partition_number:i data_compression_desc:s",
    """
    SELECT t.name AS table_name, s.name AS schema_name, 'table' AS kind, NULL AS index_name, index_id, partition_number, data_compression_desc
    FROM partitions p JOIN tables t ON t.object_id = p.object_id JOIN schemas s ON s.schema_id = t.schema_id WHERE index_id IN (0, 1)
    UNION ALL
    SELECT t.name, s.name, 'index', i.name, p.index_id, partition_number, p.data_compression_desc
    FROM partitions p JOIN tables t ON t.object_id = p.object_id JOIN schemas s ON s.schema_id = t.schema_id
    JOIN indexes i ON i.object_id = p.object_id AND i.index_id = p.index_id WHERE p.index_id > 1
    """,
)
def compression_status(t):
    return op.compression_status(t.partitions, t.tables, t.indexes, t.schemas)


@query(
    "schema_name:s table_name:s index_name:s script:s",
    """
    SELECT DISTINCT s.name AS schema_name, t.name AS table_name, NULL AS index_name,
      'ALTER TABLE [' || s.name || '].[' || t.name || '] REBUILD WITH(DATA_COMPRESSION = PAGE )' AS script
    FROM partitions p JOIN tables t ON t.object_id = p.object_id JOIN alloc_units a ON a.container_id = p.partition_id
    JOIN schemas s ON s.schema_id = t.schema_id WHERE p.index_id IN (0, 1) AND p.data_compression_desc = 'NONE'
    UNION
    SELECT s.name, t.name, i.name, 'ALTER INDEX [' || i.name || '] ON [' || s.name || '].[' || t.name
      || '] REBUILD WITH (SORT_IN_TEMPDB = ON, DATA_COMPRESSION = PAGE )'
    FROM partitions p JOIN tables t ON t.object_id = p.object_id JOIN schemas s ON s.schema_id = t.schema_id
    JOIN indexes i ON i.object_id = p.object_id AND i.index_id = p.index_id WHERE p.index_id > 1 AND p.data_compression_desc = 'NONE'
    """,
)
def compression_candidates(t):
    return op.compression_candidates(t.partitions, t.tables, t.schemas, t.alloc_units, t.indexes)


@query(
    "database_id:i file_id:i name:s file_group:s allocated_mb:d used_mb:d available_mb:d free_pct:d",
    f"""
    SELECT database_id, file_id, name, COALESCE(groupname, 'Log') AS file_group, {check_ratio('size_pages', '128', 2)} AS allocated_mb,
      {check_ratio('used_pages', '128', 2)} AS used_mb, {check_ratio('size_pages - used_pages', '128', 2)} AS available_mb,
      {check_ratio('10000 * ((200 * (size_pages - used_pages) + 128) // 256)', '100 * ((200 * size_pages + 128) // 256)', 4)} AS free_pct
    FROM db_files f LEFT JOIN filegroups g ON g.groupid = f.group_id
    """,
)
def file_space_usage(t):
    return op.file_space_usage(t.db_files, t.filegroups)


_TOTALS = f"""
    SELECT database_id, {check_ratio('SUM(used_pages) * 8', '1024', 4)} AS space_used_mb,
      {check_ratio('SUM(size_pages - used_pages)', '128', 4)} AS space_unused_mb,
      {check_ratio('SUM(size_pages) * 8', '1024', 4)} AS space_allocated_mb
"""


@query(
    "variant:s database_id:i space_used_mb:d space_unused_mb:d space_allocated_mb:d",
    _TOTALS + ", 'all_files' AS variant FROM files GROUP BY database_id UNION ALL " + _TOTALS
    + ", 'rows_only' AS variant FROM files WHERE type = 0 GROUP BY database_id",
)
def database_space_totals(t):
    return variants(all_files=op.database_space_totals(t.files), rows_only=op.database_space_totals(t.files, rows_only=True))


@query(
    "name:s owner:s recovery_model_desc:s read_only:s data_mb:i log_mb:i change_owner_text:s",
    """
    SELECT d.name, l.name AS owner, recovery_model_desc, CASE WHEN is_read_only = 1 THEN 'READ ONLY' ELSE '' END AS read_only,
      (SELECT SUM(size_pages * 8 // 1024) FROM files f WHERE f.database_id = d.database_id AND type = 0) AS data_mb,
      (SELECT SUM(size_pages * 8 // 1024) FROM files f WHERE f.database_id = d.database_id AND type = 1) AS log_mb,
      'use [' || d.name || '];exec sp_changedbowner ''sa''' AS change_owner_text
    FROM databases d LEFT JOIN logins l ON l.sid = d.owner_id WHERE d.name NOT IN ('master', 'model', 'msdb', 'tempdb')
    """,
)
def database_size_summary(t):
    return op.database_size_summary(t.databases, t.files, t.logins)


_AG = """
    SELECT {label} AS variant, replica_server_name, is_primary_replica, {ag} AS ag_name, COUNT(d.database_id) AS databases,
      SUM(pages // 128) AS size_mb, SUM({gb}) AS size_gb
    FROM db_replica_states s JOIN replicas r ON r.replica_id = s.replica_id {join}
    LEFT JOIN ag_databases d ON d.group_database_id = s.group_database_id
    LEFT JOIN (SELECT database_id, SUM(size_pages) AS pages FROM files GROUP BY database_id) f ON f.database_id = d.database_id
    WHERE is_local = 1 GROUP BY ALL
"""
_GB = "CAST((200 * pages + 131072) // 262144 AS DECIMAL(18, 0)) / 100"


@query(
    "variant:s replica_server_name:s is_primary_replica:i ag_name:s databases:i size_mb:i size_centi_gb:i",
    "SELECT * EXCLUDE (size_gb), round(size_gb * 100) AS size_centi_gb FROM ("
    + _AG.format(label="'by_role'", ag="NULL", join="", gb=_GB) + " UNION ALL "
    + _AG.format(label="'by_ag'", ag="g.name", join="JOIN ag_groups g ON g.group_id = s.group_id", gb=_GB) + ")",
)
def ag_size_by_replica(t):
    args = (t.db_replica_states, t.replicas, t.ag_databases, t.files, t.ag_groups)
    both = variants(by_role=op.ag_size_by_replica(*args), by_ag=op.ag_size_by_replica(*args, by_ag=True))
    return both.withColumn("size_centi_gb", F.col("size_gb") * 100)


_GROWTH = """CASE WHEN growth = 0 THEN 'N/A' WHEN is_percent_growth = 1 THEN growth || ' percent' ELSE (growth // 128) || ' mb' END
    || CASE WHEN growth = 0 THEN '' WHEN max_size = -1 THEN ' unrestricted' ELSE ' max of ' || (max_size // 128) || ' mb' END"""


@query(
    "database:s recovery_model_desc:s log_name:s autogrow:s alter_growth:s total_vlfs:i active_vlfs:i size_mb:i",
    f"""
    WITH logs AS (SELECT * FROM files WHERE type = 1),
    active AS (SELECT database_id, COUNT(*) AS n FROM log_vlfs WHERE status = 2 GROUP BY database_id)
    SELECT d.name AS database, recovery_model_desc, f.name AS log_name, {_GROWTH} AS autogrow,
      CASE WHEN is_percent_growth = 1 THEN 'USE [master];ALTER DATABASE [' || d.name || '] MODIFY FILE ( NAME = N''' || f.name
        || ''',FILEGROWTH = 64MB);' ELSE '' END AS alter_growth,
      COUNT(*) AS total_vlfs, MAX(a.n) AS active_vlfs, SUM(file_size) // 1048576 AS size_mb
    FROM log_vlfs v JOIN active a ON a.database_id = v.database_id
    JOIN logs f ON f.database_id = v.database_id AND f.file_id = v.file_id JOIN databases d ON d.database_id = f.database_id
    WHERE f.database_id IN (SELECT database_id FROM logs GROUP BY database_id HAVING COUNT(*) = 1) GROUP BY ALL
    """,
)
def vlf_stats(t):
    return op.vlf_stats(t.log_vlfs, t.files.filter(F.col("type") == 1), t.databases)


@query(
    "database_id:i vlfs:i",
    "SELECT database_id, COUNT(*) AS vlfs FROM log_vlfs GROUP BY database_id HAVING COUNT(*) >= 90",
)
def vlf_alert(t):
    return op.vlf_alert(t.log_vlfs, 90)


@query(
    "variant:s database_id:i file_count:i name:s",
    """
    SELECT 'many_logs' AS variant, database_id, COUNT(*) AS file_count, NULL AS name FROM files WHERE type = 1 GROUP BY database_id HAVING COUNT(*) > 1
    UNION ALL
    SELECT 'simple', database_id, NULL, name FROM databases WHERE is_read_only <> 1
      AND database_id IN (SELECT database_id FROM files GROUP BY database_id HAVING COUNT(*) = 3)
    """,
)
def multi_log_databases(t):
    return variants(
        many_logs=op.multi_log_databases(t.files.filter(F.col("type") == 1)),
        simple=op.multi_log_databases(t.files, 3, "=", t.databases, t.databases.filter(F.col("is_read_only") == 1)),
    )


@query(
    "database_id:i file_id:i autogrow:s growth_short:s",
    f"""
    SELECT database_id, file_id, {_GROWTH} AS autogrow,
      CASE WHEN is_percent_growth = 1 THEN growth || ' percent(s)' ELSE (growth // 128) || ' MB(s)' END AS growth_short FROM files
    """,
)
def growth_setting_text(t):
    return op.growth_setting_text(t.files)


def _lat(a, b):
    return f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) // ({b}) END"


@query(
    "database_id:i file_id:i read_latency:i write_latency:i latency:i avg_b_per_read:i avg_b_per_write:i avg_b_per_transfer:i "
    "read_latency_governed:i write_latency_governed:i",
    f"""
    SELECT database_id, file_id, {_lat('io_stall_read_ms', 'num_of_reads')} AS read_latency,
      {_lat('io_stall_write_ms', 'num_of_writes')} AS write_latency,
      {_lat('io_stall_read_ms + io_stall_write_ms', 'num_of_reads + num_of_writes')} AS latency,
      {_lat('num_of_bytes_read', 'num_of_reads')} AS avg_b_per_read, {_lat('num_of_bytes_written', 'num_of_writes')} AS avg_b_per_write,
      {_lat('num_of_bytes_read + num_of_bytes_written', 'num_of_reads + num_of_writes')} AS avg_b_per_transfer,
      {_lat('file_id * 100', 'num_of_reads')} AS read_latency_governed, {_lat('file_id * 200', 'num_of_writes')} AS write_latency_governed
    FROM io_stats
    """,
)
def disk_latency(t):
    queued = t.io_stats.withColumns({
        "io_stall_queued_read_ms": F.col("file_id") * 100, "io_stall_queued_write_ms": F.col("file_id") * 200,
    })
    return op.disk_latency(queued)


@query(
    "schema_name:s table_name:s column_name:s stat_name:s stats_date:t auto_created:i user_created:i",
    """
    SELECT s.name AS schema_name, t.name AS table_name, c.name AS column_name, st.name AS stat_name, stats_date, auto_created, user_created
    FROM stat_objects st JOIN stat_columns sc ON sc.object_id = st.object_id AND sc.stats_id = st.stats_id
    JOIN part_columns c ON c.object_id = sc.object_id AND c.column_id = sc.column_id
    JOIN part_tables t ON t.object_id = st.object_id JOIN schemas s ON s.schema_id = t.schema_id
    WHERE is_ms_shipped = 0 AND (auto_created = 1 OR user_created = 1)
    """,
)
def statistics_inventory(t):
    return op.statistics_inventory(t.stat_objects, t.stat_columns, t.part_columns, t.part_tables, t.schemas)


@query(
    "schema_id:i last_date:t",
    """
    SELECT schema_id, MIN(stats_date) AS last_date FROM index_phys p JOIN tables t ON t.object_id = p.object_id
    GROUP BY schema_id HAVING MIN(stats_date) < TIMESTAMP '2001-10-15' - INTERVAL 30 DAY
    """,
)
def stale_statistics(t):
    return op.stale_statistics(t.index_phys, t.tables, as_of="2001-10-15 00:00:00", by=("schema_id",))


@query(
    "referencing_id:i invalid_object:s type_desc:s referenced_name:s",
    """
    SELECT referencing_id, o.name AS invalid_object, type_desc, referenced_name FROM code_dependencies d
    JOIN code_objects o ON o.object_id = d.referencing_id
    WHERE is_ambiguous = 0 AND referenced_name_id NOT IN (SELECT object_id FROM known_objects)
      AND NOT (type_desc = 'SQL_TRIGGER' AND referenced_name IN ('inserted', 'deleted'))
    """,
)
def invalid_objects(t):
    return op.invalid_objects(t.code_dependencies, t.code_objects, t.known_objects)


@query(
    "object_id:i parent:s schema_name:s trigger_name:s kind:s is_ms:s is_on:s is_replicated:s event:s",
    """
    WITH listed AS (
      SELECT object_id, string_agg(label, ', ' ORDER BY type, label) AS events FROM (
        SELECT DISTINCT object_id, type, type_desc[1] || lower(type_desc[2:33])
          || CASE WHEN is_first = 1 THEN ' (First)' WHEN is_last = 1 THEN ' (Last)' ELSE '' END AS label FROM trigger_events)
      GROUP BY object_id)
    SELECT t.object_id, CASE WHEN parent_class = 0 THEN '(Database)' ELSE o.name END AS parent,
      COALESCE(s.name, '(None)') AS schema_name, t.name AS trigger_name, left(type_desc, 3) AS kind,
      CASE WHEN is_ms_shipped = 1 THEN 'X' ELSE ' ' END AS is_ms, CASE WHEN is_disabled = 0 THEN 'X' ELSE ' ' END AS is_on,
      CASE WHEN is_not_for_replication = 0 THEN 'X' ELSE ' ' END AS is_replicated,
      CASE WHEN parent_class = 0 THEN g.event_group
        ELSE CASE WHEN is_instead_of_trigger = 1 THEN 'Instead Of ' ELSE 'After ' END || events END AS event
    FROM triggers t LEFT JOIN listed e ON e.object_id = t.object_id
    LEFT JOIN (SELECT object_id, string_agg(DISTINCT event_group_type_desc, ', ' ORDER BY event_group_type_desc) AS event_group FROM trigger_events GROUP BY object_id) g ON g.object_id = t.object_id
    LEFT JOIN trigger_parents o ON o.object_id = t.parent_id
    LEFT JOIN schemas s ON s.schema_id = o.schema_id
    """,
)
def trigger_inventory(t):
    return op.trigger_inventory(t.triggers, t.trigger_events, t.trigger_parents, t.schemas)


@query(
    "object_id:i schema_name:s table_name:s ddl:s",
    """
    WITH cols AS (
      SELECT object_id, string_agg('[' || column_name || '] ' || upper(type_name)
        || CASE type_name WHEN 'varchar' THEN '(' || CASE WHEN max_length = -1 THEN 'MAX' ELSE max_length::VARCHAR END || ')'
             WHEN 'nvarchar' THEN '(' || (max_length // 2) || ')' WHEN 'datetime2' THEN '(4)' WHEN 'decimal' THEN '(18,4)' ELSE '' END
        || CASE WHEN collation_name IS NOT NULL THEN ' COLLATE ' || collation_name ELSE '' END
        || CASE WHEN is_nullable = 1 THEN ' NULL' ELSE ' NOT NULL' END
        || CASE WHEN default_definition IS NOT NULL THEN ' DEFAULT' || default_definition ELSE '' END
        || CASE WHEN is_identity = 1 THEN ' IDENTITY(1,1)' ELSE '' END, chr(13) || chr(9) || ', ' ORDER BY column_id) AS body
      FROM table_columns GROUP BY object_id),
    keys AS (
      SELECT object_id, constraint_name, string_agg('[' || column_name || '] ' || CASE WHEN is_descending_key = 1 THEN 'DESC' ELSE 'ASC' END,
        ', ' ORDER BY key_ordinal) AS list FROM table_pks GROUP BY object_id, constraint_name)
    SELECT c.object_id, s.name AS schema_name, t.name AS table_name,
      'CREATE TABLE [' || s.name || '].[' || t.name || ']' || chr(13) || '(' || chr(13) || chr(9) || '  ' || body || chr(13)
      || COALESCE(chr(9) || ', CONSTRAINT [' || constraint_name || '] PRIMARY KEY (' || list || ')' || chr(13), '') || ')' || chr(13) AS ddl
    FROM cols c JOIN tables t ON t.object_id = c.object_id JOIN schemas s ON s.schema_id = t.schema_id
    LEFT JOIN keys k ON k.object_id = c.object_id
    """,
)
def table_ddl_text(t):
    named = op.cdc_tables(t.tables.withColumn("is_tracked_by_cdc", F.lit(1)), t.schemas)
    keys = [c for c in ("server_name",) if c in named.columns] + ["object_id"]
    columns = t.table_columns.join(named.select(*keys, "table_name", "schema_name"), keys)
    return op.table_ddl_text(columns, t.table_pks)


@query(
    "object_id:i table_name:s schema_name:s",
    """
    SELECT object_id, t.name AS table_name, s.name AS schema_name FROM tables t JOIN schemas s ON s.schema_id = t.schema_id
    WHERE is_tracked_by_cdc = 1
    """,
)
def cdc_tables(t):
    return op.cdc_tables(t.tables, t.schemas)


_BROKEN = """
    WITH RECURSIVE refs AS (SELECT DISTINCT r.referencing_id AS u, r.referenced_id AS v, o.object_id IS NOT NULL AS there FROM object_references r
      JOIN code_objects s ON s.object_id = r.referencing_id LEFT JOIN code_objects o ON o.object_id = r.referenced_id),
    walk AS (SELECT DISTINCT u, 1 AS distance FROM refs WHERE NOT there
      UNION SELECT refs.u, distance + 1 FROM walk JOIN refs ON refs.v = walk.u AND there WHERE distance < 40),
    broken AS (SELECT u, MIN(distance) AS distance FROM walk GROUP BY u)
"""


@query(
    "object_id:i name:s type_desc:s distance:i via_id:i",
    _BROKEN + """
    SELECT o.object_id, o.name, o.type_desc, b.distance, (SELECT MIN(r.v) FROM refs r JOIN broken n ON n.u = r.v WHERE r.u = b.u AND n.distance = b.distance - 1) AS via_id
    FROM broken b JOIN code_objects o ON o.object_id = b.u
    """,
)
def broken_objects(t):
    return dependencies.broken_objects(t.object_references, t.code_objects)


@query("type_desc:s distance:i objects:i", _BROKEN + "SELECT o.type_desc, b.distance, COUNT(*) AS objects FROM broken b JOIN code_objects o ON o.object_id = b.u GROUP BY ALL")
def broken_impact(t):
    return dependencies.broken_impact(dependencies.broken_objects(t.object_references, t.code_objects))
