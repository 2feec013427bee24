"""Queries over maintenance decisions."""

from functools import reduce

from pyspark.sql import functions as F

from fleetlens.operators import maintenance as op
from fleetlens.plans.registry import query
from fleetlens.plans.storage import variants

AS_OF = "2001-08-01 00:00:00"

_BYTES = "COALESCE(allocated_extent_page_count * 8192, database_size * 8192)"
_TO_DIFF = """CASE WHEN '{asked}' = 'LOG' AND recovery_model_desc IN ('FULL', 'BULK_LOGGED') AND log_lsn IS NULL AND name <> 'master'
  THEN 'DIFF' ELSE '{asked}' END"""
_DECIDED = f"""
    SELECT s.*, '{{asked}}' AS variant, CASE WHEN {_TO_DIFF} = 'DIFF' AND (name = 'master' OR differential_base_lsn IS NULL
      OR COALESCE(modified_extent_page_count * 100 >= 30 * allocated_extent_page_count AND allocated_extent_page_count > 0, FALSE)
      OR {_BYTES} < 100 * 1048576 OR differential_base_is_snapshot = 1) THEN 'FULL' ELSE {_TO_DIFF} END AS current_backup_type
    FROM db_state s
"""


def _decided(t):
    return variants(**{
        asked: op.backup_type_decision(t.db_state, asked, modification_level=30, min_db_size_mb=100)
        for asked in ("FULL", "DIFF", "LOG")
    })


_ALL_DECIDED = " UNION ALL ".join(_DECIDED.format(asked=a) for a in ("FULL", "DIFF", "LOG"))


@query("variant:s name:s current_backup_type:s", f"SELECT variant, name, current_backup_type FROM ({_ALL_DECIDED})")
def backup_type_decision(t):
    return _decided(t)


_RULES = {
    "online": "state_desc = 'ONLINE'",
    "single_user": "NOT (user_access = 'SINGLE_USER')",
    "standby": "NOT (in_standby = 1)",
    "log_simple": "NOT (kind = 'LOG' AND recovery_model_desc = 'SIMPLE')",
    "log_no_chain": "NOT (kind = 'LOG' AND recovery_model_desc IN ('FULL', 'BULK_LOGGED') AND log_lsn IS NULL)",
    "diff_no_base": "NOT (kind = 'DIFF' AND differential_base_lsn IS NULL)",
    "master": "NOT (kind IN ('DIFF', 'LOG') AND name = 'master')",
    "ag_full": "NOT (availability_group IS NOT NULL AND kind = 'FULL' AND (availability_group_role <> 'PRIMARY' OR availability_group_role IS NULL))",
    "ag_diff": "NOT (availability_group IS NOT NULL AND kind = 'DIFF' AND (availability_group_role <> 'PRIMARY' OR availability_group_role IS NULL))",
    "ag_log": "NOT (availability_group IS NOT NULL AND kind = 'LOG' AND (is_preferred_backup_replica <> 1 OR is_preferred_backup_replica IS NULL))",
    "log_shipped": "NOT (log_shipping_role = 'PRIMARY' AND log_shipping_role IS NOT NULL AND kind = 'LOG')",
    "read_only": "NOT (is_read_only = 1 AND TRUE)",
    "log_not_due": "NOT (kind = 'LOG' AND NOT (log_size_since_last_log_backup >= 200 OR log_size_since_last_log_backup IS NULL OR minutes_since_log_backup * 60 >= 7200))",
    "diff_small": f"NOT (kind = 'DIFF' AND {_BYTES} < 150 * 1048576)",
}


@query(
    "variant:s name:s eligible:b " + " ".join(f"allow_{r}:b" for r in _RULES),
    "SELECT *, COALESCE(" + " AND ".join(f"allow_{r}" for r in _RULES) + ", FALSE) AS eligible FROM (SELECT variant, name, "
    + ", ".join(f"{c} AS allow_{r}" for r, c in _RULES.items())
    + f" FROM (SELECT *, current_backup_type AS kind FROM ({_ALL_DECIDED})))",
)
def backup_eligibility(t):
    state = _decided(t).withColumn(
        "last_log_backup", F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(mins=F.col("minutes_since_log_backup").cast("int"))
    )
    return op.backup_eligibility(
        state, updateability="READ_WRITE", log_size_mb=200, log_seconds=7200, min_diff_size_mb=150, as_of=AS_OF
    )


_SIZED = f"""(SELECT *, CASE current_backup_type WHEN 'FULL' THEN {_BYTES} WHEN 'DIFF' THEN modified_extent_page_count * 8192
  WHEN 'LOG' THEN log_size_since_last_log_backup * 1048576 END AS backup_size FROM ({_ALL_DECIDED}))"""
_FILE_RULES = {
    "directories": "4",
    "one": "1",
    "four_if_large": "CASE WHEN backup_size >= 104857600 OR backup_size IS NULL THEN 4 ELSE 2 END",
    "by_size": """CASE WHEN backup_size IS NULL OR backup_size = 0 THEN 4 ELSE LEAST((backup_size // 4) // 67108864
      + CASE WHEN (backup_size // 4) % 67108864 = 0 THEN 0 ELSE 1 END, 64 // 4) * 4 END""",
}


@query(
    "rule:s variant:s name:s backup_size:i number_of_files:i",
    " UNION ALL ".join(f"SELECT '{r}' AS rule, variant, name, backup_size, {c} AS number_of_files FROM {_SIZED}" for r, c in _FILE_RULES.items()),
)
def backup_file_count(t):
    d = _decided(t)
    options = {
        "directories": dict(directories=4), "one": dict(number_of_files=1, directories=4),
        "four_if_large": dict(number_of_files=4, min_multi_mb=100, directories=2), "by_size": dict(max_file_mb=64, directories=4),
    }
    return reduce(
        lambda a, b: a.unionByName(b), [op.backup_file_count(d, **o).withColumn("rule", F.lit(r)) for r, o in options.items()]
    )


_ORDERS = {
    "SELECTION": "start_position ASC, name",
    "DATABASE_NAME_ASC": "name ASC", "DATABASE_NAME_DESC": "name DESC",
    "DATABASE_SIZE_ASC": "size ASC NULLS FIRST, name", "DATABASE_SIZE_DESC": "size DESC NULLS LAST, name",
    "LOG_SIZE_SINCE_LAST_LOG_BACKUP_ASC": "log_size_since_last_log_backup ASC NULLS FIRST, name",
    "LOG_SIZE_SINCE_LAST_LOG_BACKUP_DESC": "log_size_since_last_log_backup DESC NULLS LAST, name",
    "REPLICA_LAST_GOOD_CHECK_ASC": "checked ASC NULLS FIRST, name", "REPLICA_LAST_GOOD_CHECK_DESC": "checked DESC NULLS LAST, name",
}


@query(
    "variant:s name:s work_position:i",
    """
    WITH sized AS (
      SELECT d.*, f.size, c.checked FROM db_state d
      LEFT JOIN (SELECT database_id, SUM(size_pages) AS size FROM files WHERE type = 0 GROUP BY database_id) f ON f.database_id = d.database_id
      LEFT JOIN (SELECT database_name, MAX(start_time) AS checked FROM command_log WHERE command_type = 'DBCC_CHECKDB' AND error_number = 0
                 GROUP BY database_name) c ON c.database_name = d.name)
    """ + " UNION ALL ".join(
        f"SELECT '{o}' AS variant, name, ROW_NUMBER() OVER (ORDER BY {c}) AS work_position FROM sized" for o, c in _ORDERS.items()
    ),
)
def work_order(t):
    state = t.db_state.drop("database_size")
    return variants(**{
        o: op.work_order(state, None if o == "SELECTION" else o, t.files, t.command_log).select(
            *[c for c in ("server_name",) if c in state.columns], "name", "work_position")
        for o in _ORDERS
    })


@query(
    "index_name:s statistics_name:s work_position:i",
    """
    SELECT index_name, statistics_name, ROW_NUMBER() OVER (ORDER BY resumable_index_operation DESC, start_position, schema_name, object_name,
      CASE WHEN index_type IS NULL THEN 1 ELSE 0 END, index_type, index_name, statistics_name, partition_number) AS work_position FROM index_work
    """,
)
def index_work_order(t):
    return op.index_work_order(t.index_work)


_IN_INDEX = "EXISTS (SELECT 1 FROM idx_index_columns ic JOIN idx_columns c ON c.object_id = ic.object_id AND c.column_id = ic.column_id WHERE ic.object_id = i.object_id AND ic.index_id = i.index_id AND {cond})"
_IN_TABLE = "EXISTS (SELECT 1 FROM idx_columns c WHERE c.object_id = i.object_id AND {cond})"
_LARGE = "(type_name = 'xml' OR (type_name IN ('varchar', 'nvarchar', 'varbinary') AND max_length = -1))"
_BIT = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
_NAMED = """idx_objects o JOIN schemas s ON s.schema_id = o.schema_id LEFT JOIN idx_tables t ON t.object_id = o.object_id"""


@query(
    "object_id:i schema_name:s object_name:s object_type:s is_memory_optimized:i index_id:i index_name:s index_type:i allow_page_locks:i has_filter:i "
    "is_image_text:i is_new_lob:i is_filestream:i has_columnstore:i is_computed:i is_clustered_index_computed:i is_timestamp:i "
    "on_read_only_filegroup:i resumable_index_operation:i statistics_id:i statistics_name:s no_recompute:i partition_id:i partition_number:i partition_count:i",
    f"""
    SELECT o.object_id, s.name AS schema_name, o.name AS object_name, rtrim(o.type) AS object_type, COALESCE(is_memory_optimized, 0) AS is_memory_optimized,
      i.index_id, i.name AS index_name, i.type AS index_type, allow_page_locks, has_filter,
      {_BIT("i.type = 1 AND " + _IN_TABLE.format(cond="type_name IN ('image', 'text', 'ntext')"))} AS is_image_text,
      {_BIT("(i.type = 1 AND " + _IN_TABLE.format(cond=_LARGE) + ") OR (i.type = 2 AND " + _IN_INDEX.format(cond=_LARGE) + ")")} AS is_new_lob,
      {_BIT("i.type = 1 AND " + _IN_TABLE.format(cond="is_filestream = 1"))} AS is_filestream,
      {_BIT("EXISTS (SELECT 1 FROM idx_catalog x WHERE x.object_id = i.object_id AND x.type IN (5, 6))")} AS has_columnstore,
      {_BIT(_IN_INDEX.format(cond="(key_ordinal > 0 OR partition_ordinal > 0) AND is_computed = 1"))} AS is_computed,
      {_BIT("EXISTS (SELECT 1 FROM idx_catalog x JOIN idx_index_columns ic ON ic.object_id = x.object_id AND ic.index_id = x.index_id JOIN idx_columns c ON c.object_id = ic.object_id AND c.column_id = ic.column_id WHERE x.type = 1 AND x.object_id = i.object_id AND key_ordinal > 0 AND is_computed = 1)")} AS is_clustered_index_computed,
      {_BIT(_IN_INDEX.format(cond="type_name = 'timestamp'"))} AS is_timestamp,
      {_BIT("i.data_space_id IN (SELECT data_space_id FROM fg_state WHERE is_read_only = 1) OR (i.type = 1 AND COALESCE(t.lob_data_space_id, -1) IN (SELECT data_space_id FROM fg_state WHERE is_read_only = 1))")} AS on_read_only_filegroup,
      {_BIT("EXISTS (SELECT 1 FROM resumable_ops r WHERE r.object_id = i.object_id AND r.index_id = i.index_id AND state_desc = 'PAUSED')")} AS resumable_index_operation,
      st.stats_id AS statistics_id, st.name AS statistics_name, no_recompute, p.partition_id, p.partition_number, pc.n AS partition_count
    FROM idx_catalog i JOIN {_NAMED} ON o.object_id = i.object_id
    LEFT JOIN idx_stats st ON st.object_id = i.object_id AND st.stats_id = i.index_id
    LEFT JOIN partitions p ON p.object_id = i.object_id AND p.index_id = i.index_id
    LEFT JOIN (SELECT object_id, index_id, COUNT(DISTINCT partition_number) AS n FROM partitions GROUP BY object_id, index_id) pc
      ON pc.object_id = i.object_id AND pc.index_id = i.index_id
    WHERE i.type BETWEEN 1 AND 7 AND is_disabled = 0 AND rtrim(o.type) IN ('U', 'V') AND is_ms_shipped = 0
    UNION ALL
    SELECT o.object_id, s.name, o.name, rtrim(o.type), 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
      st.stats_id, st.name, no_recompute, NULL, NULL, NULL
    FROM idx_stats st JOIN {_NAMED} ON o.object_id = st.object_id
    WHERE rtrim(o.type) IN ('U', 'V') AND is_ms_shipped = 0 AND COALESCE(is_memory_optimized, 0) = 0
      AND NOT EXISTS (SELECT 1 FROM idx_catalog x WHERE x.object_id = st.object_id AND x.index_id = st.stats_id)
      AND NOT EXISTS (SELECT 1 FROM idx_catalog x WHERE x.object_id = st.object_id AND x.type = 1 AND x.is_disabled = 1)
    """,
)
def index_capability_flags(t):
    return op.index_capability_flags(
        t.idx_catalog, t.idx_objects, t.schemas, t.idx_tables, t.idx_columns, t.idx_index_columns, t.fg_state, t.resumable_ops,
        t.partitions, t.idx_stats, partition_level=True,
    )


_ALLOWED = {
    "reorganize": "on_read_only_filegroup = 0 AND is_memory_optimized = 0 AND allow_page_locks <> 0",
    "rebuild_offline": "on_read_only_filegroup = 0 AND is_memory_optimized = 0",
    "rebuild_online": """on_read_only_filegroup = 0 AND is_memory_optimized = 0 AND NOT (index_type = 1 AND is_image_text = 1)
      AND index_type NOT IN (3, 4) AND NOT (index_type IN (5) AND {version} < 15) AND NOT (index_type = 6 AND {version} < 14)
      AND NOT (index_type = 1 AND has_columnstore = 1 AND {version} < 13) AND NOT (index_type = 2 AND has_columnstore = 1 AND {version} < 15)
      AND NOT (is_partition = 1 AND {version} < 12) AND {edition} IN (3, 5, 8)""",
}


def _plan_sql(label, min_pages, version, edition, low, medium, high):
    first = lambda acts: "COALESCE(" + "".join(f"CASE WHEN allow_{a} THEN 'INDEX_{a.upper()}' END, " for a in acts) + "NULL)"
    choice = first(high) if low == medium == high else (
        f"CASE fragmentation_group WHEN 'Low' THEN {first(low)} WHEN 'Medium' THEN {first(medium)} WHEN 'High' THEN {first(high)} END")
    return f"""
    SELECT '{label}' AS variant, *, CASE WHEN action = 'INDEX_REBUILD_ONLINE' AND allow_page_locks = 0 THEN 1 END AS max_dop FROM (
      SELECT *, CASE WHEN resumable_index_operation = 1 THEN 'INDEX_REBUILD_ONLINE' WHEN page_count >= {min_pages} THEN {choice} END AS action FROM (
        SELECT *, CASE WHEN on_read_only_filegroup = 1 THEN NULL WHEN avg_fragmentation_in_percent >= 30 THEN 'High'
          WHEN avg_fragmentation_in_percent >= 5 THEN 'Medium' ELSE 'Low' END AS fragmentation_group,
          {', '.join(f"({c.format(version=version, edition=edition)}) AS allow_{a}" for a, c in _ALLOWED.items())} FROM index_work))
    """


_MEDIUM = ("reorganize", "rebuild_online", "rebuild_offline")
_HIGH = ("rebuild_online", "rebuild_offline")
_PLANS = {
    "defaults": (dict(), (1000, 16, 3, (), _MEDIUM, _HIGH)),
    "every_size": (dict(min_pages=0), (0, 16, 3, (), _MEDIUM, _HIGH)),
    "old_standard": (dict(min_pages=0, version=11, edition=2), (0, 11, 2, (), _MEDIUM, _HIGH)),
    "old_enterprise": (dict(min_pages=0, version=12, edition=3), (0, 12, 3, (), _MEDIUM, _HIGH)),
    "same_for_all": (
        dict(min_pages=0, low="INDEX_REORGANIZE,INDEX_REBUILD_OFFLINE", medium="INDEX_REORGANIZE,INDEX_REBUILD_OFFLINE",
             high="INDEX_REORGANIZE,INDEX_REBUILD_OFFLINE"),
        (0, 16, 3, ("reorganize", "rebuild_offline"), ("reorganize", "rebuild_offline"), ("reorganize", "rebuild_offline")),
    ),
}
_ALL_PLANS = " UNION ALL ".join(_plan_sql(label, *args) for label, (_, args) in _PLANS.items())


def _plans(t):
    return variants(**{label: op.index_maintenance_plan(t.index_work, **options) for label, (options, _) in _PLANS.items()})


@query(
    "variant:s index_name:s fragmentation_group:s action:s max_dop:i allow_reorganize:b allow_rebuild_online:b allow_rebuild_offline:b",
    _ALL_PLANS,
)
def index_maintenance_plan(t):
    return _plans(t)


def _update_sql(need):
    return f"""
    CASE WHEN index_type IN (1, 2, 3, 4, 7) AND ({need}) AND CASE WHEN is_partition = 1 THEN partition_number = partition_count
      ELSE COALESCE(action, '') NOT IN ('INDEX_REBUILD_ONLINE', 'INDEX_REBUILD_OFFLINE') END THEN 'Y' ELSE 'N' END"""


_NEED_LEVEL = "modification_counter * 100 >= row_count * 5 OR modification_counter * modification_counter >= row_count * 1000"


@query(
    "variant:s index_name:s always:s modified:s level:s columns_only:s",
    f"""SELECT variant, index_name, {_update_sql('TRUE')} AS always, {_update_sql('modification_counter > 0')} AS modified,
      {_update_sql(_NEED_LEVEL)} AS level, 'N' AS columns_only FROM ({_ALL_PLANS})""",
)
def statistics_update_plan(t):
    out = _plans(t)
    for name, options in {
        "always": {}, "modified": dict(only_modified=True), "level": dict(modification_level=5), "columns_only": dict(mode="COLUMNS"),
    }.items():
        out = op.statistics_update_plan(out, **options).withColumnRenamed("update_statistics", name)
    return out


@query(
    "variant:s index_command:s statistics_command:s",
    f"""
    SELECT variant, CASE WHEN action IS NOT NULL THEN 'ALTER INDEX [' || index_name || '] ON [' || schema_name || '].[' || object_name || ']'
        || CASE WHEN resumable_index_operation = 1 THEN ' RESUME' WHEN action = 'INDEX_REORGANIZE' THEN ' REORGANIZE' ELSE ' REBUILD' END
        || CASE WHEN is_partition = 1 AND resumable_index_operation = 0 THEN ' PARTITION = ' || partition_number ELSE '' END
        || COALESCE(' WITH (' || NULLIF(concat_ws(', ',
          CASE WHEN action <> 'INDEX_REORGANIZE' AND index_type IN (1, 2, 3, 4) AND resumable_index_operation = 0 THEN 'SORT_IN_TEMPDB = ON' END,
          CASE WHEN action = 'INDEX_REBUILD_ONLINE' AND resumable_index_operation = 0 THEN 'ONLINE = ON'
               WHEN action = 'INDEX_REBUILD_OFFLINE' AND resumable_index_operation = 0 THEN 'ONLINE = OFF' END,
          CASE WHEN action <> 'INDEX_REORGANIZE' THEN 'MAXDOP = ' || max_dop END,
          CASE WHEN action <> 'INDEX_REORGANIZE' AND is_partition = 0 AND index_type IN (1, 2, 3, 4) AND resumable_index_operation = 0 THEN 'FILLFACTOR = 90' END,
          CASE WHEN action = 'INDEX_REBUILD_ONLINE' AND resumable_index_operation = 0 THEN CASE WHEN index_type IN (1, 2) THEN 'RESUMABLE = ON' ELSE 'RESUMABLE = OFF' END END,
          CASE WHEN action = 'INDEX_REORGANIZE' THEN 'LOB_COMPACTION = ON' END), '') || ')', '') END AS index_command,
      CASE WHEN {_update_sql('TRUE').strip()} = 'Y' THEN 'UPDATE STATISTICS [' || schema_name || '].[' || object_name || '] [' || statistics_name || '] WITH '
        || concat_ws(', ', 'MAXDOP = ' || max_dop, 'FULLSCAN', CASE WHEN no_recompute = 1 THEN 'NORECOMPUTE' END) END AS statistics_command
    FROM ({_ALL_PLANS})
    """,
)
def command_text_plan(t):
    planned = op.statistics_update_plan(_plans(t))
    return op.command_text_plan(planned, sort_in_tempdb=True, fill_factor=90, resumable=True, statistics_sample=100)
