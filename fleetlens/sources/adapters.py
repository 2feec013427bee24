"""Shaping the driver's tables into server-metadata snapshots.

Each text is a SELECT over the base tables that gives the same rows in Spark and
DuckDB: a query reads the result as a DataFrame, its oracle uses the same text as
a CTE.  Arithmetic is on whole numbers so both engines agree exactly.
"""

ADAPTERS: dict[str, str] = {
    "databases": """
        select c_custkey as database_id, 'db' || c_custkey as name, case c_mktsegment when 'BUILDING' then 'SIMPLE'
        when 'MACHINERY' then 'BULK_LOGGED' else 'FULL' end as recovery_model_desc, c_nationkey as owner_id, case
        when c_acctbal < 0 then 1 else 0 end as is_read_only
        from customer
        union all select -1 - r_regionkey, 'nobk' || r_regionkey, 'FULL', r_regionkey, 0
        from region
    """,
    "backupset": """
        select o_orderkey as backup_set_id, o_orderkey as media_set_id, 'db' || o_custkey as database_name, case
        o_orderstatus when 'F' then 'D' when 'O' then 'I' else 'L' end as type, o_orderdate + (o_orderkey % 1440) *
        interval '1' minute as backup_start_date, o_orderdate + (o_orderkey % 1440 + o_orderkey % 97) * interval '1'
        minute + (o_orderkey % 60) * interval '1' second as backup_finish_date, o_orderkey * 1048576 + o_custkey as
        backup_size, case when o_orderpriority = '1-URGENT' then 1 else 0 end as is_damaged
        from orders
    """,
    "backupmediafamily": """
        select l_orderkey as media_set_id, l_linenumber as family_sequence_number, 'dev' || l_suppkey as
        physical_device_name
        from lineitem
    """,
    "restorehistory": """
        select o_orderkey as restore_history_id, o_orderkey as backup_set_id, 'db' || o_custkey as
        destination_database_name, case o_orderstatus when 'F' then 'D' when 'O' then 'V' else 'L' end as
        restore_type, o_orderdate as restore_date, 'user' || (o_custkey % 10) as user_name
        from orders
    """,
    "restorefile": """
        select l_orderkey as restore_history_id, 'f' || l_partkey as destination_phys_name
        from lineitem
    """,
    "files": """
        select cast(floor(p_partkey / 3) as bigint) as database_id, p_partkey % 3 as file_id, case when p_partkey %
        3 = 2 or p_size % 10 = 0 then 1 else 0 end as type, p_name || p_partkey as name, p_size * 128 + p_partkey as
        size_pages, p_size * 128 + p_partkey - p_partkey % 128 as used_pages, case when p_brand = 'Brand#1' then 0
        else p_size end as growth, p_partkey % 2 as is_percent_growth, case when p_partkey % 5 = 0 then -1 else
        p_size * 1280 end as max_size
        from part
    """,
    "log_vlfs": """
        select cast(floor(l_partkey / 3) as bigint) as database_id, l_partkey % 3 as file_id, cast(l_quantity as
        bigint) * 65536 as file_size, case when l_returnflag = 'R' then 2 else 0 end as status
        from lineitem
    """,
    "indexes": """
        select cast(floor(p_partkey / 8) as bigint) as object_id, p_partkey % 8 as index_id, p_partkey as
        partition_id, case when p_partkey % 8 = 0 then null else 'IX_' || p_partkey end as name, p_type as
        type_desc, p_size as fill_factor, case when p_size % 3 = 0 then 'NONE' else 'PAGE' end as
        data_compression_desc
        from part
    """,
    "tables": """
        select distinct cast(floor(p_partkey / 8) as bigint) as object_id, 'T' || cast(floor(p_partkey / 8) as
        bigint) as name, cast(floor(p_partkey / 8) as bigint) % 5 as schema_id, cast(floor(p_partkey / 8) as bigint)
        % 4 as is_tracked_by_cdc
        from part
    """,
    "index_phys": """
        select cast(floor(l_partkey / 8) as bigint) as object_id, l_partkey % 8 as index_id, (sum(cast(l_quantity as
        bigint)) * 7) % 101 as avg_fragmentation_in_percent, sum(cast(l_quantity as bigint)) as page_count,
        max(l_shipdate) as stats_date, count(*) as modification_counter
        from lineitem
        group by l_partkey
    """,
    "index_usage": """
        select cast(floor(l_partkey / 8) as bigint) as object_id, l_partkey % 7 as index_id, l_suppkey as
        database_id, l_shipdate as last_user_seek, case when l_returnflag = 'A' then l_shipdate end as
        last_user_scan
        from lineitem
    """,
    "index_keys": """
        select distinct cast(floor(l_partkey / 8) as bigint) as object_id, l_partkey % 8 as index_id, l_linenumber
        as keyno, 'c' || (l_suppkey % 7) as col
        from lineitem
    """,
    "alloc_units": """
        select l_partkey as container_id, l_orderkey as allocation_unit_id, cast(l_quantity as bigint) * 10 as
        total_pages, cast(l_quantity as bigint) * 9 as used_pages, cast(l_quantity as bigint) * 8 as data_pages
        from lineitem
    """,
    "buffer_desc": """
        select l_suppkey as database_id, l_partkey as allocation_unit_id, case when l_returnflag = 'A' then 1 else 0
        end as is_modified, cast(l_quantity as bigint) * 100 as free_space_in_bytes
        from lineitem
    """,
    "waits": """
        select 'W' || l_partkey as wait_type, sum(cast(l_quantity as bigint)) * 1000 + l_partkey as wait_time_ms,
        sum(cast(l_linenumber as bigint)) * 10 as signal_wait_time_ms, count(*) as waiting_tasks_count
        from lineitem
        group by l_partkey
    """,
    "counter_samples": """
        select case when event_id % 3 = 0 then 'HOT' else 'C' || (user_id % 20) end as counter_name, ts as sample_time, event_id as sample_id,
        case when event_id % 50 = 7 then null else (event_id % 4000) * 25 + user_id % 7 end as value
        from events
    """,
    "wait_ignore": """
        select 'W' || p_partkey as wait_type
        from part
        where p_brand in ('Brand#1', 'Brand#2')
    """,
    "cached_plans": """
        select p_partkey as plan_handle, p_size % 5 as usecounts, p_size as refcounts, p_partkey * 65536 as
        size_in_bytes
        from part
    """,
    "requests": """
        select event_id as session_id, case when cast(regexp_extract(props, '([0-9]+)', 1) as int) % 3 = 0 then
        event_id - event_id % 10 else 0 end as blocking_session_id, event_type as status, cast(round(value * 100) as
        bigint) as total_elapsed_time, cast(floor(round(value * 100) / 3) as bigint) as cpu_time, user_id as
        database_id, event_id as sql_handle, ts as start_time, cast(regexp_extract(props, '([0-9]+)', 1) as
        int) as open_tran
        from events
    """,
    "sql_text": """
        select doc_id as sql_handle, text
        from documents
    """,
    "query_stats": """
        select plan_handle, cast(floor(plan_handle * documents_end / (5 * users_end)) as bigint) as sql_handle, count(*) as execution_count,
        sum(cast(round(value * 100) as bigint)) * 1000 as total_elapsed_time, sum(cast(round(value * 100) as
        bigint)) * 300 as total_worker_time, sum(event_id) as total_logical_reads
        from (select user_id * 5 + case event_type when 'signup' then 0 when 'error' then 1 when 'click' then 2 when 'view' then 3 else 4 end as plan_handle,
        value, event_id from events) e
        cross join (select max(user_id) + 1.0 as users_end from events) u
        cross join (select max(doc_id) + 1.0 as documents_end from documents) d
        group by plan_handle, users_end, documents_end
    """,
    "resource_stats": """
        select 'db' || user_id as database_name, event_type as sku, ts as end_time, cast(round(value * 100) as
        bigint) as avg_cpu_centi, cast(regexp_extract(props, '([0-9]+)', 1) as int) as avg_data_io, event_id as
        storage_in_megabytes
        from events
    """,
    "event_log": """
        select 'db' || user_id as database_name, ts as start_time, case when event_type = 'error' then
        'connection_failed' else 'connection_successful' end as event_type, cast(regexp_extract(props, '([0-9]+)',
        1) as int) % 6 as event_subtype, case when event_type = 'view' then null else props || ' Connected' end as
        description
        from events
    """,
    "trace": """
        select event_id, ts as start_time, user_id as spid, 'db' || (user_id % 20) as database_name, case event_type
        when 'signup' then 46 when 'error' then 92 when 'click' then 93 when 'view' then 104 else 107 end as
        event_class, cast(regexp_extract(props, '([0-9]+)', 1) as int) as integer_data, cast(round(value * 100) as
        bigint) * 10000 as duration, event_id % 2 as event_subclass
        from events
    """,
    "trace_events": """
        select *
        from (values (46, 'Object:Created'), (92, 'Data File Auto Grow'), (93, 'Log File Auto Grow'), 
        (104, 'Audit Addlogin Event'), (107, 'Audit Login Failed')) as t(trace_event_id, name)
    """,
    "io_stats": """
        select l_suppkey as database_id, l_linenumber as file_id, sum(case when l_returnflag = 'A' and l_linenumber
        < 6 then 1 else 0 end) as num_of_reads, sum(case when l_returnflag = 'R' and l_linenumber > 2 then 1 else 0
        end) as num_of_writes, sum(cast(l_quantity as bigint)) as io_stall_read_ms, sum(cast(l_quantity as bigint))
        * 2 as io_stall_write_ms, sum(l_orderkey) as num_of_bytes_read, sum(l_partkey) as num_of_bytes_written
        from lineitem
        group by l_suppkey, l_linenumber
    """,
    "command_log": """
        select o_orderkey as id, 'db' || o_custkey as database_name, case o_orderpriority when '1-URGENT' then
        'DBCC_CHECKDB' when '2-HIGH' then 'ALTER_INDEX' else 'UPDATE_STATISTICS' end as command_type, o_orderdate as
        start_time, case when o_orderstatus = 'O' then null else o_orderdate + (o_orderkey % 200000) * interval '1'
        second end as end_time, case when o_orderstatus = 'O' then null when o_orderkey % 10 = 0 then 1205 else 0
        end as error_number
        from orders
    """,
    "jobs": """
        select p_partkey as job_id, case when p_partkey % 50 = 0 then 'own' || p_partkey else 'job' || p_partkey end
        as name, p_partkey % 110 as owner_sid, case when p_partkey % 9 = 0 then 0 else 1 end as enabled, case when
        p_partkey % 13 = 0 then 100 else 0 end as category_id
        from part
    """,
    "repl_history": """
        select l_suppkey as agent_id, l_orderkey as xact_seqno, l_shipdate as time, l_linenumber as runstatus
        from lineitem
    """,
    "repl_commands": """
        select o_orderkey as xact_seqno, o_custkey % 50 as article_id
        from orders
    """,
    "repl_subscriptions": """
        select s_suppkey as agent_id, s_suppkey % 50 as article_id, s_nationkey % 4 as subscription_type, case when
        s_nationkey = 3 then 'virtual' else 'sub' || s_nationkey end as subscriber_db
        from supplier
    """,
    "config_kv": """
        select user_id as server_id, event_type as name, max(event_id) % 2 as value_in_use
        from events
        where user_id % 7 <> 0 or event_type <> 'view'
        group by user_id, event_type
    """,
    "ledger": """
        select user_id as k, event_id as transaction_id, 0 as sequence_number, case when event_type = 'error' then
        'DELETE' else 'INSERT' end as op, value as v
        from events
    """,
    "rls_table": """
        select o_orderkey as row_id, 'User' || (o_custkey % 3) as userlead, case o_orderstatus when 'F' then 'A'
        else 'B' end as status
        from orders
    """,
}

# Views that the reports need beyond the ones above, in the same style.
ADAPTERS.update({
    "schemas": "select r_regionkey as schema_id, r_name as name from region",
    "logins": "select n_nationkey as sid, n_name as name from nation",
    "filegroups": "select r_regionkey as groupid, r_name as groupname from region",
    "partitions": """
        select p_partkey as partition_id, cast(floor(p_partkey / 8) as bigint) as object_id, p_partkey % 8 as index_id,
        p_size as partition_number, case when p_size % 3 = 0 then 'NONE' else 'PAGE' end as data_compression_desc
        from part
    """,
    "au_map": "select p_partkey as allocation_unit_id, p_partkey as container_id from part",
    "mi_groups": "select distinct l_orderkey as index_group_handle, l_partkey as index_handle from lineitem",
    "mi_stats": """
        select o_orderkey as group_handle, o_orderkey % 50 as avg_total_user_cost, o_custkey % 101 as avg_user_impact,
        o_orderkey % 7 as user_seeks, o_custkey % 5 as user_scans
        from orders
    """,
    "mi_details": """
        select p_partkey as index_handle, '[db].[dbo].[T' || p_partkey || ']' as statement,
        case when p_size % 3 = 0 then null else '[c' || p_size || ']' end as equality_columns,
        case when p_size % 5 < 2 then null else '[d' || p_size || ']' end as inequality_columns,
        case when p_size % 2 = 0 then '[e], [f]' end as included_columns
        from part
    """,
    "plan_stats": """
        select o_orderkey as plan_handle, o_custkey as query_hash, o_orderdate as creation_time,
        o_orderkey % 100 + 1 as execution_count, o_orderkey * 7 as total_worker_time,
        o_custkey * 11 as last_elapsed_time, o_custkey as total_logical_reads, o_custkey % 4 as edition
        from orders
    """,
    "showplans": """
        select o_orderkey as plan_handle,
        '<ShowPlanXML xmlns="http://schemas.microsoft.com/sqlserver/2004/07/showplan"><BatchSequence><Batch><Statements>'
        || '<StmtSimple StatementText="select ' || o_custkey || '"><QueryPlan CachedPlanSize="' || (o_custkey % 90)
        || '" CompileTime="' || (o_orderkey % 40) || '" CompileCPU="' || (o_orderkey % 30) || '" CompileMemory="'
        || (o_orderkey % 70) || '">'
        || case when o_orderpriority = '5-LOW' then '<RelOp NodeId="0"/>' else
        '<MissingIndexes><MissingIndexGroup Impact="' || (o_custkey % 100)
        || '"><MissingIndex Database="[db1]" Schema="[dbo]" Table="[T' || o_custkey || ']">'
        || case when o_orderkey % 4 = 0 then '' else '<ColumnGroup Usage="EQUALITY"><Column Name="[b' || (o_orderkey % 5)
        || ']"/><Column Name="[a' || (o_orderkey % 7) || ']"/><Column Name="[b' || (o_orderkey % 5)
        || ']"/></ColumnGroup>' end
        || case when o_orderkey % 4 = 1 then '' else '<ColumnGroup Usage="INEQUALITY"><Column Name="[q'
        || (o_orderkey % 3) || ']"/></ColumnGroup>' end
        || case when o_orderkey % 3 = 0 then '<ColumnGroup Usage="INCLUDE"><Column Name="[z@' || (o_custkey % 9)
        || ']"/></ColumnGroup>' else '' end
        || '</MissingIndex></MissingIndexGroup></MissingIndexes>' end
        || '</QueryPlan></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>' as query_plan
        from orders
    """,
    "typed_keys": """
        select distinct cast(floor(l_partkey / 8) as bigint) as object_id, l_partkey % 8 as index_id,
        l_linenumber as keyno, 'c' || (l_suppkey % 7) as col,
        case l_suppkey % 7 when 0 then 'varchar' when 1 then 'nchar' else 'int' end as type_name,
        case l_suppkey % 7 when 0 then 50 when 1 then 20 else 4 end as max_length,
        case when l_suppkey % 7 = 2 then '((0))' end as default_definition,
        case when l_suppkey % 7 = 3 then 1 else 0 end as is_identity
        from lineitem
    """,
    "index_props": """
        select cast(floor(p_partkey / 8) as bigint) as object_id, p_partkey % 8 as index_id,
        case when p_partkey % 8 = 0 then null else 'IX_' || p_partkey end as name, p_size as fill_factor,
        p_partkey % 2 as is_disabled, p_partkey * 3 as used_pages
        from part
    """,
    "operational_stats": """
        select cast(floor(l_partkey / 8) as bigint) as object_id, l_partkey % 8 as index_id,
        case when l_returnflag = 'A' then null else l_linenumber end as leaf_allocation_count,
        case when l_linestatus = 'F' then null else l_suppkey end as nonleaf_allocation_count
        from lineitem
    """,
    "perf_counters": """
        select 'Stolen Server Memory (KB)' as counter_name, sum(p_size) as cntr_value from part
        union all select 'Total Server Memory (KB)', count(*) from part
    """,
    "cache_counters": """
        select p_partkey as pages_kb, case p_size % 4 when 0 then 'CACHESTORE_OBJCP' when 1 then 'CACHESTORE_SQLCP'
        when 2 then 'CACHESTORE_PHDR' else 'USERSTORE_TOKENPERM' end as type
        from part
    """,
    "db_files": """
        select cast(floor(p_partkey / 3) as bigint) as database_id, p_partkey as file_id, p_name || p_partkey as name,
        p_partkey % 7 as group_id, p_size * 128 + p_partkey as size_pages,
        p_size * 128 + p_partkey - p_partkey % 128 as used_pages
        from part
    """,
    "ag_groups": "select r_regionkey as group_id, r_name as name from region",
    "replicas": "select n_nationkey as replica_id, n_nationkey % 5 as group_id, n_name as replica_server_name from nation",
    "ag_databases": "select c_custkey as group_database_id, c_custkey as database_id, c_nationkey % 5 as group_id, 'db' || c_custkey as database_name from customer",
    "db_replica_states": """
        select c_custkey as group_database_id, c_nationkey as replica_id, c_nationkey % 5 as group_id,
        1 as is_primary_replica, case when c_acctbal < 0 then 0 else 1 end as is_local
        from customer
        union all select c_custkey, (c_nationkey + 1) % 25, c_nationkey % 5, 0, case when c_acctbal < 0 then 1 else 0 end
        from customer
    """,
    "stat_objects": """
        select l_partkey as object_id, 1 as stats_id, 'ST_' || l_partkey as name, max(l_shipdate) as stats_date,
        min(case when l_returnflag = 'A' then 1 else 0 end) as auto_created,
        case when l_partkey % 3 = 0 then 1 else 0 end as user_created
        from lineitem
        group by l_partkey
    """,
    "stat_columns": """
        select distinct l_partkey as object_id, 1 as stats_id, l_linenumber as column_id from lineitem
    """,
    "part_columns": """
        select distinct l_partkey as object_id, l_linenumber as column_id, 'c' || l_linenumber as name from lineitem
    """,
    "part_tables": """
        select p_partkey as object_id, 'T' || p_partkey as name, p_size % 5 as schema_id,
        case when p_size > 40 then 1 else 0 end as is_ms_shipped
        from part
    """,
    "code_objects": """
        select o_orderkey as object_id, 'obj' || o_orderkey as name,
        case o_orderstatus when 'F' then 'SQL_TRIGGER' when 'O' then 'VIEW' else 'SQL_STORED_PROCEDURE' end as type_desc
        from orders
    """,
    "object_references": """
        select o_orderkey as referencing_id, cast(floor(o_orderkey / 3) as bigint) as referenced_id from orders where o_orderkey > 2
        union all select p_partkey, 2 * p_partkey + 1 from part where p_partkey % 5 = 0
        union all select c_custkey, -1 - c_custkey from customer where c_custkey % 29 = 3
        union all select l_orderkey, l_orderkey + l_linenumber from lineitem where l_orderkey % 10 = 4
    """,
    "known_objects": "select p_partkey as object_id from part where p_size <= 45",
    "code_dependencies": """
        select l_orderkey as referencing_id, l_partkey as referenced_name_id, l_linenumber % 2 as is_ambiguous,
        case when l_suppkey % 9 = 0 then 'inserted' else 'obj' || l_partkey end as referenced_name
        from lineitem
    """,
    "triggers": """
        select p_partkey as object_id, 'TR_' || p_name || p_partkey as name, p_size % 6 as parent_id,
        case when p_size % 10 = 0 then 0 else 1 end as parent_class, 'SQL_TRIGGER' as type_desc,
        p_size % 3 as is_ms_shipped, p_partkey % 2 as is_disabled, p_size % 2 as is_not_for_replication,
        case when p_brand = 'Brand#1' then 1 else 0 end as is_instead_of_trigger
        from part
    """,
    "trigger_events": """
        select l_partkey as object_id, l_linenumber % 3 + 1 as type,
        case l_linenumber % 3 when 0 then 'INSERT' when 1 then 'UPDATE' else 'DELETE' end as type_desc,
        case when l_linenumber % 3 = 0 then 1 else 0 end as is_first, case when l_linenumber % 3 = 2 then 1 else 0 end as is_last,
        'DDL_GROUP_' || l_suppkey as event_group_type_desc
        from lineitem
    """,
    "trigger_parents": "select n_nationkey as object_id, n_name as name, n_regionkey as schema_id from nation where n_regionkey < 3",
    "table_columns": """
        select distinct cast(floor(l_partkey / 8) as bigint) as object_id, l_linenumber as column_id,
        'c' || l_linenumber as column_name,
        case l_linenumber when 1 then 'int' when 2 then 'varchar' when 3 then 'nvarchar' when 4 then 'decimal'
        when 5 then 'datetime2' when 6 then 'varchar' else 'date' end as type_name,
        case l_linenumber when 2 then 40 when 3 then 60 when 6 then -1 else 8 end as max_length,
        18 as precision, 4 as scale, case when l_linenumber % 2 = 0 then 1 else 0 end as is_nullable,
        case when l_linenumber = 1 then 1 else 0 end as is_identity, 1 as seed_value, 1 as increment_value,
        case when l_linenumber = 4 then '((0))' end as default_definition,
        case when l_linenumber = 2 then 'Latin1_General_CI_AS' end as collation_name
        from lineitem
    """,
    "table_pks": """
        select cast(floor(p_partkey / 8) as bigint) as object_id, 'PK_T' || cast(floor(p_partkey / 8) as bigint) as constraint_name,
        p_partkey % 8 as key_ordinal, 'c' || (p_partkey % 8) as column_name, p_partkey % 2 as is_descending_key
        from part
    """,
    "waiting_tasks": """
        select event_id as waiting_task_address, event_id as session_id, event_id % 4 as exec_context_id,
        cast(round(value * 100) as bigint) as wait_duration_ms,
        case event_type when 'click' then 'CXPACKET' else 'LCK_M_' || event_type end as wait_type,
        'nodeId=' || event_type || '=' || user_id as resource_description
        from events
    """,
    "os_tasks": "select event_id as task_address, event_id % 16 as scheduler_id from events where event_type <> 'signup'",
    "user_sessions": "select event_id as session_id, case when event_type = 'error' then 0 else 1 end as is_user_process from events",
    "request_offsets": """
        select event_id as session_id, user_id as database_id, event_id as sql_handle,
        cast(round(value * 100) as bigint) as total_elapsed_time, cast(floor(round(value * 100) / 3) as bigint) as cpu_time,
        (event_id % 50) * 2 as statement_start_offset,
        case when event_id % 3 = 0 then -1 else (event_id % 50) * 2 + (event_id % 90) * 2 end as statement_end_offset
        from events
    """,
    "progress_requests": """
        select event_id as session_id, case event_type when 'click' then 'BACKUP DATABASE' when 'view' then 'DBCC'
        else event_type end as command, event_id as sql_handle, user_id % 100 as percent_complete, ts as start_time,
        event_id * 1500 as estimated_completion_time
        from events
    """,
    "session_state": """
        select event_id as session_id, event_type as status, ts as last_batch,
        cast(regexp_extract(props, '([0-9]+)', 1) as int) as open_tran
        from events
    """,
    "locks": """
        select l_suppkey as session_id, l_partkey % 50 as database_id, cast(floor(l_partkey / 8) as bigint) as object_id,
        l_partkey % 8 as index_id, case l_returnflag when 'A' then 5 when 'N' then 6 else 7 end as rsc_type,
        case l_linestatus when 'F' then 2 else 7 end as req_mode, l_linenumber % 3 + 1 as req_status
        from lineitem
    """,
    "lock_codes": """
        select * from (values ('LR', 5, 'TAB'), ('LR', 6, 'PAGE'), ('LR', 7, 'KEY'), ('LS', 1, 'GRANT'), ('LS', 2, 'CNVT'),
        ('LS', 3, 'WAIT'), ('L', 3, 'S'), ('L', 8, 'IX')) as t(type, number, name)
    """,
    "lock_sessions": "select s_suppkey as session_id, s_name as login_name, 'host' || s_nationkey as host_name from supplier",
    "governance": """
        select 'db' || c_custkey as governed_database, c_custkey * 1000 as user_data_directory_space_quota_mb,
        c_custkey * 300 as user_data_directory_space_usage_mb, c_custkey * 5000000 as max_db_memory
        from customer
    """,
    "schedulers": "select n_nationkey as scheduler_id, case when n_regionkey < 3 then 'VISIBLE ONLINE' else 'HIDDEN ONLINE' end as status from nation",
})

_STEP_COMMAND = """
    replace(case p_partkey % 3 when 0 then '/ISSERVER "~"~SSISDB~' || p_brand || '~' || p_type || '~' || p_name || p_partkey
        || '.dtsx~"" /SERVER "~"srv' || p_size || '~"" /ENVREFERENCE ' || p_size || ' /Par "~"par~"";' || p_size
        || ' /Par "~"$ServerOption::LOGGING_LEVEL(Int16)~"";1' || case when p_size % 2 = 0 then ' /X86' else '' end
        when 1 then '/FILE "~"C:~pkgs~' || p_brand || '~' || p_name || '.dtsx~"" /CHECKPOINTING OFF /REPORTING E'
        else '/Server "srv' || p_size || '" /SQL "Maintenance Plans~' || p_name || '" /set "~Package~' || p_type
        || '.Disable;false"' end, '~', chr(92))
"""

# Backup, job, package and maintenance views.
ADAPTERS.update({
    "bk_lsn": """
        select o_orderkey as backup_set_id, 'db' || o_custkey as database_name,
        case o_orderstatus when 'F' then 'D' when 'O' then 'I' else 'L' end as type,
        o_orderdate + (o_orderkey % 1440) * interval '1' minute as backup_start_date,
        case when o_orderpriority = '1-URGENT' then 1 else 0 end as is_damaged, o_orderkey as last_lsn
        from orders
    """,
    "bk_chain": """
        select case when o_orderkey % 3 = 0 then 'hot' else 'db' || (o_custkey % 50) end as database_name, o_orderkey % 4 as recovery_fork, o_orderkey as backup_set_id,
        case o_orderkey % 20 when 5 then 'D' when 12 then 'I' else 'L' end as type,
        o_orderkey as first_lsn, o_orderkey + case when o_orderkey % 3 = 0 then (o_orderkey * 7) % 30 else (o_orderkey * 13) % 900 end as last_lsn,
        case when o_orderkey % 11 = 0 then 1 else 0 end as is_damaged
        from orders
    """,
    "bk_forks": """
        select 'hot' as database_name, o_orderkey as recovery_fork, o_orderkey - 1 as parent_fork, o_orderkey * 400 + 37 as fork_lsn
        from orders where o_orderkey between 1 and 3
        union all select 'db' || c_custkey, 1, 0, c_custkey * 20 + 300 from customer where c_custkey < 50
    """,
    "diff_bases": "select 'db' || c_custkey as database_name, c_custkey * 7 as differential_base_lsn from customer where c_acctbal > 0",
    "job_schedules_full": """
        select p_partkey as job_id, p_partkey as schedule_id, 'sched ' || p_partkey as name,
        case when p_size % 10 = 0 then 0 else 1 end as enabled,
        case p_partkey % 8 when 0 then 1 when 1 then 4 when 2 then 8 when 3 then 16 when 4 then 32 when 5 then 64
        when 6 then 128 else 8 end as freq_type,
        case p_partkey % 8 when 3 then p_partkey % 31 + 1 when 4 then p_size % 10 + 1 else p_partkey % 127 + 1 end as freq_interval,
        p_size % 3 + 1 as freq_recurrence_factor,
        case p_size % 4 when 0 then 1 when 1 then 2 when 2 then 4 else 8 end as freq_subday_type,
        p_size % 5 + 1 as freq_subday_interval, (p_partkey % 24) * 10000 + (p_partkey % 60) * 100 as active_start_time,
        ((p_partkey + 5) % 24) * 10000 + 3000 as active_end_time, 20240100 + p_partkey % 28 + 1 as active_start_date,
        case when p_size % 3 = 0 then 20241231 else 99991231 end as active_end_date,
        case p_partkey % 5 when 0 then 1 when 1 then 2 when 2 then 4 when 3 then 8 else 16 end as freq_relative_interval,
        case when p_size % 6 = 0 then 0 else 20240200 + p_partkey % 28 + 1 end as next_run_date,
        (p_partkey % 24) * 10000 + (p_partkey % 60) * 101 as next_run_time
        from part where p_size > 4
    """,
    "job_steps": f"""
        select p_partkey as job_id, p_partkey % 4 + 1 as step_id, 'step ' || p_name as step_name,
        case when p_size % 8 = 0 then 'TSQL' else 'SSIS' end as subsystem,
        p_size % 5 as on_success_action, p_size % 4 + 1 as on_fail_action, {_STEP_COMMAND.strip()} as command
        from part
    """,
    "step_environments": "select n_nationkey as reference_id, n_name as environment_name from nation",
    "executions": """
        select o_orderkey as execution_id, p_brand as folder_name, p_type as project_name,
        p_name || p_partkey || '.dtsx' as package_name
        from orders join part on p_partkey = o_custkey
    """,
    "operations": "select o_orderkey as operation_id, case o_orderstatus when 'F' then 4 else 7 end as status, o_orderdate as start_time from orders",
    "op_messages": "select l_orderkey as operation_id, case l_linestatus when 'F' then 120 else 70 end as message_type, 'error ' || l_partkey as message from lineitem",
    "packages": "select p_brand || '/' || p_type as project_id, p_size as project_version_lsn, p_name || p_partkey as name from part",
    "projects": "select p_brand || '/' || p_type as project_id, p_type as name, p_brand as folder_id, max(p_size) as object_version_lsn from part group by p_brand, p_type",
    "folders": "select distinct p_brand as folder_id, p_brand as name from part",
    "maint_packages": "select p_partkey * 2 as package_id, case when p_size % 2 = 0 then 'Daily Maintenance ' else 'Load ' end || p_partkey as name, p_partkey % 40 as owner_sid from part",
    "job_logins": "select n_nationkey as sid, case when n_nationkey = 1 then 'sa' else n_name end as name from nation",
    "pkg_params": """
        select p_brand || '/' || p_type as project_id, p_size as project_version_lsn, p_name as object_name,
        case p_partkey % 3 when 0 then 20 when 1 then 30 else 10 end as object_type, 'par' || p_partkey as parameter_name,
        p_partkey % 2 as value_set, case when p_partkey % 5 < 3 then 'R' else 'V' end as value_type,
        case when p_partkey % 7 = 0 then 1 else 0 end as sensitive, 'dv' || p_partkey as default_value,
        'design' || p_partkey as design_default_value, 'v' || (p_partkey % 12) as referenced_variable_name
        from part
    """,
    "env_refs": "select distinct p_brand || '/' || p_type as project_id, 'env_' || p_type as environment_name from part where p_brand <> 'Brand#3'",
    "environments": "select distinct p_brand || '/' || p_type as environment_id, p_brand as folder_id, 'env_' || p_type as environment_name from part",
    "env_vars": """
        select distinct p_brand || '/' || p_type as environment_id, 'v' || (p_partkey % 10) as name, 'String' as type,
        'val_' || p_type || (p_partkey % 10) as value, case when p_partkey % 10 = 3 then 1 else 0 end as sensitive
        from part
    """,
    "ssis_principals": "select n_nationkey as principal_id, n_nationkey as sid, case when n_nationkey = 3 then 'dbo' else n_name end as name from nation",
    "ssis_roles": "select n_nationkey as member_principal_id, n_regionkey as role_principal_id from nation",
    "folder_perms": "select p_brand as object_id, p_partkey % 25 as sid, case p_size % 6 when 0 then 1 when 1 then 2 when 2 then 4 when 3 then 100 when 4 then 104 else 7 end as permission_type from part",
    "project_perms": "select p_brand || '/' || p_type as object_id, p_size % 25 as sid, case p_size % 4 when 0 then 3 when 1 then 101 when 2 then 102 else 103 end as permission_type from part",
    "environment_perms": "select p_brand || '/' || p_type as object_id, (p_size * 3) % 25 as sid, p_size % 3 + 1 as permission_type from part",
    "db_state": """
        select c_custkey as database_id, case when c_custkey = 1 then 'master' else 'db' || c_custkey end as name,
        case c_mktsegment when 'BUILDING' then 'SIMPLE' when 'MACHINERY' then 'BULK_LOGGED' else 'FULL' end as recovery_model_desc,
        case when c_nationkey % 5 = 0 then null else c_custkey end as log_lsn,
        case when c_nationkey % 7 = 0 then null else c_custkey * 2 end as differential_base_lsn,
        (c_custkey * 37) % 9000 as modified_extent_page_count,
        case when c_custkey % 6 = 0 then null else (c_custkey * 91) % 50000 end as allocated_extent_page_count,
        (c_custkey * 53) % 90000 as database_size, case when c_custkey % 10 = 0 then 1 else 0 end as differential_base_is_snapshot,
        case when c_custkey % 9 = 0 then 'RESTORING' else 'ONLINE' end as state_desc,
        case when c_custkey % 11 = 0 then 'SINGLE_USER' else 'MULTI_USER' end as user_access,
        case when c_custkey % 13 = 0 then 1 when c_custkey % 17 = 0 then null else 0 end as in_standby,
        case when c_nationkey < 10 then 'ag' || c_nationkey end as availability_group,
        case c_custkey % 3 when 0 then 'PRIMARY' when 1 then 'SECONDARY' end as availability_group_role,
        c_custkey % 2 as is_preferred_backup_replica,
        case c_custkey % 4 when 0 then 'PRIMARY' when 1 then 'SECONDARY' end as log_shipping_role,
        case when c_acctbal < 0 then 1 else 0 end as is_read_only,
        case when c_custkey % 8 = 0 then null else c_custkey % 500 end as log_size_since_last_log_backup,
        c_custkey % 3000 as minutes_since_log_backup, c_custkey % 40 as start_position
        from customer
    """,
    "idx_catalog": """
        select cast(floor(p_partkey / 8) as bigint) as object_id, p_partkey % 8 as index_id, 'IX_' || p_partkey as name,
        case p_partkey % 8 when 0 then 0 when 1 then 1 when 4 then 3 when 5 then case when p_size % 3 = 0 then 6 else 2 end
        when 6 then 4 when 7 then 7 else 2 end as type, p_size % 2 as allow_page_locks,
        case when p_size % 3 = 0 then 1 else 0 end as has_filter, case when p_size % 11 = 0 then 1 else 0 end as is_disabled,
        p_size % 7 as data_space_id
        from part
    """,
    "idx_objects": """
        select distinct cast(floor(p_partkey / 8) as bigint) as object_id, 'T' || cast(floor(p_partkey / 8) as bigint) as name,
        cast(floor(p_partkey / 8) as bigint) % 5 as schema_id,
        case cast(floor(p_partkey / 8) as bigint) % 6 when 0 then 'V ' when 1 then 'P ' else 'U ' end as type,
        case when cast(floor(p_partkey / 8) as bigint) % 13 = 0 then 1 else 0 end as is_ms_shipped
        from part
    """,
    "idx_tables": """
        select distinct cast(floor(p_partkey / 8) as bigint) as object_id,
        case when cast(floor(p_partkey / 8) as bigint) % 10 = 0 then 1 else 0 end as is_memory_optimized,
        cast(floor(p_partkey / 8) as bigint) % 5 as lob_data_space_id
        from part where p_type <> 'ECONOMY'
    """,
    "idx_columns": """
        select distinct cast(floor(l_partkey / 8) as bigint) as object_id, l_linenumber as column_id,
        case (cast(floor(l_partkey / 8) as bigint) + l_linenumber) % 9 when 0 then 'image' when 1 then 'xml' when 2 then 'varchar'
        when 3 then 'timestamp' else 'int' end as type_name,
        case when (cast(floor(l_partkey / 8) as bigint) + l_linenumber) % 18 = 2 then -1 else 10 end as max_length,
        case when (cast(floor(l_partkey / 8) as bigint) + l_linenumber * 3) % 23 = 0 then 1 else 0 end as is_filestream,
        case when (cast(floor(l_partkey / 8) as bigint) * 3 + l_linenumber) % 5 = 0 then 1 else 0 end as is_computed
        from lineitem
    """,
    "idx_index_columns": """
        select distinct cast(floor(l_partkey / 8) as bigint) as object_id, l_partkey % 8 as index_id, l_linenumber as column_id,
        l_linenumber % 3 as key_ordinal, 0 as partition_ordinal
        from lineitem
    """,
    "fg_state": "select r_regionkey as data_space_id, case when r_regionkey = 2 then 1 else 0 end as is_read_only from region",
    "resumable_ops": """
        select cast(floor(p_partkey / 8) as bigint) as object_id, p_partkey % 8 as index_id,
        case when p_size % 4 = 0 then 'PAUSED' else 'RUNNING' end as state_desc
        from part where p_brand = 'Brand#1'
    """,
    "idx_stats": """
        select cast(floor(p_partkey / 8) as bigint) as object_id, p_partkey % 8 as stats_id, 'IXS_' || p_partkey as name,
        p_size % 2 as no_recompute, 0 as is_incremental
        from part
        union all select cast(floor(p_partkey / 8) as bigint), 100 + p_partkey, 'WA_' || p_partkey, 0, p_size % 2
        from part
    """,
    "index_work": """
        select cast(floor(l_partkey / 8) as bigint) as object_id, l_partkey % 8 as index_id, l_partkey % 8 as statistics_id,
        'S' || (l_partkey % 5) as schema_name, 'T' || cast(floor(l_partkey / 8) as bigint) as object_name, 'IX_' || l_partkey as index_name,
        'ST_' || l_partkey as statistics_name, (sum(cast(l_quantity as bigint)) * 7) % 101 as avg_fragmentation_in_percent,
        sum(cast(l_quantity as bigint)) as page_count, count(*) as modification_counter, sum(cast(l_quantity as bigint)) as row_count,
        case when l_partkey % 8 = 0 then 1 else l_partkey % 8 end as index_type, max(p_size) % 2 as allow_page_locks,
        case when max(p_size) % 3 = 0 then 1 else 0 end as is_image_text, case when max(p_size) % 5 = 0 then 1 else 0 end as has_columnstore,
        case when max(p_size) % 7 = 0 then 1 else 0 end as on_read_only_filegroup, case when max(p_size) % 11 = 0 then 1 else 0 end as is_memory_optimized,
        case when max(p_size) % 13 = 0 then 1 else 0 end as resumable_index_operation, case when max(p_size) % 4 = 0 then 1 else 0 end as is_partition,
        max(p_size) % 3 as partition_number, 2 as partition_count, max(p_size) % 2 as no_recompute, max(p_size) % 9 as start_position
        from lineitem join part on p_partkey = l_partkey
        group by l_partkey
    """,
})

# Security, configuration, topology and selection views.
ADAPTERS.update({
    "db_principals": """
        select s_suppkey as principal_id, s_name as name, case s_nationkey % 4 when 0 then 'S' when 1 then 'U' when 2 then 'G' else 'X' end as type,
        case s_nationkey % 4 when 0 then 'SQL_USER' when 1 then 'WINDOWS_USER' when 2 then 'WINDOWS_GROUP' else 'EXTERNAL_USER' end as type_desc,
        case s_nationkey % 2 when 0 then 'INSTANCE' else 'EXTERNAL' end as authentication_type_desc, s_nationkey as sid
        from supplier
        union all select -1 - n_nationkey, case when n_nationkey = 24 then 'public' when n_nationkey = 23 then 'db_owner' else n_name end,
        'R', 'DATABASE_ROLE', 'NONE', null
        from nation
    """,
    "db_role_members": """
        select s_suppkey as member_principal_id, -1 - s_nationkey as role_principal_id from supplier where s_nationkey < 20
        union all select s_suppkey, -1 - (s_nationkey + 7) % 20 from supplier where s_acctbal > 5000
    """,
    "nested_members": """
        select s_suppkey as member_principal_id, -1000 - s_suppkey as role_principal_id from supplier
        union all select -1000 - p_partkey, case when p_partkey < 3 then -1 - p_partkey else -1000 - cast(floor(p_partkey / 3) as bigint) end from part
        union all select -1000 - p_partkey, -1000 - 3 * p_partkey from part where p_partkey % 40 = 1
    """,
    "role_nesting": """
        select s_suppkey as member_principal_id, -1 - s_nationkey as role_principal_id from supplier
        union all select -1 - n_nationkey, -1 - cast(floor(n_nationkey / 4) as bigint) from nation where n_nationkey % 8 < 3
    """,
    "db_permissions": """
        select distinct case when l_orderkey % 2 = 0 then l_suppkey else -1 - l_suppkey % 25 end as grantee_principal_id, l_partkey as major_id,
        l_linenumber % 3 as minor_id,
        case l_returnflag when 'A' then 'SELECT' when 'R' then 'EXECUTE' else case when l_orderkey % 2 = 0 then 'CONNECT' else 'UPDATE' end end as permission_name,
        case l_linestatus when 'F' then 'GRANT' else 'DENY' end as state_desc,
        case when l_linenumber = 1 or (l_linenumber = 2 and l_orderkey % 2 <> 0) then 'DATABASE' when l_orderkey % 2 = 0 then 'OBJECT_OR_COLUMN' else 'SCHEMA' end as class_desc
        from lineitem
    """,
    "db_objects": """
        select p_partkey as object_id, 'obj' || p_partkey as name, case p_size % 4 when 0 then 'USER_TABLE' when 1 then 'VIEW'
        when 2 then 'SYSTEM_TABLE' else 'SQL_STORED_PROCEDURE' end as type_desc, p_size % 5 as schema_id,
        case when p_size % 7 = 0 then 1 else 0 end as is_ms_shipped
        from part where p_size <= 40
    """,
    "db_columns": """
        select p_partkey as object_id, 1 as column_id, 'c1_' || p_partkey as name from part
        union all select p_partkey, 2, 'c2_' || p_partkey from part
    """,
    "login_tokens": "select n_nationkey as sid, 'DOM/' || n_name as name from nation where n_nationkey < 20",
    "owned_schemas": "select r_regionkey as schema_id, r_name as name, r_regionkey * 4 as principal_id from region",
    "server_principals": """
        select s_suppkey as principal_id, s_name as name, case s_nationkey % 4 when 0 then 'S' when 1 then 'U' when 2 then 'G' else 'C' end as type,
        case s_nationkey % 4 when 0 then 'SQL_LOGIN' when 1 then 'WINDOWS_LOGIN' when 2 then 'WINDOWS_GROUP' else 'CERTIFICATE_MAPPED_LOGIN' end as type_desc,
        s_suppkey % 2 as is_disabled
        from supplier
    """,
    "syslogins": """
        select s_name as login_name, case when s_acctbal > 9000 then 1 else 0 end as sysadmin, s_nationkey % 2 as serveradmin,
        case when s_acctbal < 0 then 1 else 0 end as securityadmin, s_nationkey % 3 as denylogin
        from supplier where s_acctbal > -500
    """,
    "owned_databases": "select c_custkey as database_id, 'db' || c_custkey as name, case when c_acctbal < 0 then null when c_nationkey = 3 then 'sa' else 'owner' || c_nationkey end as owner from customer",
    "server_permissions": """
        select l_suppkey as grantee_principal_id, l_partkey % 100 as grantor_principal_id, 65536 + l_linenumber as major_id, 'CONNECT' as permission_name,
        case l_linestatus when 'F' then 'GRANT' else 'DENY' end as state_desc
        from lineitem
    """,
    "endpoints": "select 65536 + n_nationkey as endpoint_id, case when n_nationkey = 5 then 'Hadr_endpoint' else 'ep' || n_nationkey end as name, 'STARTED' as state_desc from nation where n_nationkey < 6",
    "server_props": """
        select p_partkey as server_id, p_size || '.' || (p_partkey % 60) || '.' || p_partkey || '.1' as product_version,
        case when p_partkey % 3 = 0 then 'SQL Azure' else 'Enterprise Edition' end as edition, p_size % 14 as engine_edition
        from part
    """,
    "server_config": "select c_custkey as server_id, c_nationkey * 2 + 2 as cores, c_custkey % 70 as affinity_mask, c_custkey % 9 as affinity64_mask from customer",
    "tempdb_files": "select o_custkey as server_id, o_orderkey as file_id, 1024 + case when o_orderpriority = '1-URGENT' then 512 else 0 end as size_pages from orders",
    "installed_features": """
        select p_partkey as feature_id, p_brand as instance,
        'Microsoft SQL Server ' || case p_size % 9 when 0 then '2022' when 1 then '2019' when 2 then '2017' when 3 then '2016' when 4 then '2014'
        when 5 then '2012' when 6 then '2008' when 7 then '2008R2' else '7' end as product,
        case p_partkey % 13 when 0 then 'Database Engine Services' when 1 then 'Full-Text and Semantic Extractions for Search'
        when 2 then 'SQL Server Replication' when 3 then 'Data Quality Services' when 4 then 'Machine Learning Services and Language Extensions'
        when 5 then 'Analysis Services' when 6 then 'PolyBase Query Service for External Data' when 7 then 'Data Quality Client'
        when 8 then 'Integration Services' when 9 then 'Scale Out Master' when 10 then 'scale out worker' when 11 then 'Master Data Services'
        else p_name end as feature
        from part
    """,
    "setup_paths": "select cast(100 + r_regionkey * 10 as varchar(10)) as version, 'C:/' || r_name || '/setup.exe' as setup_path from region",
    "win_events": """
        select event_id as record_id, ts as time_created, case when event_type = 'error' then 1074 else 7036 end as event_id,
        'proc' || user_id as p0, 'host' as p1, 'reason ' || event_type as p2, '0x' || (event_id % 100) as p3, 'restart' as p4, props as p5,
        'user' || user_id as p6
        from events
    """,
    "repl_agents": """
        select s_suppkey as agent_id, s_name as name, case when s_nationkey = 3 then 'virtual' else 'sub' || s_nationkey end as subscriber_db,
        'pub' || s_nationkey as publication, s_nationkey % 4 as subscription_type
        from supplier
    """,
    "repl_pubs": "select c_custkey as publication_id, c_custkey as pubid, c_nationkey as publisher_id, 'pub' || c_custkey as publication, 'pub' || c_custkey as name from customer",
    "repl_articles": """
        select o_orderkey as artid, o_custkey as publication_id, o_custkey as pubid, 'db' || o_custkey as publisher_db, 'art' || o_orderkey as article,
        'art' || o_orderkey as name, 'dest' || o_orderkey as destination_object
        from orders
    """,
    "repl_subs": """
        select c_custkey as publication_id, (c_nationkey + 1) % 25 as subscriber_id, 'sub' || c_nationkey as subscriber_db from customer
        union all select c_custkey, (c_nationkey + 2) % 25, 'sub' || c_nationkey from customer where c_acctbal > 5000
    """,
    "repl_article_subs": "select l_orderkey as artid, l_suppkey % 25 as srvid from lineitem",
    "repl_servers": "select n_nationkey as srvid, lower(n_name) as srvname from nation",
    "repl_routes": """
        select n_nationkey as publisher_id, (n_nationkey + 1) % 25 as subscriber_id, 'agent' || n_nationkey as name from nation
        union all select n_nationkey, (n_nationkey + 2) % 25, 'agent2_' || n_nationkey from nation where n_nationkey < 15
    """,
    "ag_db_cluster": "select c_custkey as group_database_id, c_nationkey as replica_id, 'db' || c_custkey as database_name, case when c_acctbal < 0 then null else 1 end as is_database_joined from customer",
    "ag_replica_states": """
        select n_nationkey as replica_id, n_nationkey % 5 as group_id, case when n_nationkey < 5 then 'PRIMARY' else 'SECONDARY' end as role_desc,
        case when n_nationkey % 4 = 0 then null else 'HEALTHY' end as synchronization_health_desc, n_nationkey % 2 as is_local,
        case when n_nationkey % 3 = 0 then null else n_nationkey % 3 end as role, 'CONNECTED' as connected_state_desc
        from nation where n_nationkey <> 7
    """,
    "ag_addresses": "select r_regionkey as group_id, 'ls' || r_regionkey as dns_name, 1433 + r_regionkey as port, case when r_regionkey = 1 then '10.0.0.1' end as ip_configuration from region where r_regionkey < 3",
    "ag_replica_props": "select n_nationkey as replica_id, n_nationkey % 5 as group_id, 'TCP://' || n_name as endpoint_url, 'SYNCHRONOUS_COMMIT' as availability_mode_desc, 'MANUAL' as failover_mode_desc from nation",
    "ag_group_states": "select r_regionkey as group_id, r_name as primary_replica from region where r_regionkey <> 2",
    "ag_db_states": """
        select c_custkey as group_database_id, c_nationkey as replica_id, c_custkey % 3 as synchronization_state,
        case when c_custkey % 5 = 0 then null else c_custkey % 2 end as is_suspended
        from customer where c_mktsegment <> 'BUILDING'
    """,
    "mirroring": """
        select c_custkey as database_id, case when c_acctbal < 0 then 'SYNCHRONIZED' end as mirroring_state_desc,
        case when c_custkey % 2 = 0 then 'PRINCIPAL' else 'MIRROR' end as mirroring_role_desc, 'FULL' as mirroring_safety_level_desc,
        'TCP://p' || c_nationkey as mirroring_partner_name
        from customer
    """,
    "catalog_names": """
        select 'S' || (cast(floor(p_partkey / 8) as bigint) % 5) as database_name, 'dbo' || (p_partkey % 3) as schema_name,
        'T' || cast(floor(p_partkey / 8) as bigint) as object_name, 'IX_' || p_partkey as index_name, 'FG' || (p_size % 4) as filegroup_name
        from part
    """,
    "selection_entries": """
        select p_partkey % 60 as selection, p_partkey as position,
        case p_partkey % 8 when 0 then 'db' || p_partkey || '%' when 1 then '%' || p_partkey when 2 then '-%' || (p_partkey % 997) || '%'
        when 3 then '-DB' || (p_partkey * 3) when 4 then '[db' || p_partkey || ']' when 5 then 'db' || (p_partkey % 90) || '%' || (p_partkey % 10)
        when 6 then 'd_' || p_partkey || '%' else case when p_partkey % 400 = 7 then 'SYSTEM_DATABASES' when p_partkey % 400 = 15 then '-[nobk%]'
        when p_partkey % 400 = 23 then 'USER_DATABASES' when p_partkey % 400 = 31 then '%' else '%b' || (p_partkey % 800) || '%' end end as entry
        from part
    """,
    "group_databases": "select 'ag' || (c_nationkey % 12) as availability_group, 'db' || c_custkey as name from customer where c_nationkey < 20",
})
