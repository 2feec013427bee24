"""Columns of the snapshot tables the reports read.

One DDL text per catalog view or counter table; a collector adds
``server_name`` (and ``database_name`` for database-scoped views) plus the
snapshot date as partition columns.  Reading with an explicit schema avoids
inference over a large table, and columns a server version does not have are
read as NULL.
"""

from __future__ import annotations

FLEET = "server_name STRING, snapshot_date DATE"
FLEET_DATABASE = "server_name STRING, database_name STRING, snapshot_date DATE"

SERVER_SCOPED: dict[str, str] = {
    "wait_stats": "wait_type STRING, wait_time_ms BIGINT, signal_wait_time_ms BIGINT, waiting_tasks_count BIGINT",
    "latch_stats": "latch_class STRING, wait_time_ms BIGINT, waiting_requests_count BIGINT",
    "requests": (
        "session_id INT, blocking_session_id INT, start_time TIMESTAMP_NTZ, status STRING, command STRING, database_id INT, "
        "wait_type STRING, wait_time BIGINT, total_elapsed_time BIGINT, cpu_time BIGINT, logical_reads BIGINT, sql_handle BINARY, "
        "plan_handle BINARY, statement_start_offset INT, statement_end_offset INT, percent_complete DOUBLE, estimated_completion_time BIGINT"
    ),
    "sessions": "session_id INT, is_user_process INT, login_name STRING, host_name STRING, status STRING, open_tran INT, last_batch TIMESTAMP_NTZ",
    "sql_text": "sql_handle BINARY, text STRING",
    "query_stats": (
        "plan_handle BINARY, sql_handle BINARY, query_hash BINARY, creation_time TIMESTAMP_NTZ, last_execution_time TIMESTAMP_NTZ, "
        "execution_count BIGINT, total_worker_time BIGINT, total_elapsed_time BIGINT, total_logical_reads BIGINT, total_logical_writes BIGINT, "
        "total_rows BIGINT, statement_start_offset INT, statement_end_offset INT"
    ),
    "showplans": "plan_handle BINARY, dbid INT, query_plan STRING",
    "cached_plans": "plan_handle BINARY, usecounts INT, refcounts INT, size_in_bytes INT",
    "buffer_descriptors": "database_id INT, allocation_unit_id BIGINT, is_modified INT, free_space_in_bytes INT",
    "io_file_stats": (
        "database_id INT, file_id INT, num_of_reads BIGINT, num_of_writes BIGINT, num_of_bytes_read BIGINT, num_of_bytes_written BIGINT, "
        "io_stall BIGINT, io_stall_read_ms BIGINT, io_stall_write_ms BIGINT, io_stall_queued_read_ms BIGINT, io_stall_queued_write_ms BIGINT"
    ),
    "databases": (
        "database_id INT, name STRING, recovery_model_desc STRING, owner_id BINARY, is_read_only INT, state_desc STRING, "
        "is_auto_close_on INT, is_auto_shrink_on INT, is_db_chaining_on INT, is_auto_create_stats_on INT, is_auto_update_stats_on INT"
    ),
    "files": (
        "database_id INT, file_id INT, type INT, name STRING, physical_name STRING, group_id INT, size_pages BIGINT, used_pages BIGINT, "
        "growth INT, is_percent_growth INT, max_size BIGINT"
    ),
    "log_vlfs": "database_id INT, file_id INT, file_size BIGINT, start_offset BIGINT, f_seq_no INT, status INT, parity INT, create_lsn DECIMAL(25,0)",
    "backupset": (
        "backup_set_id BIGINT, media_set_id BIGINT, database_name STRING, name STRING, type STRING, backup_start_date TIMESTAMP_NTZ, "
        "backup_finish_date TIMESTAMP_NTZ, backup_size DECIMAL(20,0), is_damaged INT, last_lsn DECIMAL(25,0)"
    ),
    "backupmediafamily": "media_set_id BIGINT, family_sequence_number INT, physical_device_name STRING",
    "restorehistory": (
        "restore_history_id BIGINT, backup_set_id BIGINT, destination_database_name STRING, restore_type STRING, restore_date TIMESTAMP_NTZ, user_name STRING"
    ),
    "command_log": (
        "id BIGINT, database_name STRING, schema_name STRING, object_name STRING, object_type STRING, index_name STRING, index_type INT, "
        "statistics_name STRING, partition_number INT, extended_info STRING, command STRING, command_type STRING, start_time TIMESTAMP_NTZ, "
        "end_time TIMESTAMP_NTZ, error_number INT, error_message STRING"
    ),
    "trace": (
        "event_class INT, event_subclass INT, database_name STRING, filename STRING, duration BIGINT, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, "
        "integer_data BIGINT, application_name STRING, host_name STRING, login_name STRING, spid INT, text_data STRING"
    ),
    "resource_stats": (
        "end_time TIMESTAMP_NTZ, sku STRING, database_name STRING, avg_cpu_percent DECIMAL(5,2), avg_data_io_percent DECIMAL(5,2), "
        "avg_log_write_percent DECIMAL(5,2), avg_instance_cpu_percent DECIMAL(5,2), avg_instance_memory_percent DECIMAL(5,2), "
        "max_worker_percent DECIMAL(5,2), max_session_percent DECIMAL(5,2), storage_in_megabytes BIGINT"
    ),
    "event_log": (
        "database_name STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, event_category STRING, event_type STRING, event_subtype INT, "
        "severity INT, event_count INT, description STRING"
    ),
    "jobs": "job_id STRING, name STRING, owner_sid BINARY, enabled INT, category_id INT",
    "job_steps": "job_id STRING, step_id INT, step_name STRING, subsystem STRING, command STRING, on_success_action INT, on_fail_action INT",
    "schedules": (
        "schedule_id INT, name STRING, enabled INT, freq_type INT, freq_interval INT, freq_subday_type INT, freq_subday_interval INT, "
        "freq_relative_interval INT, freq_recurrence_factor INT, active_start_date INT, active_end_date INT, active_start_time INT, active_end_time INT"
    ),
    "distribution_history": "agent_id INT, runstatus INT, time TIMESTAMP_NTZ, xact_seqno BINARY, comments STRING, error_id INT",
}

DATABASE_SCOPED: dict[str, str] = {
    "indexes": (
        "object_id INT, index_id INT, name STRING, type INT, type_desc STRING, fill_factor INT, is_disabled INT, allow_page_locks INT, "
        "has_filter INT, data_space_id INT"
    ),
    "index_physical_stats": (
        "object_id INT, index_id INT, index_type_desc STRING, alloc_unit_type_desc STRING, index_level INT, avg_fragmentation_in_percent DOUBLE, "
        "avg_page_space_used_in_percent DOUBLE, page_count BIGINT"
    ),
    "index_usage": (
        "object_id INT, index_id INT, last_user_seek TIMESTAMP_NTZ, last_user_scan TIMESTAMP_NTZ, last_user_lookup TIMESTAMP_NTZ, last_user_update TIMESTAMP_NTZ"
    ),
    "tables": "object_id INT, name STRING, schema_id INT, is_ms_shipped INT, is_tracked_by_cdc INT, is_memory_optimized INT, lob_data_space_id INT",
    "schemas": "schema_id INT, name STRING, principal_id INT",
    "partitions": "partition_id BIGINT, object_id INT, index_id INT, partition_number INT, rows BIGINT, data_compression_desc STRING",
    "allocation_units": "allocation_unit_id BIGINT, container_id BIGINT, total_pages BIGINT, used_pages BIGINT, data_pages BIGINT",
    "principals": "principal_id INT, name STRING, type STRING, type_desc STRING, authentication_type_desc STRING, sid BINARY",
    "role_members": "role_principal_id INT, member_principal_id INT",
    "permissions": "grantee_principal_id INT, major_id INT, minor_id INT, permission_name STRING, state_desc STRING, class_desc STRING",
}


def schema_of(table: str) -> str:
    """DDL of a snapshot table with its fleet columns."""
    if table in SERVER_SCOPED:
        return f"{SERVER_SCOPED[table]}, {FLEET}"
    return f"{DATABASE_SCOPED[table]}, {FLEET_DATABASE}"
