"""Queries over waits, sessions, locks and resource use."""

from pyspark.sql import functions as F

from fleetlens.operators import counters
from fleetlens.operators import workload as op
from fleetlens.plans.registry import check_ratio, query

AS_OF = "2024-01-30 00:00:00"


@query(
    "wait_type:s wait_s:d resource_s:d signal_s:d wait_count:i percentage:d avg_wait_s:d avg_res_s:d avg_sig_s:d help_url:s",
    f"""
    SELECT wait_type, {check_ratio('wait_time_ms', '1000', 2)} AS wait_s,
      {check_ratio('wait_time_ms - signal_wait_time_ms', '1000', 2)} AS resource_s,
      {check_ratio('signal_wait_time_ms', '1000', 2)} AS signal_s,
      waiting_tasks_count AS wait_count, {check_ratio('wait_time_ms * 100', 'total', 2)} AS percentage,
      {check_ratio('wait_time_ms', 'waiting_tasks_count * 1000', 4)} AS avg_wait_s,
      {check_ratio('wait_time_ms - signal_wait_time_ms', 'waiting_tasks_count * 1000', 4)} AS avg_res_s,
      {check_ratio('signal_wait_time_ms', 'waiting_tasks_count * 1000', 4)} AS avg_sig_s,
      'https://www.sqlskills.com/help/waits/' || wait_type AS help_url
    FROM (
      SELECT *, SUM(wait_time_ms) OVER () AS total,
        COALESCE(SUM(wait_time_ms) OVER (ORDER BY wait_time_ms DESC, wait_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM waits WHERE waiting_tasks_count > 0 AND wait_type NOT IN (SELECT wait_type FROM wait_ignore)
    ) WHERE 100 * before < 95 * total
    """,
)
def wait_pareto(t):
    return op.wait_pareto(t.waits, t.wait_ignore)


@query(
    "latch_class:s wait_s:d wait_count:i percentage:d avg_wait_s:d",
    f"""
    SELECT wait_type AS latch_class, {check_ratio('wait_time_ms', '1000', 2)} AS wait_s, waiting_tasks_count AS wait_count,
      {check_ratio('wait_time_ms * 100', 'total', 2)} AS percentage,
      {check_ratio('wait_time_ms', 'waiting_tasks_count * 1000', 4)} AS avg_wait_s
    FROM (
      SELECT *, SUM(wait_time_ms) OVER () AS total,
        COALESCE(SUM(wait_time_ms) OVER (ORDER BY wait_time_ms DESC, wait_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM waits WHERE wait_type <> 'BUFFER'
    ) WHERE 100 * before < 95 * total
    """,
)
def latch_pareto(t):
    latches = t.waits.withColumnsRenamed({"wait_type": "latch_class", "waiting_tasks_count": "waiting_requests_count"})
    return op.latch_pareto(latches)


@query(
    "session_id:i exec_context_id:i scheduler_id:i wait_duration_ms:i wait_type:s resource_description:s node_id:s text:s database_id:i cpu_time:i query_plan:s",
    """
    SELECT w.session_id, exec_context_id, scheduler_id, wait_duration_ms, w.wait_type, resource_description,
      CASE WHEN w.wait_type = 'CXPACKET' THEN regexp_extract(resource_description, '([^=]*)$', 1) END AS node_id,
      s.text, r.database_id, r.cpu_time, p.query_plan
    FROM waiting_tasks w JOIN os_tasks o ON w.waiting_task_address = o.task_address
    JOIN user_sessions u ON u.session_id = w.session_id JOIN requests r ON r.session_id = w.session_id
    LEFT JOIN sql_text s ON s.sql_handle = r.sql_handle LEFT JOIN showplans p ON p.plan_handle = r.sql_handle
    WHERE is_user_process = 1
    """,
)
def waits_now(t):
    requests = t.requests.withColumn("plan_handle", F.col("sql_handle"))
    return op.waits_now(t.waiting_tasks, t.os_tasks, t.user_sessions, requests, t.sql_text, t.showplans)


@query(
    "session_id:i sql_handle:i start_time:t status:s database_id:i total_elapsed_time:i cpu_time:i text:s",
    """
    SELECT DISTINCT r.session_id, r.sql_handle, start_time, status, database_id, total_elapsed_time, cpu_time, text
    FROM requests r JOIN sql_text s ON s.sql_handle = r.sql_handle
    WHERE blocking_session_id = 0 AND r.session_id IN (SELECT blocking_session_id FROM requests)
      AND r.session_id <> 0
    ORDER BY total_elapsed_time DESC, r.session_id LIMIT 10
    """,
)
def head_blockers(t):
    return op.head_blockers(t.requests, t.sql_text)


@query(
    "session_id:i database_id:i total_elapsed_time:i cpu_time:i wait_time:i statement_text:s",
    """
    SELECT session_id, database_id, total_elapsed_time, cpu_time, total_elapsed_time - cpu_time AS wait_time,
      replace(replace(substring(text, statement_start_offset // 2 + 1,
        ((CASE WHEN statement_end_offset = -1 THEN length(text) * 2 ELSE statement_end_offset END) - statement_start_offset) // 2 + 1),
        chr(10), ' '), chr(13), ' ') AS statement_text
    FROM request_offsets r JOIN sql_text s ON s.sql_handle = r.sql_handle
    """,
)
def running_requests(t):
    return op.running_requests(t.request_offsets, t.sql_text)


@query(
    "plan_handle:i avg_elapsed_time:i avg_cpu_time:i avg_wait_time:i avg_logical_reads:i cumulative_elapsed_time:i text:s",
    """
    SELECT plan_handle, (total_elapsed_time // 1000) // execution_count AS avg_elapsed_time,
      (total_worker_time // 1000) // execution_count AS avg_cpu_time,
      (total_elapsed_time // 1000) // execution_count - (total_worker_time // 1000) // execution_count AS avg_wait_time,
      total_logical_reads // execution_count AS avg_logical_reads, total_elapsed_time // 1000 AS cumulative_elapsed_time, text
    FROM query_stats q JOIN sql_text s ON s.sql_handle = q.sql_handle
    """,
)
def query_stats_averages(t):
    return op.query_stats_averages(t.query_stats, t.sql_text)


@query(
    "plan_handle:i avg_cpu_time:i statement_text:s",
    """
    SELECT plan_handle, total_worker_time // execution_count AS avg_cpu_time, text AS statement_text
    FROM query_stats q JOIN sql_text s ON s.sql_handle = q.sql_handle
    ORDER BY avg_cpu_time DESC, plan_handle LIMIT 5
    """,
)
def top_queries_by_cpu(t):
    return op.top_queries_by_cpu(t.query_stats, t.sql_text)


@query(
    "session_id:i last_batch:t open_tran:i",
    f"""
    SELECT session_id, last_batch, open_tran FROM session_state
    WHERE session_id > 50 AND status = 'view' AND open_tran > 0 AND last_batch < TIMESTAMP '{AS_OF}' - INTERVAL 120 SECOND
    """,
)
def idle_open_transactions(t):
    return op.idle_open_transactions(t.session_state, as_of=AS_OF, sleeping="view")


@query(
    "session_id:i command:s percent_complete:i start_time:t estimated_completion:t text:s",
    f"""
    SELECT session_id, command, percent_complete, start_time,
      TIMESTAMP '{AS_OF}' + to_seconds(estimated_completion_time // 1000) AS estimated_completion, text
    FROM progress_requests r JOIN sql_text s ON s.sql_handle = r.sql_handle WHERE command IN ('BACKUP DATABASE', 'DBCC')
    """,
)
def operation_progress(t):
    return op.operation_progress(t.progress_requests, t.sql_text, as_of=AS_OF)


@query(
    "session_id:i login_name:s host_name:s database_id:i object_id:i object_name:s index_id:i index_name:s lock_type:s lock_mode:s lock_status:s lock_count:i",
    """
    SELECT l.session_id, login_name, host_name, database_id, l.object_id, COALESCE(t.name, '') AS object_name, l.index_id,
      COALESCE(i.name, '') AS index_name, v.name AS lock_type, u.name AS lock_mode, x.name AS lock_status, COUNT(*) AS lock_count
    FROM locks l JOIN lock_codes v ON v.type = 'LR' AND v.number = rsc_type
    JOIN lock_codes x ON x.type = 'LS' AND x.number = req_status JOIN lock_codes u ON u.type = 'L' AND u.number = req_mode + 1
    JOIN lock_sessions s ON s.session_id = l.session_id
    LEFT JOIN tables t ON t.object_id = l.object_id LEFT JOIN indexes i ON i.object_id = l.object_id AND i.index_id = l.index_id
    GROUP BY ALL
    """,
)
def lock_summary(t):
    return op.lock_summary(t.locks, t.lock_codes, t.lock_sessions, t.tables, t.indexes)


@query(
    "sku:s database_name:s mean_avg_cpu_centi:d mean_avg_data_io:d max_avg_data_io:i max_storage_in_megabytes:i",
    f"""
    SELECT sku, database_name, {check_ratio('SUM(avg_cpu_centi)', 'COUNT(*)', 4)} AS mean_avg_cpu_centi,
      {check_ratio('SUM(avg_data_io)', 'COUNT(*)', 4)} AS mean_avg_data_io,
      MAX(avg_data_io) AS max_avg_data_io, MAX(storage_in_megabytes) AS max_storage_in_megabytes
    FROM resource_stats GROUP BY sku, database_name
    """,
)
def resource_summary(t):
    return op.resource_summary(t.resource_stats, ("avg_cpu_centi", "avg_data_io"), ("avg_data_io", "storage_in_megabytes"))


@query(
    "governed_database:s max_storage_gb:i current_storage_usage_gb:i max_db_memory_gb:i v_cores:i",
    """
    SELECT governed_database, user_data_directory_space_quota_mb // 1024 AS max_storage_gb,
      user_data_directory_space_usage_mb // 1024 AS current_storage_usage_gb, max_db_memory // 1048576 AS max_db_memory_gb,
      (SELECT COUNT(*) FROM schedulers WHERE status = 'VISIBLE ONLINE') AS v_cores
    FROM governance
    """,
)
def resource_quota(t):
    return op.resource_quota(t.governance, t.schedulers)


@query(
    "database_name:s start_time:t event_subtype:i",
    f"""
    SELECT database_name, start_time, event_subtype FROM event_log WHERE event_type = 'connection_failed'
      AND event_subtype = 4 AND start_time BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}'
    """,
)
def connection_failures(t):
    return op.connection_failures(t.event_log, as_of=AS_OF)


@query(
    "variant:s database_name:s start_time:t description:s",
    """
    SELECT 'no 7 in text' AS variant, database_name, start_time, description FROM event_log WHERE description NOT LIKE '%7%Connected%'
    UNION ALL
    SELECT 'one database', database_name, start_time, description FROM event_log
    WHERE database_name = 'db7' AND description NOT LIKE '%9%'
    """,
)
def error_log_filter(t):
    everywhere = op.error_log_filter(t.event_log, exclude_like="%7%Connected%").withColumn("variant", F.lit("no 7 in text"))
    one = op.error_log_filter(t.event_log, "db7", "%9%").withColumn("variant", F.lit("one database"))
    return everywhere.unionByName(one)


_DELTAS = """
    SELECT counter_name, sample_time, sample_id, value, previous_time, date_diff('microsecond', previous_time, sample_time) AS elapsed_us,
      CASE WHEN previous_time IS NOT NULL THEN CASE WHEN value < before THEN value ELSE value - before END END AS delta,
      COALESCE(value < before, FALSE) AS was_reset
    FROM (SELECT *, LAG(sample_time) OVER w AS previous_time, LAG(value) OVER w AS before FROM counter_samples WHERE value IS NOT NULL
      WINDOW w AS (PARTITION BY counter_name ORDER BY sample_time, sample_id))
"""


@query(
    "counter_name:s sample_time:t sample_id:i value:i previous_time:t elapsed_us:i delta:i was_reset:b",
    _DELTAS + " UNION ALL SELECT counter_name, sample_time, sample_id, NULL, NULL, NULL, NULL, FALSE FROM counter_samples WHERE value IS NULL",
)
def counter_deltas(t):
    return counters.counter_deltas(t.counter_samples)


@query(
    "counter_name:s window_start:t total:i covered_us:i resets:i",
    f"""
    SELECT counter_name, date_trunc('hour', sample_time) AS window_start, SUM(delta) AS total, SUM(elapsed_us) AS covered_us, SUM(was_reset::INT) AS resets
    FROM ({_DELTAS}) WHERE delta IS NOT NULL GROUP BY ALL
    """,
)
def counter_rates(t):
    return counters.counter_rates(counters.counter_deltas(t.counter_samples))
