"""Streaming queries, run to the end of the available input.

The check SQL is the batch form of the same report.  Where append mode keeps
the windows that are still open, the check leaves them out by the same rule.
"""

from pyspark.sql import functions as F

from fleetlens.plans.registry import query
from fleetlens.session import scratch
from fleetlens.streaming import operators as op
from fleetlens.streaming import stateful

_TRACE = "SELECT t.event_id, e.name AS event_name, start_time, database_name FROM trace t JOIN trace_events e ON e.trace_event_id = t.event_class"


@query("event_id:i event_name:s start_time:t database_name:s", _TRACE + " WHERE event_class IN (46, 92, 93, 104)")
def stream_trace_classes(t):
    return op.run_to_table(op.stream_trace_classes(t.stream("trace"), t.trace_events, (46, 92, 93, 104)))


_MEASURES = """sku, database_name, SUM(avg_cpu_centi) AS sum_avg_cpu_centi, MAX(avg_cpu_centi) AS max_avg_cpu_centi,
  SUM(avg_data_io) AS sum_avg_data_io, MAX(avg_data_io) AS max_avg_data_io, MAX(storage_in_megabytes) AS max_storage_in_megabytes, COUNT(*) AS samples"""
_SHAPE = ("window_start:t window_end:t sku:s database_name:s sum_avg_cpu_centi:i max_avg_cpu_centi:i sum_avg_data_io:i max_avg_data_io:i "
          "max_storage_in_megabytes:i samples:i")
_WHAT = dict(averages=("avg_cpu_centi", "avg_data_io"), peaks=("storage_in_megabytes",))


@query(
    _SHAPE,
    f"""
    SELECT time_bucket(INTERVAL 5 MINUTE, end_time) AS window_start, time_bucket(INTERVAL 5 MINUTE, end_time) + INTERVAL 5 MINUTE AS window_end, {_MEASURES}
    FROM resource_stats
    WHERE time_bucket(INTERVAL 5 MINUTE, end_time) + INTERVAL 5 MINUTE <= (SELECT MAX(end_time) - INTERVAL 10 MINUTE FROM resource_stats)
    GROUP BY ALL
    """,
)
def stream_resource_tumbling(t):
    return op.run_to_table(op.stream_resource_tumbling(t.stream("resource_stats"), **_WHAT))


@query(
    _SHAPE,
    f"""
    SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, {_MEASURES} FROM (
      SELECT *, unnest([time_bucket(INTERVAL 15 MINUTE, end_time), time_bucket(INTERVAL 15 MINUTE, end_time) - INTERVAL 15 MINUTE,
        time_bucket(INTERVAL 15 MINUTE, end_time) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, end_time) - INTERVAL 45 MINUTE]) AS s
      FROM resource_stats)
    WHERE s + INTERVAL 1 HOUR <= (SELECT MAX(end_time) - INTERVAL 10 MINUTE FROM resource_stats)
    GROUP BY ALL
    """,
)
def stream_resource_sliding(t):
    return op.run_to_table(op.stream_resource_sliding(t.stream("resource_stats"), **_WHAT))


_BUCKET = "time_bucket(INTERVAL 1 HOUR, start_time)"


@query(
    "window_start:t window_end:t database_name:s event_subtype:i failures:i",
    f"""
    SELECT {_BUCKET} AS window_start, {_BUCKET} + INTERVAL 1 HOUR AS window_end, database_name, event_subtype, COUNT(*) AS failures FROM event_log
    WHERE event_type = 'connection_failed'
      AND {_BUCKET} + INTERVAL 1 HOUR <= (SELECT MAX(start_time) - INTERVAL 10 MINUTE FROM event_log)
    GROUP BY ALL
    """,
)
def stream_connection_failures(t):
    return op.run_to_table(op.stream_connection_failures(t.stream("event_log")))


@query(
    "database_id:i active_from:t active_until:t batches:i",
    """
    WITH marked AS (SELECT database_id, start_time, CASE WHEN start_time - LAG(start_time) OVER (PARTITION BY database_id ORDER BY start_time) < INTERVAL 2 HOUR
        THEN 0 ELSE 1 END AS is_new FROM requests),
    numbered AS (SELECT *, SUM(is_new) OVER (PARTITION BY database_id ORDER BY start_time ROWS UNBOUNDED PRECEDING) AS n FROM marked)
    SELECT database_id, MIN(start_time) AS active_from, MAX(start_time) + INTERVAL 2 HOUR AS active_until, COUNT(*) AS batches FROM numbered
    GROUP BY database_id, n HAVING MAX(start_time) + INTERVAL 2 HOUR <= (SELECT MAX(start_time) - INTERVAL 10 MINUTE FROM requests)
    """,
)
def stream_session_activity(t):
    return op.run_to_table(op.stream_session_activity(t.stream("requests"), gap="2 hours", key="database_id"))


@query(
    "session_key:i idle_since:t idle_until:t",
    """
    SELECT session_key, last_batch AS idle_since, last_batch + INTERVAL 1 HOUR AS idle_until FROM (
      SELECT database_id AS session_key, start_time AS last_batch, status, open_tran,
        LEAD(start_time) OVER (PARTITION BY database_id ORDER BY start_time) AS next_batch FROM requests)
    WHERE status = 'view' AND open_tran > 0
      AND COALESCE(next_batch - last_batch > INTERVAL 1 HOUR, TRUE)
      AND last_batch + INTERVAL 1 HOUR < (SELECT MAX(start_time) - INTERVAL 10 MINUTE FROM requests)
    """,
)
def stream_idle_transactions(t):
    sessions = t.stream("requests").withColumnsRenamed({"database_id": "session_key", "start_time": "last_batch"})
    return op.run_to_table(op.stream_idle_transactions(sessions, 3600, key="session_key", sleeping="view"))


@query(
    "id:i database_name:s command_type:s start_time:t end_time:t outcome:s duration_s:i",
    """
    SELECT id, database_name, command_type, start_time, CASE WHEN done THEN end_time END AS end_time,
      CASE WHEN NOT done THEN 'no completion' WHEN error_number = 0 THEN 'Succeeded' ELSE 'Failed' END AS outcome,
      CASE WHEN done THEN date_diff('second', start_time, end_time) END AS duration_s
    FROM (SELECT *, COALESCE(end_time <= start_time + INTERVAL 3 DAY, FALSE) AS done FROM command_log)
    WHERE done OR start_time + INTERVAL 3 DAY < (SELECT LEAST((SELECT MAX(start_time) FROM command_log), (SELECT MAX(end_time) FROM command_log)) - INTERVAL 10 MINUTE)
    """,
)
def stream_command_outcomes(t):
    log = t.stream("command_log")
    ended = t.stream("command_log").filter(F.col("end_time").isNotNull())
    return op.run_to_table(op.stream_command_outcomes(log.drop("end_time", "error_number"), ended, "3 days"))


@query(
    "database_name:s type:s last_backup:t",
    "SELECT database_name, type, MAX(backup_finish_date) AS last_backup FROM backupset GROUP BY database_name, type",
)
def stream_last_backup(t):
    return op.run_to_table(op.stream_last_backup(t.stream("backupset")), "complete")


@query(
    "backup_set_id:i database_name:s type:s backup_start_date:t",
    "SELECT DISTINCT backup_set_id, database_name, type, backup_start_date FROM backupset b JOIN backupmediafamily m ON m.media_set_id = b.media_set_id",
)
def stream_dedup_backups(t):
    media = t.backupmediafamily
    repeated = t.stream("backupset").join(media, "media_set_id")
    return op.run_to_table(op.stream_dedup_backups(repeated))


@query(
    "database_name:s type:s last_backup:t",
    "SELECT database_name, type, MAX(backup_finish_date) AS last_backup FROM backupset GROUP BY database_name, type",
)
def stream_last_backup_upserts(t):
    """The same table kept by a stream that writes only changed keys, in two runs from one checkpoint."""
    base = scratch(t.spark, "last_backup")
    log = stateful.last_backup_log(t.spark, f"{base}/table")
    for _ in range(2):
        stateful.run_upserts(stateful.last_backup_changes(t.stream("backupset")), log, f"{base}/state", "backups")
    return log.read()
