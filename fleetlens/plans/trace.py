"""Queries over trace and event-log rows."""

from pyspark.sql import functions as F

from fleetlens.operators import trace as op
from fleetlens.plans.registry import check_ratio, query

_JOIN = "FROM trace t JOIN trace_events e ON e.trace_event_id = t.event_class"


@query(
    "event_id:i database_name:s event_name:s start_time:t time_taken_s:d change_mb:d",
    f"""
    SELECT t.event_id, database_name, e.name AS event_name, start_time, {check_ratio('duration', '1000000', 3)} AS time_taken_s,
      integer_data * 8 / 1024.0 AS change_mb {_JOIN} WHERE trace_event_id BETWEEN 92 AND 95
    """,
)
def file_growth_events(t):
    return op.file_growth_events(t.trace, t.trace_events)


@query(
    "event_id:i database_name:s event_name:s start_time:t growth_mb:d duration_ms:i",
    f"""
    SELECT t.event_id, database_name, e.name AS event_name, start_time, integer_data * 8 / 1024.0 AS growth_mb, duration // 1000 AS duration_ms
    {_JOIN} WHERE event_class IN (92, 93)
    """,
)
def autogrow_events(t):
    return op.autogrow_events(t.trace, t.trace_events)


@query(
    "event_id:i database_name:s event_name:s start_time:t spid:i",
    f"SELECT t.event_id, database_name, e.name AS event_name, start_time, spid {_JOIN} WHERE event_class IN (46, 47) AND event_subclass = 0 AND database_name <> 'tempdb'",
)
def schema_changes(t):
    return op.schema_changes(t.trace, t.trace_events)


@query(
    "event_id:i database_name:s event_name:s start_time:t spid:i",
    f"SELECT t.event_id, database_name, e.name AS event_name, start_time, spid {_JOIN} WHERE event_class IN (102, 103, 104, 105, 106, 108, 109, 110, 111)",
)
def security_changes(t):
    return op.security_changes(t.trace, t.trace_events)


@query(
    "event_id:i database_name:s event_name:s start_time:t spid:i",
    f"SELECT t.event_id, database_name, e.name AS event_name, start_time, spid {_JOIN} WHERE lower(e.name) LIKE '%fail%'",
)
def failed_events(t):
    return op.failed_events(t.trace, t.trace_events)


@query(
    "date:t user:s process:s action:s reason:s reason_code:s comment:s",
    """SELECT time_created AS date, p6 AS "user", p0 AS process, p4 AS action, p2 AS reason, p3 AS reason_code, p5 AS comment
    FROM win_events WHERE event_id = 1074""",
)
def host_restart_events(t):
    return op.host_restart_events(t.win_events.withColumn("properties", F.array(*[f"p{n}" for n in range(7)])))
