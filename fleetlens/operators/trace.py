"""Trace and event-log analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import optional
from fleetlens.functions.tsql import big, int_div, ratio
from fleetlens.sources.snapshots import name_events

# fixed values: trace event classes per report
GROWTH_CLASSES = (92, 93, 94, 95)
AUTOGROW_CLASSES = (92, 93)
SCHEMA_CLASSES = (46, 47)
SECURITY_CLASSES = (102, 103, 104, 105, 106, 108, 109, 110, 111)
RESTART_EVENT_ID = 1074


def trace_classes(trace: DataFrame, trace_events: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Events of some classes, with their names.  The filter comes before the
    name join, so it reaches the file scan."""
    return name_events(trace.filter(F.col("event_class").isin(list(classes))), trace_events)


def file_growth_events(trace: DataFrame, trace_events: DataFrame, classes: Sequence[int] = GROWTH_CLASSES) -> DataFrame:
    """File growth and shrink events with seconds taken and the change in MB."""
    return trace_classes(trace, trace_events, classes).withColumns({
        "time_taken_s": ratio("duration", 1_000_000, 10, 3),
        "change_mb": ratio(big("integer_data") * 8, 1024, 24, 12),
    })


def autogrow_events(trace: DataFrame, trace_events: DataFrame) -> DataFrame:
    """Automatic growth of data and log files."""
    return trace_classes(trace, trace_events, AUTOGROW_CLASSES).withColumns({
        "growth_mb": ratio(big("integer_data") * 8, 1024, 24, 12),
        "duration_ms": int_div("duration", 1000),
    })


def schema_changes(trace: DataFrame, trace_events: DataFrame) -> DataFrame:
    """Objects created or dropped outside tempdb (the begin event only)."""
    kept = trace.filter((F.lower("database_name") != "tempdb") & (F.col("event_subclass") == 0))
    return trace_classes(kept, trace_events, SCHEMA_CLASSES)


def security_changes(trace: DataFrame, trace_events: DataFrame) -> DataFrame:
    """Changes of logins, users, roles and permissions."""
    return trace_classes(trace, trace_events, SECURITY_CLASSES)


def failed_events(trace: DataFrame, trace_events: DataFrame, like: str = "%fail%") -> DataFrame:
    """Events whose name matches, case-insensitively."""
    return name_events(trace, trace_events.filter(F.col("name").ilike(like)))


def host_restart_events(win_events: DataFrame, event_id: int = RESTART_EVENT_ID) -> DataFrame:
    """Planned restarts from the operating-system log; details sit in the
    positional properties of the event."""
    prop = lambda n: F.get("properties", F.lit(n))
    return win_events.filter(F.col("event_id") == event_id).select(
        *optional(win_events, "server_name"),
        F.col("time_created").alias("date"), prop(6).alias("user"), prop(0).alias("process"), prop(4).alias("action"),
        prop(2).alias("reason"), prop(3).alias("reason_code"), prop(5).alias("comment"), *optional(win_events, "message"),
    )
