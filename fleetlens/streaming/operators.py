"""Live reports as Structured Streaming jobs.

Every function takes streaming frames and returns a streaming frame; watermarks
bound the state, so a job can run for months.  ``run_to_table`` drives one to
the end of the available input and gives the result back as a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import optional, shared_keys
from fleetlens.operators.trace import trace_classes
from fleetlens.session import scratch


def run_to_table(stream: DataFrame, mode: str = "append", label: str = "stream") -> DataFrame:
    """Process all available input and return what the sink holds.

    Append results go to a file sink.  Complete results replace the table of the
    last batch through ``foreachBatch``; writing the same batch again after a
    failure gives the same table.  Update mode would lose the rows that a batch
    does not touch, and is refused.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"no table can be kept from output mode {mode!r}: use append or complete")
    spark = stream.sparkSession
    base = scratch(spark, label)
    out = f"{base}/out"
    schema = stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def stream_trace_classes(stream: DataFrame, trace_events: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Named events of some classes as rollover files arrive (stream-static join)."""
    return trace_classes(stream, trace_events, classes)


def _resource_measures(stream: DataFrame, averages: Sequence[str], peaks: Sequence[str]) -> list:
    return [
        *[e for c in averages for e in (F.sum(c).alias(f"sum_{c}"), F.max(c).alias(f"max_{c}"))],
        *[F.max(c).alias(f"max_{c}") for c in peaks],
        F.count(F.lit(1)).alias("samples"),
    ]


def _windowed_resources(stream, window, delay, ts, averages, peaks) -> DataFrame:
    keys = [*optional(stream, "server_name"), "sku", "database_name"]
    return (
        stream.withWatermark(ts, delay).groupBy(window.alias("w"), *keys)
        .agg(*_resource_measures(stream, averages, peaks))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                *[(F.col(f"sum_{c}") / F.col("samples")).alias(f"mean_{c}") for c in averages],
                *[f"sum_{c}" for c in averages], *dict.fromkeys([f"max_{c}" for c in (*averages, *peaks)]), "samples")
    )


def stream_resource_tumbling(
    stream: DataFrame, width: str = "5 minutes", delay: str = "10 minutes", ts: str = "end_time",
    averages: Sequence[str] = ("avg_cpu_percent", "avg_data_io_percent"), peaks: Sequence[str] = ("storage_in_megabytes",),
) -> DataFrame:
    """Average and peak use per database and interval."""
    return _windowed_resources(stream, F.window(ts, width), delay, ts, averages, peaks)


def stream_resource_sliding(
    stream: DataFrame, width: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes", ts: str = "end_time",
    averages: Sequence[str] = ("avg_cpu_percent", "avg_data_io_percent"), peaks: Sequence[str] = ("storage_in_megabytes",),
) -> DataFrame:
    """The past ``width``, refreshed every ``slide``."""
    return _windowed_resources(stream, F.window(ts, width, slide), delay, ts, averages, peaks)


def stream_connection_failures(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Failed connections per database, subtype and interval; too late rows are dropped.

    Events of every type move the watermark, so a window closes without a further
    failure.  A filter before the count would be pushed below the watermark.
    """
    keys = [*optional(stream, "server_name"), "database_name", "event_subtype"]
    return (
        stream.withWatermark("start_time", delay)
        .groupBy(F.window("start_time", width).alias("w"), *keys)
        .agg(F.count_if(F.col("event_type") == "connection_failed").alias("failures"))
        .filter("failures > 0")
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "failures")
    )


def stream_session_activity(stream: DataFrame, gap: str = "120 seconds", delay: str = "10 minutes", ts: str = "start_time", key: str = "session_id") -> DataFrame:
    """Periods of activity per session, closed by a silence of ``gap``."""
    keys = [*optional(stream, "server_name"), key]
    return (
        stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("batches"))
        .select(*keys, F.col("w.start").alias("active_from"), F.col("w.end").alias("active_until"), "batches")
    )


def stream_idle_transactions(
    stream: DataFrame, idle_seconds: int = 120, delay: str = "10 minutes", key: str = "session_id", sleeping: str = "sleeping",
) -> DataFrame:
    """Each silence of a session that is longer than ``idle_seconds`` while it
    sleeps in an open transaction, reported once.

    A session window closes exactly when no batch came for that long; the last
    batch of the window tells whether a transaction was left open.  Windows merge
    before and after the shuffle, so a busy session needs no per-key buffer.
    """
    keys = [*optional(stream, "server_name"), key]
    # one microsecond more: a batch after exactly the limit still counts as in time
    gap = f"{int(idle_seconds)} seconds 1 microsecond"
    last = F.max_by(F.struct("status", "open_tran"), F.struct("last_batch", "open_tran", "status"))
    closed = (
        stream.select(*keys, "last_batch", "status", "open_tran").withWatermark("last_batch", delay)
        .groupBy(F.session_window("last_batch", gap).alias("w"), *keys)
        .agg(last.alias("final"), F.max("last_batch").alias("idle_since"))
    )
    return closed.filter((F.col("final.status") == sleeping) & (F.col("final.open_tran") > 0)).select(
        *keys, "idle_since", (F.col("idle_since") + F.expr(f"interval {int(idle_seconds)} seconds")).alias("idle_until")
    )


def stream_command_outcomes(started: DataFrame, completed: DataFrame, max_runtime: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Start rows with their completion, or 'no completion' after ``max_runtime``."""
    k = [*shared_keys(started, completed), "id"]
    left = started.withWatermark("start_time", delay).alias("s")
    right = completed.select(
        *[F.col(c).alias(f"c_{c}") for c in k], F.col("end_time").alias("c_end_time"), F.col("error_number").alias("c_error")
    ).withWatermark("c_end_time", delay)
    cond = [F.col(f"s.{c}") == F.col(f"c_{c}") for c in k]
    in_time = F.expr(f"c_end_time >= start_time AND c_end_time <= start_time + interval {max_runtime}")
    for c in cond:
        in_time = in_time & c
    outcome = (
        F.when(F.col("c_end_time").isNull(), F.lit("no completion")).when(F.col("c_error") == 0, F.lit("Succeeded")).otherwise(F.lit("Failed"))
    )
    return left.join(right, in_time, "left_outer").select(
        *k, *optional(started, "database_name", "command_type"), "start_time", F.col("c_end_time").alias("end_time"),
        outcome.alias("outcome"), F.timestamp_diff("SECOND", F.col("start_time"), F.col("c_end_time")).alias("duration_s"),
    )


def stream_last_backup(stream: DataFrame) -> DataFrame:
    """Running last backup per database and type (update or complete mode)."""
    keys = [*optional(stream, "server_name"), "database_name", "type"]
    return stream.groupBy(*keys).agg(F.max("backup_finish_date").alias("last_backup"))


def stream_dedup_backups(stream: DataFrame, delay: str = "1 day", ts: str = "backup_start_date") -> DataFrame:
    """One row per backup set although every media device repeats it."""
    keys = [*optional(stream, "server_name"), "backup_set_id"]
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
