"""Streams that keep their own state by key: reports that change row by row, and silence in time.

State lies in the RocksDB store of the stream, one small value a key; a batch touches the
keys that it has rows of, and writes only rows that changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from fleetlens.functions.fleet import optional
from fleetlens.sources.keyed_log import KeyedLog, upsert_sink

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_backup_changes(stream: DataFrame) -> DataFrame:
    """The last backup per database and type, a row whenever it changes (update mode).

    Backups without a finish date say nothing; of late ones only those later than all before count.
    The state of a key is its greatest time with the clock of the batch that brought it, the first
    of equal ones; a key whose time did not grow keeps an earlier clock and is not given out."""
    keys = [*optional(stream, "server_name"), "database_name", "type"]
    now = F.unix_micros(F.current_timestamp())  # one value a batch, kept when a batch is run again
    value = F.unix_micros(F.col("backup_finish_date").cast("timestamp"))
    rows = stream.select(*keys, F.struct(value.alias("value_us"), (-now).alias("since")).alias("_last")).where("_last.value_us IS NOT NULL")
    grown = rows.groupBy(*keys).agg(F.max("_last").alias("_last")).where(F.col("_last.since") == -now)
    return grown.select(*keys, F.timestamp_micros("_last.value_us").cast("timestamp_ntz").alias("last_backup"))


def last_backup_log(spark: SparkSession, path: str, with_server: bool = False, buckets: int = 16) -> KeyedLog:
    """The table that :func:`last_backup_changes` is kept in."""
    keys = [*(["server_name"] if with_server else []), "database_name", "type"]
    return KeyedLog(spark, path, ", ".join([*[f"{c} string" for c in keys], "last_backup timestamp_ntz", "batch long"]), keys, "batch", buckets)


def run_upserts(changes: DataFrame, log: KeyedLog, checkpoint: str, writer: str) -> None:
    """Run a stream over the input there is, each micro-batch one commit of ``log``.

    A batch that is run again after a failure is not added twice."""
    _started(changes, checkpoint, upsert_sink(log, writer), availableNow=True).awaitTermination()


def _started(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(**trigger).start()
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


class _Silence(StatefulProcessor):
    """Tells once that a key has been silent for a while after a row that left it open."""

    def __init__(self, names: list[str], wait_ms: int):
        self.names, self.wait_ms = names, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("last", "at long, open boolean, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, still, due = self.kept.get() if self.kept.exists() else (-1, False, -1)
        for part in rows:
            latest = part.sort_values(["at_us", "is_open"]).iloc[-1]
            if int(latest["at_us"]) >= at:
                at, still = int(latest["at_us"]), bool(latest["is_open"])
        if due >= 0:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms if still else -1
        if due >= 0:
            self.handle.registerTimer(due)
        self.kept.update((at, still, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, _, due = self.kept.get()
        if due == expiredTimerInfo.getExpiryTimeInMs():
            self.kept.update((at, False, -1))
            yield pd.DataFrame({**{n: [k] for n, k in zip(self.names, key)}, "at_us": [at], "told_ms": [due]})

    def close(self) -> None:
        pass


def idle_transactions_now(stream: DataFrame, idle_seconds: float = 120, key: str = "session_id", sleeping: str = "sleeping") -> DataFrame:
    """Sessions that sleep in an open transaction, as soon as nothing came from them for ``idle_seconds``.

    The clock decides, not later events: a session is told although the whole source is silent.
    Each silence is told once; a new batch starts the wait anew.  Rows with a null time are ignored.
    Update mode with a processing-time trigger."""
    keys = [*optional(stream, "server_name"), key]
    rows = stream.where(F.col("last_batch").isNotNull()).select(
        *keys, F.unix_micros(F.col("last_batch").cast("timestamp")).alias("at_us"),
        F.coalesce((F.col("status") == sleeping) & (F.col("open_tran") > 0), F.lit(False)).alias("is_open"),
    )
    shape = T.StructType([*[rows.schema[c] for c in keys], T.StructField("at_us", T.LongType()), T.StructField("told_ms", T.LongType())])
    told = rows.groupBy(*keys).transformWithStateInPandas(_Silence(keys, int(idle_seconds * 1000)), shape, "Update", "ProcessingTime")
    return told.select(*keys, F.timestamp_micros("at_us").cast("timestamp_ntz").alias("idle_since"), F.timestamp_millis("told_ms").cast("timestamp_ntz").alias("told_at"))


def watch(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str = "5 seconds") -> StreamingQuery:
    """Run a stateful stream until it is stopped."""
    return _started(stream, checkpoint, sink, processingTime=every)
