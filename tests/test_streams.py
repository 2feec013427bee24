"""Streaming rules on hand-made files: late rows, silences, missing completions."""

import datetime as dt

from pyspark.sql import functions as F

from fleetlens.streaming import operators as op

T0 = dt.datetime(2024, 1, 1)
at = lambda **kw: T0 + dt.timedelta(**kw)


def stream_of(spark, tmp_path, batches, schema, name="in"):
    """One file per batch, read one at a time in order."""
    path = str(tmp_path / name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    schema = "database_name string, start_time timestamp, event_type string, event_subtype int"
    fail = lambda t: ("d", t, "connection_failed", 4)
    batches = [[fail(at(minutes=5)), fail(at(minutes=6))], [fail(at(hours=5))], [fail(at(hours=5, minutes=30))], [fail(at(minutes=7)), fail(at(hours=9))]]
    got = op.run_to_table(op.stream_connection_failures(stream_of(spark, tmp_path, batches, schema)))
    assert rows(got, "window_start", "failures") == [(at(), 2), (at(hours=5), 2)]


def test_idle_transaction_is_reported_once(spark, tmp_path):
    schema = "session_id int, last_batch timestamp, status string, open_tran int"
    batches = [
        [(1, at(), "sleeping", 1), (2, at(), "sleeping", 0), (3, at(), "running", 1), (4, at(), "sleeping", 1)],
        [(4, at(seconds=120), "sleeping", 0), (1, at(minutes=30), "sleeping", 1)],
        [(9, at(hours=3), "running", 0)],
        [(9, at(hours=4), "running", 0)],
    ]
    got = op.run_to_table(op.stream_idle_transactions(stream_of(spark, tmp_path, batches, schema)))
    assert rows(got, "session_id", "idle_since") == [(1, at()), (1, at(minutes=30))]


def test_session_closes_after_silence(spark, tmp_path):
    schema = "session_id int, start_time timestamp"
    batches = [[(1, at()), (1, at(seconds=100)), (1, at(seconds=300))], [(2, at(hours=1))], [(2, at(hours=2))]]
    got = op.run_to_table(op.stream_session_activity(stream_of(spark, tmp_path, batches, schema)))
    assert rows(got.filter("session_id = 1"), "active_from", "batches") == [(at(), 2), (at(seconds=300), 1)]


def test_command_without_completion(spark, tmp_path):
    start = [[(1, at()), (2, at())], [(3, at(days=5))], [(4, at(days=9))]]
    end = [[(1, at(hours=1), 0)], [(2, at(days=2), 50)], [(9, at(days=9), 0)]]
    started = stream_of(spark, tmp_path, start, "id int, start_time timestamp", "s")
    completed = stream_of(spark, tmp_path, end, "id int, end_time timestamp, error_number int", "e")
    got = op.run_to_table(op.stream_command_outcomes(started, completed, "1 day"))
    assert rows(got.filter("id < 3"), "id", "outcome", "duration_s") == [(1, "Succeeded", 3600), (2, "no completion", None)]


def test_repeated_backup_sets_are_dropped(spark, tmp_path):
    schema = "backup_set_id int, backup_start_date timestamp, device string"
    batches = [[(1, at(), "a"), (1, at(), "b"), (2, at(hours=1), "a")], [(1, at(), "c")]]
    got = op.run_to_table(op.stream_dedup_backups(stream_of(spark, tmp_path, batches, schema)))
    assert rows(got, "backup_set_id") == [(1,), (2,)]


def test_last_backup_keeps_the_latest(spark, tmp_path):
    schema = "database_name string, type string, backup_finish_date timestamp"
    batches = [[("a", "D", at(hours=1)), ("a", "D", at())], [("a", "D", at(hours=3)), ("b", "L", at())]]
    got = op.run_to_table(op.stream_last_backup(stream_of(spark, tmp_path, batches, schema)), "complete")
    assert rows(got, "database_name", "last_backup") == [("a", at(hours=3)), ("b", at())]


def test_events_of_other_types_close_a_window(spark, tmp_path):
    schema = "database_name string, start_time timestamp, event_type string, event_subtype int"
    batches = [[("d", at(minutes=5), "connection_failed", 4)], [("d", at(hours=5), "connection_successful", 0)]]
    got = op.run_to_table(op.stream_connection_failures(stream_of(spark, tmp_path, batches, schema)))
    assert rows(got, "window_start", "failures") == [(at(), 1)]


RESOURCES = "sku string, database_name string, end_time timestamp, cpu long, mb long"


def test_closed_sliding_windows_equal_batch(spark, tmp_path):
    data = [("s", "d", at(minutes=7 * n), n, n) for n in range(40)]
    stream = stream_of(spark, tmp_path, [data[:20], data[20:]], RESOURCES)
    got = op.run_to_table(op.stream_resource_sliding(stream, averages=("cpu",), peaks=("mb",)))
    batch = spark.createDataFrame(data, RESOURCES).groupBy(F.window("end_time", "1 hour", "15 minutes").alias("w")).agg(F.sum("cpu").alias("s"), F.max("mb").alias("m"))
    closed = batch.filter(F.col("w.end") <= F.lit(at(minutes=7 * 39 - 10)))
    assert rows(got, "window_start", "sum_cpu", "max_mb") == rows(closed, "w.start", "s", "m")


def test_closed_windows_leave_the_state(spark, tmp_path):
    batches = [[("s", "d", at(hours=2 * n, minutes=m), n, n) for m in (0, 30)] for n in range(8)]
    live = op.stream_resource_sliding(stream_of(spark, tmp_path, batches, RESOURCES), averages=("cpu",), peaks=("mb",))
    run = live.writeStream.outputMode("append").format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    # six windows a batch: what is held does not add up
    assert len(held) >= 8 and max(held) <= 12 and held[-1] <= 6
