"""The merged-on-read log: merging, compaction, a writer that dies, commits that collide, streams that go on."""

import time

import pytest
from pyspark.sql import functions as F

from fleetlens.sources import keyed_log
from fleetlens.streaming import stateful


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def commands(spark, first, last):
    return spark.range(first, last).selectExpr(
        "id", "concat('db', id % 3) as database_name", "'x' as command_type", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as start_time",
        "timestamp_ntz'2024-01-02 00:00:00' as end_time", "id % 2 as error_number",
    )


def merged(spark, n, done):
    own = commands(spark, 0, n)
    return rows(own.select("id", "database_name", "start_time", *[F.when(F.col("id").isin(*done), F.col(c)).alias(c) for c in ("end_time", "error_number")]))


COLUMNS = ["id", "database_name", "start_time", "end_time", "error_number"]


def test_start_and_completion_are_one_row(spark, tmp_path):
    log = keyed_log.command_log(spark, str(tmp_path / "log"), 4)
    assert log.read().count() == 0 and log.compact() == 0
    keyed_log.log_started(log, commands(spark, 0, 40))
    keyed_log.log_completed(log, commands(spark, 0, 40).where("id < 10"))
    assert rows(log.read(), *COLUMNS) == merged(spark, 40, range(10))
    assert log.compact() == 4 and rows(log.read(), *COLUMNS) == merged(spark, 40, range(10))
    # a completion may come before its start; one row touches one bucket only
    keyed_log.log_completed(log, commands(spark, 40, 41))
    before = log.state()["base"]
    assert log.compact() == 1 and sum(log.state()["base"][b] != n for b, n in before.items()) == 1
    keyed_log.log_started(log, commands(spark, 40, 41))
    assert rows(log.read(), *COLUMNS) == merged(spark, 41, [*range(10), 40])
    log.append(spark.createDataFrame([(None, "n", 2), (None, None, 3)], "id long, database_name string, step int"))
    assert rows(log.read().where("id IS NULL"), "database_name") == [("n",)]
    log.append(commands(spark, 0, 0))
    assert log.read().count() == 42


def test_a_writer_that_dies_loses_nothing(spark, tmp_path):
    class Killed(BaseException):
        pass

    def die():
        raise Killed

    log = keyed_log.command_log(spark, str(tmp_path / "log"), 4)
    keyed_log.log_started(log, commands(spark, 0, 30))
    log.compact()
    keyed_log.log_completed(log, commands(spark, 0, 30).where("id < 7"))
    state = log.state()
    with pytest.raises(Killed):
        log.compact(before_swap=die)
    again = keyed_log.command_log(spark, str(tmp_path / "log"), 4)  # another process
    assert again.state() == state and rows(again.read(), *COLUMNS) == merged(spark, 30, range(7))
    assert len(again.unlisted()) == 2  # the started rows before their compaction, and the dead job's
    assert again.compact() == 4 and rows(again.read(), *COLUMNS) == merged(spark, 30, range(7))


def test_rows_that_come_during_a_compaction_stay(spark, tmp_path):
    log = keyed_log.command_log(spark, str(tmp_path / "log"), 4)
    keyed_log.log_started(log, commands(spark, 0, 20))
    other = keyed_log.command_log(spark, str(tmp_path / "log"), 4)
    log.compact(before_swap=lambda: keyed_log.log_completed(other, commands(spark, 0, 20).where("id < 5")) and None)
    assert len(log.state()["deltas"]) == 1 and rows(log.read(), *COLUMNS) == merged(spark, 20, range(5))
    with pytest.raises(RuntimeError):
        log.compact(before_swap=lambda: other.compact() and None)
    assert rows(log.read(), *COLUMNS) == merged(spark, 20, range(5))
    with pytest.raises(keyed_log.CommitTaken):
        log._commit(log.state(), log.state()["number"])


BACKUPS = "database_name string, type string, backup_finish_date timestamp_ntz"


def test_only_changed_keys_are_written(spark, tmp_path):
    day = "timestamp_ntz'2024-01-01' + make_interval(0,0,0,{}) as backup_finish_date"
    source, log = str(tmp_path / "in"), stateful.last_backup_log(spark, str(tmp_path / "log"), buckets=4)
    put = lambda *parts: [p.write.mode("append").parquet(source) for p in parts]
    base = spark.range(12).selectExpr("concat('db', id % 4) as database_name", "case id % 3 when 0 then 'D' else 'L' end as type", day.format("cast(id as int)")).coalesce(1)
    put(base)

    def run():
        stream = spark.readStream.schema(BACKUPS).option("maxFilesPerTrigger", 1).parquet(source)
        stateful.run_upserts(stateful.last_backup_changes(stream), log, str(tmp_path / "checkpoint"), "backups")

    def batch():
        return rows(spark.read.schema(BACKUPS).parquet(source).groupBy("database_name", "type").agg(F.max("backup_finish_date").alias("last_backup")))

    run()
    assert rows(log.read().drop("batch")) == batch()
    written = lambda n: rows(spark.read.parquet(f"{log.path}/data/rows={log.state()['deltas'][n]}"), "database_name", "type")
    assert len(written(0)) == 8
    # restarted: one key moves on, one row is older, one has no date
    put(spark.sql(f"SELECT 'db1' AS database_name, 'D' AS type, {day.format(90)}").union(spark.sql(f"SELECT 'db2', 'L', {day.format(-5)}")).union(spark.sql("SELECT 'db9', 'L', NULL")).coalesce(1))
    run()
    assert written(1) == [("db1", "D")] and rows(log.read().drop("batch")) == [r for r in batch() if r[2] is not None]
    assert 1 <= log.compact() <= 4 and rows(log.read().drop("batch")) == [r for r in batch() if r[2] is not None]
    # the same batch again changes nothing
    assert not log.append(base.select("database_name", "type"), "backups", 1)


def test_silence_is_told_without_further_events(spark, tmp_path):
    """Nothing arrives after the first file, and still the idle session is reported once."""
    source = str(tmp_path / "in")
    sessions = [(1, "sleeping", 1), (2, "sleeping", 0), (3, "running", 1)]
    made = spark.createDataFrame(sessions, "session_id long, status string, open_tran int").withColumn("last_batch", F.expr("timestamp_ntz'2024-01-01 10:00:00'"))
    made.coalesce(1).write.parquet(source)
    told = []
    stream = spark.readStream.schema(made.schema).parquet(source)
    query = stateful.watch(stateful.idle_transactions_now(stream, 2), str(tmp_path / "checkpoint"), lambda df, n: told.extend(df.collect()), "500 milliseconds")
    try:
        end = time.time() + 60
        while not told and time.time() < end:
            time.sleep(0.5)
        time.sleep(3)
    finally:
        query.stop()
    assert [r["session_id"] for r in told] == [1] and str(told[0]["idle_since"]) == "2024-01-01 10:00:00"


def test_last_backups_need_no_python_per_key(spark, tmp_path):
    """Keys are compared by the aggregate itself: equal and older times of a later batch give nothing out."""
    source, log = str(tmp_path / "in"), stateful.last_backup_log(spark, str(tmp_path / "log"), buckets=4)
    stream = lambda: spark.readStream.schema(BACKUPS).parquet(source)
    put = lambda n: spark.sql(f"SELECT 'a' AS database_name, t AS type, timestamp_ntz'2024-01-01' + make_interval(0,0,0,{n}) AS backup_finish_date FROM VALUES ('D'), (NULL) v(t)").coalesce(1).write.mode("append").parquet(source)
    for n in (5, 5, 3, 6):
        put(n)
        stateful.run_upserts(stateful.last_backup_changes(stream()), log, str(tmp_path / "checkpoint"), "backups")
    sizes = [spark.read.schema(log.schema).parquet(f"{log.path}/data/rows={d}").count() for d in log.state()["deltas"]]
    assert sizes[0] == sizes[-1] == 2 and sum(sizes) == 4
    assert rows(log.read(), "type", "last_backup") == rows(spark.read.schema(BACKUPS).parquet(source).groupBy("type").agg(F.max("backup_finish_date").alias("last_backup")), "type", "last_backup")
    assert "Pandas" not in stateful.last_backup_changes(stream())._jdf.queryExecution().analyzed().toString()
