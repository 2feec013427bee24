"""Waits, sessions, requests, locks and resource use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.fleet import DATABASE, existing, has, optional, shared_keys
from fleetlens.functions.ordering import running_totals
from fleetlens.functions.tsql import big, int_div, ratio
from fleetlens.operators.catalog import sql_text_lookup, statement_text

# fixed values: wait types that are almost never a problem
BENIGN_WAITS = (
    "HADR_FABRIC_CALLBACK", "PREEMPTIVE_XE_DISPATCHER", "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR",
    "BROKER_TASK_STOP", "BROKER_TO_FLUSH", "BROKER_TRANSMITTER", "CHECKPOINT_QUEUE", "CHKPT", "CLR_AUTO_EVENT",
    "CLR_MANUAL_EVENT", "CLR_SEMAPHORE", "CXCONSUMER", "DBMIRROR_DBM_EVENT", "DBMIRROR_EVENTS_QUEUE",
    "DBMIRROR_WORKER_QUEUE", "DBMIRRORING_CMD", "DIRTY_PAGE_POLL", "DISPATCHER_QUEUE_SEMAPHORE", "EXECSYNC",
    "FSAGENT", "FT_IFTS_SCHEDULER_IDLE_WAIT", "FT_IFTSHC_MUTEX", "HADR_CLUSAPI_CALL",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_LOGCAPTURE_WAIT", "HADR_NOTIFICATION_DEQUEUE", "HADR_TIMER_TASK",
    "HADR_WORK_QUEUE", "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE", "MEMORY_ALLOCATION_EXT",
    "ONDEMAND_TASK_QUEUE", "PARALLEL_REDO_DRAIN_WORKER", "PARALLEL_REDO_LOG_CACHE", "PARALLEL_REDO_TRAN_LIST",
    "PARALLEL_REDO_WORKER_SYNC", "PARALLEL_REDO_WORKER_WAIT_WORK", "PREEMPTIVE_OS_FLUSHFILEBUFFERS",
    "PREEMPTIVE_XE_GETTARGETSTATE", "PVS_PREALLOCATE", "PWAIT_ALL_COMPONENTS_INITIALIZED",
    "PWAIT_DIRECTLOGCONSUMER_GETNEXT", "PWAIT_EXTENSIBILITY_CLEANUP_TASK", "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP",
    "QDS_ASYNC_QUEUE", "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP", "QDS_SHUTDOWN_QUEUE",
    "REDO_THREAD_PENDING_WORK", "REQUEST_FOR_DEADLOCK_SEARCH", "RESOURCE_QUEUE", "SERVER_IDLE_CHECK",
    "SLEEP_BPOOL_FLUSH", "SLEEP_DBSTARTUP", "SLEEP_DCOMSTARTUP", "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY",
    "SLEEP_MASTERUPGRADED", "SLEEP_MSDBSTARTUP", "SLEEP_SYSTEMTASK", "SLEEP_TASK", "SLEEP_TEMPDBSTARTUP",
    "SNI_HTTP_ACCEPT", "SOS_WORK_DISPATCHER", "SP_SERVER_DIAGNOSTICS_SLEEP", "SQLTRACE_BUFFER_FLUSH",
    "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "SQLTRACE_WAIT_ENTRIES", "VDI_CLIENT_OTHER", "WAIT_FOR_RESULTS", "WAITFOR",
    "WAITFOR_TASKSHUTDOWN", "WAIT_XTP_RECOVERY", "WAIT_XTP_HOST_WAIT", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG",
    "WAIT_XTP_CKPT_CLOSE", "XE_DISPATCHER_JOIN", "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT",
)
WAIT_HELP_URL = "https://www.sqlskills.com/help/waits/"


def _pareto(df: DataFrame, keys: list[str], name: str, threshold: float) -> DataFrame:
    """Head of the ranking by wait time: a row stays while the share summed over
    the rows before it is below ``threshold`` percent.

    Compared on whole numbers (``100 * before < threshold * total``), so there is
    no rounding at the cut.  Equal wait times are ordered by name.
    """
    ranked = running_totals(df, keys, [F.col("wait_time_ms").desc(), F.col(name)], F.col("wait_time_ms"))
    return ranked.filter(F.col("sum_before") * 100 < F.col("sum_total") * F.lit(threshold).cast("decimal(9,4)"))


def wait_pareto(
    waits: DataFrame, ignore: DataFrame | Sequence[str] = BENIGN_WAITS, threshold: float = 95
) -> DataFrame:
    """The wait types that make up most of the wait time of each server."""
    k = shared_keys(waits)
    real = waits.filter(F.col("waiting_tasks_count") > 0)
    if isinstance(ignore, DataFrame):
        keys = [*shared_keys(real, ignore), "wait_type"]
        real = real.join(existing(ignore, keys), keys, "left_anti")
    else:
        real = real.filter(~F.col("wait_type").isin(list(ignore)))
    total, signal = big("wait_time_ms"), big("signal_wait_time_ms")
    count = big("waiting_tasks_count")
    return _pareto(real, k, "wait_type", threshold).select(
        *k, "wait_type",
        ratio(total, 1000, 16, 2).alias("wait_s"),
        ratio(total - signal, 1000, 16, 2).alias("resource_s"),
        ratio(signal, 1000, 16, 2).alias("signal_s"),
        count.alias("wait_count"),
        ratio(total * 100, "sum_total", 5, 2).alias("percentage"),
        ratio(total, count * 1000, 16, 4).alias("avg_wait_s"),
        ratio(total - signal, count * 1000, 16, 4).alias("avg_res_s"),
        ratio(signal, count * 1000, 16, 4).alias("avg_sig_s"),
        F.concat(F.lit(WAIT_HELP_URL), "wait_type").alias("help_url"),
    )


def latch_pareto(latches: DataFrame, exclude: Sequence[str] = ("BUFFER",), threshold: float = 95) -> DataFrame:
    """The same cut over latch classes; a class without waits has no average."""
    k = shared_keys(latches)
    ranked = _pareto(latches.filter(~F.col("latch_class").isin(list(exclude))), k, "latch_class", threshold)
    total, count = big("wait_time_ms"), big("waiting_requests_count")
    return ranked.select(
        *k, "latch_class",
        ratio(total, 1000, 14, 2).alias("wait_s"), count.alias("wait_count"),
        ratio(total * 100, "sum_total", 14, 2).alias("percentage"),
        ratio(total, count * 1000, 14, 4).alias("avg_wait_s"),
    )


def waits_now(
    waiting_tasks: DataFrame, tasks: DataFrame, sessions: DataFrame, requests: DataFrame, sql_text: DataFrame,
    plans: DataFrame | None = None,
) -> DataFrame:
    """User tasks that wait right now, with scheduler, statement and plan.

    For parallelism waits the node id is the text after the last ``=`` of the
    resource description.
    """
    k = shared_keys(waiting_tasks, tasks, sessions, requests)
    node = F.when(F.col("wait_type") == "CXPACKET", F.substring_index("resource_description", "=", -1))
    out = (
        waiting_tasks.join(
            tasks.select(*k, F.col("task_address").alias("waiting_task_address"), "scheduler_id"), [*k, "waiting_task_address"]
        )
        .join(sessions.filter(F.col("is_user_process") == 1).select(*k, "session_id"), [*k, "session_id"], "left_semi")
        .join(requests.select(*k, "session_id", "sql_handle", "database_id", "cpu_time", *optional(requests, "plan_handle")), [*k, "session_id"])
        .withColumn("node_id", node)
    )
    out = sql_text_lookup(out, sql_text, outer=True)
    if plans is not None and has(out, "plan_handle"):
        kp = [*shared_keys(out, common=plans), "plan_handle"]
        # a plan is long text, of which the optimizer knows no size: merged, as statements are
        out = out.join(plans.select(*kp, "query_plan").hint("merge"), kp, "left")
    return out


def head_blockers(requests: DataFrame, sql_text: DataFrame, top: int = 10) -> DataFrame:
    """Requests that block others and are not blocked, longest first per server."""
    k = shared_keys(requests)
    blockers = requests.filter(F.col("blocking_session_id") != 0).select(*k, F.col("blocking_session_id").alias("session_id")).distinct()
    heads = requests.filter(F.col("blocking_session_id") == 0).join(blockers, [*k, "session_id"], "left_semi").distinct()
    # the ranking needs no statement text, so only the survivors fetch it
    if not k:
        known = heads.join(sql_text.select("sql_handle"), "sql_handle", "left_semi")
        best = known.orderBy(F.col("total_elapsed_time").desc(), F.col("session_id")).limit(top)
    else:
        kt = [*shared_keys(heads, common=sql_text), "sql_handle"]
        known = heads.join(sql_text.select(*kt), kt, "left_semi")
        w = Window.partitionBy(*k).orderBy(F.col("total_elapsed_time").desc(), F.col("session_id"))
        best = known.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")
    return sql_text_lookup(best, sql_text, few=True)


def running_requests(requests: DataFrame, sql_text: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Current requests: elapsed, CPU and wait time with the running statement."""
    wait = big("total_elapsed_time") - big("cpu_time")
    out = sql_text_lookup(requests, sql_text).withColumns({
        "wait_time": wait,
        "statement_text": statement_text("text", "statement_start_offset", "statement_end_offset", max_chars),
    })
    return out.drop("text")


def query_stats_averages(query_stats: DataFrame, sql_text: DataFrame, text_prefix: str | None = None) -> DataFrame:
    """Truncated per-execution averages of cached statements, times in ms."""
    if text_prefix:
        sql_text = sql_text.filter(F.col("text").startswith(text_prefix))
    n = big("execution_count")
    elapsed, cpu = int_div("total_elapsed_time", 1000), int_div("total_worker_time", 1000)
    out = {
        "avg_elapsed_time": int_div(elapsed, n),
        "avg_cpu_time": int_div(cpu, n),
        "avg_wait_time": int_div(elapsed, n) - int_div(cpu, n),
        "avg_logical_reads": int_div("total_logical_reads", n),
        "cumulative_elapsed_time": elapsed,
    }
    if has(query_stats, "total_logical_writes"):
        out["avg_writes"] = int_div("total_logical_writes", n)
    return sql_text_lookup(query_stats, sql_text).withColumns(out)


def top_queries_by_cpu(query_stats: DataFrame, sql_text: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` statements with the highest average CPU time per server."""
    k = shared_keys(query_stats)
    costed = query_stats.withColumn("avg_cpu_time", int_div("total_worker_time", "execution_count"))
    kt = [*shared_keys(costed, common=sql_text), "sql_handle"]
    known = costed.join(sql_text.select(*kt), kt, "left_semi")
    order = [F.col("avg_cpu_time").desc(), F.col("plan_handle")]
    if k:
        w = Window.partitionBy(*k).orderBy(*order)
        best = known.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    else:
        best = known.orderBy(*order).limit(n)
    out = sql_text_lookup(best, sql_text, few=True)
    if has(out, "statement_start_offset", "statement_end_offset"):
        return out.withColumn("statement_text", statement_text("text", "statement_start_offset", "statement_end_offset")).drop("text")
    return out.withColumnRenamed("text", "statement_text")


def idle_open_transactions(
    sessions: DataFrame, idle_seconds: int = 120, min_session_id: int = 50, *, as_of, sleeping: str = "sleeping"
) -> DataFrame:
    """Sleeping sessions that hold a transaction and ran nothing for a while."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(idle_seconds)} seconds")
    return sessions.filter(
        (F.col("session_id") > min_session_id) & (F.col("status") == sleeping)
        & (F.col("open_tran") > 0) & (F.col("last_batch") < limit)
    )


# fixed values: commands with a completion estimate
PROGRESS_COMMANDS = (
    "DbccFilesCompact", "DBCC", "BACKUP LOG", "BACKUP DATABASE", "RESTORE DATABASE", "RESTORE HEADERONLY",
    "DBCC TABLE CHECK", "DBCC TABLE REPAIR", "UPDATE STATISTICS", "CREATE INDEX", "ALTER TABLE",
)


def operation_progress(requests: DataFrame, sql_text: DataFrame, commands: Sequence[str] = PROGRESS_COMMANDS, *, as_of) -> DataFrame:
    """Long maintenance commands with their estimated completion time."""
    seconds = int_div("estimated_completion_time", 1000)
    eta = F.timestamp_add("SECOND", seconds.cast("int"), F.lit(as_of).cast("timestamp_ntz"))
    chosen = requests.filter(F.col("command").isin(list(commands)))
    return sql_text_lookup(chosen, sql_text).withColumn("estimated_completion", eta)


def lock_summary(
    lock_info: DataFrame, code_dim: DataFrame, sessions: DataFrame, objects: DataFrame, indexes: DataFrame,
    spids: Sequence[int] | None = None, width: int | None = None,
) -> DataFrame:
    """Locks per session and resource with decoded type, mode and status, as whole texts
    unless ``width`` limits them.  Names come from the database of the lock: where the
    catalogs carry ``database_name``, the locks must too (``with_database_name``).

    ``code_dim`` (type, number, name) holds one short list per kind: LR resource
    types, LS states, L modes (stored one higher).  Locks are counted on their
    raw codes first, so names are looked up once per group.
    """
    k = shared_keys(lock_info, sessions, objects, indexes)
    kd = shared_keys(lock_info, objects, indexes, scope=DATABASE)
    shown = (lambda c: F.col(c)) if width is None else (lambda c: F.left(c, F.lit(width)))
    locks = lock_info if spids is None else lock_info.filter(F.col("session_id").isin(list(spids)))
    raw = [*dict.fromkeys([*k, *kd]), "session_id", "database_id", "object_id", "index_id", *optional(lock_info, "resource"),
           "rsc_type", "req_mode", "req_status"]
    counted = locks.groupBy(*raw).agg(F.count(F.lit(1)).alias("lock_count"))

    kc = shared_keys(lock_info, common=code_dim)

    def codes(kind: str, key: str, name: str, shift: int = 0) -> DataFrame:
        return code_dim.filter(F.col("type") == kind).select(
            *kc, (F.col("number") - shift).alias(key), shown("name").alias(name)
        )

    who = sessions.select(*k, "session_id", shown("login_name").alias("login_name"), shown("host_name").alias("host_name"))
    return (
        counted.join(codes("LR", "rsc_type", "lock_type"), [*kc, "rsc_type"])
        .join(codes("LS", "req_status", "lock_status"), [*kc, "req_status"])
        .join(codes("L", "req_mode", "lock_mode", shift=1), [*kc, "req_mode"])
        .join(who, [*k, "session_id"])
        .join(objects.select(*kd, "object_id", F.col("name").alias("object_name")), [*kd, "object_id"], "left")
        .join(indexes.select(*kd, "object_id", "index_id", F.col("name").alias("index_name")), [*kd, "object_id", "index_id"], "left")
        .withColumns({c: F.coalesce(c, F.lit("")) for c in ("object_name", "index_name", "login_name", "host_name")})
        .drop("rsc_type", "req_status", "req_mode")
    )


# fixed values: which measures of a resource sample are averaged and which peak
RESOURCE_AVG = (
    "avg_cpu_percent", "avg_data_io_percent", "avg_log_write_percent", "avg_instance_cpu_percent",
    "avg_instance_memory_percent",
)
RESOURCE_MAX = (
    "storage_in_megabytes", "avg_data_io_percent", "avg_log_write_percent", "avg_instance_cpu_percent",
    "avg_instance_memory_percent", "max_worker_percent", "max_session_percent",
)


def resource_summary(
    resource_stats: DataFrame, averages: Sequence[str] = RESOURCE_AVG, peaks: Sequence[str] = RESOURCE_MAX
) -> DataFrame:
    """Average and peak use per service tier and database."""
    k = shared_keys(resource_stats)
    return resource_stats.groupBy(*k, "sku", "database_name").agg(
        *[ratio(F.sum(c), F.count(c), 19, 4).alias(f"mean_{c}") if dict(resource_stats.dtypes)[c] in ("bigint", "int", "smallint")
          else F.avg(c).alias(f"mean_{c}") for c in optional(resource_stats, *averages)],
        *[F.max(c).alias(f"max_{c}") for c in optional(resource_stats, *peaks)],
    )


def resource_quota(governance: DataFrame, schedulers: DataFrame) -> DataFrame:
    """Storage and memory quotas in whole gigabytes and the usable cores."""
    k = shared_keys(governance, schedulers)
    by = k or ["_all"]
    cores = schedulers.filter(F.col("status") == "VISIBLE ONLINE")
    if not k:
        online = cores.agg(F.count(F.lit(1)).alias("v_cores")).scalar()
        out = governance.withColumn("v_cores", online)
    else:
        out = governance.join(cores.groupBy(*by).agg(F.count(F.lit(1)).alias("v_cores")), by, "left").na.fill(0, ["v_cores"])
    gb = {
        "max_storage_gb": ("user_data_directory_space_quota_mb", 1024),
        "current_storage_usage_gb": ("user_data_directory_space_usage_mb", 1024),
        "max_db_memory_gb": ("max_db_memory", 1024 * 1024),
    }
    return out.withColumns({name: int_div(src, by_) for name, (src, by_) in gb.items() if has(governance, src)})


def connection_failures(event_log: DataFrame, days: int = 7, subtype: int = 4, *, as_of) -> DataFrame:
    """Failed connections of one subtype in the last ``days`` (both ends included)."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return event_log.filter(
        (F.col("event_type") == "connection_failed") & (F.col("event_subtype") == subtype)
        & F.col("start_time").between(end - F.expr(f"interval {int(days)} days"), end)
    )


def error_log_filter(event_log: DataFrame, database: str | None = None, exclude_like: str = "%Connected%") -> DataFrame:
    """Events whose description does not match; an unknown description is dropped too."""
    df = event_log if database is None else event_log.filter(F.col("database_name") == database)
    return df.filter(~F.col("description").like(exclude_like))
