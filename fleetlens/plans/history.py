"""Queries over backups, restores, jobs and the command log."""

from pyspark.sql import functions as F

from fleetlens.operators import chains
from fleetlens.operators import history as op
from fleetlens.plans.registry import query
from fleetlens.plans.storage import variants
from fleetlens.session import scratch
from fleetlens.sources import keyed_log

AS_OF = "2001-08-01 00:00:00"
T = f"TIMESTAMP '{AS_OF}'"

# fixed values: words for the backup types
_TYPE = """CASE type WHEN 'D' THEN 'Database' WHEN 'L' THEN 'Log' WHEN 'I' THEN 'Differential' WHEN 'F' THEN 'File or filegroup'
  WHEN 'G' THEN 'Differential file' WHEN 'P' THEN 'Partial' WHEN 'Q' THEN 'Differential partial' ELSE 'Unknown' END"""
_HISTORY = f"""
    SELECT DISTINCT {{variant}} AS variant, database_name, backup_start_date, date_diff('minute', backup_start_date, backup_finish_date) AS duration_min,
      {_TYPE} AS backup_type, (backup_size // 1048576) || ' MB' AS size_text
    FROM backupmediafamily m JOIN backupset b ON b.media_set_id = m.media_set_id
"""


@query(
    "variant:s database_name:s backup_start_date:t duration_min:i backup_type:s size_text:s",
    _HISTORY.format(variant="'all'") + " UNION ALL " + _HISTORY.format(variant="'log_year'")
    + f" WHERE type = 'L' AND backup_start_date >= {T} - INTERVAL 365 DAY"
    + " UNION ALL " + _HISTORY.format(variant="'one_database'") + " WHERE database_name = 'db42'",
)
def backup_history(t):
    args = (t.backupset, t.backupmediafamily)
    return variants(
        all=op.backup_history(*args), log_year=op.backup_history(*args, type="L", days=365, as_of=AS_OF),
        one_database=op.backup_history(*args, db="db42"),
    )


@query(
    "name:s recovery_model_desc:s last_full:t last_diff:t last_log:t",
    """
    SELECT name, recovery_model_desc, MAX(backup_finish_date) FILTER (type = 'D') AS last_full,
      MAX(backup_finish_date) FILTER (type = 'I') AS last_diff, MAX(backup_finish_date) FILTER (type = 'L') AS last_log
    FROM databases d LEFT JOIN backupset b ON b.database_name = d.name GROUP BY name, recovery_model_desc
    """,
)
def last_backup_by_type(t):
    return op.last_backup_by_type(t.databases, t.backupset)


_TIMES = """SELECT database_name, type, CAST(backup_start_date AS DATE) AS backup_day,
  'Times: ' || string_agg(strftime(backup_start_date, '%H:%M:%S'), ' | ' ORDER BY strftime(backup_start_date, '%H:%M:%S')) || ' | ' AS times
  FROM {source} GROUP BY database_name, type, CAST(backup_start_date AS DATE)"""
_STORED = "(SELECT * FROM backupset WHERE media_set_id IN (SELECT media_set_id FROM backupmediafamily))"


@query("database_name:s type:s backup_day:t times:s", _TIMES.format(source="backupset"))
def backup_times_of_day(t):
    return op.backup_times_of_day(t.backupset)


def _activity(label, days):
    return f"""
    SELECT '{label}' AS variant, d.name AS database_name, recovery_model_desc,
      CASE WHEN h.type IS NULL THEN 'No Backup' ELSE {_TYPE.replace('CASE type', 'CASE h.type')} END AS backup_type,
      COALESCE(h.mb || ' MB', '') AS max_size, COALESCE(h.minutes::VARCHAR, '') AS max_duration_min, COALESCE(h.n::VARCHAR, '') AS backup_count,
      COALESCE(l.backup_day::VARCHAR, '') AS last_day, COALESCE(x.times, '') AS times
    FROM databases d
    LEFT JOIN (SELECT database_name, type, MAX(mb) AS mb, MAX(minutes) AS minutes, COUNT(*) AS n FROM (
        SELECT DISTINCT database_name, type, backup_start_date, date_diff('minute', backup_start_date, backup_finish_date) AS minutes, backup_size // 1048576 AS mb
        FROM {_STORED} WHERE backup_start_date >= {T} - INTERVAL {days} DAY) GROUP BY database_name, type) h ON h.database_name = d.name
    LEFT JOIN (SELECT database_name, type, MAX(CAST(backup_start_date AS DATE)) AS backup_day FROM {_STORED} GROUP BY database_name, type) l
      ON l.database_name = d.name AND l.type = h.type
    LEFT JOIN ({_TIMES.format(source=_STORED)}) x ON x.database_name = d.name AND x.type = h.type AND x.backup_day = l.backup_day
    """


@query(
    "variant:s database_name:s recovery_model_desc:s backup_type:s max_size:s max_duration_min:s backup_count:s last_day:s times:s",
    _activity("week", 7) + " UNION ALL " + _activity("year", 365),
)
def backup_activity(t):
    args = (t.databases, t.backupset, t.backupmediafamily)
    return variants(week=op.backup_activity(*args, as_of=AS_OF), year=op.backup_activity(*args, days=365, as_of=AS_OF))


@query(
    "restore_history_id:i database_name:s restored_by:s restore_type:s restore_started:t restored_from:s restored_to:s",
    f"""
    SELECT r.restore_history_id, destination_database_name AS database_name, user_name AS restored_by, 'Log' AS restore_type,
      restore_date AS restore_started, physical_device_name AS restored_from, destination_phys_name AS restored_to
    FROM restorehistory r JOIN backupset b ON b.backup_set_id = r.backup_set_id JOIN restorefile f ON f.restore_history_id = r.restore_history_id
    JOIN backupmediafamily m ON m.media_set_id = b.media_set_id
    WHERE restore_type = 'L' AND restore_date >= {T} - INTERVAL 365 DAY
    """,
)
def restore_history(t):
    return op.restore_history(t.restorehistory, t.backupset, t.restorefile, t.backupmediafamily, days=365, as_of=AS_OF)


@query(
    "backup_set:i media_family:i restores:i commands:i data_mb:i log_mb:i",
    """
    SELECT (SELECT COUNT(*) FROM backupset) AS backup_set, (SELECT COUNT(*) FROM backupmediafamily) AS media_family,
      (SELECT COUNT(*) FROM restorehistory) AS restores, (SELECT COUNT(*) FROM command_log) AS commands,
      (SELECT SUM(size_pages * 8 // 1024) FROM files WHERE type = 0) AS data_mb, (SELECT SUM(size_pages * 8 // 1024) FROM files WHERE type = 1) AS log_mb
    """,
)
def history_table_counts(t):
    return op.history_table_counts(
        {"backup_set": t.backupset, "media_family": t.backupmediafamily, "restores": t.restorehistory, "commands": t.command_log}, t.files
    )


@query(
    "variant:s backup_set_id:i database_name:s type:s backup_start_date:t cleanup_cutoff:t",
    f"""
    WITH cover AS (
      SELECT b.database_name, MAX(backup_start_date) FILTER (type IN ('D', 'I') AND is_damaged = 0) AS plain,
        MAX(backup_start_date) FILTER ((type IN ('D', 'I') OR (type = 'L' AND last_lsn < differential_base_lsn)) AND is_damaged = 0) AS based
      FROM bk_lsn b LEFT JOIN diff_bases f ON f.database_name = b.database_name GROUP BY b.database_name)
    SELECT 'log' AS variant, backup_set_id, b.database_name, type, backup_start_date, LEAST({T} - INTERVAL 24 HOUR, based) AS cleanup_cutoff
    FROM bk_lsn b JOIN cover c ON c.database_name = b.database_name
    WHERE type = 'L' AND based IS NOT NULL AND backup_start_date < LEAST({T} - INTERVAL 24 HOUR, based)
    UNION ALL
    SELECT 'all_types', backup_set_id, b.database_name, type, backup_start_date,
      CASE WHEN type = 'L' THEN LEAST({T} - INTERVAL 48 HOUR, plain) ELSE {T} - INTERVAL 48 HOUR END
    FROM bk_lsn b JOIN cover c ON c.database_name = b.database_name
    WHERE (type <> 'L' AND backup_start_date < {T} - INTERVAL 48 HOUR)
       OR (type = 'L' AND plain IS NOT NULL AND backup_start_date < LEAST({T} - INTERVAL 48 HOUR, plain))
    """,
)
def purgeable_log_backups(t):
    return variants(
        log=op.purgeable_log_backups(t.bk_lsn, t.diff_bases, as_of=AS_OF),
        all_types=op.purgeable_log_backups(t.bk_lsn, cleanup_hours=48, as_of=AS_OF, types=("D", "I", "L")),
    )


@query(
    "variant:s kind:s object_name:s owner:s",
    """
    SELECT 'audit' AS variant, 'job' AS kind, j.name AS object_name, l.name AS owner FROM jobs j LEFT JOIN job_logins l ON l.sid = j.owner_sid
    WHERE l.name NOT IN ('sa') OR l.name IS NULL
    UNION ALL SELECT 'audit', 'package', p.name, l.name FROM maint_packages p LEFT JOIN job_logins l ON l.sid = p.owner_sid
    WHERE l.name NOT IN ('sa') OR l.name IS NULL
    UNION ALL SELECT 'plans', 'job', j.name, l.name FROM jobs j LEFT JOIN job_logins l ON l.sid = j.owner_sid
    WHERE l.name NOT IN ('sa') OR l.name IS NULL
    UNION ALL SELECT 'plans', 'package', p.name, l.name FROM maint_packages p LEFT JOIN job_logins l ON l.sid = p.owner_sid
    WHERE p.name LIKE '%Maintenance%' AND l.name <> 'sa'
    """,
)
def job_owner_audit(t):
    args = (t.jobs, t.job_logins, t.maint_packages)
    return variants(audit=op.job_owner_audit(*args), plans=op.job_owner_audit(*args, maintenance_only=True))


@query(
    "kind:s findings:i",
    """
    SELECT 'job' AS kind, COUNT(*) AS findings FROM jobs j LEFT JOIN job_logins l ON l.sid = j.owner_sid WHERE l.name NOT IN ('sa') OR l.name IS NULL
    UNION ALL SELECT 'package', COUNT(*) FROM maint_packages p LEFT JOIN job_logins l ON l.sid = p.owner_sid
    WHERE p.name LIKE '%Maintenance%' AND l.name <> 'sa'
    """,
)
def job_owner_counts(t):
    return op.job_owner_counts(op.job_owner_audit(t.jobs, t.job_logins, t.maint_packages, maintenance_only=True))


def _clock(c):
    h, m = f"(({c} % 1000000) // 10000)", f"(({c} % 10000) // 100)"
    return (f"(CASE WHEN {h} = 0 THEN 12 WHEN {h} <= 12 THEN {h} ELSE {h} - 12 END || ':' || lpad({m}::VARCHAR, 2, '0') "
            f"|| CASE WHEN {h} < 12 THEN ' AM' ELSE ' PM' END)")


_DAYS = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN freq_interval & {1 << i} > 0 THEN '{d}' END"
    for i, d in enumerate(("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"))
) + ")"


def _every(once, unit):
    return (f"CASE WHEN freq_recurrence_factor = 1 THEN '{once}' WHEN freq_recurrence_factor > 1 THEN "
            f"'Every ' || freq_recurrence_factor || ' {unit} on{' the' if unit == 'months' else ''} ' END")


@query(
    "job_id:i job_name:s job_owner:s schedule_name:s schedule_state:s schedule:s start_date:s end_date:s",
    f"""
    SELECT j.job_id, j.name AS job_name, l.name AS job_owner, s.name AS schedule_name,
      CASE WHEN s.enabled = 0 THEN 'Disabled' WHEN s.enabled = 1 THEN 'Enabled' ELSE 'Unscheduled' END AS schedule_state,
      CASE WHEN j.enabled = 0 THEN 'Job is disabled' WHEN s.enabled IS NULL THEN 'Unscheduled'
        WHEN freq_type = 1 THEN 'Once on ' || strftime(strptime(active_start_date::VARCHAR, '%Y%m%d'), '%Y.%m.%d')
        WHEN freq_type = 4 THEN 'Daily'
        WHEN freq_type = 8 THEN {_every('Weekly on ', 'weeks')} || {_DAYS}
        WHEN freq_type = 16 THEN {_every('Monthly on the ', 'months')} || freq_interval
          || CASE WHEN freq_interval IN (1, 21, 31) THEN 'st' WHEN freq_interval IN (2, 22) THEN 'nd' WHEN freq_interval IN (3, 23) THEN 'rd' ELSE 'th' END
        WHEN freq_type = 32 THEN {_every('Monthly on the ', 'months')}
          || CASE freq_relative_interval WHEN 1 THEN 'first ' WHEN 2 THEN 'second ' WHEN 4 THEN 'third ' WHEN 8 THEN 'fourth ' WHEN 16 THEN 'last ' END
          || CASE freq_interval WHEN 1 THEN 'Sunday' WHEN 2 THEN 'Monday' WHEN 3 THEN 'Tuesday' WHEN 4 THEN 'Wednesday' WHEN 5 THEN 'Thursday'
               WHEN 6 THEN 'Friday' WHEN 7 THEN 'Saturday' WHEN 8 THEN 'day' WHEN 9 THEN 'week day' WHEN 10 THEN 'weekend day' END
        WHEN freq_type = 64 THEN 'Automatically starts when SQLServerAgent starts.'
        WHEN freq_type = 128 THEN 'Starts whenever the CPUs become idle' ELSE '' END
      || CASE WHEN j.enabled = 0 THEN '' WHEN freq_subday_type = 1 OR freq_type = 1 THEN ' at ' || {_clock('active_start_time')}
        WHEN freq_subday_type IN (2, 4, 8) THEN ' every ' || freq_subday_interval || CASE freq_subday_type WHEN 2 THEN ' second' WHEN 4 THEN ' minute' ELSE ' hour' END
          || CASE WHEN freq_subday_interval > 1 THEN 's' ELSE '' END ELSE '' END
      || CASE WHEN j.enabled = 0 THEN '' WHEN freq_subday_type IN (2, 4, 8) THEN ' between ' || {_clock('active_start_time')} || ' and ' || {_clock('active_end_time')}
        ELSE '' END AS schedule,
      strftime(strptime(active_start_date::VARCHAR, '%Y%m%d'), '%d/%m/%Y') || ' ' || {_clock('active_start_time')} AS start_date,
      CASE WHEN active_end_date = 99991231 THEN 'No end date'
        ELSE strftime(strptime(active_end_date::VARCHAR, '%Y%m%d'), '%d/%m/%Y') || ' ' || {_clock('active_end_time')} END AS end_date
    FROM jobs j LEFT JOIN job_schedules_full s ON s.job_id = j.job_id LEFT JOIN job_logins l ON l.sid = j.owner_sid
    WHERE category_id <> 100 AND j.name NOT LIKE 'own%'
    """,
)
def schedule_description(t):
    return op.schedule_description(t.jobs, t.job_schedules_full, t.job_logins, own_prefix="own")


@query(
    "job_id:i next_run_at:t next_run_text:s",
    """
    SELECT job_id, CASE WHEN next_run_date <> 0 THEN strptime(next_run_date || lpad(next_run_time::VARCHAR, 6, '0'), '%Y%m%d%H%M%S') END AS next_run_at,
      COALESCE(strftime(CASE WHEN next_run_date <> 0 THEN strptime(next_run_date || lpad(next_run_time::VARCHAR, 6, '0'), '%Y%m%d%H%M%S') END, '%Y-%m-%d %H:%M:%S'), 'n/a') AS next_run_text
    FROM job_schedules_full
    """,
)
def next_run_time(t):
    return op.next_run_time(t.job_schedules_full)


@query(
    "id:i database_name:s command_type:s outcome:s duration:s page_count:i fragmentation:d",
    """
    SELECT id, database_name, command_type,
      CASE WHEN end_time IS NULL OR error_number IS NULL THEN 'Not executed' WHEN error_number = 0 THEN 'Succeeded' ELSE 'Failed' END AS outcome,
      CASE WHEN s >= 86400 THEN (s // 86400) || '.' ELSE '' END || lpad((s % 86400 // 3600)::VARCHAR, 2, '0') || ':'
        || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS duration, id * 3 AS page_count, id % 100 AS fragmentation
    FROM (SELECT *, date_diff('second', start_time, end_time) AS s FROM command_log)
    """,
)
def command_log_report(t):
    info = F.concat(
        F.lit("<ExtendedInfo><PageCount>"), F.col("id") * 3, F.lit("</PageCount><Fragmentation>"), F.col("id") % 100,
        F.lit("</Fragmentation></ExtendedInfo>"),
    )
    return op.command_log_report(t.command_log.withColumn("extended_info", info))


@query(
    "name:s last_good_check:t",
    """
    SELECT d.name, MAX(start_time) AS last_good_check FROM databases d
    LEFT JOIN (SELECT * FROM command_log WHERE command_type = 'DBCC_CHECKDB' AND error_number = 0) c ON c.database_name = d.name GROUP BY d.name
    """,
)
def last_good_check(t):
    return op.last_good_check(t.command_log, t.databases)


@query(
    "id:i database_name:s command_type:s start_time:t end_time:t error_number:i",
    "SELECT id, database_name, command_type, start_time, end_time, error_number FROM command_log",
)
def command_log_merged(t):
    """Starts and completions appended to a log in several commits, compacted in between, and merged on read."""
    log = keyed_log.command_log(t.spark, scratch(t.spark, "command_log"))
    done = t.command_log.filter(F.col("end_time").isNotNull())
    early = F.col("id") % 3 == 0
    keyed_log.log_started(log, t.command_log.filter(early))
    keyed_log.log_completed(log, done.filter(early))
    log.compact()
    keyed_log.log_completed(log, done.filter(~early))
    keyed_log.log_started(log, t.command_log.filter(~early))
    return log.read()


_LOGS = "SELECT * FROM bk_chain WHERE type = 'L' AND is_damaged = 0"
_REACH = """
    , walk AS (SELECT database_name, recovery_fork, id, lsn, lsn AS r FROM points
      UNION SELECT w.database_name, w.recovery_fork, w.id, w.lsn, l.last_lsn FROM walk w JOIN logs l
        ON l.database_name = w.database_name AND l.recovery_fork = w.recovery_fork AND l.first_lsn <= w.r AND l.last_lsn > w.r)
    , reached AS (SELECT database_name, recovery_fork, id, lsn, MAX(r) AS r FROM walk GROUP BY ALL)
    , met AS (SELECT p.*, EXISTS (SELECT 1 FROM logs l WHERE l.database_name = p.database_name AND l.recovery_fork = p.recovery_fork AND l.first_lsn <= p.lsn AND l.last_lsn >= p.lsn) AS covered
      FROM reached p)
"""


@query(
    "database_name:s recovery_fork:i backup_set_id:i first_lsn:i last_lsn:i chain_start:i chain_end:i place:s missing:i",
    f"""
    WITH logs AS ({_LOGS}),
    reached AS (SELECT *, MAX(last_lsn) OVER (PARTITION BY database_name, recovery_fork ORDER BY first_lsn, last_lsn, backup_set_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM logs),
    counted AS (SELECT *, reach IS NULL OR first_lsn > reach AS opens, SUM(CASE WHEN reach IS NULL OR first_lsn > reach THEN 1 ELSE 0 END)
      OVER (PARTITION BY database_name, recovery_fork ORDER BY first_lsn, last_lsn, backup_set_id) AS chain FROM reached)
    SELECT *, MIN(first_lsn) OVER c AS chain_start, MAX(last_lsn) OVER c AS chain_end, CASE WHEN opens AND reach IS NOT NULL THEN first_lsn - reach END AS missing,
      CASE WHEN reach IS NULL THEN 'start' WHEN opens THEN 'gap' WHEN last_lsn <= reach THEN 'covered' WHEN first_lsn < reach THEN 'overlap' ELSE 'next' END AS place
    FROM counted WINDOW c AS (PARTITION BY database_name, recovery_fork, chain)
    """,
)
def backup_log_chains(t):
    return chains.backup_log_chains(t.bk_chain)


@query(
    "database_name:s recovery_fork:i start_id:i start_lsn:i restorable_lsn:i has_log_chain:b",
    f"""
    WITH RECURSIVE logs AS ({_LOGS}),
    points AS (SELECT database_name, recovery_fork, backup_set_id AS id, last_lsn AS lsn FROM bk_chain WHERE type IN ('D', 'I') AND is_damaged = 0)
    {_REACH}
    SELECT database_name, recovery_fork, id AS start_id, lsn AS start_lsn, r AS restorable_lsn, covered AS has_log_chain FROM met
    """,
)
def last_restorable_points(t):
    return chains.last_restorable_points(t.bk_chain, ("D", "I"))


@query(
    "database_name:s recovery_fork:i parent_fork:i fork_lsn:i parent_reaches:b continues:b reaches:i",
    f"""
    WITH RECURSIVE logs AS ({_LOGS}),
    points AS (SELECT database_name, recovery_fork, recovery_fork AS id, fork_lsn AS lsn FROM bk_forks)
    {_REACH}
    SELECT f.*, m.covered AS continues, m.r AS reaches, EXISTS (SELECT 1 FROM logs l WHERE l.database_name = f.database_name AND l.recovery_fork = f.parent_fork
      AND l.first_lsn <= f.fork_lsn AND l.last_lsn >= f.fork_lsn) AS parent_reaches
    FROM bk_forks f JOIN met m ON m.database_name = f.database_name AND m.recovery_fork = f.recovery_fork AND m.id = f.recovery_fork
    """,
)
def fork_continuity(t):
    return chains.fork_continuity(t.bk_chain, t.bk_forks)
