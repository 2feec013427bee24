"""Backup, restore, job and command history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import SYSTEM_DATABASES, existing, has, optional, shared_keys
from fleetlens.functions.tsql import (
    blank_if_null, boundaries, clock_12h, clock_text, decode, duration_text, int_div, int_to_timestamp, pages_to_mb, text,
)

# fixed values: backup and restore type codes
BACKUP_TYPES = {
    "D": "Database", "L": "Log", "I": "Differential", "F": "File or filegroup", "G": "Differential file",
    "P": "Partial", "Q": "Differential partial",
}
RESTORE_TYPES = {
    "D": "Database", "F": "File", "G": "Filegroup", "I": "Differential", "L": "Log", "V": "Verifyonly", "R": "Revert",
}


def _cut(as_of, days: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")


def _with_media(backupset: DataFrame, media_family: DataFrame | None) -> DataFrame:
    """Backups that have media.  One backup may be striped over many devices, so
    this is an existence test, not a join."""
    if media_family is None:
        return backupset
    keys = [*shared_keys(backupset, media_family), "media_set_id"]
    return backupset.join(existing(media_family, keys), keys, "left_semi")


def backup_history(
    backupset: DataFrame, media_family: DataFrame, db: str | None = None, type: str | None = None,
    days: int | None = None, as_of=None,
) -> DataFrame:
    """Backups of user databases with decoded type, size text and minutes taken."""
    k = shared_keys(backupset, media_family)
    wanted = backupset.filter(~F.lower("database_name").isin(*SYSTEM_DATABASES))
    if db is not None:
        wanted = wanted.filter(F.col("database_name") == db)
    if type is not None:
        wanted = wanted.filter(F.col("type") == type)
    if days is not None:
        wanted = wanted.filter(F.col("backup_start_date") >= _cut(as_of, days))
    return _with_media(wanted, media_family).select(
        *k, "database_name", "backup_start_date",
        boundaries("MINUTE", "backup_start_date", "backup_finish_date").alias("duration_min"),
        decode("type", BACKUP_TYPES, "Unknown").alias("backup_type"),
        F.concat(text(int_div("backup_size", 1024 * 1024)), F.lit(" MB")).alias("size_text"),
        *([F.col("name").alias("backupset_name")] if has(backupset, "name") else []),
    ).distinct()


def last_backup_by_type(databases: DataFrame, backupset: DataFrame) -> DataFrame:
    """Last full, differential and log backup of every user database, NULL when never."""
    k = shared_keys(databases, backupset)
    finish = lambda code: F.max(F.when(F.col("type") == code, F.col("backup_finish_date")))
    last = backupset.groupBy(*k, F.col("database_name").alias("name")).agg(
        finish("D").alias("last_full"), finish("I").alias("last_diff"), finish("L").alias("last_log")
    )
    users = databases.filter(~F.lower("name").isin(*SYSTEM_DATABASES)).select(*k, "name", "recovery_model_desc")
    return users.join(last, [*k, "name"], "left")


def backup_times_of_day(
    backupset: DataFrame, date_by_key: DataFrame | None = None, media_family: DataFrame | None = None
) -> DataFrame:
    """``Times: hh:mm:ss | ...`` per database, type and day.

    Equal times are counted before they are collected, so a list holds at most
    one entry per second of a day however many backups there are.
    """
    k = shared_keys(backupset, *([date_by_key] if date_by_key is not None else []))
    by = [*k, "database_name", "type", "backup_day"]
    rows = _with_media(backupset, media_family).withColumn("backup_day", F.to_date("backup_start_date"))
    if date_by_key is not None:
        rows = rows.join(date_by_key.select(*by), by, "left_semi")
    counted = rows.groupBy(*by, clock_text("backup_start_date").alias("_t")).agg(
        F.count(F.lit(1)).cast("int").alias("_n")
    )
    entries = F.array_sort(F.collect_list(F.struct("_t", "_n")))
    line = F.array_join(F.flatten(F.transform(entries, lambda e: F.array_repeat(e["_t"], e["_n"]))), " | ")
    return counted.groupBy(*by).agg(F.concat(F.lit("Times: "), line, F.lit(" | ")).alias("times"))


def backup_activity(databases: DataFrame, backupset: DataFrame, media_family: DataFrame, days: int = 7, *, as_of) -> DataFrame:
    """Recent backups per database and type, with the last day ever and its times.

    Sizes are compared as numbers (the old report compared their texts).
    """
    k = shared_keys(databases, backupset, media_family)
    by = [*k, "database_name", "type"]
    stored = _with_media(backupset, media_family)
    recent = (
        stored.filter(F.col("backup_start_date") >= _cut(as_of, days))
        .select(*by, "backup_start_date", boundaries("MINUTE", "backup_start_date", "backup_finish_date").alias("_min"),
                int_div("backup_size", 1024 * 1024).alias("_mb"), *optional(backupset, "name"))
        .distinct()
        .groupBy(*by)
        .agg(F.max("_mb").alias("_mb"), F.max("_min").alias("_min"), F.count(F.lit(1)).alias("_n"))
    )
    last = stored.groupBy(*by).agg(F.max(F.to_date("backup_start_date")).alias("backup_day"))
    # only the last day of the few (database, type) pairs that were active is listed
    active = recent.join(last, by)
    out = active.join(backup_times_of_day(stored, active), [*by, "backup_day"], "left")
    listed = databases.filter(F.lower("name") != "tempdb").select(
        *k, F.col("name").alias("database_name"), "recovery_model_desc"
    )
    return listed.join(out, [*k, "database_name"], "left").select(
        *k, "database_name", "recovery_model_desc",
        F.when(F.col("type").isNull(), F.lit("No Backup")).otherwise(decode("type", BACKUP_TYPES, "Unknown")).alias("backup_type"),
        blank_if_null(F.concat(text("_mb"), F.lit(" MB"))).alias("max_size"),
        blank_if_null("_min").alias("max_duration_min"),
        blank_if_null("_n").alias("backup_count"),
        blank_if_null("backup_day").alias("last_day"),
        blank_if_null("times").alias("times"),
    )


def restore_history(
    restore: DataFrame, backupset: DataFrame, restorefile: DataFrame, media_family: DataFrame,
    db: str | None = None, type: str | None = "L", days: int = 30, *, as_of,
) -> DataFrame:
    """Restores with their source devices and target files."""
    k = shared_keys(restore, backupset, restorefile, media_family)
    wanted = restore.filter(F.col("restore_date") >= _cut(as_of, days))
    if type is not None:
        wanted = wanted.filter(F.col("restore_type") == type)
    if db is not None:
        wanted = wanted.filter(F.col("destination_database_name") == db)
    return (
        wanted.join(backupset.select(*k, "backup_set_id", "media_set_id"), [*k, "backup_set_id"])
        .join(restorefile.select(*k, "restore_history_id", "destination_phys_name"), [*k, "restore_history_id"])
        .join(media_family.select(*k, "media_set_id", "physical_device_name"), [*k, "media_set_id"])
        .select(
            *k, "restore_history_id", F.col("destination_database_name").alias("database_name"),
            F.col("user_name").alias("restored_by"),
            decode("restore_type", RESTORE_TYPES, F.col("restore_type")).alias("restore_type"),
            F.col("restore_date").alias("restore_started"), F.col("physical_device_name").alias("restored_from"),
            F.col("destination_phys_name").alias("restored_to"),
        )
    )


def history_table_counts(tables: Mapping[str, DataFrame], files: DataFrame | None = None) -> DataFrame:
    """Row counts of history tables side by side, with data and log megabytes."""
    frames = list(tables.values()) + ([files] if files is not None else [])
    k = shared_keys(*frames)
    parts = [df.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name)) for name, df in tables.items()]
    names = list(tables)
    if files is not None:
        mb = pages_to_mb("size_pages")
        for name, kind in (("data_mb", 0), ("log_mb", 1)):
            parts.append(files.filter(F.col("type") == kind).groupBy(*k).agg(F.sum(mb).alias("n")).withColumn("what", F.lit(name)))
            names.append(name)
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    out = stacked.groupBy(*k).agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in names])
    return out.na.fill(0, list(tables))


def purgeable_log_backups(
    backups: DataFrame, differential_base: DataFrame | None = None, cleanup_hours: int = 24, *, as_of,
    types: Sequence[str] = ("L",),
) -> DataFrame:
    """Backups that may be deleted.

    The cut-off is ``as_of`` minus the hours.  Log backups must also be older than
    the latest undamaged full or differential backup (or a log backup that ends
    before the differential base); a database without one keeps its log backups.
    """
    k = shared_keys(backups, *([differential_base] if differential_base is not None else []))
    by = [*k, "database_name"]
    covered = F.col("type").isin("D", "I")
    candidates = backups
    if differential_base is not None:
        candidates = backups.join(differential_base.select(*by, "differential_base_lsn"), by, "left")
        covered = covered | ((F.col("type") == "L") & (F.col("last_lsn") < F.col("differential_base_lsn")))
    latest = candidates.groupBy(*by).agg(
        F.max(F.when(covered & (F.col("is_damaged") == 0), F.col("backup_start_date"))).alias("latest_cover")
    )
    by_age = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(cleanup_hours)} hours")
    cut = F.when(F.col("type") != "L", by_age).when(F.col("latest_cover").isNotNull(), F.least(by_age, F.col("latest_cover")))
    old = backups.filter(F.col("type").isin(*types) & (F.col("backup_start_date") < by_age))
    return old.join(latest, by, "left").withColumn("cleanup_cutoff", cut).filter(F.col("backup_start_date") < F.col("cleanup_cutoff"))


# --- jobs -------------------------------------------------------------------------


def job_owner_audit(
    jobs: DataFrame, logins: DataFrame, packages: DataFrame | None = None, allowed: Sequence[str] = ("sa",),
    maintenance_only: bool = False,
) -> DataFrame:
    """Jobs and packages with an owner that is not allowed or does not resolve.

    ``maintenance_only`` restricts packages to maintenance plans with a known
    owner, the form used for the configuration overview.
    """
    k = shared_keys(jobs, logins)
    owners = logins.select(*k, F.col("sid").alias("owner_sid"), F.col("name").alias("owner"))
    out = None
    for kind, df in (("job", jobs), ("package", packages)):
        if df is None:
            continue
        rows = df.select(*k, F.col("name").alias("object_name"), "owner_sid").join(owners, [*k, "owner_sid"], "left")
        wrong = ~F.col("owner").isin(list(allowed))
        if kind == "package" and maintenance_only:
            rows = rows.filter(F.col("object_name").like("%Maintenance%") & wrong)
        else:
            rows = rows.filter(wrong | F.col("owner").isNull())
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def job_owner_counts(audit: DataFrame) -> DataFrame:
    """Number of findings per kind."""
    return audit.groupBy(*shared_keys(audit), "kind").agg(F.count(F.lit(1)).alias("findings"))


# fixed values: weekday bits, ordinal weeks and day kinds of schedules
DAY_BITS = {1: "Sunday", 2: "Monday", 4: "Tuesday", 8: "Wednesday", 16: "Thursday", 32: "Friday", 64: "Saturday"}
RELATIVE_WEEK = {1: "first ", 2: "second ", 4: "third ", 8: "fourth ", 16: "last "}
RELATIVE_DAY = {
    1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday", 5: "Thursday", 6: "Friday", 7: "Saturday",
    8: "day", 9: "week day", 10: "weekend day",
}
SUBDAY_UNIT = {2: " second", 4: " minute", 8: " hour"}
HOUSEKEEPING_JOBS = ("syspolicy_purge_history", "SSIS Server Maintenance Job")
REPORT_SERVER_CATEGORY = 100
NO_END_DATE = 99991231


def day_list(mask: str | Column) -> Column:
    """Names of the days whose bit is set."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.array_join(
        F.array_compact(F.array(*[F.when(m.bitwiseAND(F.lit(bit).cast("bigint")) == bit, F.lit(day)) for bit, day in DAY_BITS.items()])), ", "
    )


def reportable_jobs(jobs: DataFrame, own_prefix: str | None = None) -> DataFrame:
    """Jobs worth reporting: no report-server or housekeeping jobs, nor those of the own
    installation if their names' prefix is given."""
    out = jobs.filter((F.col("category_id") != REPORT_SERVER_CATEGORY) & ~F.col("name").isin(*HOUSEKEEPING_JOBS))
    return out if own_prefix is None else out.filter(~F.col("name").startswith(own_prefix))


def schedule_description(
    jobs: DataFrame, schedules: DataFrame, logins: DataFrame, job_schedules: DataFrame | None = None,
    job_name: str | None = None, noon_quirk: bool = False, own_prefix: str | None = None,
) -> DataFrame:
    """Every reportable job with its schedule in words.

    ``job_schedules`` links jobs to shared schedules; without it ``schedules``
    carries the job id itself.  ``job_name`` is a LIKE pattern.
    """
    k = shared_keys(jobs, schedules, logins)
    chosen = reportable_jobs(jobs, own_prefix)
    if job_name:
        chosen = chosen.filter(F.col("name").like(job_name))
    timing = schedules.withColumnsRenamed({"name": "schedule_name", "enabled": "schedule_enabled"})
    if job_schedules is not None:
        timing = job_schedules.select(*k, "job_id", "schedule_id").join(timing, [*k, "schedule_id"], "left")
    owners = logins.select(*k, F.col("sid").alias("owner_sid"), F.col("name").alias("job_owner"))
    df = (
        chosen.withColumnsRenamed({"name": "job_name", "enabled": "job_enabled"})
        .join(timing, [*k, "job_id"], "left").join(owners, [*k, "owner_sid"], "left")
    )
    kind, interval, every = F.col("freq_type"), F.col("freq_interval").cast("bigint"), F.col("freq_recurrence_factor")
    repeat = lambda once, unit: F.when(every == 1, F.lit(once)).when(
        every > 1, F.concat(F.lit("Every "), text(every), F.lit(f" {unit} on " + ("the " if unit == "months" else "")))
    )
    ordinal = (
        F.when(interval.isin(1, 21, 31), F.lit("st")).when(interval.isin(2, 22), F.lit("nd"))
        .when(interval.isin(3, 23), F.lit("rd")).otherwise(F.lit("th"))
    )
    start_day = F.to_date(F.lpad(text("active_start_date"), 8, "0"), "yyyyMMdd")
    end_day = F.to_date(F.lpad(text("active_end_date"), 8, "0"), "yyyyMMdd")
    base = (
        F.when(F.col("job_enabled") == 0, F.lit("Job is disabled"))
        .when(F.col("schedule_enabled").isNull(), F.lit("Unscheduled"))
        .when(kind == 1, F.concat(F.lit("Once on "), F.date_format(start_day, "yyyy.MM.dd")))
        .when(kind == 4, F.lit("Daily"))
        .when(kind == 8, F.concat(repeat("Weekly on ", "weeks"), day_list(interval)))
        .when(kind == 16, F.concat(repeat("Monthly on the ", "months"), text(interval), ordinal))
        .when(kind == 32, F.concat(repeat("Monthly on the ", "months"), decode("freq_relative_interval", RELATIVE_WEEK), decode(interval, RELATIVE_DAY)))
        .when(kind == 64, F.lit("Automatically starts when SQLServerAgent starts."))
        .when(kind == 128, F.lit("Starts whenever the CPUs become idle"))
        .otherwise(F.lit(""))
    )
    sub = F.col("freq_subday_type")
    starts, ends = clock_12h("active_start_time", noon_quirk), clock_12h("active_end_time", noon_quirk)
    plural = F.when(F.col("freq_subday_interval") > 1, F.lit("s")).otherwise(F.lit(""))
    inside_day = (
        F.when(F.col("job_enabled") == 0, F.lit(""))
        .when((sub == 1) | (kind == 1), F.concat(F.lit(" at "), starts))
        .when(sub.isin(2, 4, 8), F.concat(F.lit(" every "), text("freq_subday_interval"), decode(sub, SUBDAY_UNIT), plural))
        .otherwise(F.lit(""))
    )
    window = (
        F.when(F.col("job_enabled") == 0, F.lit(""))
        .when(sub.isin(2, 4, 8), F.concat(F.lit(" between "), starts, F.lit(" and "), ends))
        .otherwise(F.lit(""))
    )
    state = F.when(F.col("schedule_enabled") == 0, F.lit("Disabled")).when(F.col("schedule_enabled") == 1, F.lit("Enabled")).when(
        F.col("schedule_enabled").isNull(), F.lit("Unscheduled")
    )
    return df.select(
        *k, "job_id", "job_name", "job_owner", *optional(df, "schedule_id", "schedule_name"),
        state.alias("schedule_state"),
        F.concat(base, inside_day, window).alias("schedule"),
        F.concat(F.date_format(start_day, "dd/MM/yyyy"), F.lit(" "), starts).alias("start_date"),
        F.when(F.col("active_end_date") == NO_END_DATE, F.lit("No end date"))
        .otherwise(F.concat(F.date_format(end_day, "dd/MM/yyyy"), F.lit(" "), ends)).alias("end_date"),
    )


def next_run_time(job_schedules: DataFrame) -> DataFrame:
    """Next run as a timestamp, and as text with 'n/a' when nothing is planned."""
    planned = F.col("next_run_date") != 0
    moment = F.when(planned, int_to_timestamp(F.when(planned, F.col("next_run_date")), "next_run_time"))
    return job_schedules.withColumns({
        "next_run_at": moment,
        "next_run_text": F.coalesce(text(moment), F.lit("n/a")),
    })


# --- command log ---------------------------------------------------------------------


def command_log_report(command_log: DataFrame) -> DataFrame:
    """Outcome and duration of every logged maintenance command."""
    started, ended = F.col("start_time"), F.col("end_time")
    outcome = (
        F.when(ended.isNull() | F.col("error_number").isNull(), F.lit("Not executed"))
        .when(F.col("error_number") == 0, F.lit("Succeeded")).otherwise(F.lit("Failed"))
    )
    out = command_log.withColumns({"outcome": outcome, "duration": duration_text(boundaries("SECOND", started, ended))})
    if not has(command_log, "extended_info"):
        return out
    # one parse per row gives both values
    info = F.from_xml("extended_info", "PageCount BIGINT, Fragmentation DOUBLE")
    return out.withColumn("_info", info).withColumns({
        "page_count": F.col("_info.PageCount"), "fragmentation": F.col("_info.Fragmentation"),
    }).drop("_info")


def last_good_check(command_log: DataFrame, databases: DataFrame) -> DataFrame:
    """Start of the last successful consistency check of every database, NULL when none."""
    k = shared_keys(command_log, databases)
    good = (
        command_log.filter((F.col("command_type") == "DBCC_CHECKDB") & (F.col("error_number") == 0))
        .groupBy(*k, F.col("database_name").alias("name")).agg(F.max("start_time").alias("last_good_check"))
    )
    return databases.select(*k, "name").join(good, [*k, "name"], "left")
