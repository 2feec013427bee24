"""Maintenance decisions: what to back up, rebuild, update, and in which order.

Each decision is a set of column expressions over one row per database, index or
statistic, so a whole fleet is decided in one pass.  Nothing is executed.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import DATABASE, has, optional, shared_keys
from fleetlens.functions.ordering import positions
from fleetlens.functions.tsql import big, boundaries, int_div, quote, text

MB = 1024 * 1024
PAGE = 8192


def _database_bytes() -> Column:
    return F.coalesce(big("allocated_extent_page_count") * PAGE, big("database_size") * PAGE)


# --- backups ----------------------------------------------------------------------


def backup_type_decision(
    db_state: DataFrame, requested: str, modification_level: int | None = None, min_db_size_mb: int | None = None,
    change_type: bool = True,
) -> DataFrame:
    """The backup type to take instead of the requested one.

    A log backup without a log chain becomes differential; a differential one
    becomes full when there is no usable base, too much changed, the database is
    small, or the base is a snapshot.
    """
    if not change_type:
        return db_state.withColumn("current_backup_type", F.lit(requested))
    master = F.lower("name") == "master"
    unchained = F.col("recovery_model_desc").isin("FULL", "BULK_LOGGED") & F.col("log_lsn").isNull() & ~master
    first = F.when(F.lit(requested) == "LOG", F.when(unchained, F.lit("DIFF")).otherwise(F.lit("LOG"))).otherwise(F.lit(requested))
    full = master | F.col("differential_base_lsn").isNull()
    if modification_level is not None:
        full = full | (
            (big("allocated_extent_page_count") > 0)
            & (big("modified_extent_page_count") * 100 >= big("allocated_extent_page_count") * modification_level)
        )
    if min_db_size_mb is not None:
        full = full | (_database_bytes() < min_db_size_mb * MB)
    if has(db_state, "differential_base_is_snapshot"):
        full = full | (F.col("differential_base_is_snapshot") == 1)
    return db_state.withColumn("_t", first).withColumn(
        "current_backup_type", F.when((F.col("_t") == "DIFF") & F.coalesce(full, F.lit(False)), F.lit("FULL")).otherwise(F.col("_t"))
    ).drop("_t")


def backup_eligibility(
    db_state: DataFrame, copy_only: bool = False, override_preference: bool = False, updateability: str = "ALL",
    exclude_log_shipped: bool = True, log_size_mb: int | None = None, log_seconds: int | None = None,
    min_diff_size_mb: int | None = None, software: str | None = None, *, as_of=None,
) -> DataFrame:
    """One flag per rule and ``eligible`` when all of them hold.

    A rule is NULL when a column it compares is NULL; as in the source's
    three-valued logic such a database is not eligible.
    """
    kind = F.col("current_backup_type")
    in_group = F.col("availability_group").isNotNull()
    not_primary = (F.col("availability_group_role") != "PRIMARY") | F.col("availability_group_role").isNull()
    not_preferred = (F.col("is_preferred_backup_replica") != 1) | F.col("is_preferred_backup_replica").isNull()
    const = lambda b: F.lit(bool(b))
    full_log = F.col("recovery_model_desc").isin("FULL", "BULK_LOGGED")
    blocked = {
        "single_user": F.col("user_access") == "SINGLE_USER",
        "standby": F.col("in_standby") == 1,
        "log_simple": (kind == "LOG") & (F.col("recovery_model_desc") == "SIMPLE"),
        "log_no_chain": (kind == "LOG") & full_log & F.col("log_lsn").isNull(),
        "diff_no_base": (kind == "DIFF") & F.col("differential_base_lsn").isNull(),
        "master": kind.isin("DIFF", "LOG") & (F.lower("name") == "master"),
        "ag_full": in_group & (kind == "FULL") & const(not copy_only) & not_primary,
        "ag_full_copy": in_group & (kind == "FULL") & const(copy_only) & not_preferred & const(not override_preference),
        "ag_diff": in_group & (kind == "DIFF") & not_primary,
        "ag_log": in_group & (kind == "LOG") & const(not copy_only) & not_preferred & const(not override_preference),
        "ag_log_copy": in_group & (kind == "LOG") & const(copy_only) & not_primary,
        "log_shipped": (F.col("log_shipping_role") == "PRIMARY") & F.col("log_shipping_role").isNotNull() & (kind == "LOG") & const(exclude_log_shipped),
        "read_only": (F.col("is_read_only") == 1) & const(updateability == "READ_WRITE"),
        "read_write": (F.col("is_read_only") == 0) & const(updateability == "READ_ONLY"),
        "read_only_appliance": (kind == "LOG") & const(updateability == "READ_ONLY") & const(software == "DATA_DOMAIN_BOOST"),
    }
    if log_size_mb is not None and log_seconds is not None:
        since = boundaries("SECOND", "last_log_backup", F.lit(as_of).cast("timestamp_ntz"))
        due = (
            (F.col("log_size_since_last_log_backup") >= log_size_mb) | F.col("log_size_since_last_log_backup").isNull()
            | (since >= log_seconds) | F.col("last_log_backup").isNull()
        )
        blocked["log_not_due"] = (kind == "LOG") & ~due
    if min_diff_size_mb is not None:
        blocked["diff_small"] = (kind == "DIFF") & (_database_bytes() < min_diff_size_mb * MB)
    rules = {"allow_online": F.col("state_desc") == "ONLINE", **{f"allow_{n}": ~c for n, c in blocked.items()}}
    out = db_state.withColumns(rules)
    everything = F.lit(True)
    for name in rules:
        everything = everything & F.col(name)
    return out.withColumn("eligible", F.coalesce(everything, F.lit(False)))


def backup_file_count(
    db_state: DataFrame, number_of_files: int | None = None, max_file_mb: int | None = None,
    min_multi_mb: int | None = None, directories: int = 1, software: str | None = None,
) -> DataFrame:
    """Expected backup size by type and the number of files to write it to."""
    limit = 32 if software in ("SQLBACKUP", "DATA_DOMAIN_BOOST") else 64
    kind = F.col("current_backup_type")
    size = (
        F.when(kind == "FULL", _database_bytes())
        .when(kind == "DIFF", big("modified_extent_page_count") * PAGE)
        .when(kind == "LOG", big(F.col("log_size_since_last_log_backup") * MB))
    )
    out = db_state.withColumn("backup_size", size)
    size, dirs = F.col("backup_size"), F.lit(directories).cast("bigint")
    files: Column
    if number_of_files is None and software == "DATA_DOMAIN_BOOST":
        files = F.lit(1)
    elif number_of_files is None and max_file_mb is None:
        files = dirs
    elif number_of_files == 1:
        files = F.lit(1)
    elif number_of_files is not None:
        enough = F.lit(min_multi_mb is None) if min_multi_mb is None else ((size >= min_multi_mb * MB) | size.isNull())
        files = F.when(enough, F.lit(number_of_files)).otherwise(dirs)
    else:
        each = int_div(size, directories)
        file_bytes = max_file_mb * MB
        needed = int_div(each, file_bytes) + F.when(each % file_bytes == 0, F.lit(0)).otherwise(F.lit(1))
        files = F.when(size.isNull() | (size == 0), dirs).otherwise(
            F.least(needed, F.lit(limit // directories).cast("bigint")) * dirs
        )
    return out.withColumn("number_of_files", files.cast("bigint"))


# --- order of work --------------------------------------------------------------------

# fixed values: accepted orders and the column each one sorts by
ORDER_COLUMNS = {
    "DATABASE_NAME": "name", "DATABASE_SIZE": "database_size",
    "LOG_SIZE_SINCE_LAST_LOG_BACKUP": "log_size_since_last_log_backup",
    "DATABASE_LAST_GOOD_CHECK": "last_good_check", "REPLICA_LAST_GOOD_CHECK": "last_command_time",
}


def work_order(
    selected: DataFrame, order_by: str | None = None, files: DataFrame | None = None, command_log: DataFrame | None = None
) -> DataFrame:
    """Number the selected databases of each server in the asked order.

    Without ``order_by`` the position in the selection decides.  Sizes come from
    ``files`` and check times from ``command_log`` when the order needs them.
    Ties are broken by name, and NULL sorts lowest.
    """
    k = shared_keys(selected)
    if order_by is None:
        return positions(selected, k, [F.col("start_position").asc(), F.col("name").asc()], "work_position")
    base, _, direction = order_by.rpartition("_")
    if base not in ORDER_COLUMNS or direction not in ("ASC", "DESC"):
        raise ValueError(f"unknown order {order_by!r}")
    column = ORDER_COLUMNS[base]
    df = selected
    if column == "database_size" and files is not None:
        sizes = files.filter(F.col("type") == 0).groupBy(*shared_keys(selected, files), "database_id").agg(
            F.sum(big("size_pages")).alias("database_size")
        )
        df = df.join(sizes, [*shared_keys(selected, files), "database_id"], "left")
    if column == "last_command_time" and command_log is not None:
        kc = shared_keys(selected, command_log)
        last = (
            command_log.filter((F.col("command_type") == "DBCC_CHECKDB") & (F.col("error_number") == 0))
            .groupBy(*kc, F.col("database_name").alias("name")).agg(F.max("start_time").alias("last_command_time"))
        )
        df = df.join(last, [*kc, "name"], "left")
    first = F.col(column).asc() if direction == "ASC" else F.col(column).desc()
    return positions(df, k, [first] if column == "name" else [first, F.col("name").asc()], "work_position")


def index_work_order(index_rows: DataFrame) -> DataFrame:
    """Order of the index and statistics work inside each database."""
    k = shared_keys(index_rows, scope=DATABASE)
    df = index_rows.withColumn("_paused", F.coalesce(F.col("resumable_index_operation"), F.lit(0)))
    df = df.withColumn("_no_type", F.when(F.col("index_type").isNull(), 1).otherwise(0))
    order = [
        F.col("_paused").desc(), *[F.col(c).asc() for c in (
            "start_position", "schema_name", "object_name", "_no_type", "index_type", "index_name", "statistics_name", "partition_number",
        )],
    ]
    return positions(df, k, order, "work_position").drop("_paused", "_no_type")


# --- index and statistics work list -------------------------------------------------------

INDEX = ["object_id", "index_id"]
_IMAGE = ("image", "text", "ntext")
_LARGE = ("varchar", "nvarchar", "varbinary")


def index_capability_flags(
    indexes: DataFrame, objects: DataFrame, schemas: DataFrame, tables: DataFrame, columns: DataFrame,
    index_columns: DataFrame, filegroups: DataFrame, resumable: DataFrame, partitions: DataFrame, stats: DataFrame,
    partition_level: bool = False, ms_shipped: bool = False,
) -> DataFrame:
    """Indexes and column statistics to consider, with 0/1 flags for what they hold.

    Every existence test is one aggregate per object or per index, joined back
    once, instead of a subquery per row.
    """
    k = shared_keys(indexes, objects, schemas, tables, columns, index_columns, partitions, stats, scope=DATABASE)
    flag = lambda cond: F.max(F.when(cond, 1).otherwise(0))
    kind = F.lower("type_name")
    large = (kind == "xml") | (kind.isin(*_LARGE) & (F.col("max_length") == -1))
    assembly = (F.col("is_assembly_type") == 1) if has(columns, "is_assembly_type") else F.lit(False)

    per_object = columns.groupBy(*k, "object_id").agg(
        flag(kind.isin(*_IMAGE)).alias("_o_image"), flag(large | assembly).alias("_o_large"),
        flag(F.col("is_filestream") == 1).alias("_o_stream"),
    )
    in_key = (F.col("key_ordinal") > 0) | (F.col("partition_ordinal") > 0)
    per_index = index_columns.join(columns, [*k, "object_id", "column_id"]).groupBy(*k, *INDEX).agg(
        flag(large | assembly).alias("_i_large"), flag(in_key & (F.col("is_computed") == 1)).alias("_i_computed"),
        flag(kind == "timestamp").alias("_i_stamp"),
    )
    siblings = indexes.groupBy(*k, "object_id").agg(
        flag(F.col("type").isin(5, 6)).alias("has_columnstore"),
        flag((F.col("type") == 1) & (F.col("is_disabled") == 1)).alias("_clustered_off"),
    )
    clustered = (
        indexes.filter(F.col("type") == 1).select(*k, *INDEX).join(per_index, [*k, *INDEX])
        .groupBy(*k, "object_id").agg(F.max("_i_computed").alias("_c_computed"))
    )
    kf = shared_keys(indexes, filegroups, scope=DATABASE)
    frozen = filegroups.filter(F.col("is_read_only") == 1).select(*kf, "data_space_id").distinct()
    table_props = tables.select(*k, "object_id", "is_memory_optimized", *optional(tables, "lob_data_space_id"))
    wanted_objects = objects.filter(F.rtrim("type").isin("U", "V"))
    if not ms_shipped:
        wanted_objects = wanted_objects.filter(F.col("is_ms_shipped") == 0)
    named = (
        wanted_objects.select(*k, "object_id", F.col("name").alias("object_name"), F.rtrim("type").alias("object_type"), "schema_id")
        .join(schemas.select(*k, "schema_id", F.col("name").alias("schema_name")), [*k, "schema_id"])
        .join(table_props, [*k, "object_id"], "left")
    )
    kr = shared_keys(indexes, resumable, scope=DATABASE)
    paused = resumable.filter(F.col("state_desc") == "PAUSED").select(*kr, *INDEX).distinct().withColumn("_paused", F.lit(1))
    own_stats = stats.select(
        *k, "object_id", F.col("stats_id").alias("index_id"), F.col("stats_id").alias("statistics_id"),
        F.col("name").alias("statistics_name"), "no_recompute", "is_incremental",
    )
    usable = indexes.filter(F.col("type").isin(1, 2, 3, 4, 5, 6, 7) & (F.col("is_disabled") == 0))
    if has(indexes, "is_hypothetical"):
        usable = usable.filter(F.col("is_hypothetical") == 0)
    rows = (
        usable.withColumnsRenamed({"name": "index_name", "type": "index_type"})
        .join(named, [*k, "object_id"])
        .join(per_object, [*k, "object_id"], "left").join(per_index, [*k, *INDEX], "left")
        .join(siblings, [*k, "object_id"], "left").join(clustered, [*k, "object_id"], "left")
        .join(frozen.withColumn("_frozen", F.lit(1)), [*kf, "data_space_id"], "left")
        .join(paused, [*kr, *INDEX], "left").join(own_stats, [*k, *INDEX], "left")
    )
    lob_frozen = F.lit(0)
    if has(tables, "lob_data_space_id"):
        rows = rows.join(frozen.select(*kf, F.col("data_space_id").alias("lob_data_space_id"), F.lit(1).alias("_lob_frozen")), [*kf, "lob_data_space_id"], "left")
        lob_frozen = F.coalesce("_lob_frozen", F.lit(0))
    if partition_level:
        pieces = partitions.select(*k, *INDEX, "partition_id", "partition_number")
        counts = partitions.groupBy(*k, *INDEX).agg(F.countDistinct("partition_number").alias("partition_count"))
        rows = rows.join(pieces, [*k, *INDEX], "left").join(counts, [*k, *INDEX], "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("bigint") for c in ("partition_id", "partition_number", "partition_count")})
    is_clustered, zero = F.col("index_type") == 1, F.lit(0)
    on = lambda cond, c: F.when(cond, F.coalesce(c, zero)).otherwise(zero)
    index_rows = rows.select(
        *k, "schema_name", "object_id", "object_name", "object_type",
        F.coalesce("is_memory_optimized", zero).alias("is_memory_optimized"),
        "index_id", "index_name", "index_type", "allow_page_locks", "has_filter",
        on(is_clustered, F.col("_o_image")).alias("is_image_text"),
        F.when(is_clustered, F.coalesce("_o_large", zero)).otherwise(on(F.col("index_type") == 2, F.col("_i_large"))).alias("is_new_lob"),
        on(is_clustered, F.col("_o_stream")).alias("is_filestream"),
        F.coalesce("has_columnstore", zero).alias("has_columnstore"),
        F.coalesce("_i_computed", zero).alias("is_computed"),
        F.coalesce("_c_computed", zero).alias("is_clustered_index_computed"),
        F.coalesce("_i_stamp", zero).alias("is_timestamp"),
        F.greatest(F.coalesce("_frozen", zero), on(is_clustered, lob_frozen)).alias("on_read_only_filegroup"),
        F.coalesce("_paused", zero).alias("resumable_index_operation"),
        "statistics_id", "statistics_name", "no_recompute", "is_incremental",
        "partition_id", "partition_number", "partition_count",
    )
    column_stats = (
        stats.join(indexes.select(*k, "object_id", F.col("index_id").alias("stats_id")), [*k, "object_id", "stats_id"], "left_anti")
        .join(siblings.filter(F.col("_clustered_off") == 1).select(*k, "object_id"), [*k, "object_id"], "left_anti")
        .join(named, [*k, "object_id"])
        .filter(F.coalesce("is_memory_optimized", zero) == 0)
        .select(*k, "schema_name", "object_id", "object_name", "object_type", F.lit(0).alias("is_memory_optimized"),
                F.col("stats_id").alias("statistics_id"), F.col("name").alias("statistics_name"), "no_recompute", "is_incremental")
    )
    return index_rows.unionByName(column_stats, allowMissingColumns=True)


# fixed values: the actions and the editions that can rebuild online
REORGANIZE, ONLINE, OFFLINE = "INDEX_REORGANIZE", "INDEX_REBUILD_ONLINE", "INDEX_REBUILD_OFFLINE"
ONLINE_EDITIONS = (3, 5, 8)


def _actions(listed: str | None) -> list[str]:
    return [a.strip() for a in listed.split(",") if a.strip()] if listed else []


def _zero(frame: DataFrame, column: str) -> Column:
    return F.col(column) if has(frame, column) else F.lit(0)


def index_maintenance_plan(
    index_stats: DataFrame, low: str | None = None, medium: str | None = f"{REORGANIZE},{ONLINE},{OFFLINE}",
    high: str | None = f"{ONLINE},{OFFLINE}", level1: int = 5, level2: int = 30, min_pages: int = 1000,
    max_pages: int | None = None, edition: int = 3, version: float = 16, max_dop: int | None = None,
) -> DataFrame:
    """Fragmentation band, allowed actions and the first preferred one that is allowed.

    ``index_stats`` has one row per index (or partition) with its fragmentation,
    page count and capability flags.  NULL action means nothing to do.
    """
    frag, pages = F.col("avg_fragmentation_in_percent"), F.col("page_count")
    frozen = _zero(index_stats, "on_read_only_filegroup") == 1
    in_memory = _zero(index_stats, "is_memory_optimized") == 1
    page_locks_off = F.col("allow_page_locks") == 0
    kind, paused = F.col("index_type"), _zero(index_stats, "resumable_index_operation") == 1
    writable = ~frozen & ~in_memory
    online = writable & F.lit(edition in ONLINE_EDITIONS)
    not_online = [
        (kind == 1) & (_zero(index_stats, "is_image_text") == 1),
        (kind == 1) & (_zero(index_stats, "is_filestream") == 1),
        kind.isin(3, 4),
    ]
    columnstore = _zero(index_stats, "has_columnstore") == 1
    by_version = [
        (12, _zero(index_stats, "is_partition") == 1),
        (11, kind.isin(1, 2) & (_zero(index_stats, "is_new_lob") == 1)),
        (15, kind == 5), (14, kind == 6), (13, (kind == 1) & columnstore), (15, (kind == 2) & columnstore),
    ]
    for cond in not_online + [cond for needs, cond in by_version if version < needs]:
        online = online & ~cond
    allowed = {REORGANIZE: writable & ~page_locks_off, OFFLINE: writable, ONLINE: online}
    lists = {"Low": _actions(low), "Medium": _actions(medium), "High": _actions(high)}
    first = lambda wanted: F.coalesce(
        *[F.when(allowed[a], F.lit(a)) for a in wanted if a in allowed], F.lit(None).cast("string")
    )
    band = F.when(~frozen, F.when(frag >= level2, F.lit("High")).when(frag >= level1, F.lit("Medium")).when(frag < level1, F.lit("Low")))
    if lists["Low"] == lists["Medium"] == lists["High"]:
        choice = first(lists["High"])  # equal preferences: the band does not matter
    else:
        choice = F.lit(None).cast("string")
        for name, wanted in lists.items():
            choice = F.when(F.col("fragmentation_group") == name, first(wanted)).otherwise(choice)
    in_bounds = ((pages >= min_pages) | F.lit(min_pages == 0)) & (F.lit(True) if max_pages is None else pages <= max_pages)
    any_action = any(lists.values())
    out = index_stats.withColumns({
        "fragmentation_group": band if any_action else F.lit(None).cast("string"),
        **{f"allow_{a.removeprefix('INDEX_').lower()}": c for a, c in allowed.items()},
    })
    out = out.withColumn(
        "action",
        F.when(paused, F.lit(ONLINE)).when(F.lit(any_action) & in_bounds, choice),
    )
    dop = F.lit(max_dop).cast("int")
    return out.withColumn("max_dop", F.when((F.col("action") == ONLINE) & page_locks_off, F.lit(1)).otherwise(dop))


def statistics_update_plan(
    stats: DataFrame, mode: str | None = "ALL", only_modified: bool = False, modification_level: int | None = None,
    edition: int = 3, version: float = 16, partition_level_statistics: bool = False,
) -> DataFrame:
    """Whether each statistic is updated (Y/N), after the index action is known."""
    own_index = F.col("index_id").isNotNull()
    row_index = F.col("index_type").isin(1, 2, 3, 4, 7)
    scope = {
        "ALL": F.coalesce(row_index, F.lit(False)) | ~own_index, "INDEX": own_index & row_index, "COLUMNS": ~own_index,
    }.get(mode, F.lit(False))
    changed, rows = big("modification_counter"), big("row_count")
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  the square of a large counter leaves BIGINT
    need = F.lit(not only_modified and modification_level is None) | (F.lit(only_modified) & (changed > 0))
    if modification_level is not None:
        need = need | ((rows > 0) & (wide(changed) * 100 >= wide(rows) * modification_level)) | (
            (changed > 0) & (wide(changed) * wide(changed) >= wide(rows) * 1000)
        )
    if not (version >= 13 or edition in (5, 8)):
        need = need | (_zero(stats, "is_memory_optimized") == 1)
    rebuilt = F.col("action").isin(ONLINE, OFFLINE) & F.col("action").isNotNull()
    partitioned = _zero(stats, "is_partition") == 1
    last_part = F.col("partition_number") == F.col("partition_count") if has(stats, "partition_number", "partition_count") else F.lit(True)
    if partition_level_statistics:
        last_part = last_part | (F.col("is_incremental") == 1)
    timely = F.when(partitioned, last_part).otherwise(~rebuilt)
    go = F.col("statistics_id").isNotNull() & scope & need & timely
    return stats.withColumn("update_statistics", F.when(F.coalesce(go, F.lit(False)), F.lit("Y")).otherwise(F.lit("N")))


def command_text_plan(
    plan: DataFrame, sort_in_tempdb: bool = False, fill_factor: int | None = None, pad_index: bool = False,
    lob_compaction: bool = True, resumable: bool = False, version: float = 16, edition: int = 3,
    lock_timeout: int | None = None, statistics_sample: int | None = None, statistics_resample: bool = False,
    wait_minutes: int | None = None, abort_after_wait: str | None = None,
) -> DataFrame:
    """ALTER INDEX and UPDATE STATISTICS text of the chosen work.  Never executed."""
    action, kind = F.col("action"), F.col("index_type")
    paused = _zero(plan, "resumable_index_operation") == 1
    partition = _zero(plan, "is_partition") == 1
    rebuild, online = action.isin(ONLINE, OFFLINE), action == ONLINE
    fresh, row_index = ~paused, kind.isin(1, 2, 3, 4)
    # which WITH arguments apply is one array per row; NULL entries are dropped
    can_resume = (
        kind.isin(1, 2) & (_zero(plan, "is_computed") == 0) & (_zero(plan, "is_clustered_index_computed") == 0)
        & (_zero(plan, "is_timestamp") == 0) & (_zero(plan, "has_filter") == 0)
    )
    low_priority = ""
    if wait_minutes is not None:
        low_priority = f" (WAIT_AT_LOW_PRIORITY (MAX_DURATION = {int(wait_minutes)}, ABORT_AFTER_WAIT = {(abort_after_wait or 'NONE').upper()}))"
    whole = ~partition | F.lit(version >= 12)
    options = [
        F.when(rebuild & row_index & fresh, F.lit(f"SORT_IN_TEMPDB = {'ON' if sort_in_tempdb else 'OFF'}")),
        F.when(online & whole & fresh, F.lit("ONLINE = ON" + low_priority)),
        F.when((action == OFFLINE) & whole & fresh, F.lit("ONLINE = OFF")),
        F.when(rebuild & F.col("max_dop").isNotNull(), F.concat(F.lit("MAXDOP = "), text("max_dop"))),
    ]
    if fill_factor is not None:
        options.append(F.when(rebuild & ~partition & row_index & fresh, F.lit(f"FILLFACTOR = {int(fill_factor)}")))
    if pad_index:
        options.append(F.when(rebuild & ~partition & row_index & fresh, F.lit("PAD_INDEX = ON")))
    if version >= 14 or edition in (5, 8):
        options.append(F.when(online & fresh, F.when(F.lit(resumable) & can_resume, F.lit("RESUMABLE = ON")).otherwise(F.lit("RESUMABLE = OFF"))))
    options.append(F.when(action == REORGANIZE, F.lit(f"LOB_COMPACTION = {'ON' if lob_compaction else 'OFF'}")))

    def clause(items: list[Column], left: str, right: str) -> Column:
        present = F.array_compact(F.array(*items))
        return F.when(F.size(present) > 0, F.concat(F.lit(left), F.array_join(present, ", "), F.lit(right))).otherwise(F.lit(""))

    timeout = F.lit(f"SET LOCK_TIMEOUT {lock_timeout * 1000}; " if lock_timeout is not None else "")
    target = F.concat(quote("schema_name"), F.lit("."), quote("object_name"))
    part_text = F.when(partition & fresh, F.concat(F.lit(" PARTITION = "), text("partition_number"))) if has(plan, "partition_number") else F.lit("")
    verb = F.when(paused, F.lit(" RESUME")).when(rebuild, F.lit(" REBUILD")).when(action == REORGANIZE, F.lit(" REORGANIZE"))
    index_text = F.concat(
        timeout, F.lit("ALTER INDEX "), quote("index_name"), F.lit(" ON "), target, verb, F.coalesce(part_text, F.lit("")),
        clause(options, " WITH (", ")"),
    )
    stat_options: list[Column] = []
    sees_dop = 12.06024 <= version < 13 or 13.05026 <= version < 14 or version >= 14.030154
    if sees_dop:
        stat_options.append(F.when(F.col("max_dop").isNotNull(), F.concat(F.lit("MAXDOP = "), text("max_dop"))))
    if statistics_sample is not None:
        stat_options.append(F.lit("FULLSCAN" if statistics_sample == 100 else f"SAMPLE {int(statistics_sample)} PERCENT"))
    if has(plan, "no_recompute"):
        stat_options.append(F.when(F.col("no_recompute") == 1, F.lit("NORECOMPUTE")))
    if statistics_resample:
        stat_options.append(F.lit("RESAMPLE"))
    out = plan.withColumn("index_command", F.when(action.isNotNull(), index_text))
    if has(plan, "update_statistics"):
        stat_text = F.concat(timeout, F.lit("UPDATE STATISTICS "), target, F.lit(" "), quote("statistics_name"),
                             clause(stat_options, " WITH ", "") if stat_options else F.lit(""))
        out = out.withColumn("statistics_command", F.when(F.col("update_statistics") == "Y", stat_text))
    return out
