"""Indexes, objects, files, buffer pool and plan cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from fleetlens.functions.fleet import DATABASE, SYSTEM_DATABASES, existing, has, optional, shared_keys
from fleetlens.functions.tsql import (
    big, blank_if_null, guarded_div, int_div, last_name_part, pages_to_mb, quote, ratio, text,
)

INDEX = ["object_id", "index_id"]


def _tables_with_schema(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """(keys, object_id, table_name, schema_name) for every table that has a schema row."""
    k = shared_keys(tables, schemas, scope=DATABASE)
    return tables.select(
        *k, "object_id", F.col("name").alias("table_name"), "schema_id",
        *optional(tables, "is_ms_shipped", "is_tracked_by_cdc", "is_memory_optimized"),
    ).join(schemas.select(*k, "schema_id", F.col("name").alias("schema_name")), [*k, "schema_id"])


# --- indexes -----------------------------------------------------------------


def index_physical_detail(
    phys: DataFrame, indexes: DataFrame, tables: DataFrame, schemas: DataFrame,
    min_frag: float | None = None, named_only: bool = False,
) -> DataFrame:
    """Physical index statistics with index, table and schema names."""
    k = shared_keys(phys, indexes, tables, schemas, scope=DATABASE)
    named = indexes.select(*k, *INDEX, F.col("name").alias("index_name"), *optional(indexes, "fill_factor", "type_desc"))
    if named_only:
        named = named.filter(F.col("index_name").isNotNull())
    if min_frag is not None:
        phys = phys.filter(F.col("avg_fragmentation_in_percent") > min_frag)
    return phys.join(named, [*k, *INDEX]).join(_tables_with_schema(tables, schemas), [*k, "object_id"])


def index_fragmentation_alert(detail: DataFrame, frag_pct: float = 50, min_pages: int = 100) -> DataFrame:
    """Fragmented indexes of a worthwhile size.  Staged numbers may be text, so
    both are compared as numbers."""
    return detail.filter(
        (F.col("avg_fragmentation_in_percent").try_cast("double") > frag_pct)
        & (F.col("page_count").try_cast("bigint") > min_pages)
    )


def indexes_unused(indexes: DataFrame, usage: DataFrame) -> DataFrame:
    """Indexes without any usage row in their database."""
    own = ["database_id"] if has(indexes, "database_id") and has(usage, "database_id") else []
    keys = [*shared_keys(indexes, usage, scope=DATABASE), *own, *INDEX]
    return indexes.join(existing(usage, keys), keys, "left_anti")


def index_last_usage(
    usage: DataFrame, indexes: DataFrame, index_columns: DataFrame, tables: DataFrame | None = None,
    table_like: str | None = None,
) -> DataFrame:
    """Latest seek, scan, lookup and update per index that has key columns.

    MAX is the same with or without the column fan-out, so usage is aggregated
    first and the columns only act as an existence test.
    """
    k = shared_keys(usage, indexes, index_columns, scope=DATABASE)
    if has(usage, "database_name"):
        usage = usage.filter(~F.lower("database_name").isin(*SYSTEM_DATABASES))
    moments = optional(usage, "last_user_seek", "last_user_scan", "last_user_lookup", "last_user_update")
    last = usage.groupBy(*k, *INDEX).agg(*[F.max(c).alias(c) for c in moments])
    out = last.join(indexes.select(*k, *INDEX, F.col("name").alias("index_name")), [*k, *INDEX]).join(
        existing(index_columns, [*k, *INDEX]), [*k, *INDEX], "left_semi"
    )
    if tables is not None:
        names = tables.select(*k, "object_id", F.col("name").alias("table_name"))
        if table_like:
            names = names.filter(F.col("table_name").like(table_like))
        out = out.join(names, [*k, "object_id"])
    return out


def missing_index_advice(
    groups: DataFrame, group_stats: DataFrame, details: DataFrame, min_measure: float = 10
) -> DataFrame:
    """Improvement measure and CREATE INDEX text for suggested indexes."""
    k = shared_keys(groups, group_stats, details)
    weight = (
        F.col("avg_total_user_cost").cast("double") * (F.col("avg_user_impact").cast("double") / 100.0)
        * (big("user_seeks") + big("user_scans"))
    )
    worthwhile = group_stats.select(
        *k, F.col("group_handle").alias("index_group_handle"), weight.alias("improvement_measure")
    ).filter(F.col("improvement_measure") > min_measure)
    eq, ineq = F.col("equality_columns"), F.col("inequality_columns")
    both = F.when(eq.isNotNull() & ineq.isNotNull(), F.lit(",")).otherwise(F.lit(""))
    create = F.concat(
        F.lit("CREATE INDEX [missing_index_"), text("index_group_handle"), F.lit("_"), text("index_handle"), F.lit("_"),
        last_name_part("statement"), F.lit("] ON "), F.col("statement"), F.lit(" ("),
        blank_if_null(eq), both, blank_if_null(ineq), F.lit(")"),
        F.coalesce(F.concat(F.lit(" INCLUDE ("), F.col("included_columns"), F.lit(")")), F.lit("")),
    )
    return (
        groups.join(worthwhile, [*k, "index_group_handle"])
        .join(details, [*k, "index_handle"])
        .withColumn("create_index_statement", create)
    )


# Only the parts of a showplan document that the report reads.  Attributes are
# named with a leading underscore by the XML reader.
SHOWPLAN = """
BatchSequence STRUCT<Batch: ARRAY<STRUCT<Statements: ARRAY<STRUCT<StmtSimple: ARRAY<STRUCT<
  _StatementText: STRING,
  QueryPlan: STRUCT<
    _CachedPlanSize: INT, _CompileTime: INT, _CompileCPU: INT, _CompileMemory: INT,
    MissingIndexes: STRUCT<MissingIndexGroup: ARRAY<STRUCT<
      _Impact: DOUBLE,
      MissingIndex: ARRAY<STRUCT<
        _Database: STRING, _Schema: STRING, _Table: STRING,
        ColumnGroup: ARRAY<STRUCT<_Usage: STRING, Column: ARRAY<STRUCT<_Name: STRING>>>>>>>>>>>>>>>>>
"""


def _all(elements: Column, field: str) -> Column:
    """The elements of the arrays ``field`` of all structs; a missing array has none
    (``flatten`` would make the whole result null)."""
    return F.flatten(F.filter(F.transform(elements, lambda e: e[field]), lambda a: a.isNotNull()))


def _usage_columns(groups: Column, usage: str) -> Column:
    """Sorted distinct column names of one usage over all missing-index groups; NULL when none."""
    column_groups = _all(_all(groups, "MissingIndex"), "ColumnGroup")
    picked = F.filter(column_groups, lambda c: c["_Usage"] == usage)
    names = F.array_sort(F.array_compact(F.array_distinct(F.transform(_all(picked, "Column"), lambda n: n["_Name"]))))
    return F.when(F.size(names) > 0, names)


def missing_index_from_plans(query_stats: DataFrame, plans_xml: DataFrame, engine_edition: int | str = 2) -> DataFrame:
    """One row per cached statement whose plan carries a missing-index hint.

    ``engine_edition`` is a number, or the column of ``query_stats`` that holds
    it where servers differ; edition 3 can build indexes online.
    """
    k = [*shared_keys(query_stats, plans_xml), "plan_handle"]
    # a plain search spares the parser the plans without a hint; any white space may follow the name
    hinted = plans_xml.filter(F.col("query_plan").contains("<MissingIndex")).select(*k, "query_plan")
    batches = hinted.select(*k, F.from_xml("query_plan", SHOWPLAN, {"mode": "PERMISSIVE"}).alias("plan"))
    statements = batches.select(
        *k,
        F.explode(
            _all(_all(F.col("plan.BatchSequence.Batch"), "Statements"), "StmtSimple")
        ).alias("st"),
    )
    found = statements.select(
        *k, F.col("st._StatementText").alias("sql_text"),
        F.col("st.QueryPlan").alias("qp"),
        F.col("st.QueryPlan.MissingIndexes.MissingIndexGroup").alias("groups"),
    ).filter(F.size(_all(F.col("groups"), "MissingIndex")) > 0)
    first = F.get(_all(F.col("groups"), "MissingIndex"), 0)
    parsed = found.select(
        *k, "sql_text",
        F.get("groups", 0)["_Impact"].alias("impact_pct"),
        F.col("qp._CachedPlanSize").alias("cached_plan_size_kb"),
        F.col("qp._CompileTime").alias("compile_time_ms"),
        F.col("qp._CompileCPU").alias("compile_cpu_ms"),
        F.col("qp._CompileMemory").alias("compile_memory_kb"),
        F.concat_ws(".", first["_Database"], first["_Schema"], first["_Table"]).alias("object"),
        _usage_columns(F.col("groups"), "EQUALITY").alias("eq"),
        _usage_columns(F.col("groups"), "INEQUALITY").alias("ineq"),
        _usage_columns(F.col("groups"), "INCLUDE").alias("incl"),
    )

    def name_part(c: str) -> Column:
        plain = F.regexp_replace(F.array_join(c, "_"), r"[\[\]]", "")
        return F.coalesce(F.concat(F.lit("_"), plain), F.lit(""))

    edition = F.col(engine_edition) if isinstance(engine_edition, str) else F.lit(engine_edition)
    empty = F.array().cast("array<string>")
    keys = F.concat(F.coalesce("eq", empty), F.coalesce("ineq", empty))
    create = F.concat(
        F.lit("CREATE NONCLUSTERED INDEX "),
        quote(F.concat(F.lit("IX"), name_part("eq"), name_part("ineq"), name_part("incl"))),
        F.lit(" ON "), F.col("object"),
        F.when(F.size(keys) > 0, quote(F.array_join(keys, ","), "(", ")")),
        F.coalesce(
            F.concat(F.lit(" INCLUDE "), quote(F.replace(F.array_join("incl", ","), F.lit("@"), F.lit("")), "(", ")")),
            F.lit(""),
        ),
        F.when(edition == 3, F.lit(" WITH (ONLINE = ON);")).otherwise(F.lit(";")),
    )
    times = [c for c in query_stats.columns if c.endswith(("_worker_time", "_clr_time", "_elapsed_time"))]
    stats = query_stats.select(
        *k,
        *[c for c in query_stats.columns if c not in times and c not in k],
        *[ratio(c, 1000, 28, 3).alias(f"{c}_ms") for c in times],
    )
    return parsed.join(stats, k).withColumn("missing_index_creation", create).drop("eq", "ineq", "incl")


def index_key_pivot(
    index_keys: DataFrame, indexes: DataFrame | None = None, tables: DataFrame | None = None,
    schemas: DataFrame | None = None, alloc_counts: DataFrame | None = None, max_cols: int = 16,
) -> DataFrame:
    """Key columns side by side (``col1 .. colN``, empty when absent), and all of them in
    order in the array ``key_columns``, however many there are.

    With the catalog frames given, also the clustered key type and its default or
    identity mark, size, page-split proxy and the DISABLE / REBUILD text.
    """
    k = shared_keys(index_keys, *[f for f in (indexes, tables) if f is not None], scope=DATABASE)
    first = F.col("keyno") == 1
    aggregates = [
        F.coalesce(F.min(F.when(F.col("keyno") == n, F.col("col"))), F.lit("")).alias(f"col{n}")
        for n in range(1, max_cols + 1)
    ]
    keyed = F.array_sort(F.collect_set(F.struct("keyno", "col")))
    aggregates.append(F.transform(keyed, lambda x: x["col"]).alias("key_columns"))
    if has(index_keys, "type_name"):
        sized = F.when(
            F.col("type_name").isin("nvarchar", "varchar", "char", "nchar"),
            F.concat("type_name", F.lit("("), text("max_length"), F.lit(")")),
        ).otherwise(F.col("type_name"))
        aggregates.append(F.min(F.when(first, sized)).alias("key_type"))
        mark = F.when(F.col("is_identity") == 1, F.lit("IDENTITY"))
        aggregates.append(F.min(F.when(first, F.coalesce(F.col("default_definition"), mark))).alias("key_mark"))
    out = index_keys.groupBy(*k, *INDEX).agg(*aggregates)
    if indexes is None:
        return out
    props = indexes.select(
        *k, *INDEX, F.col("name").alias("index_name"),
        *optional(indexes, "fill_factor", "is_disabled", "rows", "used_pages"),
    )
    out = props.join(out, [*k, *INDEX]).na.fill("", [f"col{n}" for n in range(1, max_cols + 1)])
    if has(out, "key_type"):
        out = out.withColumn(
            "cl",
            F.when(F.col("index_id") == 1, F.concat(F.lit("CL: "), blank_if_null("key_type"), F.lit(" "), blank_if_null("key_mark")))
            .otherwise(F.lit("NC")),
        ).drop("key_type", "key_mark")
    if has(out, "used_pages"):
        out = out.withColumn("size_mb", pages_to_mb("used_pages"))
    if alloc_counts is not None:
        out = out.join(alloc_counts.select(*k, *INDEX, "alloc_count"), [*k, *INDEX], "left").na.fill(0, ["alloc_count"])
    if tables is not None and schemas is not None:
        out = out.join(_tables_with_schema(tables, schemas), [*k, "object_id"])
        target = F.concat(F.lit("ALTER INDEX "), blank_if_null("index_name"), F.lit(" ON "), "schema_name", F.lit("."), "table_name")
        out = out.withColumns({
            "disable_text": F.concat(target, F.lit(" DISABLE;")),
            "rebuild_text": F.concat(target, F.lit(" REBUILD;")),
        })
    return out.withColumn("index_name", F.coalesce("index_name", F.lit("!! HEAP !!")))


def index_alloc_counts(operational_stats: DataFrame) -> DataFrame:
    """Page allocations per index, a proxy for page splits."""
    k = shared_keys(operational_stats, scope=DATABASE)
    zero = F.lit(0).cast("bigint")
    both = F.coalesce(big("leaf_allocation_count"), zero) + F.coalesce(big("nonleaf_allocation_count"), zero)
    return operational_stats.groupBy(*k, *INDEX).agg(F.sum(both).alias("alloc_count"))


def table_size_rollup(
    tables: DataFrame, indexes: DataFrame, alloc_units: DataFrame, schemas: DataFrame, reference_fanout: bool = False
) -> DataFrame:
    """Heap or clustered pages and nonclustered megabytes per table.

    ``reference_fanout`` repeats the nonclustered size once per allocation unit,
    as the old report did.
    """
    k = shared_keys(tables, indexes, alloc_units, schemas, scope=DATABASE)
    units = alloc_units.groupBy(*k, F.col("container_id").alias("partition_id")).agg(
        F.sum("total_pages").alias("total_pages"), F.sum("used_pages").alias("used_pages"),
        F.sum("data_pages").alias("data_pages"), F.count(F.lit(1)).alias("_units"),
    )
    sized = indexes.select(
        *k, *INDEX, "partition_id", F.col("name").alias("index_name"), *optional(indexes, "rows")
    ).join(units, [*k, "partition_id"])
    nonclustered = (
        sized.filter(F.col("index_id") > 1).groupBy(*k, "object_id")
        .agg(int_div(F.sum("used_pages") * 8, 1024).alias("_nc_mb"))
    )
    base = sized.filter(F.col("index_id") <= 1).groupBy(*k, *INDEX, "index_name", *optional(sized, "rows")).agg(
        *[F.sum(c).alias(c) for c in ("total_pages", "used_pages", "data_pages", "_units")]
    )
    extra = F.coalesce(F.col("_nc_mb"), F.lit(0).cast("bigint"))
    return (
        base.join(nonclustered, [*k, "object_id"], "left")
        .join(_tables_with_schema(tables, schemas), [*k, "object_id"])
        .withColumns({
            "index_name": blank_if_null("index_name"),
            "total_mb": pages_to_mb("total_pages"), "used_mb": pages_to_mb("used_pages"),
            "data_mb": pages_to_mb("data_pages"),
            "indexes_mb": extra * F.col("_units") if reference_fanout else extra,
        })
        .drop("_nc_mb", "_units")
    )


def compression_status(partitions: DataFrame, tables: DataFrame, indexes: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Compression per partition: ``kind`` is table (heap or clustered) or index."""
    k = shared_keys(partitions, tables, indexes, scope=DATABASE)
    names = indexes.select(*k, *INDEX, F.col("name").alias("index_name"))
    # a nonclustered partition needs its index row, a table partition does not
    joined = partitions.join(tables.select(*k, "object_id", F.col("name").alias("table_name"), "schema_id"), [*k, "object_id"]).join(
        names.withColumn("_named", F.lit(True)), [*k, *INDEX], "left"
    ).filter((F.col("index_id") <= 1) | F.col("_named"))
    if schemas is not None:
        ks = shared_keys(partitions, schemas, scope=DATABASE)
        joined = joined.join(schemas.select(*ks, "schema_id", F.col("name").alias("schema_name")), [*ks, "schema_id"])
    is_table = F.col("index_id") <= 1
    return joined.select(
        *k, *INDEX, "table_name", *optional(joined, "schema_name"),
        F.when(is_table, F.lit("table")).otherwise(F.lit("index")).alias("kind"),
        F.when(~is_table, F.col("index_name")).alias("index_name"),
        *optional(joined, "partition_number"), "data_compression_desc",
    )


def compression_candidates(
    partitions: DataFrame, tables: DataFrame, schemas: DataFrame, alloc_units: DataFrame, indexes: DataFrame
) -> DataFrame:
    """Uncompressed tables and indexes with the statement that would compress them."""
    k = shared_keys(partitions, tables, schemas, alloc_units, indexes, scope=DATABASE)
    plain = partitions.filter(F.col("data_compression_desc") == "NONE").select(*k, *INDEX, "partition_id")
    owner = F.concat(F.lit("["), "schema_name", F.lit("].["), "table_name", F.lit("]"))
    located = plain.join(_tables_with_schema(tables, schemas), [*k, "object_id"])
    stored = alloc_units.select(*k, F.col("container_id").alias("partition_id")).distinct()
    table_rows = (
        located.filter(F.col("index_id") <= 1)
        .join(stored, [*k, "partition_id"], "left_semi")
        .select(*k, "schema_name", "table_name", F.lit(None).cast("string").alias("index_name"),
                F.concat(F.lit("ALTER TABLE "), owner, F.lit(" REBUILD WITH(DATA_COMPRESSION = PAGE )")).alias("script"))
    )
    index_rows = (
        located.filter(F.col("index_id") > 1)
        .join(indexes.select(*k, *INDEX, F.col("name").alias("index_name")), [*k, *INDEX])
        .select(*k, "schema_name", "table_name", "index_name",
                F.concat(F.lit("ALTER INDEX ["), "index_name", F.lit("] ON "), owner,
                         F.lit(" REBUILD WITH (SORT_IN_TEMPDB = ON, DATA_COMPRESSION = PAGE )")).alias("script"))
    )
    return table_rows.unionByName(index_rows).distinct()


# --- buffer pool and plan cache -------------------------------------------------


def buffer_pool_by_database(buffer_desc: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """Allocated, used and empty megabytes of the buffer pool per database."""
    k = shared_keys(buffer_desc, *([databases] if databases is not None else []))
    free = big("free_space_in_bytes")
    out = buffer_desc.groupBy(*k, "database_id").agg(
        int_div(F.count(F.lit(1)) * 8, 1024).alias("mb_allocated"),
        int_div(F.sum(F.lit(8 * 1024) - free), 1024 * 1024).alias("mb_used"),
        int_div(F.sum(free), 1024 * 1024).alias("mb_empty"),
    )
    resource = F.when(F.col("database_id") == 32767, F.lit("Resource Database"))
    if databases is None:
        return out.withColumn("database", resource)
    names = databases.select(*k, "database_id", F.col("name").alias("_name"))
    return out.join(names, [*k, "database_id"], "left").withColumn("database", F.coalesce(resource, "_name")).drop("_name")


def buffer_pool_by_index(
    buffer_desc: DataFrame, alloc_units: DataFrame, partitions: DataFrame, indexes: DataFrame
) -> DataFrame:
    """Buffer-pool megabytes and free space per index of user objects."""
    k = shared_keys(buffer_desc, alloc_units, partitions, indexes, scope=DATABASE)
    dirty, free = F.col("is_modified") == 1, big("free_space_in_bytes")
    one, zero = F.lit(1), F.lit(0)
    pages = buffer_desc.groupBy(*k, "allocation_unit_id").agg(
        F.sum(F.when(dirty, one).otherwise(zero)).alias("dirty_pages"),
        F.sum(F.when(dirty, zero).otherwise(one)).alias("clean_pages"),
        F.sum(F.when(dirty, free).otherwise(zero)).alias("dirty_free"),
        F.sum(F.when(dirty, zero).otherwise(free)).alias("clean_free"),
    )
    all_pages = F.col("dirty_pages") + F.col("clean_pages")
    all_free = F.col("dirty_free") + F.col("clean_free")
    return (
        pages.join(alloc_units.select(*k, "allocation_unit_id", F.col("container_id").alias("partition_id")), [*k, "allocation_unit_id"])
        .join(partitions.select(*k, "partition_id", *INDEX), [*k, "partition_id"])
        .join(indexes.select(*k, *INDEX, F.col("name").alias("index_name"), *optional(indexes, "fill_factor", "type_desc")), [*k, *INDEX])
        .filter(F.col("object_id") > 100)
        .withColumns({
            "total_mem_mb": ratio(all_pages * 8, 1024, 19, 6),
            "free_space_mb": ratio(all_free, 1024 * 1024, 19, 6),
            "free_space_pct": ratio(int_div(all_free, 1024) * 100, all_pages * 8, 4, 1),
        })
    )


# fixed values: counter and cache names read by the memory report
STOLEN_COUNTER = "Stolen Server Memory (KB)"
PLAN_CACHE_STORES = ("CACHESTORE_OBJCP", "CACHESTORE_SQLCP", "CACHESTORE_PHDR")


def memory_distribution(perf_counters: DataFrame, cache_counters: DataFrame, buffer_desc: DataFrame) -> DataFrame:
    """Stolen, plan-cache and buffer-pool megabytes, one row per server."""
    k = shared_keys(perf_counters, cache_counters, buffer_desc)
    stolen = perf_counters.filter(F.col("counter_name") == STOLEN_COUNTER).groupBy(*k).agg(
        int_div(F.max("cntr_value"), 1024).alias("mb")
    )
    plans = cache_counters.filter(F.col("type").isin(*PLAN_CACHE_STORES)).groupBy(*k).agg(
        int_div(F.sum("pages_kb"), 1024).alias("mb")
    )
    pool = buffer_desc.groupBy(*k).agg(int_div(F.count(F.lit(1)) * 8, 1024).alias("mb"))
    areas = {"stolen_mb": stolen, "plan_cache_mb": plans, "buffer_pool_mb": pool}
    stacked = None
    for name, df in areas.items():
        part = df.withColumn("area", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*k).agg(*[F.max(F.when(F.col("area") == a, F.col("mb"))).alias(a) for a in areas])


def plan_cache_reuse(cached_plans: DataFrame, buckets: str = "1/2/3+") -> DataFrame:
    """Plans by number of uses.  A bucket without plans still gives a row.

    ``"1/2/3+"``: count and megabytes; ``"1/>1"``: average use count (truncated),
    referencing objects and megabytes.
    """
    k = shared_keys(cached_plans)
    uses = F.col("usecounts")
    if buckets == "1/2/3+":
        bands = {"One_call": uses == 1, "Two_calls": uses == 2, "More_than_two": uses >= 3}
    elif buckets == "1/>1":
        bands = {"single_use": uses == 1, "reused": uses > 1}
    else:
        raise ValueError(f"unknown buckets {buckets!r}")
    aggregates = []
    for i, cond in enumerate(bands.values()):
        aggregates += [
            F.count(F.when(cond, 1)).alias(f"n{i}"),
            F.sum(F.when(cond, big("size_in_bytes"))).alias(f"b{i}"),
            F.sum(F.when(cond, big("refcounts"))).alias(f"r{i}"),
            F.sum(F.when(cond, big(uses))).alias(f"u{i}"),
        ]
    one_row = cached_plans.groupBy(*k).agg(*aggregates)
    bucket = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("bucket"), F.col(f"n{i}").alias("plan_count"),
            int_div(F.col(f"b{i}"), 1024 * 1024).alias("size_mb"),
            F.col(f"r{i}").alias("all_ref_objects"), int_div(F.col(f"u{i}"), F.col(f"n{i}")).alias("avg_usecount"),
        )
        for i, name in enumerate(bands)
    ]))
    out = one_row.select(*k, bucket.alias("b")).select(*k, "b.*")
    return out.drop("all_ref_objects", "avg_usecount") if buckets == "1/2/3+" else out


# --- files and databases ----------------------------------------------------------


def file_space_usage(files: DataFrame, filegroups: DataFrame) -> DataFrame:
    """Allocated, used and available megabytes per file, with its filegroup or 'Log'."""
    k = shared_keys(files, filegroups, scope=DATABASE)
    groups = filegroups.select(*k, F.col("groupid").alias("group_id"), F.col("groupname").alias("_group"))
    free = big("size_pages") - big("used_pages")
    allocated, available = ratio("size_pages", 128, 15, 2), ratio(free, 128, 15, 2)
    return files.join(groups, [*k, "group_id"], "left").withColumns({
        "file_group": F.coalesce("_group", F.lit("Log")),
        "allocated_mb": allocated,
        "used_mb": ratio("used_pages", 128, 15, 2),
        "available_mb": available,
        "free_pct": F.try_divide(available * 100, allocated).cast(DecimalType(9, 4)),
    }).drop("_group")


def database_space_totals(files: DataFrame, rows_only: bool = False) -> DataFrame:
    """Used, unused, allocated and maximum megabytes per database."""
    k = shared_keys(files)
    if rows_only:
        files = files.filter(F.col("type") == 0)
    return files.groupBy(*k, "database_id").agg(
        ratio(F.sum(big("used_pages")) * 8, 1024, 19, 4).alias("space_used_mb"),
        ratio(F.sum(big("size_pages") - big("used_pages")), 128, 19, 4).alias("space_unused_mb"),
        ratio(F.sum(big("size_pages")) * 8, 1024, 19, 4).alias("space_allocated_mb"),
        ratio(F.sum(big("max_size")) * 8, 1024, 19, 4).alias("max_size_mb"),
    )


OPTION_FLAGS = ("is_auto_close_on", "is_auto_shrink_on", "is_db_chaining_on", "is_auto_create_stats_on", "is_auto_update_stats_on")


def database_size_summary(databases: DataFrame, files: DataFrame, logins: DataFrame) -> DataFrame:
    """Owner, recovery model, data and log megabytes and options of user databases.

    Each file is truncated to whole megabytes before it is summed.
    """
    k = shared_keys(databases, files, logins)
    mb = pages_to_mb("size_pages")
    sizes = files.groupBy(*k, "database_id").agg(
        F.sum(F.when(F.col("type") == 0, mb)).alias("data_mb"), F.sum(F.when(F.col("type") == 1, mb)).alias("log_mb")
    )
    owners = logins.select(*k, F.col("sid").alias("owner_id"), F.col("name").alias("owner"))
    flags = {c[3:].removesuffix("_on"): F.when(F.col(c) == 1, F.lit("Y")).otherwise(F.lit("N")) for c in optional(databases, *OPTION_FLAGS)}
    return (
        databases.filter(~F.lower("name").isin(*SYSTEM_DATABASES))
        .join(sizes, [*k, "database_id"], "left")
        .join(owners, [*k, "owner_id"], "left")
        .withColumns({
            "read_only": F.when(F.col("is_read_only") == 1, F.lit("READ ONLY")).otherwise(F.lit("")),
            "change_owner_text": F.concat(F.lit("use ["), "name", F.lit("];exec sp_changedbowner 'sa'")),
            **flags,
        })
    )


def ag_size_by_replica(
    db_replica_states: DataFrame, replicas: DataFrame, databases: DataFrame, files: DataFrame,
    groups: DataFrame | None = None, by_ag: bool = False,
) -> DataFrame:
    """Databases and their size on local replicas, per role (and availability group)."""
    k = shared_keys(db_replica_states, replicas, databases, files)
    sizes = files.groupBy(*k, "database_id").agg(F.sum(big("size_pages")).alias("_pages"))
    names = replicas.select(*k, "replica_id", "replica_server_name")
    states = db_replica_states.filter(F.col("is_local") == 1).join(names, [*k, "replica_id"])
    by = [*k, "replica_server_name", "is_primary_replica"]
    if by_ag:
        states = states.join(groups.select(*k, "group_id", F.col("name").alias("ag_name")), [*k, "group_id"])
        by.append("ag_name")
    members = databases.select(*k, "group_database_id", "database_id").join(sizes, [*k, "database_id"], "left")
    return states.join(members, [*k, "group_database_id"], "left").groupBy(*by).agg(
        F.count("database_id").alias("databases"),
        F.sum(int_div("_pages", 128)).alias("size_mb"),
        F.sum(ratio("_pages", 128 * 1024, 19, 2)).alias("size_gb"),
    )


def growth_setting(growth: str = "growth", percent: str = "is_percent_growth", limit: str = "max_size") -> Column:
    """File growth setting in words; sizes are 8 KB pages."""
    step = F.when(F.col(percent) == 1, F.concat(text(growth), F.lit(" percent"))).otherwise(
        F.concat(text(int_div(growth, 128)), F.lit(" mb"))
    )
    bound = F.when(F.col(limit) == -1, F.lit(" unrestricted")).otherwise(
        F.concat(F.lit(" max of "), text(int_div(limit, 128)), F.lit(" mb"))
    )
    return F.when(F.col(growth) == 0, F.lit("N/A")).otherwise(F.concat(step, bound))


def growth_setting_text(files: DataFrame) -> DataFrame:
    """Files with their growth setting in words, long and short form."""
    short = F.when(F.col("is_percent_growth") == 1, F.concat(text("growth"), F.lit(" percent(s)"))).otherwise(
        F.concat(text(int_div("growth", 128)), F.lit(" MB(s)"))
    )
    return files.withColumns({"autogrow": growth_setting(), "growth_short": short})


def multi_log_databases(
    files: DataFrame, n: int = 1, op: str = ">", databases: DataFrame | None = None, exclude: DataFrame | None = None
) -> DataFrame:
    """Databases whose number of files compares to ``n`` as asked.

    Without ``databases`` the counts themselves are returned.  ``exclude`` (for
    example already mirrored databases) is taken out by ``database_id``.
    """
    k = shared_keys(files)
    compare = {">": lambda c: c > n, ">=": lambda c: c >= n, "=": lambda c: c == n, "<": lambda c: c < n}[op]
    counts = files.groupBy(*k, "database_id").agg(F.count(F.lit(1)).alias("file_count")).filter(compare(F.col("file_count")))
    out = counts if databases is None else databases.join(counts, [*shared_keys(databases, files), "database_id"], "left_semi")
    if exclude is not None:
        keys = [*shared_keys(out, exclude), "database_id"]
        out = out.join(existing(exclude, keys), keys, "left_anti")
    return out


def vlf_stats(log_vlfs: DataFrame, files: DataFrame, databases: DataFrame) -> DataFrame:
    """Virtual log files per database with one log file and an active part.

    ``files`` are log files.  The counts are aggregated before any join.
    """
    k = shared_keys(log_vlfs, files, databases)
    single = multi_log_databases(files, 1, "=").select(*k, "database_id")
    per_file = log_vlfs.groupBy(*k, "database_id", "file_id").agg(
        F.count(F.lit(1)).alias("total_vlfs"),
        F.count(F.when(F.col("status") == 2, 1)).alias("_active"),
        int_div(F.sum(big("file_size")), 1024 * 1024).alias("size_mb"),
    )
    # active parts are counted over the whole database, also for files no longer listed
    active = per_file.groupBy(*k, "database_id").agg(F.sum("_active").alias("active_vlfs")).filter(F.col("active_vlfs") > 0)
    logs = files.join(single, [*k, "database_id"], "left_semi").select(
        *k, "database_id", "file_id", F.col("name").alias("log_name"), growth_setting().alias("autogrow"), "is_percent_growth"
    )
    users = databases.filter(~F.lower("name").isin(*SYSTEM_DATABASES)).select(
        *k, "database_id", F.col("name").alias("database"), "recovery_model_desc"
    )
    alter = F.concat(F.lit("USE [master];ALTER DATABASE ["), "database", F.lit("] MODIFY FILE ( NAME = N'"), "log_name",
                     F.lit("',FILEGROWTH = 64MB);"))
    return (
        per_file.drop("_active").join(active, [*k, "database_id"]).join(logs, [*k, "database_id", "file_id"])
        .join(users, [*k, "database_id"])
        .withColumn("alter_growth", F.when(F.col("is_percent_growth") == 1, alter).otherwise(F.lit("")))
        .drop("is_percent_growth")
    )


def vlf_alert(log_vlfs: DataFrame, min_vlfs: int = 50) -> DataFrame:
    """Databases with at least ``min_vlfs`` virtual log files."""
    k = shared_keys(log_vlfs)
    return log_vlfs.groupBy(*k, "database_id").agg(F.count(F.lit(1)).alias("vlfs")).filter(F.col("vlfs") >= min_vlfs)


def disk_latency(io_stats: DataFrame) -> DataFrame:
    """Latencies and bytes per operation of each file; no operations give 0."""
    reads, writes = big("num_of_reads"), big("num_of_writes")
    stall = big("io_stall") if has(io_stats, "io_stall") else big("io_stall_read_ms") + big("io_stall_write_ms")
    out = {
        "read_latency": guarded_div("io_stall_read_ms", reads),
        "write_latency": guarded_div("io_stall_write_ms", writes),
        "latency": guarded_div(stall, reads + writes),
        "avg_b_per_read": guarded_div("num_of_bytes_read", reads),
        "avg_b_per_write": guarded_div("num_of_bytes_written", writes),
        "avg_b_per_transfer": guarded_div(big("num_of_bytes_read") + big("num_of_bytes_written"), reads + writes),
    }
    if has(io_stats, "io_stall_queued_read_ms", "io_stall_queued_write_ms"):
        out["read_latency_governed"] = guarded_div("io_stall_queued_read_ms", reads)
        out["write_latency_governed"] = guarded_div("io_stall_queued_write_ms", writes)
    return io_stats.withColumns(out)


# --- statistics, objects, code ------------------------------------------------------


def statistics_inventory(
    stats: DataFrame, stats_columns: DataFrame, columns: DataFrame, tables: DataFrame, schemas: DataFrame
) -> DataFrame:
    """Columns of automatic and user-made statistics on user tables."""
    k = shared_keys(stats, stats_columns, columns, tables, schemas, scope=DATABASE)
    wanted = stats.filter((F.col("auto_created") == 1) | (F.col("user_created") == 1))
    tables = tables.filter(F.col("is_ms_shipped") == 0) if has(tables, "is_ms_shipped") else tables
    return (
        wanted.withColumnRenamed("name", "stat_name")
        .join(stats_columns.select(*k, "object_id", "stats_id", "column_id"), [*k, "object_id", "stats_id"])
        .join(columns.select(*k, "object_id", "column_id", F.col("name").alias("column_name")), [*k, "object_id", "column_id"])
        .join(_tables_with_schema(tables, schemas), [*k, "object_id"])
    )


def stale_statistics(stats: DataFrame, objects: DataFrame, days: int = 30, *, as_of, by: tuple[str, ...] = ()) -> DataFrame:
    """Oldest statistics date per database (or ``by``) when it is older than ``days``."""
    k = shared_keys(stats, objects, scope=DATABASE)
    users = objects.filter(F.col("type_desc") == "USER_TABLE") if has(objects, "type_desc") else objects
    oldest = stats.join(users.select(*k, "object_id", *by), [*k, "object_id"]).groupBy(*k, *by).agg(
        F.min("stats_date").alias("last_date")
    )
    return oldest.filter(F.col("last_date") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days"))


def invalid_objects(dependencies: DataFrame, objects: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Objects that reference a name which resolves to nothing.

    With ``catalog`` the resolution is made again from a catalog snapshot by
    ``referenced_name_id``; otherwise ``referenced_id`` says what was unresolved.
    Triggers on the inserted/deleted rows are not errors.
    """
    k = shared_keys(dependencies, objects, scope=DATABASE)
    clear = dependencies.filter(F.col("is_ambiguous") == 0)
    if catalog is not None:
        kc = shared_keys(dependencies, catalog, scope=DATABASE)
        clear = clear.join(
            catalog.select(*kc, F.col("object_id").alias("referenced_name_id")).distinct(), [*kc, "referenced_name_id"], "left_anti"
        )
    else:
        clear = clear.filter(F.col("referenced_id").isNull())
    out = clear.join(
        objects.select(*k, F.col("object_id").alias("referencing_id"), F.col("name").alias("invalid_object"), "type_desc"),
        [*k, "referencing_id"],
    )
    return out.filter(~((F.col("type_desc") == "SQL_TRIGGER") & F.lower("referenced_name").isin("inserted", "deleted")))


def trigger_inventory(
    triggers: DataFrame, trigger_events: DataFrame, objects: DataFrame, schemas: DataFrame, width: int | None = None
) -> DataFrame:
    """Triggers with their parent, flags and ordered event list, as whole texts unless
    ``width`` limits the characters of each name and list.

    The events of one trigger come from a short fixed vocabulary, so they are
    made distinct before they are collected.
    """
    k = shared_keys(triggers, trigger_events, objects, schemas, scope=DATABASE)
    mark = F.when(F.col("is_first") == 1, F.lit(" (First)")).when(F.col("is_last") == 1, F.lit(" (Last)")).otherwise(F.lit(""))
    label = F.concat(F.left("type_desc", F.lit(1)), F.lower(F.expr("substring(type_desc, 2)")), mark)
    events = (
        trigger_events.select(*k, "object_id", F.col("type").alias("_t"), label.alias("_label")).distinct()
        .groupBy(*k, "object_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_label"))), lambda e: e["_label"]), ", ").alias("_events"))
    )
    # a database-level trigger shows its event groups instead of its events
    groups = trigger_events.groupBy(*k, "object_id").agg(F.array_join(F.array_sort(F.collect_set("event_group_type_desc")), ", ").alias("_group"))
    shown = (lambda c: c) if width is None else (lambda c: F.left(c, F.lit(width)))
    parents = objects.select(*k, F.col("object_id").alias("parent_id"), F.col("name").alias("_parent"), "schema_id")
    owner = schemas.select(*k, "schema_id", F.col("name").alias("_schema"))
    database_level = F.col("parent_class") == 0
    timing = F.when(F.col("is_instead_of_trigger") == 1, F.lit("Instead Of ")).otherwise(F.lit("After "))
    yes = lambda c, v: F.when(F.col(c) == v, F.lit("X")).otherwise(F.lit(" "))
    return (
        triggers.join(events, [*k, "object_id"], "left").join(groups, [*k, "object_id"], "left").join(parents, [*k, "parent_id"], "left")
        .join(owner, [*k, "schema_id"], "left")
        .withColumns({
            "parent": F.when(database_level, F.lit("(Database)")).otherwise(shown(F.col("_parent"))),
            "schema_name": shown(F.coalesce("_schema", F.lit("(None)"))),
            "trigger_name": shown(F.col("name")),
            "kind": F.left("type_desc", F.lit(3)),
            "is_ms": yes("is_ms_shipped", 1),
            "is_on": yes("is_disabled", 0),
            "is_replicated": yes("is_not_for_replication", 0),
            "event": shown(F.when(database_level, F.col("_group")).otherwise(F.concat(timing, "_events"))),
        })
        .drop("_events", "_group", "_parent", "_schema", "name", "type_desc")
    )


_BYTES = ("varchar", "char", "varbinary", "binary", "text")
_WIDE = ("nvarchar", "nchar", "ntext")
_SCALED = ("datetime2", "time2", "datetimeoffset")


def column_type_text() -> Column:
    """Type name with length, scale or precision, from the usual column catalog."""
    limit = lambda n: F.when(F.col("max_length") == -1, F.lit("MAX")).otherwise(text(n))
    wrap = lambda *parts: F.concat(F.lit("("), *parts, F.lit(")"))
    kind = F.lower("type_name")
    return F.concat(
        F.upper("type_name"),
        F.when(kind.isin(*_BYTES), wrap(limit("max_length")))
        .when(kind.isin(*_WIDE), wrap(limit(int_div("max_length", 2))))
        .when(kind.isin(*_SCALED), wrap(text("scale")))
        .when(kind == "decimal", wrap(text("precision"), F.lit(","), text("scale")))
        .otherwise(F.lit("")),
    )


def table_ddl_text(columns: DataFrame, key_columns: DataFrame | None = None) -> DataFrame:
    """CREATE TABLE text for every table in the frame.

    ``columns`` carries table name parts and one row per column; a table has at
    most a few thousand columns, so its list fits one row.
    """
    k = [*shared_keys(columns, scope=DATABASE), "object_id", "schema_name", "table_name"]
    extras = F.concat(
        F.coalesce(F.concat(F.lit(" COLLATE "), "collation_name"), F.lit("")) if has(columns, "collation_name") else F.lit(""),
        F.when(F.col("is_nullable") == 1, F.lit(" NULL")).otherwise(F.lit(" NOT NULL")),
        F.coalesce(F.concat(F.lit(" DEFAULT"), "default_definition"), F.lit("")) if has(columns, "default_definition") else F.lit(""),
        F.when(
            F.col("is_identity") == 1,
            F.concat(F.lit(" IDENTITY("), F.coalesce(text("seed_value"), F.lit("0")), F.lit(","),
                     F.coalesce(text("increment_value"), F.lit("1")), F.lit(")")),
        ).otherwise(F.lit("")) if has(columns, "is_identity") else F.lit(""),
    )
    body = F.concat(column_type_text(), extras)
    if has(columns, "is_computed"):
        body = F.when(F.col("is_computed") == 1, F.concat(F.lit("AS "), "computed_definition")).otherwise(body)
    line = F.concat(F.lit("["), "column_name", F.lit("] "), body)
    tables = columns.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("column_id", line.alias("line")))).alias("_c"))
    lines = F.array_join(F.transform("_c", lambda c: c["line"]), "\r\t, ")
    constraint: Column = F.lit("")
    if key_columns is not None:
        kk = [*shared_keys(columns, key_columns, scope=DATABASE), "object_id"]
        part = F.concat(F.lit("["), "column_name", F.lit("] "), F.when(F.col("is_descending_key") == 1, F.lit("DESC")).otherwise(F.lit("ASC")))
        keys = key_columns.groupBy(*kk, "constraint_name").agg(
            F.array_sort(F.collect_list(F.struct("key_ordinal", part.alias("part")))).alias("_k")
        )
        tables = tables.join(keys, kk, "left")
        constraint = F.coalesce(
            F.concat(F.lit("\t, CONSTRAINT ["), "constraint_name", F.lit("] PRIMARY KEY ("),
                     F.array_join(F.transform("_k", lambda c: c["part"]), ", "), F.lit(")\r")),
            F.lit(""),
        )
    ddl = F.concat(F.lit("CREATE TABLE ["), "schema_name", F.lit("].["), "table_name", F.lit("]\r(\r\t  "), lines, F.lit("\r"), constraint, F.lit(")\r"))
    return tables.withColumn("ddl", ddl).drop("_c", "_k", "constraint_name")


def cdc_tables(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """Tables tracked by change data capture."""
    return _tables_with_schema(tables.filter(F.col("is_tracked_by_cdc") == 1), schemas)

