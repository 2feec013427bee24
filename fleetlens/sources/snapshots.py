"""Reading metadata snapshots landed in a lake.

Layout: one folder per catalog view or counter table, partitioned by
``server_name`` and a date column, so that server, database and date filters
prune partitions or reach the Parquet row groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.functions.fleet import SYSTEM_DATABASES, shared_keys


def snapshot_scan(
    spark: SparkSession,
    root: str,
    table: str,
    schema: StructType | str | None = None,
    server: str | Sequence[str] | None = None,
    db: str | Sequence[str] | None = None,
    since=None,
    columns: Sequence[str] | None = None,
    date_column: str = "snapshot_date",
) -> DataFrame:
    """Read one snapshot table, keeping only what is asked for."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(f"{root.rstrip('/')}/{table}")
    for column, wanted in (("server_name", server), ("database_name", db)):
        if wanted is not None:
            df = df.filter(F.col(column).isin([wanted] if isinstance(wanted, str) else list(wanted)))
    if since is not None:
        df = df.filter(F.col(date_column) >= F.lit(since))
    return df.select(*columns) if columns else df


def without_system(df: DataFrame, column: str = "database_name", system: Sequence[str] = SYSTEM_DATABASES) -> DataFrame:
    """Drop the rows of the server's own databases."""
    return df.filter(~F.lower(F.col(column)).isin([s.lower() for s in system]))


def fleet_scan(
    spark: SparkSession, root: str, table: str, exclude_system: bool = True, merge_schema: bool = True
) -> DataFrame:
    """One partitioned scan over every server and database of the fleet."""
    df = spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(f"{root.rstrip('/')}/{table}")
    return without_system(df) if exclude_system else df


def fleet_union(
    frames: Iterable[tuple[str, str, DataFrame]],
    exclude_system: bool = True,
    system: Sequence[str] = SYSTEM_DATABASES,
) -> DataFrame:
    """Stack the same report from several databases, tagged with server and database.

    Columns a server version does not have become NULL.  Databases known to be
    system ones are left out before their frame is read.
    """
    banned = {s.lower() for s in system} if exclude_system else set()
    tagged = [
        df.select(F.lit(server).alias("server_name"), F.lit(db).alias("database_name"), *df.columns)
        for server, db, df in frames
        if db.lower() not in banned
    ]
    if not tagged:
        raise ValueError("no database left to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def trace_scan(
    spark: SparkSession,
    path: str,
    trace_events: DataFrame,
    schema: StructType | str | None = None,
    class_column: str = "event_class",
) -> DataFrame:
    """Read every rollover file of a trace and name the events.

    ``path`` is a folder or glob that covers the oldest to the current file.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(path).withColumn("trace_file", F.col("_metadata.file_name"))
    return name_events(rows, trace_events, class_column)


def name_events(trace: DataFrame, trace_events: DataFrame, class_column: str = "event_class") -> DataFrame:
    """Attach the event name; classes without a name are dropped (inner join).

    The name list may be one for all servers or one per server.
    """
    keys = shared_keys(trace, trace_events)
    names = trace_events.select(
        *keys, F.col("trace_event_id").alias(class_column), F.col("name").alias("event_name")
    )
    return trace.join(names, [*keys, class_column])
