"""Plain listings over any snapshot table, and statement-text lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import shared_keys


def catalog_listing(
    table: DataFrame,
    columns: Sequence[str | Column] | None = None,
    predicate: Column | str | None = None,
    order: Sequence[Column] | None = None,
    distinct: bool = False,
    top: int | None = None,
) -> DataFrame:
    """Projection, filter, optional distinct and top-n.

    ``order`` with ``top`` runs as a per-task top-n followed by a merge of at
    most ``top`` rows per task.  Without ``top`` it is a range-partitioned sort.
    """
    df = table
    if predicate is not None:
        df = df.filter(predicate)
    if columns is not None:
        df = df.select(*columns)
    if distinct:
        df = df.distinct()
    if order:
        df = df.orderBy(*order)
    return df.limit(top) if top is not None else df


def _desc(name: str) -> Column:
    return F.col(name).desc()


def _asc(name: str) -> Column:
    return F.col(name).asc()


# The plain listings, each one a set of arguments for catalog_listing.  Columns
# are given only where the report picks some.
LISTINGS: dict[str, dict] = {
    "updates_installed": dict(
        columns=["display_name", "display_version", "install_date"],
        predicate=lambda: F.col("display_name").like("%SQL Server%"),
        order=lambda: [_asc("install_date")],
    ),
    "replication_recent_history": dict(order=lambda: [_desc("time")], top=10),
    "memory_clerk_ranking": dict(order=lambda: [_desc("pages_kb")]),
    "rebuild_candidates": dict(predicate=lambda: F.col("avg_fragmentation_in_percent") > 30),
    "resource_detail": dict(order=lambda: [_desc("end_time")]),
    "storage_trend": dict(
        columns=["database_name", "end_time", "storage_in_megabytes"],
        order=lambda: [_asc("database_name"), _asc("end_time")],
    ),
    "oom_events": dict(order=lambda: [_desc("event_time")]),
    "trace_browse": dict(order=lambda: [_asc("start_time")]),
    "database_user_list": dict(
        columns=["name", "type_desc", "authentication_type_desc"],
        predicate=lambda: ~F.col("type").isin("A", "G", "R", "X") & F.col("sid").isNotNull(),
        order=lambda: [_asc("name")],
    ),
    "linked_server_listing": dict(order=lambda: [_asc("name")]),
    "firewall_rules": dict(order=lambda: [_asc("name")]),
    "mail_settings": dict(),
    "config_listing": dict(order=lambda: [_asc("name")]),
    "subscriber_publications": dict(columns=["publisher", "publisher_db", "publication"], distinct=True),
    "mirroring_endpoints": dict(columns=["name", "state_desc", "role_desc", "port"]),
}


def named_listing(name: str, table: DataFrame, **overrides) -> DataFrame:
    """One of the ready-made listings; fleet columns lead when the table has them."""
    spec = {**LISTINGS[name], **overrides}
    spec = {k: (v() if callable(v) else v) for k, v in spec.items()}
    if spec.get("columns") is not None:
        keys = [k for k in ("server_name", "database_name") if k in table.columns and k not in spec["columns"]]
        spec["columns"] = [*keys, *spec["columns"]]
    return catalog_listing(table, **spec)


def sql_text_lookup(rows: DataFrame, sql_text: DataFrame, key: str = "sql_handle", outer: bool = False, few: bool = False) -> DataFrame:
    """Attach statement text; without ``outer`` rows with no text are dropped.

    The optimizer takes any string to be 20 bytes, so whole texts are sorted and merged, never
    broadcast through the driver by that guess.  ``few``: ``rows`` are a handful, and the choice stays free."""
    keys = [*shared_keys(rows, common=sql_text), key]
    texts = sql_text.select(*keys, "text")
    return rows.join(texts if few else texts.hint("merge"), keys, "left" if outer else "inner")


def statement_text(
    text: Column | str, start_offset: Column | str, end_offset: Column | str, max_chars: int | None = None
) -> Column:
    """Cut one statement out of its batch.

    Offsets are in bytes of two-byte characters; an end of -1 means up to the
    end of the batch.  Line breaks become blanks.  The whole statement is kept
    unless ``max_chars`` is given.
    """
    batch = F.col(text) if isinstance(text, str) else text
    start = F.call_function("div", F.col(start_offset) if isinstance(start_offset, str) else start_offset, F.lit(2))
    start_raw = F.col(start_offset) if isinstance(start_offset, str) else start_offset
    end_raw = F.col(end_offset) if isinstance(end_offset, str) else end_offset
    end = F.when(end_raw == -1, F.length(batch) * 2).otherwise(end_raw)
    length = F.call_function("div", end - start_raw, F.lit(2)) + 1
    cut = F.substring(batch, (start + 1).cast("int"), F.greatest(length, F.lit(0)).cast("int"))
    flat = F.translate(cut, "\n\r", "  ")
    return flat if max_chars is None else F.substring(flat, 1, max_chars)
