"""Fleet keys: which of the tagging columns a set of frames shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERVER = ("server_name",)
DATABASE = ("server_name", "database_name")

# fixed values: databases that belong to the server itself
SYSTEM_DATABASES = ("master", "msdb", "model", "tempdb")


def shared_keys(*frames: DataFrame, scope: tuple[str, ...] = SERVER, common: DataFrame | None = None) -> list[str]:
    """Columns of ``scope`` that the frames carry, in scope order.

    Frames from a single server have no ``server_name``, frames from a single
    database no ``database_name``; reports then have fewer keys.  A key that only
    some of the frames carry would mix servers or databases, and is an error.
    ``common`` is a frame that may be global on purpose, such as texts by their hash or
    code names: a key that it lacks is left out.
    """
    keys = []
    for c in scope:
        having = [c in f.columns for f in frames]
        if any(having) and not all(having):
            raise ValueError(f"only some inputs carry {c}: tag the others, databases by with_database_name")
        if all(having) and (common is None or c in common.columns):
            keys.append(c)
    return keys


def with_database_name(frame: DataFrame, databases: DataFrame) -> DataFrame:
    """``frame`` with the ``database_name`` of its ``database_id``.

    ``databases`` has one row per database (database_id, name, and server_name where
    the frame has it).  Rows of an unknown database keep a null name.
    """
    keys = [*shared_keys(frame, databases), "database_id"]
    return frame.join(databases.select(*keys, F.col("name").alias("database_name")), keys, "left")


def existing(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys for a semi or anti join.

    Repeated keys are merged before the shuffle, so one key with very many rows
    reaches the join as one row per task.
    """
    return frame.select(*keys).distinct()


def has(frame: DataFrame, *columns: str) -> bool:
    return all(c in frame.columns for c in columns)


def optional(frame: DataFrame, *columns: str) -> list[str]:
    """The given columns the frame really has: collectors differ by server version."""
    return [c for c in columns if c in frame.columns]
