"""The include/exclude selection grammar.

A selection is a delimited list.  ``-`` in front excludes, ``%`` is a wildcard,
``_`` is literal, ``[...]`` quotes a name, and a few keywords stand for all or
some kinds of databases.  What an include matches is taken unless an exclude
matches it too.  The list is a parameter, so it becomes one column expression:
rows are selected in a single narrow pass without any join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import SERVER, shared_keys
from fleetlens.functions.tsql import like_pattern

# fixed values: keywords of the grammar
DATABASE_KEYWORDS = {
    "ALL_DATABASES": {}, "SYSTEM_DATABASES": {"database_type": "S"}, "USER_DATABASES": {"database_type": "U"},
    "AVAILABILITY_GROUP_DATABASES": {"in_availability_group": 1},
}
ALL_AVAILABILITY_GROUPS, ALL_OBJECTS, ALL_INDEXES, ALL_FILEGROUPS = (
    "ALL_AVAILABILITY_GROUPS", "ALL_OBJECTS", "ALL_INDEXES", "ALL_FILEGROUPS",
)
SYSTEM_NAMES = ("master", "msdb", "model")


@dataclass(frozen=True)
class Item:
    """One entry: the name parts it must match and whether it includes."""

    parts: tuple[str, ...]
    include: bool
    position: int
    conditions: tuple[tuple[str, object], ...] = ()
    text: str = ""


def split_list(selection: str, delimiter: str = ",") -> list[tuple[str, bool, int]]:
    """(entry, include, position) of a selection list; blanks around entries go away."""
    flat = selection.replace("\n", "").replace("\r", "").strip()
    entries = [e.strip() for e in flat.split(delimiter)]
    if any(e in ("", "-") for e in entries):
        raise ValueError(f"empty entry in selection {selection!r}")
    return [(e[1:] if e.startswith("-") else e, not e.startswith("-"), n) for n, e in enumerate(entries, 1)]


def unquote(name: str) -> str:
    return name[1:-1].replace("]]", "]") if name.startswith("[") and name.endswith("]") else name


def name_parts(entry: str) -> list[str]:
    """Split a dotted name; dots inside brackets belong to the name."""
    return [unquote(p) for p in re.findall(r"\[(?:[^\]]|\]\])*\]|[^.\[]+", entry)]


def _like(column: str, pattern: str) -> Column:
    """Case-insensitive match; a lone wildcard needs no test but a value."""
    if pattern == "%":
        return F.col(column).isNotNull()
    return F.lower(F.col(column)).like(like_pattern(pattern.lower()))


def _matches(item: Item, columns: list[str]) -> Column:
    tests = [_like(c, p) for c, p in zip(columns, item.parts)]
    tests += [F.col(c) == v for c, v in item.conditions]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _apply(df: DataFrame, items: list[Item], columns: list[str], position: str = "start_position") -> DataFrame:
    none = F.lit(False)
    included = reduce(lambda a, b: a | b, [_matches(i, columns) for i in items if i.include], none)
    excluded = reduce(lambda a, b: a | b, [_matches(i, columns) for i in items if not i.include], none)
    first = F.coalesce(*[F.when(_matches(i, columns), F.lit(i.position)) for i in items if i.include], F.lit(None).cast("int"))
    return df.filter(included & ~excluded).withColumn(position, first)


def parse_databases(selection: str, delimiter: str = ",") -> list[Item]:
    items = []
    for entry, include, position in split_list(selection, delimiter):
        keyword = DATABASE_KEYWORDS.get(entry.upper())
        if keyword is not None:
            items.append(Item(("%",), include, position, tuple(keyword.items()), entry))
        else:
            items.append(Item((unquote(entry),), include, position, (), entry))
    return items


def select_by_patterns(items: DataFrame, selection: str, delimiter: str = ",", name_col: str = "name") -> DataFrame:
    """Databases that a selection takes, with the position of the first matching entry.

    ``database_type`` (S/U) is derived from the name when absent, and
    ``in_availability_group`` counts as 0 when absent.  tempdb is never selected.
    """
    df = items.filter(F.lower(F.col(name_col)) != "tempdb")
    added = []
    if "database_type" not in df.columns:
        df = df.withColumn("database_type", F.when(F.lower(F.col(name_col)).isin(*SYSTEM_NAMES), F.lit("S")).otherwise(F.lit("U")))
        added.append("database_type")
    if "in_availability_group" not in df.columns:
        df = df.withColumn("in_availability_group", F.lit(0))
        added.append("in_availability_group")
    return _apply(df, parse_databases(selection, delimiter), [name_col]).drop(*added)


def parse_objects(selection: str, parts: int = 4, delimiter: str = ",") -> list[Item]:
    """Entries of ``parts`` names; with four, a three-part name means every index."""
    items = []
    for entry, include, position in split_list(selection, delimiter):
        if entry.upper() in (ALL_OBJECTS, ALL_INDEXES, ALL_FILEGROUPS):
            names = ["%"] * parts
        else:
            names = name_parts(entry)
            if parts == 4 and len(names) == 3:
                names = [*names, "%"]
        if len(names) != parts:
            raise ValueError(f"{entry!r} does not have {parts} parts")
        items.append(Item(tuple(names), include, position, (), entry))
    return items


OBJECT_COLUMNS = ("database_name", "schema_name", "object_name", "index_name")


def select_objects(items: DataFrame, selection: str, columns: tuple[str, ...] = OBJECT_COLUMNS, delimiter: str = ",") -> DataFrame:
    """Objects, indexes or filegroups that a selection of dotted names takes.

    ``columns`` are the matched columns in name order: four for indexes, three
    for objects, ``("database_name", "filegroup_name")`` for filegroups.
    """
    return _apply(items, parse_objects(selection, len(columns), delimiter), list(columns))


def select_availability_groups(dbs: DataFrame, ags: DataFrame, selection: str, delimiter: str = ",") -> DataFrame:
    """Databases of the selected availability groups.

    ``ags`` links groups to databases: (availability_group, name).
    """
    k = shared_keys(dbs, ags, scope=SERVER)
    parsed = [
        Item(("%" if e.upper() == ALL_AVAILABILITY_GROUPS else unquote(e),), inc, pos, (), e)
        for e, inc, pos in split_list(selection, delimiter)
    ]
    groups = _apply(ags.select(*k, "availability_group", "name"), parsed, ["availability_group"])
    return dbs.join(groups, [*k, "name"])


def unmatched_selections(items: DataFrame, selection: str, delimiter: str = ",", name_col: str = "name") -> DataFrame:
    """Named entries (no wildcard or keyword) that exist nowhere in ``items``."""
    named = [(i.parts[0], i.position) for i in parse_databases(selection, delimiter) if "%" not in i.parts[0]]
    wanted = items.sparkSession.createDataFrame(named, "selected_name string, position int")
    # only the few listed names are looked for, so the big side shrinks in the scan
    known = (
        items.filter(F.lower(F.col(name_col)).isin([n.lower() for n, _ in named]))
        .select(F.lower(F.col(name_col)).alias("_known")).distinct()
    )
    return wanted.withColumn("_known", F.lower("selected_name")).join(known, "_known", "left_anti").drop("_known")
