"""Selections that are tables: very many wildcard patterns held against very many names.

Patterns are indexed by the ends of their fixed text: the characters before the first
``%`` and after the last one, cut to one of a few depths, name a node in a trie of
prefixes and one of suffixes.  A name looks up only the pairs of depths that some pattern
has, so the join is one of equal keys; what meets is tested against the whole pattern.
Patterns with a ``%`` at both ends are found by a run of characters from their longest
inner part.  There is no LIKE join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import SERVER, existing, optional
from fleetlens.operators.grants import named_sets
from fleetlens.operators.selection import DATABASE_KEYWORDS, SYSTEM_NAMES
from fleetlens.session import checkpoint_root

DEPTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32)  # characters of an end that make a node
GRAM = 5  # characters looked up of an inner part, at most


def _depth(size: Column) -> Column:
    return F.greatest(*[F.when(size >= d, F.lit(d)).otherwise(F.lit(0)) for d in DEPTHS])


def _left(c: Column, n: Column | int) -> Column:
    return F.substring(c, F.lit(1), F.lit(n) if isinstance(n, int) else n)


def _right(c: Column, n: Column) -> Column:
    # a start beyond the text gives the empty string, as n = 0 should
    return F.substring(c, F.length(c) - n + 1, n)


def indexed_patterns(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``pattern`` (lower case, distinct) with ``kind`` and ``node``, where names look for it.

    ``%`` is the only wildcard.  A null pattern matches nothing and is left out."""
    own = patterns.select(F.lower(pattern).alias("pattern")).where("pattern IS NOT NULL").distinct()
    cut = own.withColumn("parts", F.split("pattern", "%"))
    cut = cut.withColumns({
        "first": F.element_at("parts", 1), "last": F.element_at("parts", -1),
        "inner": _left(F.array_max(F.transform("parts", lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"], GRAM),
    })
    cut = cut.withColumns({"before": _depth(F.length("first")), "after": _depth(F.length("last"))})
    kind = (
        F.when(F.size("parts") == 1, "whole").when(F.col("before") + F.col("after") > 0, "ends").when(F.length("inner") > 0, "inner").otherwise("any")
    )
    cut = cut.withColumn("kind", kind)
    ends = F.concat(_left(F.col("first"), F.col("before")), F.lit("%"), _right(F.col("last"), F.col("after")))
    return cut.select(
        "pattern", "kind", F.when(F.col("kind") == "ends", F.col("before")).otherwise(F.length("inner")).alias("before"), "after",
        F.when(F.col("kind") == "whole", F.col("pattern")).when(F.col("kind") == "ends", ends).when(F.col("kind") == "inner", F.col("inner")).otherwise("").alias("node"),
    )


def matches(names: DataFrame, patterns: DataFrame, name: str = "name", pattern: str = "pattern") -> DataFrame:
    """``name``, ``pattern`` (lower case, distinct) of all that match, as LIKE with ``%`` alone would."""
    checkpoint_root(names.sparkSession)
    index = indexed_patterns(patterns, pattern).checkpoint()
    kinds = index.select("kind", "before", "after").distinct().collect()  # pairs of depths: 200 at most
    own = names.select(F.lower(name).alias("name")).where("name IS NOT NULL").distinct()
    ends = [(r["before"], r["after"]) for r in kinds if r["kind"] == "ends"]
    size, none, asked = F.length("name"), F.lit(0), []
    if any(r["kind"] == "whole" for r in kinds):
        asked.append(own.select("name", F.lit("whole").alias("kind"), none.alias("before"), none.alias("after"), F.col("name").alias("node")))
    if any(r["kind"] == "any" for r in kinds):
        asked.append(own.select("name", F.lit("any").alias("kind"), none.alias("before"), none.alias("after"), F.lit("").alias("node")))
    if ends:
        pairs = F.array(*[F.struct(F.lit(x).alias("before"), F.lit(y).alias("after")) for x, y in ends])
        each = own.select("name", F.lit("ends").alias("kind"), F.inline(pairs)).where(size >= F.col("before") + F.col("after"))
        node = F.concat(_left(F.col("name"), F.col("before")), F.lit("%"), _right(F.col("name"), F.col("after")))
        asked.append(each.withColumn("node", node))
    for n in sorted({r["before"] for r in kinds if r["kind"] == "inner"}):
        runs = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("name", i, F.lit(n)))  # noqa: B023
        long = own.where(size >= n)
        asked.append(long.select("name", F.lit("inner").alias("kind"), F.lit(n).alias("before"), none.alias("after"), F.explode(F.array_distinct(runs)).alias("node")))
    if not asked:
        return own.select("name", F.lit("").alias("pattern")).limit(0)
    index = index.withColumns({c: F.when(F.col("kind").isin("whole", "any"), 0).otherwise(F.col(c)) for c in ("before", "after")})
    asked = reduce(DataFrame.unionByName, asked)
    literal = F.replace(F.replace(F.col("pattern"), F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\_"))
    met = asked.join(index, ["kind", "before", "after", "node"]).withColumn("_like", literal)
    return met.where(F.expr("name LIKE _like")).select("name", "pattern")


def parsed_entries(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """``entries`` with ``include`` and ``pattern`` (a keyword in capitals, or the name in lower case)
    by the grammar of selection lists: ``-`` in front excludes, ``[..]`` quotes.  Empty entries go."""
    text, bare = F.col("_entry"), F.col("_bare")
    cut = entries.withColumn("_entry", F.trim(F.translate(F.col(entry), "\r\n", "")))
    cut = cut.withColumn("include", ~text.startswith("-")).withColumn("_bare", F.when(F.col("include"), text).otherwise(F.expr("substring(_entry, 2)")))
    cut = cut.withColumn("_keyword", F.upper(bare).isin(*DATABASE_KEYWORDS))
    quoted = bare.startswith("[") & bare.endswith("]") & (F.length(bare) > 1)
    name = F.when(quoted, F.replace(F.expr("substring(_bare, 2, length(_bare) - 2)"), F.lit("]]"), F.lit("]"))).otherwise(bare)
    cut = cut.withColumn("pattern", F.when(F.col("_keyword"), F.upper(bare)).otherwise(F.lower(name)))
    # written before it is filtered: a filter pushed below would repeat these expressions many times over
    checkpoint_root(entries.sparkSession)
    return cut.drop("_entry", "_bare").checkpoint().where(F.length("pattern") > 0)


def rules_of(entries: DataFrame) -> DataFrame:
    """``selection``, ``pattern``, ``_keyword`` once, with the first position of its includes and whether it excludes (``_out``)."""
    return parsed_entries(entries).groupBy("selection", "pattern", "_keyword").agg(
        F.min(F.when(F.col("include"), F.col("position"))).alias("start_position"), F.max((~F.col("include")).cast("int")).alias("_out")
    ).checkpoint()


def _met(named: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` (``pattern``, ``_keyword`` and others) with the names, types and groups that they meet."""
    facts, listed = named.columns, rules.where("NOT _keyword")
    by_name = matches(named, listed, "_name").withColumnRenamed("name", "_name").join(listed, "pattern").join(named, "_name")
    tests = {"database_type": "_type", "in_availability_group": "_group"}
    words = F.array(*[
        F.when(F.lit(True) if not rule else F.col(tests[next(iter(rule))]) == F.lit(next(iter(rule.values()))), F.lit(word))
        for word, rule in DATABASE_KEYWORDS.items()
    ])
    of_kind = named.withColumn("pattern", F.explode(F.array_compact(words))).join(rules.where("_keyword"), "pattern")
    return by_name.select(*rules.columns, *facts).unionByName(of_kind.select(*rules.columns, *facts))


def select_by_table(items: DataFrame, entries: DataFrame, name_col: str = "name") -> DataFrame:
    """Databases that each selection of a table takes, with ``selection`` and ``start_position``.

    ``entries`` has ``selection``, ``entry``, ``position`` (one row an entry).  What an include
    matches is taken unless an exclude of the same selection matches too; the position is that of
    the first include.  tempdb is never selected.  ``database_type`` and
    ``in_availability_group`` of the items decide about keywords; without them the type follows from
    the name and no database is in a group.

    A pattern that a selection has very often is one rule.  Excludes are only held against names
    that an include met, by selections that took something; exclude patterns of the same selections
    are one set, so a name that many of them match is left out once for each selection."""
    checkpoint_root(items.sparkSession)
    lowered = F.lower(name_col)
    kind = F.col("database_type") if "database_type" in items.columns else F.when(lowered.isin(*SYSTEM_NAMES), "S").otherwise("U")
    grouped = F.col("in_availability_group") if "in_availability_group" in items.columns else F.lit(0)
    facts = {"_name": lowered, "_type": kind, "_group": F.coalesce(grouped.cast("int"), F.lit(0))}
    tagged = items.withColumns(facts).where("_name <> 'tempdb'")
    rules = rules_of(entries)
    includes = rules.where("start_position IS NOT NULL").drop("_out")
    found = _met(tagged.select(*facts).distinct(), includes).groupBy("selection", *facts).agg(F.min("start_position").alias("start_position")).checkpoint()
    in_use = existing(found, ["selection"]).withColumnRenamed("selection", "_used")
    excludes = rules.where("_out = 1").join(in_use, F.col("selection").eqNullSafe(F.col("_used")), "left_semi").select("selection", "pattern", "_keyword").checkpoint()
    sets = named_sets(excludes, [], "pattern", ["selection"], "_set").select("pattern", "_set")
    hit = _met(existing(found, [*facts]), excludes.select("pattern", "_keyword").distinct().join(sets, "pattern")).select("_set", *facts).distinct()
    left_out = hit.join(excludes.select(F.col("pattern").alias("_set"), "selection"), "_set").select("selection", *facts).distinct()
    left_out = left_out.withColumnsRenamed({c: f"{c}_" for c in left_out.columns})
    taken = found.join(left_out, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("selection", *facts)], "left_anti")
    taken = taken.withColumnsRenamed({c: f"{c}_" for c in facts})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in facts]
    return tagged.join(taken, same).select("selection", *items.columns, "start_position")


def unmatched_entries(items: DataFrame, entries: DataFrame, name_col: str = "name") -> DataFrame:
    """Entries (no keywords) of a selection table that match no name at all, on any server."""
    wanted = parsed_entries(entries).where("NOT _keyword").select("selection", "entry", "position", "pattern")
    found = matches(items.select(*optional(items, *SERVER), name_col), wanted, name_col).select("pattern").distinct()
    return wanted.join(found, "pattern", "left_anti").select("selection", "entry", "position")
