"""Chains of log backups by sequence number: gaps, overlaps, forks, last restorable points.

A log backup covers the numbers from ``first_lsn`` to ``last_lsn``.  It can be restored onto a
database that has reached r if ``first_lsn <= r``, and then reaches ``last_lsn``; so logs whose
intervals touch or overlap form one chain, and from any point inside it the end of the chain can
be reached.  Chains are the unions of those intervals in order of ``first_lsn``: the greatest end so far
is carried over range slices, so a database with a third of all backups is spread over all tasks.

Points (full backups, fork points) are laid into the same order after the logs that begin at or
before them, so no range join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import shared_keys
from fleetlens.functions.ordering import running_max

FORK = "recovery_fork"


def _by(*frames: DataFrame) -> list[str]:
    return [*shared_keys(*frames), "database_name", *([FORK] if all(FORK in f.columns for f in frames) else [])]


def _logs(backups: DataFrame, by: list[str]) -> DataFrame:
    """Usable log backups: undamaged, with both numbers, the first not above the last."""
    usable = (F.col("type") == "L") & (F.coalesce(F.col("is_damaged"), F.lit(0)) == 0) & (F.col("first_lsn") <= F.col("last_lsn"))
    return backups.where(usable).select(*by, F.col("backup_set_id").alias("id"), F.col("first_lsn").alias("low"), F.col("last_lsn").alias("high"), F.lit(0).alias("kind"))


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """``reach`` (greatest end before the row) and ``chain_start`` of each row; kind 0 is a log, 1 a point."""
    order = [F.col("low"), F.col("kind"), F.col("high"), F.col("id")]
    log = F.col("kind") == 0
    reached = running_max(rows, by, order, F.when(log, F.col("high")), "reach")
    opens = log & (F.col("reach").isNull() | (F.col("low") > F.col("reach")))
    started = running_max(reached, by, order, F.when(opens, F.col("low")), "_start")
    return started.withColumn("opens", opens).withColumn("chain_start", F.when(opens, F.col("low")).otherwise(F.col("_start"))).drop("_start")


def _ends(placed: DataFrame, by: list[str]) -> DataFrame:
    return placed.where("kind = 0").groupBy(*by, "chain_start").agg(F.max("high").alias("chain_end"), F.count(F.lit(1)).alias("logs"))


def _with(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on ``on``; null names are equal."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    return left.join(named, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on], "left").drop(*[f"_r_{c}" for c in on])


def backup_log_chains(backups: DataFrame) -> DataFrame:
    """Every usable log backup with ``chain_start``, ``chain_end`` and its ``place`` in the chain:

    ``start`` (first of its database and fork), ``gap`` (``missing`` numbers lie before it), ``next``,
    ``overlap`` (begins before the end reached) or ``covered`` (adds nothing).  Damaged backups and those
    without numbers take no part.  With a column ``recovery_fork`` forks are apart."""
    by = _by(backups)
    placed = _placed(_logs(backups, by), by)
    first = F.col("reach").isNull()
    place = (
        F.when(first, "start").when(F.col("opens"), "gap").when(F.col("high") <= F.col("reach"), "covered").when(F.col("low") < F.col("reach"), "overlap").otherwise("next")
    )
    out = _with(placed, _ends(placed, by).drop("logs"), [*by, "chain_start"])
    return out.select(
        *by, F.col("id").alias("backup_set_id"), F.col("low").alias("first_lsn"), F.col("high").alias("last_lsn"), "chain_start", "chain_end",
        place.alias("place"), F.when(F.col("opens") & ~first, F.col("low") - F.col("reach")).alias("missing"),
    )


def _reaching(backups: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """``points`` (``by``, ``id``, ``low``) with ``covered``, ``chain_start`` and ``chain_end`` of the chain they lie in."""
    rows = _logs(backups, by).unionByName(points.withColumn("high", F.col("low")).withColumn("kind", F.lit(1)))
    placed = _placed(rows, by)
    at = placed.where("kind = 1").withColumn("covered", F.coalesce(F.col("reach") >= F.col("low"), F.lit(False)))
    return _with(at, _ends(placed, by), [*by, "chain_start"])


def last_restorable_points(backups: DataFrame, types: Sequence[str] = ("D",)) -> DataFrame:
    """``start_id``, ``start_lsn``, ``restorable_lsn``, ``has_log_chain`` of each undamaged backup of ``types``:
    how far its database can be rolled forward from it.  Without a log chain that is its own end."""
    by = _by(backups)
    starts = backups.where(F.col("type").isin(*types) & (F.coalesce(F.col("is_damaged"), F.lit(0)) == 0) & F.col("last_lsn").isNotNull())
    got = _reaching(backups, starts.select(*by, F.col("backup_set_id").alias("id"), F.col("last_lsn").alias("low")), by)
    return got.select(
        *by, F.col("id").alias("start_id"), F.col("low").alias("start_lsn"), F.when(F.col("covered"), F.col("chain_end")).otherwise(F.col("low")).alias("restorable_lsn"),
        F.col("covered").alias("has_log_chain"),
    )


def fork_continuity(backups: DataFrame, forks: DataFrame) -> DataFrame:
    """Of each fork (``recovery_fork``, ``parent_fork``, ``fork_lsn``): does the parent's chain reach the fork point,
    do the fork's own logs go on from it, and up to which number (``reaches``, the fork point itself without a chain)."""
    by = [*shared_keys(backups, forks), "database_name", FORK]
    rest = [c for c in by if c != FORK]
    marks = forks.select(*rest, FORK, "parent_fork", "fork_lsn")
    # the id of a point is the fork on the other side; a fork is named once per database
    above = _reaching(backups, marks.select(*rest, F.col("parent_fork").alias(FORK), F.col(FORK).alias("id"), F.col("fork_lsn").alias("low")), by)
    below = _reaching(backups, marks.select(*rest, FORK, F.col(FORK).alias("id"), F.col("fork_lsn").alias("low")), by)
    up = above.select(*rest, F.col("id").alias(FORK), F.col("covered").alias("parent_reaches"))
    down = below.select(*rest, FORK, F.col("covered").alias("continues"), F.when(F.col("covered"), F.col("chain_end")).otherwise(F.col("low")).alias("reaches"))
    return _with(_with(marks, up, [*rest, FORK]), down, [*rest, FORK])
