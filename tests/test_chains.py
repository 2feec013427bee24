"""Log backup chains against a plain walk: gaps, overlaps, equal numbers, damage, hot databases, forks."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.ordering import running_max
from fleetlens.operators import chains

SCHEMA = "server_name string, database_name string, recovery_fork long, backup_set_id long, type string, first_lsn long, last_lsn long, is_damaged int"


def made(seed, n=500):
    rng, rows = random.Random(seed), []
    for i in range(n):
        low = rng.randrange(3000)
        kind = rng.choice("LLLLLLLLDI")
        name = rng.choice(["hot", "hot", "hot", "a", "b", None])
        high = None if rng.random() < 0.03 else low + rng.randrange(40) - (3 if rng.random() < 0.1 else 0)
        rows.append((rng.choice(["s1", "s2"]), name, rng.randrange(2), i, kind, low, high, rng.choice([0, 0, 0, 0, 0, 1, None])))
    return rows


def usable(rows):
    return [r for r in rows if r[4] == "L" and not r[7] and r[6] is not None and r[5] <= r[6]]


def walk(logs, point):
    reach, grown = point, True
    while grown:
        further = max([r[6] for r in logs if r[5] <= reach], default=reach)
        grown, reach = further > reach, max(reach, further)
    return reach


@pytest.mark.parametrize("slices", [1, 3, 19])
def test_running_max(spark, slices):
    rows = made(3)
    got = running_max(spark.createDataFrame(rows, SCHEMA), ["server_name", "database_name"], [F.col("first_lsn"), F.col("backup_set_id")], F.col("last_lsn"), slices=slices)
    assert got.columns[-1] == "max_before"
    seen, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[3])):
        want[r[3]] = seen.get(r[:2])
        if r[6] is not None:
            seen[r[:2]] = max(seen.get(r[:2], r[6]), r[6])
    assert {r["backup_set_id"]: r["max_before"] for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_points_are_reached_as_by_walking(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("low", F.lit("clash")).withColumn("reach", F.lit(1))
    got = {r["start_id"]: (r["restorable_lsn"], r["has_log_chain"]) for r in chains.last_restorable_points(df, ("D", "I")).collect()}
    want = {}
    for r in rows:
        if r[4] in "DI" and not r[7] and r[6] is not None:
            own = [x for x in usable(rows) if x[:3] == r[:3]]
            want[r[3]] = (walk(own, r[6]), any(x[5] <= r[6] <= x[6] for x in own))
    assert got == want


def test_chains_are_unions_of_touching_intervals(spark):
    rows = made(5)
    got = chains.backup_log_chains(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["backup_set_id"] for r in got) == sorted(r[3] for r in usable(rows))
    for r in got:
        own = [x for x in usable(rows) if x[:3] == (r["server_name"], r["database_name"], r["recovery_fork"])]
        assert r["chain_end"] == walk(own, r["chain_start"]) and r["chain_start"] <= r["first_lsn"]
        earlier = [x for x in own if (x[5], x[6], x[3]) < (r["first_lsn"], r["last_lsn"], r["backup_set_id"])]
        reach = max([x[6] for x in earlier], default=None)
        if reach is None:
            place = "start"
        elif r["first_lsn"] > reach:
            place = "gap"
        else:
            place = "covered" if r["last_lsn"] <= reach else "overlap" if r["first_lsn"] < reach else "next"
        assert (r["place"], r["missing"]) == (place, r["first_lsn"] - reach if place == "gap" else None)


def test_forks(spark):
    rows = [
        ("s1", "d", 0, 1, "L", 0, 10, 0), ("s1", "d", 0, 2, "L", 10, 20, 0), ("s1", "d", 1, 3, "L", 15, 30, 0), ("s1", "d", 1, 4, "L", 30, 44, 0),
        ("s1", "d", 2, 5, "L", 50, 60, 0),
    ]
    forks = spark.createDataFrame([("s1", "d", 1, 0, 15), ("s1", "d", 2, 1, 48), ("s1", "e", 1, 0, 5)], "server_name string, database_name string, recovery_fork long, parent_fork long, fork_lsn long")
    got = {(r["database_name"], r["recovery_fork"]): (r["parent_reaches"], r["continues"], r["reaches"]) for r in chains.fork_continuity(spark.createDataFrame(rows, SCHEMA), forks).collect()}
    assert got == {("d", 1): (True, True, 44), ("d", 2): (False, False, 48), ("e", 1): (False, False, 5)}


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chains.backup_log_chains(none).count() == 0 and chains.last_restorable_points(none).count() == 0


def test_a_hot_database_is_spread(spark):
    """All backups of one database: every slice holds its share."""
    rows = spark.range(20_000).selectExpr("'hot' as database_name", "id as backup_set_id", "'L' as type", "id as first_lsn", "id + 1 as last_lsn", "0 as is_damaged")
    got = chains.backup_log_chains(rows)
    assert got.agg({"chain_end": "min"}).first()[0] == 20_000 and got.where("place = 'next'").count() == 19_999
