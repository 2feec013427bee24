"""Pattern tables against a plain matcher: all shapes of patterns, odd names, plan without a nested loop."""

import random
import re

import pytest

from fleetlens.operators import pattern_index, selection


def like(name, pattern):
    return re.fullmatch(".*".join(map(re.escape, pattern.lower().split("%"))), name.lower(), re.DOTALL) is not None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_equal_like(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(["a", "b", "_", "B", "ab", "é", "\\", ".", "aaaaaaaaaaaaaaaaaa"]) for _ in range(rng.randint(0, n)))
    names = [word(8) for _ in range(250)] + ["", None, "%", "a%b"]
    patterns = [rng.choice(["", "%"]) + "%".join(word(3) for _ in range(rng.randint(1, 3))) + rng.choice(["", "%"]) for _ in range(200)] + ["%", "%%", "", None]
    got = pattern_index.matches(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    )
    want = {(n.lower(), p.lower()) for n in names if n is not None for p in patterns if p is not None and like(n, p)}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 300


def test_no_nested_loop(spark):
    names = spark.range(2000).selectExpr("concat('db', id) as name")
    patterns = spark.range(3000).selectExpr("case id % 3 when 0 then concat('db', id, '%') when 1 then concat('%', id) else concat('%b', id, '%') end as pattern")
    got = pattern_index.matches(names, patterns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == sum(f"db{i}".startswith(f"db{j}") for j in range(0, 2000, 3) for i in range(2000)) + sum(
        f"db{i}".endswith(str(j)) for j in range(1, 2000, 3) for i in range(2000)
    ) + sum(f"db{i}".startswith(f"db{j}") for j in range(2, 2000, 3) for i in range(2000))


def test_tables_equal_strings(spark):
    """A selection as a table takes what the same selection as a string takes."""
    rows = [("db1", "x", 0), ("DB12", "x", 1), ("db2", "x", 0), ("master", "x", 0), ("tempdb", "x", 1), ("a]b", "x", None), ("a_b", "x", 1), ("azb", "x", 0), (None, "x", 0)]
    dbs = spark.createDataFrame(rows, "name string, _type string, in_availability_group int")
    lists = ["db%, -db2", "[a]]b], a_b", "SYSTEM_DATABASES, %2", "USER_DATABASES,-a%", "ALL_DATABASES, -AVAILABILITY_GROUP_DATABASES", "-db1", "%", "AVAILABILITY_GROUP_DATABASES,db1"]
    entries = [(i, e.strip(), n) for i, text in enumerate(lists) for n, e in enumerate(text.split(","), 1)]
    got = pattern_index.select_by_table(dbs, spark.createDataFrame([*entries, (9, "", 1), (9, None, 2)], "selection int, entry string, position int"))
    assert got.columns == ["selection", *dbs.columns, "start_position"]
    for i, text in enumerate(lists):
        alone = selection.select_by_patterns(dbs, text).select("name", "start_position").collect()
        assert sorted((r["name"], r["start_position"]) for r in got.where(f"selection = {i}").collect()) == sorted(map(tuple, alone)), text
    assert pattern_index.select_by_table(dbs.limit(0), spark.createDataFrame(entries, "selection int, entry string, position int")).count() == 0
    assert pattern_index.select_by_table(dbs, spark.createDataFrame([], "selection int, entry string, position int")).count() == 0


def test_repeated_rules_are_one(spark):
    """A pattern listed very often, and excludes of selections that take nothing, make no rows of their own."""
    names = spark.range(2000).selectExpr("concat('db', id) as name")
    often = spark.range(3000).selectExpr("1 as selection", "'%' as entry", "id + 5 as position")
    out = spark.range(100).selectExpr("explode(array(1, 2, 3)) as selection", "concat('-%', id, '%') as entry", "id as position")
    got = pattern_index.select_by_table(names, often.union(out))
    assert got.count() == 0
    names = names.union(spark.sql("SELECT 'main'"))
    got = pattern_index.select_by_table(names, often.union(out).union(spark.sql("SELECT CAST(NULL AS INT), 'DB1%', 4")).union(spark.sql("SELECT CAST(NULL AS INT), '-db1_', 1")))
    found = {(r["selection"], r["name"], r["start_position"]) for r in got.collect()}
    assert found == {(1, "main", 5)} | {(None, f"db{i}", 4) for i in range(2000) if str(i).startswith("1")}
    met = pattern_index._met(names.withColumnRenamed("name", "_name").selectExpr("_name", "'U' as _type", "0 as _group"), pattern_index.rules_of(often.union(out)).where("start_position IS NOT NULL"))
    assert met.count() == 2001
