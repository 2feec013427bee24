"""Every registered query against its check SQL, and against itself on a fleet."""

import os

import pytest

from fleetlens.plans import load_all
from fleetlens.sources.tables import BASE, FleetTables, Tables

duckdb = pytest.importorskip("duckdb")
REGISTRY = load_all()

# these write their own server tags, read base tables directly, or take a top over the whole fleet
NOT_FLEET = {
    "catalog_listing",
    "snapshot_scan", "fleet_union", "trace_scan", "report_batch", "bulk_append", "unmatched_selections",
    "adaptive_join_sum", "product_sales", "staged_self_join",
}


@pytest.fixture(scope="module")
def check(small_dir):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_matches_check_sql(spark, small_dir, check, name):
    q = REGISTRY[name]
    got = q.run(spark, small_dir).select(*q.columns).collect()
    if q.sql is None:
        assert got
        return
    assert ordered(got) == ordered(check.execute(q.check_sql()).fetchall())


def test_every_line_is_a_grant(spark, small_dir, check):
    """No row of lineitem is left out of the grants, and both sides of them are there."""
    t = Tables(spark, small_dir)
    lines = check.execute("SELECT DISTINCT l_partkey, l_linenumber % 3, l_linestatus FROM lineitem").fetchall()
    found = t.db_permissions.selectExpr("major_id", "minor_id", "CASE state_desc WHEN 'GRANT' THEN 'F' ELSE 'O' END AS status").distinct().collect()
    assert ordered(found) == ordered(lines)
    assert t.server_permissions.count() == check.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert t.db_permissions.filter("grantee_principal_id < 0").count() and t.db_permissions.filter("grantee_principal_id > 0").count()


def test_statements_reach_over_all_documents(spark, small_dir, check):
    """Plans have texts from the first to the last tenth of the documents."""
    end = check.execute("SELECT max(doc_id) + 1 FROM documents").fetchone()[0]
    plans = Tables(spark, small_dir).query_stats
    found = {r["sql_handle"] * 10 // end for r in plans.select("sql_handle").collect()}
    assert found == set(range(10))
    assert plans.agg({"execution_count": "sum"}).first()[0] == check.execute("SELECT count(*) FROM events WHERE user_id IS NOT NULL").fetchone()[0]


FLEET = [n for n in REGISTRY if n not in NOT_FLEET and not n.startswith("stream_")]
# always run: a window, an existence test, a rollup, a selection, permissions, factored grants
ALWAYS = {"wait_pareto", "indexes_unused", "table_size_rollup", "select_by_patterns", "user_permission_audit", "member_grant_classes", "profile_permissions"}
_often = pytest.mark.skipif(not os.environ.get("FLEET_TESTS"), reason="set FLEET_TESTS=1; runs every query twice")


@pytest.mark.parametrize("name", [n if n in ALWAYS else pytest.param(n, marks=_often) for n in FLEET])
def test_servers_do_not_mix(spark, small_dir, name):
    """On a fleet of equal servers each server gets the result of a single one."""
    q = REGISTRY[name]
    alone = ordered(q.shape(q.build(Tables(spark, small_dir))).collect())
    fleet = q.shape(q.build(FleetTables(spark, small_dir, ("s1", "s2"))))
    assert "server_name" in fleet.columns
    for server in ("s1", "s2"):
        assert ordered(fleet.filter(fleet.server_name == server).drop("server_name").collect()) == alone
