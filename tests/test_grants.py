"""Factored grants: expansion, equal sets, nested roles with cycles, DENY over GRANT."""

from pyspark.sql import functions as F

from fleetlens.operators import grants, security
from fleetlens.sources.tables import Tables

PERMISSIONS = "grantee_principal_id long, major_id long, minor_id long, class_desc string, permission_name string, state_desc string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def given(spark):
    # 1 and 2 have equal grants, 3 has one of them twice, 4 the same with DENY
    made = [(g, m, 0, "OBJECT", "SELECT", "GRANT") for g in (1, 2) for m in (10, 11)]
    made += [(3, 10, 0, "OBJECT", "SELECT", "GRANT")] * 2 + [(3, 11, 0, "OBJECT", "SELECT", "GRANT"), (4, 10, 0, "OBJECT", "SELECT", "DENY")]
    made += [(20, 10, 0, "OBJECT", "SELECT", "GRANT"), (20, 12, 0, "OBJECT", "SELECT", "DENY"), (21, 11, 0, "OBJECT", "SELECT", "GRANT")]
    return spark.createDataFrame(made, PERMISSIONS)


def test_equal_sets_are_one_class(spark):
    owners, class_rows = grants.grant_classes(given(spark))
    assert rows(owners, "grantee_principal_id", "class_id") == [(1, 1), (2, 1), (20, 20), (21, 21), (3, 3), (4, 4)]
    assert rows(class_rows.where("class_id < 4"), "class_id", "major_id", "times") == [(1, 10, 1), (1, 11, 1), (3, 10, 2), (3, 11, 1)]
    none = grants.grant_classes(given(spark).limit(0))
    assert none[0].count() == 0 and none[1].count() == 0


def test_expansion_is_the_product(spark, small_dir):
    t = Tables(spark, small_dir)
    owners, class_rows = grants.grant_classes(t.db_permissions)
    links = grants.member_classes(t.db_role_members, t.db_principals, owners)
    whole = security.role_effective_permissions(t.db_role_members, t.db_principals, t.db_permissions, t.db_objects)
    got = grants.expanded(links, class_rows, t.db_objects).select(whole.columns)
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.bit_xor(F.xxhash64(F.lit(3), *df.columns))).first()
    assert mark(got) == mark(whole)
    assert links.count() == t.db_role_members.count() and class_rows.count() <= t.db_permissions.count()
    few = spark.createDataFrame([(30, 3), (31, 5)], "member_principal_id long, role_principal_id long")
    people = spark.createDataFrame([(i, f"p{i}", "x") for i in (3, 5, 30, 31)], "principal_id long, name string, type_desc string")
    owners, class_rows = grants.grant_classes(given(spark))
    got = grants.expanded(grants.member_classes(few, people, owners), class_rows)
    assert rows(got, *got.columns) == rows(security.role_effective_permissions(few, people, given(spark)).select(got.columns), *got.columns)
    assert got.count() == 4


def test_long_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(40, 38), (100, 100), (101, 0), (101, 0), (102, None)]
    got = grants.nested_roles(spark.createDataFrame(edges, "member_principal_id long, role_principal_id long"))
    found = {(r[0], r[1]): (r[2], r[3]) for r in got.collect()}
    step = {m: r for m, r in edges[:40]}
    want = {}
    for m in [*range(41), 101]:
        seen, todo = {}, [(0, m)]
        while todo:
            d, x = todo.pop(0)
            for y in [step[x]] if x in step else [38] if x == 40 else [0] if x == 101 else []:
                if y not in seen:
                    seen[y] = d + 1
                    todo.append((d + 1, y))
        want |= {(m, r): (d, r in (38, 39, 40)) for r, d in seen.items()}
    assert found == want and found[0, 40] == (40, True)
    assert grants.nested_roles(spark.createDataFrame([], "member_principal_id long, role_principal_id long")).count() == 0


def test_deny_wins(spark):
    members = spark.createDataFrame([(20, 1), (20, 4), (21, 2), (21, 4), (22, 3)], "member_principal_id long, role_principal_id long")
    owners, class_rows = grants.grant_classes(given(spark))
    held, classes = grants.profiles(members, owners)
    assert rows(held, "member_principal_id", "profile_id") == [(20, 20), (21, 20), (22, 22)]
    allowed = grants.profile_permissions(classes, class_rows)
    assert rows(allowed, "profile_id", "major_id", "state_desc") == [(20, 10, "DENY"), (20, 11, "GRANT"), (22, 10, "GRANT"), (22, 11, "GRANT")]
    own = grants.member_permissions(given(spark), held, allowed).where("grantee_principal_id >= 20")
    assert rows(own, "grantee_principal_id", "major_id", "state_desc", "decided_by") == [
        (20, 10, "DENY", "role"), (20, 12, "DENY", "own"), (21, 11, "GRANT", "both"),
    ]


def test_additional_permissions_are_made_distinct_once(spark):
    users = spark.createDataFrame([(20, "u", "SQL_USER"), (4, "dbo", "SQL_USER")], "principal_id long, name string, type_desc string")
    objects = spark.createDataFrame([(10, "o", "VIEW", 1), (11, "o", "VIEW", 1), (12, "p", "VIEW", 2)], "object_id long, name string, type_desc string, schema_id long")
    schemas = spark.createDataFrame([(1, "s")], "schema_id long, name string")
    more = given(spark).union(given(spark)).union(spark.createDataFrame([(20, 11, 3, "OBJECT", "SELECT", "GRANT"), (20, 11, 0, "DATABASE", "CONNECT", "GRANT")], PERMISSIONS))
    got = security.additional_permissions(users, more, objects, schemas)
    assert rows(got, "database_user", "permission_state", "object_name") == [("u", "DENY", ""), ("u", "GRANT", "[s].[o]")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_audit_reads_every_grant_once(spark):
    """Before, the grants were read and shuffled once for each part of the audit, and again for the names of securables."""
    people = spark.createDataFrame(
        [(5, "u", "S", 1), (7, "u", "S", 1), (5, "v", "U", 1), (6, "w", "U", 9), (8, "x", "G", 1), (3, "dbo", "S", 1), (-1, "public", "R", None), (-2, "r", "R", None),
         (-3, None, "R", None), (-4, "empty", "R", None)], "principal_id long, name string, type string, sid long",
    )
    logins = spark.createDataFrame([(1, "D/l")], "sid long, name string")
    made = [(5, 10, 1, "OBJECT", "SELECT", "GRANT"), (5, 10, 1, "COLUMN", "SELECT", "GRANT"), (7, 10, 1, "OBJECT", "SELECT", "GRANT"), (7, 12, 0, "OBJECT", "SELECT", "DENY"),
            (-1, 10, 0, "OBJECT", "SELECT", "GRANT"), (-1, 11, 0, "OBJECT", "SELECT", "GRANT"), (-2, 10, 0, "OBJECT", "UPDATE", "GRANT"), (-2, 13, 0, "OBJECT", "UPDATE", "GRANT"),
            (-3, 12, 0, "OBJECT", "SELECT", "DENY"), (99, 10, 0, "OBJECT", "SELECT", "GRANT")]
    permissions = spark.createDataFrame(made, PERMISSIONS)
    members = spark.createDataFrame([(8, -2), (8, -2), (7, -3), (6, -4), (6, None), (77, -2)], "member_principal_id long, role_principal_id long")
    columns = spark.createDataFrame([(10, 1, "c")], "object_id long, column_id long, name string")
    objects = spark.createDataFrame([(10, "o", "VIEW", 0), (11, "s", "VIEW", 1), (13, "o", "VIEW", 0)], "object_id long, name string, type_desc string, is_ms_shipped int")
    got = security.user_permission_audit(people, logins, permissions, members, columns, objects)
    u, w = ("u", "SQL User", "u"), (None, "Windows User", "w")
    assert rows(got, *got.columns) == sorted([
        (*u, None, "SELECT", "GRANT", "VIEW", "o", "c"), (*u, None, "SELECT", "DENY", None, None, None),
        ("D/l", "Windows User", "v", None, "SELECT", "GRANT", "VIEW", "o", "c"), (*w, None, None, None, None, None, None),
        (*w, "empty", None, None, None, None, None), (None, None, "x", "r", "UPDATE", "GRANT", "VIEW", "o", None),
        (*["{All Users}"] * 3, "public", "SELECT", "GRANT", "VIEW", "o", None),
    ], key=repr)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [grantee_principal_id") == 1
    # owners are held in memory, not the grants of a role
    assert "LeftOuter, BuildLeft" in got._jdf.queryExecution().executedPlan().toString()
