"""Grants in factored form: classes of equal grants, nested membership, DENY over GRANT.

What every member of every role may do is a product of members and grants.  Here it is
kept as its factors: each distinct set of grants is one class, written once; members are
linked to classes; and members with the same classes share a profile.  The tables grow
with grants plus memberships, and :func:`expanded` makes the product where it is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import DATABASE, shared_keys
from fleetlens.session import checkpoint_root

SECURABLE = ("class_desc", "major_id", "minor_id", "permission_name")


def _fixed(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def _set_mark(*columns: str) -> list:
    """Aggregates that tell sets apart whatever the order of their rows (some 200 bits);
    they are partial before the shuffle, so a set of any size is no single row."""
    first, second = F.xxhash64(*columns), F.xxhash64(*columns, F.lit(7))
    return [F.count(F.lit(1)).alias("n_grants"), F.sum(first.cast("decimal(20,0)")).alias("_s"), F.bit_xor(second).alias("_x"), F.sum(second.cast("decimal(20,0)")).alias("_t")]


def named_sets(rows: DataFrame, k: list[str], owner: str, columns: Sequence[str], name: str) -> DataFrame:
    """``owner``, ``name``, ``n_grants``: owners of equal sets of ``columns`` have one ``name``, the least owner."""
    marks = _fixed(rows.groupBy(*k, owner).agg(*_set_mark(*columns)))
    equal = [*k, "n_grants", "_s", "_x", "_t"]
    least = marks.groupBy(*equal).agg(F.min(owner).alias(name))
    return marks.join(least, equal).select(*k, owner, name, "n_grants")


def nested_roles(role_members: DataFrame) -> DataFrame:
    """``member_principal_id``, ``role_principal_id``, ``depth``, ``in_cycle``: every role a member is in,
    directly (depth 1) or through other roles, by the shortest way.

    Only memberships of roles in roles are closed, by pointer jumping: each round joins the
    paths with themselves, so n rounds reach a depth of 2^n; a cycle adds no further pairs and
    ends the rounds.  ``in_cycle`` marks roles that contain themselves.  A membership of a role in itself
    says nothing.  Only the number of paths of each round reaches the driver.
    """
    k = shared_keys(role_members, scope=DATABASE)
    own = role_members.select(*k, F.col("member_principal_id").alias("m"), F.col("role_principal_id").alias("r"))
    edges = _fixed(own.where("m <> r").distinct())
    roles = edges.select(*k, F.col("r").alias("m")).distinct()
    paths = _fixed(edges.join(roles, [*k, "m"], "left_semi").withColumn("depth", F.lit(1)))
    before, n = -1, paths.count()
    while n > before:
        on = paths.select(*k, F.col("m").alias("r"), F.col("r").alias("_far"), F.col("depth").alias("_more"))
        longer = paths.join(on, [*k, "r"]).select(*k, "m", F.col("_far").alias("r"), (F.col("depth") + F.col("_more")).alias("depth"))
        paths = _fixed(paths.unionByName(longer).groupBy(*k, "m", "r").agg(F.min("depth").alias("depth")))
        before, n = n, paths.count()
    up = paths.select(*k, F.col("m").alias("r"), F.col("r").alias("_far"), "depth")
    through = edges.join(up, [*k, "r"]).select(*k, "m", F.col("_far").alias("r"), (F.col("depth") + 1).alias("depth"))
    every = edges.withColumn("depth", F.lit(1)).unionByName(through).groupBy(*k, "m", "r").agg(F.min("depth").alias("depth"))
    rings = paths.where("m = r").select(*k, "r", F.lit(True).alias("in_cycle"))
    return every.join(rings, [*k, "r"], "left").select(
        *k, F.col("m").alias("member_principal_id"), F.col("r").alias("role_principal_id"), "depth", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle")
    )


def _grants(permissions: DataFrame, k: list[str]) -> DataFrame:
    return permissions.groupBy(*k, "grantee_principal_id", *SECURABLE, "state_desc").agg(F.count(F.lit(1)).alias("times"))


def grant_classes(permissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grantee, ``class_id``, ``n_grants``) and the distinct grants of each class, with ``times``.

    Principals with the same grants, repeats included, share a class, named by the least of them.
    """
    k = shared_keys(permissions, scope=DATABASE)
    grants = _fixed(_grants(permissions, k))
    owners = _fixed(named_sets(grants, k, "grantee_principal_id", [*SECURABLE, "state_desc", "times"], "class_id"))
    first = owners.where("grantee_principal_id = class_id").select(*k, "class_id")
    rows = grants.withColumnRenamed("grantee_principal_id", "class_id").join(first, [*k, "class_id"], "left_semi")
    return owners, rows


def member_classes(role_members: DataFrame, principals: DataFrame, owners: DataFrame) -> DataFrame:
    """``member_principal_id``, names, ``role_principal_id``, ``class_id``, ``n_grants``: a row for each membership.

    ``role_members`` may be :func:`nested_roles`.  A role without grants has a null class."""
    k = shared_keys(role_members, principals, owners, scope=DATABASE)
    names = principals.select(*k, "principal_id", "name", "type_desc")
    members = names.select(*k, F.col("principal_id").alias("member_principal_id"), F.col("name").alias("member_name"), F.col("type_desc").alias("member_type"))
    roles = names.select(*k, F.col("principal_id").alias("role_principal_id"), F.col("name").alias("role_name"))
    return (
        role_members.select(*k, "member_principal_id", "role_principal_id")
        .join(members, [*k, "member_principal_id"]).join(roles, [*k, "role_principal_id"], "left")
        .join(owners.withColumnRenamed("grantee_principal_id", "role_principal_id"), [*k, "role_principal_id"], "left")
        .withColumn("n_grants", F.coalesce("n_grants", F.lit(0)))
    )


def expanded(links: DataFrame, class_rows: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """The product of :func:`member_classes` and the grants of the classes: what each member may do through
    each role, as often as it was granted.  Names are looked up once for each grant of a class."""
    k = shared_keys(links, class_rows, scope=DATABASE)
    rows = class_rows
    if objects is not None:
        names = objects.select(*k, F.col("object_id").alias("major_id"), F.col("name").alias("object_name"))
        rows = rows.join(names, [*k, "major_id"], "left")
    rows = rows.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_each", "times", "major_id", "minor_id")
    return links.join(rows, [*k, "class_id"], "left").drop("class_id", "n_grants", "member_principal_id", "role_principal_id")


def profiles(role_members: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member, ``profile_id``) and (``profile_id``, ``class_id``): members whose roles have the same classes
    share a profile, named by the least of them.  Members of roles without grants have none."""
    k = shared_keys(role_members, owners, scope=DATABASE)
    of_role = owners.select(*k, F.col("grantee_principal_id").alias("role_principal_id"), "class_id")
    held = _fixed(role_members.select(*k, "member_principal_id", "role_principal_id").join(of_role, [*k, "role_principal_id"]).select(*k, "member_principal_id", "class_id").distinct())
    named = _fixed(named_sets(held, k, "member_principal_id", ["class_id"], "profile_id").drop("n_grants"))
    first = named.where("member_principal_id = profile_id").select(*k, "profile_id")
    return named, held.withColumnRenamed("member_principal_id", "profile_id").join(first, [*k, "profile_id"], "left_semi")


def _decided(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A DENY anywhere wins over every GRANT."""
    return rows.groupBy(*keys).agg(F.when(F.max((F.col("state_desc") == "DENY").cast("int")) == 1, "DENY").otherwise("GRANT").alias("state_desc"))


def profile_permissions(profile_classes: DataFrame, class_rows: DataFrame) -> DataFrame:
    """``profile_id``, securable, ``state_desc``: what the roles of a profile allow or deny together."""
    k = shared_keys(profile_classes, class_rows, scope=DATABASE)
    return _decided(profile_classes.join(class_rows, [*k, "class_id"]), [*k, "profile_id", *SECURABLE])


def member_permissions(permissions: DataFrame, members: DataFrame, profile_rows: DataFrame) -> DataFrame:
    """Each principal's own grants as they hold: ``state_desc`` after DENY over GRANT, here and in its roles,
    and ``decided_by`` (own, role, both).  What its profile has beyond these holds unchanged."""
    k = shared_keys(permissions, members, profile_rows, scope=DATABASE)
    own = _decided(permissions, [*k, "grantee_principal_id", *SECURABLE]).join(
        members.withColumnRenamed("member_principal_id", "grantee_principal_id"), [*k, "grantee_principal_id"], "left"
    )
    both = own.join(profile_rows.withColumnRenamed("state_desc", "_role"), [*k, "profile_id", *SECURABLE], "left")
    deny = (F.col("state_desc") == "DENY") | F.coalesce(F.col("_role") == "DENY", F.lit(False))
    by = F.when(F.col("_role").isNull(), "own").when(F.col("_role") == F.col("state_desc"), "both").when(F.col("_role") == "DENY", "role").otherwise("own")
    return both.select(*k, "grantee_principal_id", "profile_id", *SECURABLE, F.when(deny, "DENY").otherwise("GRANT").alias("state_desc"), by.alias("decided_by"))
