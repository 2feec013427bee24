"""Permissions, logins, configuration, features, row-level rules and ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.fleet import DATABASE, existing, has, optional, shared_keys
from fleetlens.functions.tsql import blank_if_null, decode, int_div, text

# fixed values: built-in database principals
BUILTIN_PRINCIPALS = (
    "public", "guest", "dbo", "sys", "db_backupoperator", "db_denydatareader", "db_ddladmin", "db_denydatawriter",
    "db_owner", "db_datareader", "db_accessadmin", "db_securityadmin", "db_datawriter", "INFORMATION_SCHEMA",
)
GRANTABLE_TYPES = ("SQL_USER", "WINDOWS_USER", "WINDOWS_GROUP", "EXTERNAL_USER", "EXTERNAL_GROUP", "APPLICATION_ROLE")
SERVICE_LOGINS = ("##MS_PolicyEventProcessingLogin##", "MS_DataCollectorInternalUser", "##MS_PolicyTsqlExecutionLogin##")
# parts that the grants of one role are listed in: its members are repeated as often
PIECES = 8
NON_USER_DATABASES = ("master", "msdb", "tempdb", "model", "reportserver", "reportservertempdb")


def _names(principals: DataFrame, k: list[str], id_as: str, name_as: str, *extra: Column | str) -> DataFrame:
    return principals.select(*k, F.col("principal_id").alias(id_as), F.col("name").alias(name_as), *extra)


def _object_names(objects: DataFrame, k: list[str]) -> DataFrame:
    return objects.select(*k, F.col("object_id").alias("major_id"), F.col("name").alias("object_name"), F.col("type_desc").alias("object_type"),
                          *optional(objects, "schema_id", "is_ms_shipped"))


def user_permission_audit(
    principals: DataFrame, logins: DataFrame, permissions: DataFrame, role_members: DataFrame, columns: DataFrame,
    objects: DataFrame, public_role: str = "public", min_principal_id: int = 4,
) -> DataFrame:
    """Everything a user may do: direct grants, grants through roles, grants to everyone.

    Grants are read once and moved three times: to the principals that are listed, to the names of
    securables, and to those who hold them, where they are made distinct.  Until then a grant carries
    no user: ``_holder`` and ``_nth`` stand for users of equal names or for roles of one name.  The
    grants of a role lie in ``PIECES`` parts, each beside all its members.
    """
    k = shared_keys(principals, logins, permissions, role_members, columns, objects, scope=DATABASE)
    token = logins.select(*k, "sid", F.col("name").alias("_login"))
    kind = {"S": "SQL User", "U": "Windows User"}
    user = {
        "user_name": F.when(F.col("type") == "S", F.col("name")).when(F.col("type") == "U", F.col("_login")),
        "user_type": decode("type", kind), "database_user_name": F.col("name"),
    }
    by_user, by_role, by_public = F.lit(0), F.lit(1), F.lit(2)
    known = principals.filter(F.col("principal_id").isNotNull())

    def held_as(df: DataFrame, *names: str) -> DataFrame:
        """Rows of equal names have one holder: the least of their ids, with a number as an id may have several names."""
        own = F.struct("principal_id", F.dense_rank().over(Window.partitionBy(*k, "principal_id").orderBy(*names)).alias("nth"))
        least = F.min("_own").over(Window.partitionBy(*k, *names))
        df = df.withColumn("_own", own).withColumn("_least", least)
        return df.withColumns({"_holder": F.col("_least.principal_id"), "_nth": F.col("_least.nth"), "_first": F.col("_own") == F.col("_least")}).drop("_own", "_least")

    listed = F.col("type").isin("S", "U") & (F.col("principal_id") > min_principal_id) & ~F.col("name").isin("NT AUTHORITY\\SYSTEM", "dbo")
    people = held_as(known.join(token, [*k, "sid"], "left").withColumns(user).select(*k, "principal_id", *user, listed.alias("_listed")), *user)
    roles = _names(known, k, "principal_id", "role_name").join(
        existing(role_members, [*k, "role_principal_id"]).withColumnRenamed("role_principal_id", "principal_id"), [*k, "principal_id"], "left_semi"
    )
    roles = held_as(roles, "role_name")
    members = (
        role_members.select(*k, F.col("role_principal_id").alias("principal_id"), "member_principal_id")
        .join(roles, [*k, "principal_id"])
        .join(people.select(*k, F.col("principal_id").alias("member_principal_id"), F.col("_holder").alias("_member"), F.col("_nth").alias("_member_nth"), *user),
              [*k, "member_principal_id"])
    )
    # what comes through a role without a name looks like a user's own grant: its members hold it themselves
    unnamed = (
        members.filter(F.col("role_name").isNull()).select(*k, "_holder", "_nth", "_member", "_member_nth").distinct()
        .join(roles.filter(F.col("role_name").isNull()).select(*k, "_holder", "_nth", "principal_id"), [*k, "_holder", "_nth"])
        .select(*k, "principal_id", F.col("_member").alias("_holder"), F.col("_member_nth").alias("_nth"))
    )
    everyone = held_as(_names(known.filter((F.col("type") == "R") & (F.col("name") == public_role)), k, "principal_id", "role_name"), "role_name")
    as_owner = (*k, "principal_id", "_holder", "_nth")
    owners = (
        people.filter("_listed").select(*as_owner, by_user.alias("_part"))
        .unionByName(unnamed.select(*as_owner, by_user.alias("_part")))
        .unionByName(roles.filter(F.col("role_name").isNotNull()).select(*as_owner, by_role.alias("_part")))
        .unionByName(everyone.select(*as_owner, by_public.alias("_part")))
        .distinct()
    )
    # owners are few beside grants, so they are what is held in memory; one without grants stays.  Only whole pairs are named
    securable = F.when(F.col("minor_id").isNotNull(), F.col("major_id")).alias("major_id")
    grants = permissions.select(*k, F.col("grantee_principal_id").alias("principal_id"), securable, "minor_id", "permission_name", "state_desc")
    grants = owners.hint("shuffle_hash").join(grants, [*k, "principal_id"], "left").drop("principal_id")
    named = grants.join(_object_names(objects, k).drop("schema_id"), [*k, "major_id"], "left")
    # the column is compared as a range: as an equal key it would move the grants again, by object and column
    columns = columns.select(*[F.col(c).alias(f"_of_{c}") for c in k], F.col("object_id").alias("_of"), "column_id", F.col("name").alias("column_name"))
    same = [named[c] == columns[f"_of_{c}"] for c in k] + [named["major_id"] == columns["_of"]]
    named = named.join(columns, [*same, named["minor_id"] >= columns["column_id"], named["minor_id"] <= columns["column_id"]], "left")
    shipped = (F.col("is_ms_shipped") == 0) if has(objects, "is_ms_shipped") else F.col("object_name").isNotNull()
    shown = ("permission_name", "state_desc", "object_type", "object_name", "column_name")
    beside = (*k, "_part", "_holder", "_nth", "_piece")
    piece = F.when(F.col("_part") == by_user, F.lit(0)).otherwise(F.pmod(F.xxhash64(*shown), F.lit(PIECES)).cast("int"))
    named = named.filter((F.col("_part") != by_public) | shipped).withColumn("_piece", piece).select(*beside, *shown)
    pieces = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("_piece")
    all_users = F.lit("{All Users}")
    holders = (
        people.filter("_first").select(
            *k, by_user.alias("_part"), "_holder", "_nth", F.lit(0).alias("_piece"), *user, F.lit(None).cast("string").alias("role_name")
        ).distinct()
        .unionByName(
            members.filter(F.col("role_name").isNotNull()).select(*k, by_role.alias("_part"), "_holder", "_nth", *user, "role_name").distinct().select("*", pieces)
        )
        .unionByName(
            everyone.select(*k, by_public.alias("_part"), "_holder", "_nth", *[all_users.alias(c) for c in user], "role_name").distinct().select("*", pieces)
        )
    )
    return named.repartition(*beside).distinct().join(holders.hint("shuffle_hash"), [*beside]).select(
        *k, *user, "role_name", F.col("permission_name").alias("permission_type"), F.col("state_desc").alias("permission_state"),
        "object_type", "object_name", "column_name",
    )


def role_and_grant_listing(
    role_members: DataFrame, principals: DataFrame, permissions: DataFrame, objects: DataFrame | None = None,
    keep_unassigned: bool = True, types: Sequence[str] = GRANTABLE_TYPES,
) -> DataFrame:
    """Roles of every user and their explicit grants, padded to one shape.

    ``keep_unassigned`` also lists users without a role.
    """
    k = shared_keys(role_members, principals, permissions, scope=DATABASE)
    people = principals.filter(F.col("type_desc").isin(*types)).select(
        *k, "principal_id", F.col("name").alias("principal_name"), F.col("type_desc").alias("principal_type")
    )
    how = "left" if keep_unassigned else "inner"
    membership = role_members.select(*k, F.col("member_principal_id").alias("principal_id"), "role_principal_id")
    # only the state of a user's grants is shown here, so the grants shrink first
    states = permissions.select(*k, F.col("grantee_principal_id").alias("principal_id"), F.col("state_desc").alias("role_state")).distinct()
    roles = (
        people.join(membership, [*k, "principal_id"], how)
        .join(_names(principals, k, "role_principal_id", "role_name"), [*k, "role_principal_id"], how)
        .join(states, [*k, "principal_id"], how)
        .select(*k, "principal_name", "principal_type", "role_name", "role_state")
    )
    grants = permissions.filter(F.col("permission_name") != "CONNECT").withColumnRenamed("grantee_principal_id", "principal_id").join(people, [*k, "principal_id"])
    if objects is not None:
        grants = grants.join(_object_names(objects, k).select(*k, "major_id", "object_name"), [*k, "major_id"], "left")
    else:
        grants = grants.withColumn("object_name", F.lit(None).cast("string"))
    grants = grants.select(
        *k, "principal_name", "principal_type", "permission_name", F.col("state_desc").alias("permission_state"),
        F.col("class_desc").alias("permission_class"), "object_name",
    )
    return roles.unionByName(grants, allowMissingColumns=True).distinct()


def user_roles(principals: DataFrame, role_members: DataFrame, builtin: Sequence[str] = BUILTIN_PRINCIPALS) -> DataFrame:
    """Own users with the roles they belong to."""
    k = shared_keys(principals, role_members, scope=DATABASE)
    users = principals.filter(~F.col("name").isin(*builtin)).select(
        *k, F.col("principal_id").alias("member_principal_id"), F.col("name").alias("database_user"),
        F.col("type_desc").alias("user_type"), *optional(principals, "authentication_type_desc"),
    )
    roles = _names(principals.filter(F.col("name") != ""), k, "role_principal_id", "role_name")
    return (
        role_members.select(*k, "member_principal_id", "role_principal_id").join(users, [*k, "member_principal_id"])
        .join(roles, [*k, "role_principal_id"]).drop("member_principal_id", "role_principal_id").distinct()
    )


def additional_permissions(
    principals: DataFrame, permissions: DataFrame, objects: DataFrame, schemas: DataFrame, builtin: Sequence[str] = BUILTIN_PRINCIPALS
) -> DataFrame:
    """Own users' grants other than CONNECT, with the quoted object name."""
    k = shared_keys(principals, permissions, objects, schemas, scope=DATABASE)
    users = principals.filter(~F.col("name").isin(*builtin)).select(
        *k, F.col("principal_id").alias("grantee_principal_id"), F.col("name").alias("database_user"), F.col("type_desc").alias("user_type")
    )
    # made distinct once, at the end: before the lookups it would be one more shuffle, of hardly fewer rows, into larger parts
    grants = permissions.filter(~F.col("permission_name").isin("CONNECT", "")).select(
        *k, "grantee_principal_id", "major_id", "permission_name", "state_desc"
    )
    owners = schemas.select(*k, "schema_id", F.col("name").alias("_schema"))
    quoted = F.concat(F.lit("["), "_schema", F.lit("].["), "object_name", F.lit("]"))
    return (
        grants.join(users, [*k, "grantee_principal_id"])
        .join(_object_names(objects, k), [*k, "major_id"], "left").join(owners, [*k, "schema_id"], "left")
        .select(*k, "database_user", "user_type", F.col("permission_name").alias("additional_permission"),
                blank_if_null("state_desc").alias("permission_state"), blank_if_null("object_type").alias("object_type"),
                F.coalesce(quoted, F.lit("")).alias("object_name"))
        .distinct()
    )


def role_members_listing(principals: DataFrame, role_members: DataFrame) -> DataFrame:
    """Every role with each member, or 'No members'."""
    k = shared_keys(principals, role_members, scope=DATABASE)
    roles = _names(principals.filter(F.col("type") == "R"), k, "role_principal_id", "role_name")
    members = role_members.select(*k, "role_principal_id", "member_principal_id")
    users = _names(principals, k, "member_principal_id", "_user")
    return (
        roles.join(members, [*k, "role_principal_id"], "left").join(users, [*k, "member_principal_id"], "left")
        .select(*k, "role_name", F.coalesce("_user", F.lit("No members")).alias("user_name"))
    )


def role_effective_permissions(role_members: DataFrame, principals: DataFrame, permissions: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Permissions each member has through each role; roles without any stay."""
    k = shared_keys(role_members, principals, permissions, scope=DATABASE)
    members = (
        role_members.select(*k, "role_principal_id", "member_principal_id")
        .join(_names(principals, k, "member_principal_id", "member_name", F.col("type_desc").alias("member_type")), [*k, "member_principal_id"])
        .join(_names(principals, k, "role_principal_id", "role_name"), [*k, "role_principal_id"], "left")
    )
    grants = permissions.select(*k, F.col("grantee_principal_id").alias("role_principal_id"), "major_id", "class_desc", "permission_name", "state_desc")
    if objects is not None:
        grants = grants.join(_object_names(objects, k).select(*k, "major_id", "object_name"), [*k, "major_id"], "left")
    return members.join(grants, [*k, "role_principal_id"], "left").drop("role_principal_id", "member_principal_id", "major_id")


def role_object_permissions(principals: DataFrame, permissions: DataFrame, schemas: DataFrame, objects: DataFrame) -> DataFrame:
    """Object-level permissions of roles, with type and name fallbacks."""
    k = shared_keys(principals, permissions, schemas, objects, scope=DATABASE)
    roles = _names(
        principals.filter((F.col("type_desc") == "DATABASE_ROLE") & (F.col("name") != "public")), k, "grantee_principal_id", "role_name",
        F.col("type_desc").alias("role_type"),
    )
    grants = permissions.filter(F.col("class_desc") != "DATABASE").select(
        *k, "grantee_principal_id", "major_id", "class_desc", "permission_name", "state_desc"
    ).distinct()
    as_schema = schemas.select(*k, F.col("schema_id").alias("major_id"), F.col("name").alias("_own_schema"))
    owners = schemas.select(*k, "schema_id", F.col("name").alias("schema_name"))
    fallback = F.col("object_type").isNull() | (F.col("object_type") == "SYSTEM_TABLE")
    return (
        grants.join(roles, [*k, "grantee_principal_id"]).join(as_schema, [*k, "major_id"], "left")
        .join(_object_names(objects, k), [*k, "major_id"], "left").join(owners, [*k, "schema_id"], "left")
        .select(*k, "role_name", "role_type", "class_desc", "permission_name", "state_desc",
                F.when(fallback, F.col("class_desc")).otherwise(F.col("object_type")).alias("object_type"), "schema_name",
                F.coalesce("_own_schema", "object_name").alias("object_name"))
        .distinct()
    )


def user_owned_schemas(principals: DataFrame, schemas: DataFrame) -> DataFrame:
    """Users with each schema they own, '' when none."""
    k = shared_keys(principals, schemas, scope=DATABASE)
    users = principals.filter(
        F.col("type").isin("S", "U") & ~F.col("name").isin("dbo", "guest", "sys", "INFORMATION_SCHEMA") & ~F.col("name").isin(*SERVICE_LOGINS)
    )
    if has(principals, "database_name"):
        users = users.filter(~F.lower("database_name").isin(*NON_USER_DATABASES))
    owned = schemas.select(*k, "principal_id", F.col("name").alias("_schema"))
    return users.join(owned, [*k, "principal_id"], "left").select(
        *k, F.col("name").alias("login_name"), F.coalesce("_schema", F.lit("")).alias("owned_schema")
    )


SERVER_ROLES = ("sysadmin", "serveradmin", "securityadmin", "denylogin")


def login_status(server_principals: DataFrame, syslogins: DataFrame) -> DataFrame:
    """Logins with their state and server-role marks."""
    k = shared_keys(server_principals, syslogins)
    marks = syslogins.select(*k, F.col("login_name").alias("name"), *[F.col(r).alias(f"_{r}") for r in SERVER_ROLES])
    return (
        server_principals.filter(~F.col("type").isin("G", "R")).join(marks, [*k, "name"], "left")
        .select(*k, F.col("name").alias("login"), F.col("type_desc").alias("login_type"),
                F.when(F.col("is_disabled") == 1, F.lit("Disabled")).otherwise(F.lit("Enabled")).alias("status"),
                *[F.when(F.col(f"_{r}") == 1, F.lit(r)).otherwise(F.lit("")).alias(r) for r in SERVER_ROLES])
    )


def database_owner_audit(databases: DataFrame, expected: str = "sa", owner_col: str = "owner", include_null: bool = False) -> DataFrame:
    """Databases with another owner; an unknown owner only with ``include_null``."""
    other = F.col(owner_col) != expected
    return databases.filter(other | F.col(owner_col).isNull()) if include_null else databases.filter(other)


def endpoint_permissions(
    server_permissions: DataFrame, endpoints: DataFrame, principals: DataFrame, name: str | None = None
) -> DataFrame:
    """Grants on endpoints with the names of grantor and grantee."""
    k = shared_keys(server_permissions, endpoints, principals)
    targets = endpoints.select(*k, F.col("endpoint_id").alias("major_id"), F.col("name").alias("endpoint_name"), *optional(endpoints, "state_desc"))
    if name is not None:
        targets = targets.filter(F.col("endpoint_name") == name)
    if has(targets, "state_desc"):
        targets = targets.withColumnRenamed("state_desc", "endpoint_state")
    return (
        server_permissions.join(targets, [*k, "major_id"])
        .join(_names(principals, k, "grantee_principal_id", "granted_to"), [*k, "grantee_principal_id"])
        .join(_names(principals, k, "grantor_principal_id", "granted_by"), [*k, "grantor_principal_id"], "left")
    )


# --- configuration ------------------------------------------------------------------


# fixed values: settings of the configuration overview; switches with their text when off
CONFIG_NAMES = (
    "max degree of parallelism", "min server memory (MB)", "max server memory (MB)", "remote admin connections",
    "backup compression default",
)
CONFIG_SWITCHES = {"remote admin connections": "Disabled", "backup compression default": "No"}


def config_wide(
    config_kv: DataFrame, names: Sequence[str] = CONFIG_NAMES, server: str = "server_name",
    enabled: Mapping[str, str] = CONFIG_SWITCHES, lists: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One wide row per server from name/value settings.

    Settings in ``enabled`` are switches, shown as Enabled or the given text.  ``lists`` adds joined
    value lists: frames of (server, value), listed in text order.
    """
    key = [c for c in dict.fromkeys(["server_name", server]) if has(config_kv, c)]
    label = lambda n: n.lower().replace(" ", "_").replace("(", "").replace(")", "")
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value_in_use")))
    shown = [
        (F.when(value(n) == 1, F.lit("Enabled")).otherwise(F.lit(enabled[n])) if n in enabled else value(n)).alias(label(n))
        for n in names
    ]
    out = config_kv.filter(F.col("name").isin(list(names))).groupBy(*key).agg(*shown)
    for name, df in (lists or {}).items():
        kl = [c for c in key if has(df, c)]
        # equal values are counted before they are collected
        counted = df.groupBy(*kl, text("value").alias("_v")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
        entries = F.array_sort(F.collect_list(F.struct("_v", "_n")))
        joined = counted.groupBy(*kl).agg(
            F.array_join(F.flatten(F.transform(entries, lambda e: F.array_repeat(e["_v"], e["_n"]))), ", ").alias(name)
        )
        out = out.join(joined, kl, "left")
    return out


# fixed values: platform of each engine edition, in the cloud edition and elsewhere
CLOUD_PLATFORMS = {
    4: "SQL on linux", 5: "SQL Azure - SQL Database", 6: "SQL Azure - Microsoft Azure Synapse Analytics",
    7: "SQL Azure - Stretch Database", 8: "SQL Azure - Managed Instance", 9: "SQL Edge on linux",
    10: "SQL Azure - Don't know", 11: "SQL Azure - Azure Synapse serverless SQL pool", 12: "SQL Azure - Don't know",
}
LOCAL_PLATFORMS = {4: "SQL on Docker", 9: "SQL Edge on linux"}


def server_version_parse(props: DataFrame) -> DataFrame:
    """Major and minor version numbers and the platform of each server."""
    part = lambda n: F.split_part("product_version", F.lit("."), F.lit(n)).try_cast("int")
    platform = F.when(F.col("edition") == "SQL Azure", decode("engine_edition", CLOUD_PLATFORMS, "")).otherwise(
        decode("engine_edition", LOCAL_PLATFORMS, "")
    )
    return props.withColumns({"major_version": part(1), "minor_version": part(2), "platform": platform})


def tempdb_file_advice(config: DataFrame, tempdb_files: DataFrame, server: str = "server_name", max_files: int = 8, size_mb: int = 8) -> DataFrame:
    """Recommended against present tempdb data files.

    Usable cores are the bits set in the affinity masks; no bit means all cores.
    """
    key = [c for c in dict.fromkeys(["server_name", server]) if has(config, c) and has(tempdb_files, c)]
    low = F.least(F.col("cores"), F.lit(32))
    masked = F.bit_count(F.col("affinity_mask").cast("bigint").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), low.cast("int")) - 1))
    if has(config, "affinity64_mask"):
        high = F.greatest(F.col("cores") - 32, F.lit(0))
        masked = masked + F.bit_count(
            F.col("affinity64_mask").cast("bigint").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), high.cast("int")) - 1)
        )
    present = tempdb_files.groupBy(*key).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.max(F.when(int_div("size_pages", 128) != size_mb, 1).otherwise(0)).alias("size_mismatch"),
    )
    out = config.withColumn("_bits", masked.cast("bigint")).withColumn(
        "usable_cores", F.when(F.col("_bits") == 0, F.col("cores").cast("bigint")).otherwise(F.col("_bits"))
    ).drop("_bits")
    return out.join(present, key, "left").na.fill(0, ["file_count", "size_mismatch"]).withColumns({
        "recommended_files": F.least("usable_cores", F.lit(max_files)),
        "missing_files": F.greatest(F.least(F.col("usable_cores"), F.lit(max_files)) - F.col("file_count"), F.lit(0)),
    })


# fixed values: product and feature names and their codes, applied in this order
PRODUCT_CODES = {
    "Microsoft SQL Server 2022": "160", "Microsoft SQL Server 2019": "150", "Microsoft SQL Server 2017": "140",
    "Microsoft SQL Server 2016": "130", "Microsoft SQL Server 2014": "120", "Microsoft SQL Server 2012": "110",
    "Microsoft SQL Server 2008": "100", "Microsoft SQL Server 2008R2": "100",
}
FEATURE_CODES = {
    "Database Engine Services": "SQLENGINE", "Full-Text and Semantic Extractions for Search": "FULLTEXT",
    "SQL Server Replication": "REPLICATION", "Data Quality Services": "DQ",
    "Machine Learning Services and Language Extensions": "ADVANCEDANALYTICS", "Analysis Services": "AS",
    "PolyBase Query Service for External Data": "POLYBASECORE", "Data Quality Client": "DQC",
    "Integration Services": "IS", "Scale Out Master": "IS_Master", "Scale Out Worker": "IS_Worker",
    "Master Data Services": "MDS",
}


def _replace_all(c: str, codes: Mapping[str, str]) -> Column:
    out = F.col(c)
    for name, code in codes.items():
        out = F.regexp_replace(out, "(?i)" + name, code)
    return out


def feature_normalise(
    features: DataFrame, products: Mapping[str, str] = PRODUCT_CODES, codes: Mapping[str, str] = FEATURE_CODES
) -> DataFrame:
    """Version code and short feature name by ordered, case-insensitive replacement."""
    return features.withColumns({"version": _replace_all("product", products), "feature_code": _replace_all("feature", codes)})


def feature_rollup(features: DataFrame, setup_paths: DataFrame) -> DataFrame:
    """Features per instance and version with the setup path and uninstall text.

    Features come from a short vocabulary and are made distinct before joining.
    """
    k = shared_keys(features, setup_paths)
    by = [*optional(features, "server_name"), "instance", "version"]
    listed = features.select(*by, "feature_code").distinct().groupBy(*by).agg(
        F.replace(F.array_join(F.array_sort(F.collect_list("feature_code")), ","), F.lit(" "), F.lit(",")).alias("features")
    )
    uninstall = F.concat(
        F.lit('"'), blank_if_null("setup_path"), F.lit('" /ACTION="unInstall" /INDICATEPROGRESS="FALSE" /QUIETSIMPLE="TRUE" /FEATURES='), "features",
        F.when(F.col("instance") != "", F.concat(F.lit(' /INSTANCENAME="'), "instance", F.lit('"'))).otherwise(F.lit("")),
    )
    return listed.join(setup_paths.select(*k, "version", "setup_path"), [*k, "version"], "left").withColumn("uninstall_text", uninstall)


# --- row-level rules and ledgers -------------------------------------------------------


def visible_to(user: str, owner_col: str = "userlead", status_col: str = "status", supervisor: str = "BOSS", status: str = "A") -> Column:
    """Whether a row is visible: its owner, or the supervisor for active rows."""
    own = F.col(owner_col) == user
    return own | (F.col(status_col) == status) if user == supervisor else own


def row_level_filter(df: DataFrame, user: str, owner_col: str = "userlead", status_col: str = "status", supervisor: str = "BOSS", status: str = "A") -> DataFrame:
    return df.filter(visible_to(user, owner_col, status_col, supervisor, status))


def row_level_rejected(new_rows: DataFrame, user: str, **rule) -> DataFrame:
    """Rows the user may not insert, because they could not see them afterwards."""
    return new_rows.filter(~F.coalesce(visible_to(user, **rule), F.lit(False)))


def row_level_append(new_rows: DataFrame, path: str, user: str, **rule) -> None:
    """Append the rows, or nothing at all when one of them is not allowed."""
    if not row_level_rejected(new_rows, user, **rule).isEmpty():
        raise PermissionError(f"{user} may not insert rows they cannot see")
    new_rows.write.mode("append").parquet(path)


def ledger_history(change_log: DataFrame, op: str | None = None, key=None, key_col: str = "k") -> DataFrame:
    """Every insert and delete; an update is a delete and an insert of one transaction."""
    out = change_log
    if op is not None:
        out = out.filter(F.col("op") == op)
    if key is not None:
        out = out.filter(F.col(key_col) == key)
    return out


def ledger_current(change_log: DataFrame, key: str | Sequence[str] = "k") -> DataFrame:
    """Rows alive now: the last operation of their key is an insert.

    Within one transaction the delete of an update comes before its insert.
    """
    keys = [*optional(change_log, "server_name"), *([key] if isinstance(key, str) else key)]
    rest = [c for c in change_log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct("transaction_id", "sequence_number", F.when(F.col("op") == "INSERT", 1).otherwise(0)))
    return change_log.groupBy(*keys).agg(last.alias("_last")).filter(F.col("_last.op") == "INSERT").select(*keys, "_last.*")
