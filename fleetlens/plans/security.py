"""Queries over permissions, configuration, row rules and ledgers."""

from pyspark.sql import functions as F

from fleetlens.operators import security as op
from fleetlens.plans.registry import query
from fleetlens.plans.storage import variants

_GRANTS = "SELECT {user}, {role} AS role_name, p.permission_name AS permission_type, p.state_desc AS permission_state, o.type_desc AS object_type, o.name AS object_name, c.name AS column_name"
_USER = """CASE u.type WHEN 'S' THEN u.name WHEN 'U' THEN l.name END AS user_name, CASE u.type WHEN 'S' THEN 'SQL User' WHEN 'U' THEN 'Windows User' END AS user_type,
  u.name AS database_user_name"""
_LOOK = "db_columns c ON c.object_id = p.major_id AND c.column_id = p.minor_id"


@query(
    "user_name:s user_type:s database_user_name:s role_name:s permission_type:s permission_state:s object_type:s object_name:s column_name:s",
    f"""
    {_GRANTS.format(user=_USER, role='NULL')} FROM db_principals u LEFT JOIN login_tokens l ON l.sid = u.sid
    LEFT JOIN db_permissions p ON p.grantee_principal_id = u.principal_id LEFT JOIN {_LOOK} LEFT JOIN db_objects o ON o.object_id = p.major_id
    WHERE u.type IN ('S', 'U') AND u.principal_id > 4 AND u.name NOT IN ('NT AUTHORITY\\SYSTEM', 'dbo')
    UNION
    {_GRANTS.format(user=_USER, role='r.name')} FROM db_role_members m JOIN db_principals r ON r.principal_id = m.role_principal_id
    JOIN db_principals u ON u.principal_id = m.member_principal_id LEFT JOIN login_tokens l ON l.sid = u.sid
    LEFT JOIN db_permissions p ON p.grantee_principal_id = r.principal_id LEFT JOIN {_LOOK} LEFT JOIN db_objects o ON o.object_id = p.major_id
    UNION
    {_GRANTS.format(user="'{All Users}' AS user_name, '{All Users}' AS user_type, '{All Users}' AS database_user_name", role='r.name')}
    FROM db_principals r LEFT JOIN db_permissions p ON p.grantee_principal_id = r.principal_id LEFT JOIN {_LOOK}
    JOIN db_objects o ON o.object_id = p.major_id WHERE r.type = 'R' AND r.name = 'public' AND o.is_ms_shipped = 0
    """,
)
def user_permission_audit(t):
    return op.user_permission_audit(t.db_principals, t.login_tokens, t.db_permissions, t.db_role_members, t.db_columns, t.db_objects)


_TYPES = "('SQL_USER', 'WINDOWS_USER', 'WINDOWS_GROUP', 'EXTERNAL_USER', 'EXTERNAL_GROUP', 'APPLICATION_ROLE')"


def _roles_and_grants(label, first, second):
    return f"""
    SELECT '{label}' AS variant, * FROM (
      SELECT u.name AS principal_name, u.type_desc AS principal_type, r.name AS role_name, p.state_desc AS role_state, NULL AS permission_name,
        NULL AS permission_state, NULL AS permission_class, NULL AS object_name
      FROM db_role_members m {first} JOIN db_principals u ON m.member_principal_id = u.principal_id
      {second} JOIN db_principals r ON m.role_principal_id = r.principal_id {second} JOIN db_permissions p ON u.principal_id = p.grantee_principal_id
      WHERE u.type_desc IN {_TYPES}
      UNION
      SELECT u.name, u.type_desc, NULL, NULL, p.permission_name, p.state_desc, p.class_desc, o.name
      FROM db_permissions p JOIN db_principals u ON p.grantee_principal_id = u.principal_id LEFT JOIN db_objects o ON o.object_id = p.major_id
      WHERE u.type_desc IN {_TYPES} AND p.permission_name NOT IN ('CONNECT'))
    """


@query(
    "variant:s principal_name:s principal_type:s role_name:s role_state:s permission_name:s permission_state:s permission_class:s object_name:s",
    _roles_and_grants("all_users", "RIGHT", "LEFT") + " UNION ALL " + _roles_and_grants("with_role", "INNER", "INNER"),
)
def role_and_grant_listing(t):
    args = (t.db_role_members, t.db_principals, t.db_permissions, t.db_objects)
    return variants(all_users=op.role_and_grant_listing(*args), with_role=op.role_and_grant_listing(*args, keep_unassigned=False))


_BUILTIN = "('public', 'guest', 'dbo', 'sys', 'db_owner', 'db_datareader')"


@query(
    "database_user:s user_type:s authentication_type_desc:s role_name:s",
    f"""
    SELECT DISTINCT d.name AS database_user, d.type_desc AS user_type, d.authentication_type_desc, r.name AS role_name
    FROM db_principals d LEFT JOIN db_role_members m ON d.principal_id = m.member_principal_id LEFT JOIN db_principals r ON m.role_principal_id = r.principal_id
    WHERE d.name NOT IN {_BUILTIN} AND COALESCE(r.name, '') <> ''
    """,
)
def user_roles(t):
    return op.user_roles(t.db_principals, t.db_role_members)


@query(
    "database_user:s user_type:s additional_permission:s permission_state:s object_type:s object_name:s",
    f"""
    SELECT DISTINCT d.name AS database_user, d.type_desc AS user_type, p.permission_name AS additional_permission, COALESCE(p.state_desc, '') AS permission_state,
      COALESCE(o.type_desc, '') AS object_type, COALESCE('[' || s.name || '].[' || o.name || ']', '') AS object_name
    FROM db_principals d LEFT JOIN db_permissions p ON d.principal_id = p.grantee_principal_id LEFT JOIN db_objects o ON p.major_id = o.object_id
    LEFT JOIN schemas s ON s.schema_id = o.schema_id
    WHERE d.name NOT IN {_BUILTIN} AND COALESCE(p.permission_name, '') NOT IN ('CONNECT', '')
    """,
)
def additional_permissions(t):
    return op.additional_permissions(t.db_principals, t.db_permissions, t.db_objects, t.schemas)


@query(
    "role_name:s user_name:s",
    """
    SELECT r.name AS role_name, COALESCE(u.name, 'No members') AS user_name FROM db_role_members m
    RIGHT JOIN db_principals r ON m.role_principal_id = r.principal_id LEFT JOIN db_principals u ON m.member_principal_id = u.principal_id WHERE r.type = 'R'
    """,
)
def role_members_listing(t):
    return op.role_members_listing(t.db_principals, t.db_role_members)


@query(
    "member_name:s member_type:s role_name:s class_desc:s object_name:s permission_name:s state_desc:s",
    """
    SELECT u.name AS member_name, u.type_desc AS member_type, r.name AS role_name, class_desc, o.name AS object_name, permission_name, state_desc
    FROM db_role_members m JOIN db_principals u ON u.principal_id = m.member_principal_id LEFT JOIN db_principals r ON r.principal_id = m.role_principal_id
    LEFT JOIN db_permissions p ON p.grantee_principal_id = m.role_principal_id LEFT JOIN db_objects o ON o.object_id = p.major_id
    """,
)
def role_effective_permissions(t):
    return op.role_effective_permissions(t.db_role_members, t.db_principals, t.db_permissions, t.db_objects)


@query(
    "role_name:s role_type:s class_desc:s permission_name:s state_desc:s object_type:s schema_name:s object_name:s",
    """
    SELECT DISTINCT r.name AS role_name, r.type_desc AS role_type, class_desc, permission_name, state_desc,
      CASE WHEN o.type_desc IS NULL OR o.type_desc = 'SYSTEM_TABLE' THEN class_desc ELSE o.type_desc END AS object_type,
      s.name AS schema_name, COALESCE(ss.name, o.name) AS object_name
    FROM db_principals r LEFT JOIN db_permissions p ON p.grantee_principal_id = r.principal_id LEFT JOIN schemas ss ON ss.schema_id = p.major_id
    LEFT JOIN db_objects o ON o.object_id = p.major_id LEFT JOIN schemas s ON s.schema_id = o.schema_id
    WHERE r.type_desc = 'DATABASE_ROLE' AND class_desc <> 'DATABASE' AND r.name <> 'public'
    """,
)
def role_object_permissions(t):
    return op.role_object_permissions(t.db_principals, t.db_permissions, t.schemas, t.db_objects)


@query(
    "login_name:s owned_schema:s",
    """
    SELECT p.name AS login_name, COALESCE(s.name, '') AS owned_schema FROM db_principals p LEFT JOIN owned_schemas s ON s.principal_id = p.principal_id
    WHERE p.type IN ('S', 'U') AND p.name NOT IN ('dbo', 'guest', 'sys', 'INFORMATION_SCHEMA')
    """,
)
def user_owned_schemas(t):
    return op.user_owned_schemas(t.db_principals, t.owned_schemas)


@query(
    "login:s login_type:s status:s sysadmin:s serveradmin:s securityadmin:s denylogin:s",
    """
    SELECT p.name AS login, type_desc AS login_type, CASE WHEN is_disabled = 1 THEN 'Disabled' ELSE 'Enabled' END AS status, """
    + ", ".join(f"CASE WHEN l.{r} = 1 THEN '{r}' ELSE '' END AS {r}" for r in op.SERVER_ROLES)
    + " FROM server_principals p LEFT JOIN syslogins l ON l.login_name = p.name WHERE p.type NOT IN ('G', 'R')",
)
def login_status(t):
    return op.login_status(t.server_principals, t.syslogins)


@query(
    "variant:s name:s owner:s",
    """
    SELECT 'known' AS variant, name, owner FROM owned_databases WHERE owner <> 'sa'
    UNION ALL SELECT 'with_unknown', name, owner FROM owned_databases WHERE owner <> 'sa' OR owner IS NULL
    """,
)
def database_owner_audit(t):
    return variants(
        known=op.database_owner_audit(t.owned_databases), with_unknown=op.database_owner_audit(t.owned_databases, include_null=True)
    )


@query(
    "endpoint_name:s endpoint_state:s permission_name:s state_desc:s granted_by:s granted_to:s",
    """
    SELECT e.name AS endpoint_name, e.state_desc AS endpoint_state, p.permission_name, p.state_desc, b.name AS granted_by, g.name AS granted_to
    FROM server_permissions p JOIN endpoints e ON e.endpoint_id = p.major_id JOIN server_principals g ON g.principal_id = p.grantee_principal_id
    LEFT JOIN server_principals b ON b.principal_id = p.grantor_principal_id
    """,
)
def endpoint_permissions(t):
    return op.endpoint_permissions(t.server_permissions, t.endpoints, t.server_principals)


_NAMES = ("view", "click", "purchase", "signup", "error")


@query(
    "server_id:i view:i click:i purchase:s signup:s error:s tempdb_mb:s",
    """
    SELECT c.server_id, MAX(value_in_use) FILTER (name = 'view') AS view, MAX(value_in_use) FILTER (name = 'click') AS click, """
    + ", ".join(f"CASE WHEN MAX(value_in_use) FILTER (name = '{n}') = 1 THEN 'Enabled' ELSE 'Disabled' END AS {n}" for n in _NAMES[2:])
    + """, ANY_VALUE(f.sizes) AS tempdb_mb FROM config_kv c
    LEFT JOIN (SELECT server_id, string_agg((size_pages // 128)::VARCHAR, ', ' ORDER BY (size_pages // 128)::VARCHAR) AS sizes FROM tempdb_files GROUP BY server_id) f
      ON f.server_id = c.server_id GROUP BY c.server_id
    """,
)
def config_wide(t):
    sizes = t.tempdb_files.withColumn("value", F.expr("size_pages div 128"))
    return op.config_wide(t.config_kv, _NAMES, server="server_id", enabled=dict.fromkeys(_NAMES[2:], "Disabled"), lists={"tempdb_mb": sizes})


@query(
    "server_id:i major_version:i minor_version:i platform:s",
    "SELECT server_id, split_part(product_version, '.', 1)::INT AS major_version, split_part(product_version, '.', 2)::INT AS minor_version, "
    "CASE WHEN edition = 'SQL Azure' THEN CASE engine_edition "
    + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in op.CLOUD_PLATFORMS.items())
    + " ELSE '' END ELSE CASE engine_edition WHEN 4 THEN 'SQL on Docker' WHEN 9 THEN 'SQL Edge on linux' ELSE '' END END AS platform FROM server_props",
)
def server_version_parse(t):
    return op.server_version_parse(t.server_props)


_CORES = """(SELECT server_id, CASE WHEN bits = 0 THEN cores ELSE bits END AS usable FROM (SELECT server_id, cores,
  bit_count((affinity_mask & ((1::BIGINT << LEAST(cores, 32)) - 1))::BIGINT)
  + bit_count((affinity64_mask & ((1::BIGINT << GREATEST(cores - 32, 0)) - 1))::BIGINT) AS bits FROM server_config))"""


@query(
    "server_id:i usable_cores:i file_count:i size_mismatch:i recommended_files:i missing_files:i",
    f"""
    SELECT c.server_id, usable AS usable_cores, COALESCE(n, 0) AS file_count, COALESCE(bad, 0) AS size_mismatch, LEAST(usable, 8) AS recommended_files,
      GREATEST(LEAST(usable, 8) - COALESCE(n, 0), 0) AS missing_files
    FROM {_CORES} c LEFT JOIN (SELECT server_id, COUNT(*) AS n, MAX(CASE WHEN size_pages // 128 <> 8 THEN 1 ELSE 0 END) AS bad FROM tempdb_files GROUP BY server_id) f
      ON f.server_id = c.server_id
    """,
)
def tempdb_file_advice(t):
    return op.tempdb_file_advice(t.server_config, t.tempdb_files, server="server_id")


def _replaced(column, codes):
    out = column
    for name, code in codes.items():
        out = f"regexp_replace({out}, '(?i){name}', '{code}', 'g')"
    return out


_NORMAL = (f"SELECT feature_id, instance, {_replaced('product', op.PRODUCT_CODES)} AS version, {_replaced('feature', op.FEATURE_CODES)} AS feature_code "
           "FROM installed_features")


@query("feature_id:i instance:s version:s feature_code:s", _NORMAL)
def feature_normalise(t):
    return op.feature_normalise(t.installed_features)


@query(
    "instance:s version:s features:s setup_path:s uninstall_text:s",
    f"""
    SELECT f.instance, f.version, features, setup_path, '"' || COALESCE(setup_path, '') || '" /ACTION="unInstall" /INDICATEPROGRESS="FALSE" /QUIETSIMPLE="TRUE" /FEATURES='
      || features || ' /INSTANCENAME="' || f.instance || '"' AS uninstall_text
    FROM (SELECT instance, version, replace(string_agg(feature_code, ',' ORDER BY feature_code), ' ', ',') AS features
          FROM (SELECT DISTINCT instance, version, feature_code FROM ({_NORMAL})) GROUP BY instance, version) f
    LEFT JOIN setup_paths s ON s.version = f.version
    """,
)
def feature_rollup(t):
    return op.feature_rollup(op.feature_normalise(t.installed_features), t.setup_paths)


@query(
    "variant:s row_id:i userlead:s status:s",
    """
    SELECT 'user1' AS variant, row_id, userlead, status FROM rls_table WHERE userlead = 'User1'
    UNION ALL SELECT 'boss', row_id, userlead, status FROM rls_table WHERE userlead = 'BOSS' OR status = 'A'
    UNION ALL SELECT 'rejected', row_id, userlead, status FROM rls_table WHERE NOT (userlead = 'BOSS' OR status = 'A')
    """,
)
def row_level_filter(t):
    return variants(
        user1=op.row_level_filter(t.rls_table, "User1"), boss=op.row_level_filter(t.rls_table, "BOSS"),
        rejected=op.row_level_rejected(t.rls_table, "BOSS"),
    )


@query(
    "variant:s k:i transaction_id:i sequence_number:i op:s v:d",
    "SELECT 'everything' AS variant, * FROM ledger UNION ALL SELECT 'deletes', * FROM ledger WHERE op = 'DELETE' UNION ALL SELECT 'one_key', * FROM ledger WHERE k = 42",
)
def ledger_history(t):
    return variants(
        everything=op.ledger_history(t.ledger), deletes=op.ledger_history(t.ledger, "DELETE"), one_key=op.ledger_history(t.ledger, key=42)
    )


@query(
    "k:i transaction_id:i v:d",
    """
    SELECT k, transaction_id, v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY transaction_id DESC, sequence_number DESC) AS r FROM ledger)
    WHERE r = 1 AND op = 'INSERT'
    """,
)
def ledger_current(t):
    return op.ledger_current(t.ledger)
