"""Queries over grants in factored form."""

from fleetlens.operators import grants as op
from fleetlens.plans.registry import query

_SECURABLE = "class_desc, major_id, minor_id, permission_name"
_CLOSURE = """
    WITH RECURSIVE walked AS (
      SELECT DISTINCT member_principal_id AS m, role_principal_id AS r, 1 AS depth FROM nested_members WHERE member_principal_id <> role_principal_id
      UNION SELECT w.m, e.role_principal_id, w.depth + 1 FROM walked w JOIN nested_members e ON e.member_principal_id = w.r
      WHERE e.member_principal_id <> e.role_principal_id AND w.depth < 24),
    closed AS (SELECT m AS member_principal_id, r AS role_principal_id, MIN(depth) AS depth FROM walked GROUP BY m, r)
"""


@query(
    "member_principal_id:i role_principal_id:i depth:i in_cycle:b",
    _CLOSURE + """
    SELECT *, role_principal_id IN (SELECT member_principal_id FROM closed WHERE member_principal_id = role_principal_id) AS in_cycle FROM closed
    """,
)
def nested_roles(t):
    return op.nested_roles(t.nested_members)


_SETS = f"""
    WITH grants AS (SELECT grantee_principal_id, {_SECURABLE}, state_desc, COUNT(*) AS times FROM db_permissions GROUP BY ALL),
    sets AS (SELECT grantee_principal_id, COUNT(*) AS n_grants, md5(string_agg(concat_ws('|', {_SECURABLE}, state_desc, times), ';' ORDER BY {_SECURABLE}, state_desc)) AS s
      FROM grants GROUP BY grantee_principal_id),
    owners AS (SELECT grantee_principal_id, MIN(grantee_principal_id) OVER (PARTITION BY n_grants, s) AS class_id, n_grants FROM sets)
"""


@query(
    f"class_id:i {' '.join(f'{c}:{"i" if c.endswith("_id") else "s"}' for c in op.SECURABLE)} state_desc:s times:i",
    _SETS + f"SELECT grantee_principal_id AS class_id, {_SECURABLE}, state_desc, times FROM grants WHERE grantee_principal_id IN (SELECT class_id FROM owners)",
)
def role_grant_classes(t):
    return op.grant_classes(t.db_permissions)[1]


@query(
    "member_name:s member_type:s role_name:s class_id:i n_grants:i",
    _SETS + """
    SELECT u.name AS member_name, u.type_desc AS member_type, r.name AS role_name, class_id, COALESCE(n_grants, 0) AS n_grants
    FROM db_role_members m JOIN db_principals u ON u.principal_id = m.member_principal_id LEFT JOIN db_principals r ON r.principal_id = m.role_principal_id
    LEFT JOIN owners o ON o.grantee_principal_id = m.role_principal_id
    """,
)
def member_grant_classes(t):
    return op.member_classes(t.db_role_members, t.db_principals, op.grant_classes(t.db_permissions)[0])


_PROFILES = _CLOSURE.replace("nested_members", "role_nesting") + _SETS.replace("WITH grants", ", grants") + """,
    held AS (SELECT DISTINCT member_principal_id, class_id FROM closed JOIN owners ON grantee_principal_id = role_principal_id),
    marks AS (SELECT member_principal_id, string_agg(class_id, ',' ORDER BY class_id) AS s FROM held GROUP BY member_principal_id),
    profiles AS (SELECT member_principal_id, MIN(member_principal_id) OVER (PARTITION BY s) AS profile_id FROM marks),
    allowed AS (SELECT h.member_principal_id AS profile_id, """ + _SECURABLE + """, CASE WHEN bool_or(state_desc = 'DENY') THEN 'DENY' ELSE 'GRANT' END AS state_desc
      FROM held h JOIN grants g ON g.grantee_principal_id = h.class_id WHERE h.member_principal_id IN (SELECT profile_id FROM profiles) GROUP BY ALL)
"""


def _profiles(t):
    owners, rows = op.grant_classes(t.db_permissions)
    members, classes = op.profiles(op.nested_roles(t.role_nesting), owners)
    return members, op.profile_permissions(classes, rows)


@query(
    f"profile_id:i {' '.join(f'{c}:{"i" if c.endswith("_id") else "s"}' for c in op.SECURABLE)} state_desc:s",
    _PROFILES + "SELECT * FROM allowed",
)
def profile_permissions(t):
    return _profiles(t)[1]


@query(
    f"grantee_principal_id:i profile_id:i {' '.join(f'{c}:{"i" if c.endswith("_id") else "s"}' for c in op.SECURABLE)} state_desc:s decided_by:s",
    _PROFILES + f"""
    , own AS (SELECT grantee_principal_id, {_SECURABLE}, CASE WHEN bool_or(state_desc = 'DENY') THEN 'DENY' ELSE 'GRANT' END AS state_desc FROM grants GROUP BY ALL)
    SELECT o.grantee_principal_id, p.profile_id, o.class_desc, o.major_id, o.minor_id, o.permission_name,
      CASE WHEN 'DENY' IN (o.state_desc, a.state_desc) THEN 'DENY' ELSE 'GRANT' END AS state_desc,
      CASE WHEN a.state_desc IS NULL THEN 'own' WHEN a.state_desc = o.state_desc THEN 'both' WHEN a.state_desc = 'DENY' THEN 'role' ELSE 'own' END AS decided_by
    FROM own o LEFT JOIN profiles p ON p.member_principal_id = o.grantee_principal_id
    LEFT JOIN allowed a ON a.profile_id = p.profile_id AND a.class_desc = o.class_desc AND a.major_id = o.major_id AND a.minor_id = o.minor_id AND a.permission_name = o.permission_name
    """,
)
def member_permissions(t):
    members, allowed = _profiles(t)
    return op.member_permissions(t.db_permissions, members, allowed)
