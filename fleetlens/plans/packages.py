"""Queries over the package catalog and the job steps that use it."""

from fleetlens.operators import packages as op
from fleetlens.plans.registry import query
from fleetlens.plans.storage import variants

AS_OF = "2001-08-01 00:00:00"

# job and step columns behind each command text, as the fixture view builds it
_STEPS = """
    SELECT j.name AS job_name, p_partkey % 4 + 1 AS step_id, on_success, on_error, subsystem, kind, p_brand, p_type, p_name, p_partkey, p_size
    FROM (SELECT *, CASE WHEN p_size % 8 = 0 THEN 'TSQL' ELSE 'SSIS' END AS subsystem, p_partkey % 3 AS kind,
        CASE p_size % 5 WHEN 1 THEN 'Quit with success' WHEN 2 THEN 'Quit with failure' WHEN 3 THEN 'Next step' WHEN 4 THEN 'Go to step on_success_step_id' END AS on_success,
        CASE p_size % 4 + 1 WHEN 1 THEN 'Quit with success' WHEN 2 THEN 'Quit with failure' WHEN 3 THEN 'Next step' WHEN 4 THEN 'Go to step on_success_step_id' END AS on_error
      FROM part) p JOIN jobs j ON j.job_id = p_partkey
    WHERE category_id <> 100 AND j.name NOT LIKE 'own%'
"""


@query(
    "job_name:s step_id:i subsystem:s on_success:s on_error:s folder:s project:s package:s server:s environment:s is_32bit:s changed_parameters:s",
    f"""
    SELECT job_name, step_id, subsystem, on_success, on_error,
      CASE WHEN subsystem <> 'SSIS' THEN '' WHEN kind = 0 THEN p_brand WHEN kind = 1 THEN 'C:\\pkgs\\' || p_brand || '\\' ELSE 'Maintenance Plans\\' || p_name END AS folder,
      CASE WHEN subsystem = 'SSIS' AND kind = 0 THEN p_type ELSE '' END AS project,
      CASE WHEN subsystem <> 'SSIS' THEN '' WHEN kind = 0 THEN p_name || p_partkey || '.dtsx' WHEN kind = 1 THEN p_name || '.dtsx'
        ELSE '\\Package\\' || p_type || '.Disable;false' END AS package,
      CASE WHEN subsystem <> 'SSIS' OR kind = 1 THEN '' ELSE 'srv' || p_size END AS server,
      CASE WHEN subsystem = 'SSIS' AND kind = 0 THEN COALESCE(environment_name, '') ELSE '' END AS environment,
      CASE WHEN kind = 0 AND p_size % 2 = 0 THEN 'Yes' ELSE '' END AS is_32bit,
      CASE WHEN subsystem = 'SSIS' AND kind = 0 THEN '"\\"par\\"";' || p_size || ' ' ELSE '' END AS changed_parameters
    FROM ({_STEPS}) LEFT JOIN step_environments e ON e.reference_id = p_size
    """,
)
def job_step_structure(t):
    return op.job_step_structure(t.job_steps, t.jobs, t.step_environments, own_prefix="own")


@query(
    "object:s job_step:s error_message:s error_time:t",
    f"""
    SELECT DISTINCT '/' || folder_name || '/' || project_name || '/' || package_name AS object,
      s.job_name || ' (Step ' || s.step_id || ')' AS job_step, message AS error_message, start_time AS error_time
    FROM executions x JOIN operations o ON o.operation_id = x.execution_id JOIN op_messages m ON m.operation_id = o.operation_id
    JOIN ({_STEPS}) s ON s.subsystem = 'SSIS' AND s.kind = 0 AND s.p_name || s.p_partkey || '.dtsx' = x.package_name
    WHERE status = 4 AND message_type = 120 AND start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY
    """,
)
def package_errors(t):
    steps = op.job_step_structure(t.job_steps, t.jobs, own_prefix="own")
    return op.package_errors(t.executions, t.operations, t.op_messages, steps, days=365, as_of=AS_OF)


_INVENTORY = """
    SELECT {label} AS variant, f.name AS folder_name, p.name AS project_name, a.name AS package_name
    FROM packages a JOIN projects p ON p.project_id = a.project_id AND p.object_version_lsn = a.project_version_lsn
    JOIN folders f ON f.folder_id = p.folder_id {where}
"""


@query(
    "variant:s folder_name:s project_name:s package_name:s",
    _INVENTORY.format(label="'all'", where="") + " UNION ALL "
    + _INVENTORY.format(label="'folder'", where="WHERE f.name = 'Brand#1'") + " UNION ALL "
    + _INVENTORY.format(label="'project'", where="WHERE f.name = 'Brand#1' AND p.name = 'ECONOMY'"),
)
def package_inventory(t):
    args = (t.packages, t.projects, t.folders)
    return variants(
        all=op.package_inventory(*args), folder=op.package_inventory(*args, folder="Brand#1"),
        project=op.package_inventory(*args, folder="Brand#1", project="ECONOMY"),
    )


_PARAMETERS = """
    SELECT f.name AS folder_name, r.name AS project_name, object_name,
      CASE object_type WHEN 20 THEN 'project parameter' WHEN 30 THEN 'package parameter' ELSE '' END AS parameter_scope, parameter_name,
      COALESCE(v.type, '') AS env_type, CASE WHEN p.sensitive = 1 THEN 'Yes' ELSE '' END AS encrypted,
      CASE WHEN v.sensitive = 1 THEN 'Yes' ELSE '' END AS env_encrypted, CASE WHEN value_set = 1 THEN 'Yes' ELSE '' END AS modified,
      COALESCE(er.environment_name, '') AS environment_name, COALESCE(v.name, '') AS env_variable,
      CASE WHEN p.sensitive = 1 THEN '******' ELSE design_default_value END AS design_value,
      CASE WHEN value_set = 0 OR (value_type = 'R' AND v.value IS NULL) THEN ''
        WHEN p.sensitive = 1 OR v.sensitive = 1 THEN '******' WHEN value_type = 'V' THEN default_value ELSE v.value END AS modified_value
    FROM pkg_params p JOIN (SELECT project_id, MAX(project_version_lsn) AS lsn FROM pkg_params GROUP BY project_id) m
      ON m.project_id = p.project_id AND m.lsn = p.project_version_lsn
    LEFT JOIN projects r ON r.project_id = p.project_id LEFT JOIN folders f ON f.folder_id = r.folder_id
    LEFT JOIN env_refs er ON er.project_id = p.project_id
    LEFT JOIN environments e ON e.folder_id = r.folder_id AND e.environment_name = er.environment_name
    LEFT JOIN env_vars v ON v.environment_id = e.environment_id AND v.name = p.referenced_variable_name
    WHERE value_set = 1 OR p.sensitive = 1 OR v.sensitive = 1
"""


def _parameters(t):
    return op.package_parameters(t.pkg_params, t.projects, t.folders, t.env_refs, t.environments, t.env_vars)


@query(
    "folder_name:s project_name:s object_name:s parameter_scope:s parameter_name:s env_type:s encrypted:s env_encrypted:s modified:s "
    "environment_name:s env_variable:s design_value:s modified_value:s",
    _PARAMETERS,
)
def package_parameters(t):
    return _parameters(t)


@query(
    "folder_name:s environment_name:s variable_name:s variable_type:s encrypted:s value:s",
    f"""
    SELECT f.name AS folder_name, e.environment_name, v.name AS variable_name, v.type AS variable_type,
      CASE WHEN sensitive = 1 THEN 'Yes' ELSE '' END AS encrypted, CASE WHEN sensitive = 1 THEN '******' ELSE value END AS value
    FROM env_vars v JOIN environments e ON e.environment_id = v.environment_id JOIN folders f ON f.folder_id = e.folder_id
    WHERE e.environment_name IN (SELECT environment_name FROM ({_PARAMETERS}))
    """,
)
def package_environments(t):
    return op.package_environments(t.env_vars, t.environments, t.folders, _parameters(t))


_CODE = """CASE permission_type WHEN 1 THEN 'Read' WHEN 2 THEN 'Modify' WHEN 3 THEN 'Execution' WHEN 4 THEN 'Manage permissions' WHEN 100 THEN 'Create Objects'
  WHEN 101 THEN 'Read Objects' WHEN 102 THEN 'Modify Objects' WHEN 103 THEN 'Execute Objects' WHEN 104 THEN 'Manage Object Permissions' END"""
_PERMISSIONS = f"""
    SELECT 'Database role' AS object_type, r.name AS path, m.name AS "user", NULL AS permission_type, '' AS permission
    FROM ssis_roles x JOIN ssis_principals r ON r.principal_id = x.role_principal_id JOIN ssis_principals m ON m.principal_id = x.member_principal_id
    UNION SELECT 'folder', f.name, u.name, permission_type, {_CODE} FROM folder_perms p JOIN ssis_principals u ON u.sid = p.sid JOIN folders f ON f.folder_id = p.object_id
    UNION SELECT 'project', f.name || '/' || j.name, u.name, permission_type, {_CODE} FROM project_perms p JOIN ssis_principals u ON u.sid = p.sid
      JOIN projects j ON j.project_id = p.object_id JOIN folders f ON f.folder_id = j.folder_id
    UNION SELECT 'environment', f.name || '/' || e.environment_name, u.name, permission_type, {_CODE} FROM environment_perms p JOIN ssis_principals u ON u.sid = p.sid
      JOIN environments e ON e.environment_id = p.object_id JOIN folders f ON f.folder_id = e.folder_id
"""


@query(
    "variant:s object_type:s path:s user:s permission_type:i permission:s",
    f"""SELECT 'all' AS variant, * FROM ({_PERMISSIONS}) WHERE "user" <> 'dbo' UNION ALL
        SELECT 'folder', * FROM ({_PERMISSIONS}) WHERE "user" <> 'dbo' AND (path LIKE 'Brand#2%' OR object_type = 'Database role')""",
)
def package_permissions(t):
    args = (t.ssis_roles, t.ssis_principals, t.folder_perms, t.project_perms, t.environment_perms, t.folders, t.projects, t.environments)
    return variants(all=op.package_permissions(*args), folder=op.package_permissions(*args, folder="Brand#2"))


@query(
    "jobs_structure:s",
    f"""
    SELECT DISTINCT 'EXEC dbo.job_steps ''' || job_name || '''' AS jobs_structure FROM ({_STEPS}) s
    WHERE kind = 0 AND subsystem = 'SSIS' AND (p_brand, p_type) IN (SELECT (f.name, p.name) FROM packages a
      JOIN projects p ON p.project_id = a.project_id AND p.object_version_lsn = a.project_version_lsn JOIN folders f ON f.folder_id = p.folder_id)
    """,
)
def package_job_links(t):
    return op.package_job_links(op.job_step_structure(t.job_steps, t.jobs, own_prefix="own"), op.package_inventory(t.packages, t.projects, t.folders), "dbo.job_steps")
