"""Package catalog: job steps that run packages, inventory, parameters, permissions, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import existing, optional, shared_keys
from fleetlens.functions.tsql import blank_if_null, decode, text
from fleetlens.operators.history import reportable_jobs

# fixed values: step actions, permission codes, parameter scopes
STEP_ACTIONS = {1: "Quit with success", 2: "Quit with failure", 3: "Next step", 4: "Go to step on_success_step_id"}
PERMISSION_CODES = {
    1: "Read", 2: "Modify", 3: "Execution", 4: "Manage permissions", 100: "Create Objects", 101: "Read Objects",
    102: "Modify Objects", 103: "Execute Objects", 104: "Manage Object Permissions",
}
PARAMETER_SCOPES = {20: "project parameter", 30: "package parameter"}
MASK = "******"

# fixed values: shapes of the package command line
CATALOG_PATH = r'/ISSERVER "\\"\\SSISDB\\([^\\]*)\\([^\\]*)\\([^\\]*)\\""'
FILE_PATH = r'/FILE "\\"(.*\\)([^\\]*\.dtsx)\\""'
CATALOG_SERVER = r'/SERVER "?\\"([^\\"]*)'
PLAN_SERVER = r'^/Server "([^"]*)"'
PLAN_PATH = r'/SQL "([^"]*)"'
PLAN_SET = r'/set "(.*)"[^"]*$'
ENVIRONMENT = r"/ENVREFERENCE\s+(\d+)\s*/"
CHANGED = r'/Par (.*?)/Par "\\"\$ServerOption::LOGGING_LEVEL\(Int16\)\\""'


def parse_command(command: str = "command", subsystem: str = "subsystem") -> dict[str, Column]:
    """Folder, project, package and the rest from a step's command text."""
    c = F.col(command)
    ssis = F.col(subsystem) == "SSIS"
    from_file = ssis & c.contains("/FILE")
    from_catalog = ssis & c.contains("/ISSERVER")
    from_plan = ssis & c.contains("/SQL")
    get = lambda pattern, n=1: F.regexp_extract(c, pattern, n)
    none = F.lit("")

    def pick(file: Column, catalog: Column, plan: Column) -> Column:
        return F.when(from_file, file).when(from_catalog, catalog).when(from_plan, plan).otherwise(none)

    return {
        "folder": pick(get(FILE_PATH, 1), get(CATALOG_PATH, 1), get(PLAN_PATH)),
        "project": F.when(from_catalog, get(CATALOG_PATH, 2)).otherwise(none),
        "package": pick(get(FILE_PATH, 2), get(CATALOG_PATH, 3), get(PLAN_SET)),
        "server": pick(none, get(CATALOG_SERVER), get(PLAN_SERVER)),
        "environment_reference": F.when(from_catalog & (get(ENVIRONMENT) != ""), get(ENVIRONMENT)).try_cast("bigint"),
        "is_32bit": F.when(c.contains("/X86"), F.lit("Yes")).otherwise(none),
        "changed_parameters": F.when(ssis, get(CHANGED)).otherwise(none),
    }


def job_step_structure(
    job_steps: DataFrame, jobs: DataFrame, environments: DataFrame | None = None, own_prefix: str | None = None
) -> DataFrame:
    """Steps of reportable jobs with decoded actions and parsed package command.

    ``environments`` (reference_id, environment_name) names the environment of a
    catalog package.
    """
    k = shared_keys(job_steps, jobs)
    owners = reportable_jobs(jobs, own_prefix).select(*k, "job_id", F.col("name").alias("job_name"), "category_id")
    out = job_steps.join(owners, [*k, "job_id"]).withColumns({
        "on_success": decode("on_success_action", STEP_ACTIONS),
        "on_error": decode("on_fail_action", STEP_ACTIONS),
        **parse_command(),
    })
    if environments is not None:
        ke = shared_keys(out, environments)
        names = environments.select(*ke, F.col("reference_id").alias("environment_reference"), "environment_name")
        out = out.join(names, [*ke, "environment_reference"], "left").withColumn("environment", blank_if_null("environment_name")).drop("environment_name")
    return out


def package_errors(
    executions: DataFrame, operations: DataFrame, messages: DataFrame, steps: DataFrame, days: int = 2, *, as_of
) -> DataFrame:
    """Error messages of failed package runs with the job step that starts the package.

    ``steps`` is the step structure.  Runs without a step are not reported.
    """
    k = shared_keys(executions, operations, messages, steps)
    cut = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
    failed = operations.filter((F.col("status") == 4) & (F.col("start_time") >= cut)).select(*k, "operation_id", "start_time")
    errors = messages.filter(F.col("message_type") == 120).select(*k, "operation_id", "message")
    starters = steps.filter((F.col("subsystem") == "SSIS") & F.col("command").contains("/ISSERVER")).select(
        *k, F.col("package").alias("package_name"),
        F.concat("job_name", F.lit(" (Step "), text("step_id"), F.lit(")")).alias("job_step"),
    ).distinct()
    runs = executions.select(*k, F.col("execution_id").alias("operation_id"), "folder_name", "project_name", "package_name")
    return (
        failed.join(errors, [*k, "operation_id"]).join(runs, [*k, "operation_id"]).join(starters, [*k, "package_name"])
        .select(
            *k, F.concat(F.lit("/"), "folder_name", F.lit("/"), "project_name", F.lit("/"), "package_name").alias("object"),
            "job_step", F.col("message").alias("error_message"), F.col("start_time").alias("error_time"),
        )
        .distinct()
    )


def package_inventory(
    packages: DataFrame, projects: DataFrame, folders: DataFrame, folder: str = "", project: str = "", package: str = ""
) -> DataFrame:
    """Packages of the deployed project version; a narrower name needs the wider one."""
    k = shared_keys(packages, projects, folders)
    deployed = projects.select(
        *k, "project_id", F.col("object_version_lsn").alias("project_version_lsn"), "folder_id",
        F.col("name").alias("project_name"), *optional(projects, "deployed_by_name", "last_deployed_time"),
    )
    where = folders.select(*k, "folder_id", F.col("name").alias("folder_name"))
    if folder:
        where = where.filter(F.col("folder_name") == folder)
        if project:
            deployed = deployed.filter(F.col("project_name") == project)
    out = packages.withColumnRenamed("name", "package_name")
    if folder and project and package:
        out = out.filter(F.col("package_name") == package)
    return out.join(deployed, [*k, "project_id", "project_version_lsn"]).join(where, [*k, "folder_id"])


def package_parameters(
    params: DataFrame, projects: DataFrame, folders: DataFrame, env_refs: DataFrame, envs: DataFrame,
    env_vars: DataFrame, folder: str = "", project: str = "", package: str = "",
) -> DataFrame:
    """Changed or sensitive parameters at the latest version of each project.

    Sensitive values are shown as a mask and never read.
    """
    k = shared_keys(params, projects, folders, env_refs, envs, env_vars)
    latest = params.groupBy(*k, "project_id").agg(F.max("project_version_lsn").alias("project_version_lsn"))
    current = params.join(latest, [*k, "project_id", "project_version_lsn"], "left_semi")
    variables = env_vars.select(
        *k, "environment_id", F.col("name").alias("referenced_variable_name"), F.col("type").alias("env_type"),
        F.col("value").alias("env_value"), F.col("sensitive").alias("env_sensitive"),
        F.lit(True).alias("_var"),
    )
    out = (
        current.join(projects.select(*k, "project_id", "folder_id", F.col("name").alias("project_name")), [*k, "project_id"], "left")
        .join(folders.select(*k, "folder_id", F.col("name").alias("folder_name")), [*k, "folder_id"], "left")
        .join(env_refs.select(*k, "project_id", "environment_name"), [*k, "project_id"], "left")
        .join(envs.select(*k, "folder_id", "environment_name", "environment_id"), [*k, "folder_id", "environment_name"], "left")
        .join(variables, [*k, "environment_id", "referenced_variable_name"], "left")
        .filter((F.col("value_set") == 1) | (F.col("sensitive") == 1) | (F.col("env_sensitive") == 1))
    )
    if folder:
        out = out.filter(F.col("folder_name") == folder)
        if project:
            out = out.filter(F.col("project_name") == project)
            if package:
                out = out.filter(F.col("object_name") == package)
    secret = (F.col("sensitive") == 1) | F.coalesce(F.col("env_sensitive") == 1, F.lit(False))
    changed = (
        F.when((F.col("value_set") == 1) & (F.col("value_type") == "V"), F.col("default_value"))
        .when((F.col("value_set") == 1) & (F.col("value_type") == "R"), F.col("env_value"))
    )
    yes = lambda cond: F.when(cond, F.lit("Yes")).otherwise(F.lit(""))
    return out.select(
        *k, "folder_name", "project_name", "object_name",
        decode("object_type", PARAMETER_SCOPES, "").alias("parameter_scope"), "parameter_name",
        blank_if_null("env_type").alias("env_type"),
        yes(F.col("sensitive") == 1).alias("encrypted"), yes(F.col("env_sensitive") == 1).alias("env_encrypted"),
        yes(F.col("value_set") == 1).alias("modified"),
        blank_if_null("environment_name").alias("environment_name"),
        F.when(F.col("_var"), F.col("referenced_variable_name")).otherwise(F.lit("")).alias("env_variable"),
        F.when(F.col("sensitive") == 1, F.lit(MASK)).otherwise(blank_if_null("design_default_value")).alias("design_value"),
        F.when(secret & changed.isNotNull(), F.lit(MASK)).otherwise(F.coalesce(changed, F.lit(""))).alias("modified_value"),
    )


def package_environments(env_vars: DataFrame, environments: DataFrame, folders: DataFrame, used_env_names: DataFrame) -> DataFrame:
    """Variables of the environments that some reported parameter uses; secrets masked."""
    k = shared_keys(env_vars, environments, folders, used_env_names)
    used = environments.join(existing(used_env_names, [*k, "environment_name"]), [*k, "environment_name"], "left_semi")
    secret = F.col("sensitive") == 1
    return (
        env_vars.withColumnsRenamed({"name": "variable_name", "type": "variable_type"})
        .join(used, [*k, "environment_id"])
        .join(folders.select(*k, "folder_id", F.col("name").alias("folder_name")), [*k, "folder_id"])
        .withColumns({
            "encrypted": F.when(secret, F.lit("Yes")).otherwise(F.lit("")),
            "value": F.when(secret, F.lit(MASK)).otherwise(F.col("value")),
        })
    )


def package_permissions(
    role_members: DataFrame, principals: DataFrame, folder_perms: DataFrame, project_perms: DataFrame,
    environment_perms: DataFrame, folders: DataFrame, projects: DataFrame, environments: DataFrame, folder: str = "",
) -> DataFrame:
    """Role members and the permissions on folders, projects and environments.

    ``folder`` keeps paths that start with it (roles always stay).
    """
    k = shared_keys(role_members, principals, folder_perms, project_perms, environment_perms)
    ids = principals.select(*k, "principal_id", "name")
    by_sid = principals.select(*k, "sid", F.col("name").alias("user"))
    roles = (
        role_members.join(ids.select(*k, F.col("principal_id").alias("role_principal_id"), F.col("name").alias("path")), [*k, "role_principal_id"])
        .join(ids.select(*k, F.col("principal_id").alias("member_principal_id"), F.col("name").alias("user")), [*k, "member_principal_id"])
        .select(*k, F.lit("Database role").alias("object_type"), "path", "user",
                F.lit(None).cast("bigint").alias("permission_type"), F.lit("").alias("permission"))
    )
    root = folders.select(*k, "folder_id", F.col("name").alias("_folder"))
    inner = lambda df, id_col, name_col: df.join(root, [*k, "folder_id"]).select(
        *k, F.col(id_col).alias("object_id"), F.concat("_folder", F.lit("/"), name_col).alias("path")
    )
    targets = {
        "folder": (folder_perms, folders.select(*k, F.col("folder_id").alias("object_id"), F.col("name").alias("path"))),
        "project": (project_perms, inner(projects, "project_id", "name")),
        "environment": (environment_perms, inner(environments, "environment_id", "environment_name")),
    }
    out = roles
    for kind, (perms, paths) in targets.items():
        out = out.unionByName(
            perms.join(by_sid, [*k, "sid"]).join(paths, [*k, "object_id"]).select(
                *k, F.lit(kind).alias("object_type"), "path", "user",
                F.col("permission_type").cast("bigint").alias("permission_type"),
                decode("permission_type", PERMISSION_CODES).alias("permission"),
            )
        )
    out = out.distinct().filter(F.trim("user") != "dbo")
    if folder:
        out = out.filter(F.col("path").startswith(folder) | (F.col("object_type") == "Database role"))
    return out


def package_job_links(steps: DataFrame, inventory: DataFrame, procedure: str) -> DataFrame:
    """Jobs with a step that runs a package of a listed folder and project, each as a call
    of ``procedure`` with its name."""
    k = shared_keys(steps, inventory)
    listed = inventory.filter(F.col("folder_name") != "").select(
        *k, F.col("folder_name").alias("folder"), F.col("project_name").alias("project")
    ).distinct()
    return (
        steps.filter(F.col("command").contains("/ISSERVER")).join(listed, [*k, "folder", "project"], "left_semi")
        .select(*k, F.concat(F.lit(f"EXEC {procedure} '"), "job_name", F.lit("'")).alias("jobs_structure"))
        .distinct()
    )
