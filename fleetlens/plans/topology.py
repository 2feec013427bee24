"""Queries over replication, availability groups, selections and the samples."""

from pyspark.sql import functions as F

from fleetlens.operators import pattern_index, samples, selection
from fleetlens.operators import topology as op
from fleetlens.plans.registry import query
from fleetlens.plans.storage import variants


@query(
    "agent_id:i name:s subscriber_db:s publication:s run_status:s subscription:s xact_seqno:i time:t undelivered:i",
    """
    WITH marks AS (
      SELECT h.agent_id, MAX(h.time) AS time, m.maxseq FROM repl_history h
      JOIN (SELECT agent_id, COALESCE(MAX(xact_seqno), 0) AS maxseq FROM repl_history GROUP BY agent_id) m ON m.agent_id = h.agent_id AND m.maxseq = h.xact_seqno
      GROUP BY h.agent_id, m.maxseq),
    pending AS (
      SELECT s.agent_id, m.time, SUM(CASE WHEN c.xact_seqno > m.maxseq THEN 1 ELSE 0 END) AS undelivered
      FROM repl_commands c JOIN repl_subscriptions s ON s.article_id = c.article_id JOIN marks m ON m.agent_id = s.agent_id GROUP BY s.agent_id, m.time)
    SELECT a.agent_id, a.name, subscriber_db, publication,
      COALESCE(CASE runstatus WHEN 1 THEN 'Start' WHEN 2 THEN 'Succeed' WHEN 3 THEN 'InProgress' WHEN 4 THEN 'Idle' WHEN 5 THEN 'Retry' WHEN 6 THEN 'Fail' END
        || ' - ' || runstatus, runstatus::VARCHAR) AS run_status,
      CASE subscription_type WHEN 0 THEN 'Push' WHEN 1 THEN 'Pull' WHEN 2 THEN 'Anonymous' ELSE subscription_type::VARCHAR END AS subscription,
      h.xact_seqno, h.time, undelivered
    FROM repl_agents a JOIN repl_history h ON h.agent_id = a.agent_id JOIN pending p ON p.agent_id = a.agent_id AND p.time = h.time
    WHERE subscriber_db <> 'virtual'
    """,
)
def replication_latency(t):
    return op.replication_latency(t.repl_agents, t.repl_history, t.repl_commands, t.repl_subscriptions)


@query(
    "publication_server:s publisher_db:s publication_name:s article:s destination_object:s subscription_server:s subscriber_db:s agent_job:s",
    """
    SELECT DISTINCT srv.srvname AS publication_server, a.publisher_db, p.publication AS publication_name, a.article, a.destination_object,
      ss.srvname AS subscription_server, s.subscriber_db, r.name AS agent_job
    FROM repl_articles a JOIN repl_pubs p ON p.publication_id = a.publication_id JOIN repl_subs s ON s.publication_id = p.publication_id
    JOIN repl_servers ss ON ss.srvid = s.subscriber_id JOIN repl_servers srv ON srv.srvid = p.publisher_id
    JOIN repl_routes r ON r.publisher_id = p.publisher_id AND r.subscriber_id = s.subscriber_id
    """,
)
def replication_articles(t):
    return op.replication_articles(t.repl_articles, t.repl_pubs, t.repl_subs, t.repl_servers, t.repl_routes)


@query(
    "variant:s publication:s table_name:s subscriber_server:s",
    """
    WITH listed AS (SELECT p.name AS publication, a.name AS table_name, upper(srvname) AS subscriber_server FROM repl_pubs p
      JOIN repl_articles a ON a.pubid = p.pubid JOIN repl_article_subs s ON s.artid = a.artid JOIN repl_servers v ON v.srvid = s.srvid)
    SELECT 'detail' AS variant, * FROM listed UNION ALL SELECT 'short', publication, NULL, subscriber_server FROM (SELECT DISTINCT publication, subscriber_server FROM listed)
    """,
)
def publisher_articles(t):
    args = (t.repl_pubs, t.repl_articles, t.repl_article_subs, t.repl_servers)
    return variants(detail=op.publisher_articles(*args), short=op.publisher_articles(*args, detail=False))


@query(
    "ag_name:s database_name:s replica_server_name:s role_desc:s synchronization_health_desc:s listener:s listener_port:i ip_configuration:s endpoint_url:s "
    "availability_mode_desc:s failover_mode_desc:s connected_state_desc:s",
    """
    SELECT g.name AS ag_name, d.database_name, rc.replica_server_name, rs.role_desc, rs.synchronization_health_desc, COALESCE(l.dns_name, '') AS listener,
      COALESCE(l.port, 0) AS listener_port, CASE WHEN l.dns_name IS NOT NULL THEN COALESCE(l.ip_configuration, 'no virtual IP addresses') ELSE '' END AS ip_configuration,
      p.endpoint_url, p.availability_mode_desc, p.failover_mode_desc, rs.connected_state_desc
    FROM ag_db_cluster c LEFT JOIN replicas rc ON rc.replica_id = c.replica_id
    LEFT JOIN ag_databases d ON d.group_id = rc.group_id AND d.group_database_id = c.group_database_id LEFT JOIN ag_groups g ON g.group_id = d.group_id
    LEFT JOIN ag_replica_states rs ON rs.group_id = rc.group_id AND rs.replica_id = rc.replica_id LEFT JOIN ag_addresses l ON l.group_id = rc.group_id
    LEFT JOIN ag_replica_props p ON p.replica_id = c.replica_id WHERE g.name IS NOT NULL
    """,
)
def ag_topology(t):
    return op.ag_topology(
        t.ag_db_cluster, t.replicas, t.ag_databases, t.ag_groups, t.ag_replica_states, t.ag_addresses, t.ag_replica_props
    )


@query(
    "ag_name:s primary_replica:s local_role:i database_name:s synchronization_state:i is_suspended:i is_joined:i",
    """
    SELECT g.name AS ag_name, COALESCE(s.primary_replica, '') AS primary_replica, COALESCE(rs.role, 3) AS local_role, c.database_name,
      COALESCE(ds.synchronization_state, 0) AS synchronization_state, COALESCE(ds.is_suspended, 0) AS is_suspended, COALESCE(c.is_database_joined, 0) AS is_joined
    FROM ag_groups g LEFT JOIN ag_group_states s ON s.group_id = g.group_id JOIN ag_replica_props r ON r.group_id = g.group_id
    JOIN ag_replica_states rs ON rs.replica_id = r.replica_id AND rs.is_local = 1 JOIN ag_db_cluster c ON c.replica_id = rs.replica_id
    LEFT JOIN ag_db_states ds ON ds.replica_id = c.replica_id AND ds.group_database_id = c.group_database_id
    """,
)
def ag_sync_state(t):
    return op.ag_sync_state(t.ag_groups, t.ag_group_states, t.ag_replica_props, t.ag_replica_states, t.ag_db_cluster, t.ag_db_states)


@query(
    "database:s mirroring_state_desc:s mirroring_role_desc:s mirroring_safety_level_desc:s mirroring_partner_name:s",
    """
    SELECT d.name AS database, mirroring_state_desc, mirroring_role_desc, mirroring_safety_level_desc, mirroring_partner_name
    FROM mirroring m JOIN databases d ON d.database_id = m.database_id WHERE mirroring_state_desc IS NOT NULL
    """,
)
def mirroring_status(t):
    return op.mirroring_status(t.mirroring, t.databases)


@query(
    "variant:s name:s start_position:i",
    """
    SELECT 'wild' AS variant, name, CASE WHEN name LIKE 'db1%' THEN 1 ELSE 3 END AS start_position FROM databases
    WHERE (name LIKE 'db1%' OR name LIKE '%7') AND name NOT LIKE 'db15%'
    UNION ALL SELECT 'users', name, 1 FROM databases WHERE lower(name) NOT LIKE 'nobk%'
    UNION ALL SELECT 'grouped', name, 1 FROM databases WHERE is_read_only = 1
    UNION ALL SELECT 'quoted', name, CASE name WHEN 'db7' THEN 2 ELSE 1 END FROM databases WHERE name IN ('db7', 'nobk1')
    """,
)
def select_by_patterns(t):
    df = t.databases
    grouped = df.withColumn("in_availability_group", F.col("is_read_only"))
    return variants(
        wild=selection.select_by_patterns(df, "db1%, -db15%, %7"),
        users=selection.select_by_patterns(df, "USER_DATABASES, -NOBK%"),
        grouped=selection.select_by_patterns(grouped, "AVAILABILITY_GROUP_DATABASES"),
        quoted=selection.select_by_patterns(df, "[nobk1], [db7], db_, SYSTEM_DATABASES"),
    )


_ENTRIES = """
    WITH parsed AS (SELECT selection, position, entry, NOT starts_with(entry, '-') AS include, trim(CASE WHEN starts_with(entry, '-') THEN substr(entry, 2) ELSE entry END) AS bare FROM selection_entries),
    entries AS (SELECT selection, position, entry, include, bare IN ('SYSTEM_DATABASES', 'USER_DATABASES') AS keyword,
      lower(CASE WHEN starts_with(bare, '[') THEN replace(substr(bare, 2, length(bare) - 2), ']]', ']') ELSE bare END) AS pattern FROM parsed)
"""
_FITS = "lower(d.name) LIKE replace(pattern, '_', '\\_') ESCAPE '\\'"


@query(
    "selection:i name:s start_position:i",
    _ENTRIES + f"""
    SELECT selection, name, MIN(CASE WHEN include THEN position END) AS start_position
    FROM databases d JOIN entries ON CASE WHEN keyword THEN pattern = 'user_databases' ELSE {_FITS} END
    GROUP BY selection, name HAVING bool_or(include) AND NOT bool_or(NOT include)
    """,
)
def select_by_table(t):
    return pattern_index.select_by_table(t.databases, t.selection_entries).drop("recovery_model_desc", "owner_id", "is_read_only")


@query(
    "selection:i entry:s position:i",
    _ENTRIES + f"SELECT selection, entry, position FROM entries WHERE NOT keyword AND NOT EXISTS (SELECT 1 FROM databases d WHERE {_FITS})",
)
def unmatched_entries(t):
    return pattern_index.unmatched_entries(t.databases, t.selection_entries)


@query(
    "variant:s database_name:s schema_name:s object_name:s index_name:s filegroup_name:s start_position:i",
    """
    SELECT 'indexes' AS variant, *, 1 AS start_position FROM catalog_names WHERE database_name LIKE 'S%' AND object_name LIKE 'T1%' AND index_name LIKE 'IX_1%'
      AND database_name <> 'S1'
    UNION ALL SELECT 'every_index', *, 1 FROM catalog_names WHERE NOT (database_name = 'S2' AND schema_name = 'dbo0')
    UNION ALL SELECT 'objects', *, CASE WHEN schema_name = 'dbo1' THEN 1 ELSE 2 END FROM catalog_names WHERE schema_name = 'dbo1' OR object_name = 'T5'
    UNION ALL SELECT 'filegroups', *, 1 FROM catalog_names WHERE filegroup_name <> 'FG2'
    """,
)
def select_objects(t):
    df = t.catalog_names
    return variants(
        indexes=selection.select_objects(df, "S%.%.T1%.IX_1%,-S1.%.%"),
        every_index=selection.select_objects(df, "ALL_INDEXES,-[S2].dbo0.%"),
        objects=selection.select_objects(df, "%.dbo1.%, %.%.T5", ("database_name", "schema_name", "object_name")),
        filegroups=selection.select_objects(df, "ALL_FILEGROUPS, -%.FG2", ("database_name", "filegroup_name")),
    )


@query(
    "name:s availability_group:s start_position:i",
    """
    SELECT d.name, availability_group, 1 AS start_position FROM databases d JOIN group_databases g ON g.name = d.name WHERE availability_group NOT LIKE 'ag1%'
    """,
)
def select_availability_groups(t):
    return selection.select_availability_groups(t.databases, t.group_databases, "ALL_AVAILABILITY_GROUPS, -ag1%")


@query(
    "selected_name:s position:i",
    "SELECT * FROM (VALUES ('absent1', 2), ('db_', 4), ('Gone', 5)) AS v(selected_name, position) WHERE lower(selected_name) NOT IN (SELECT name FROM databases)",
)
def unmatched_selections(t):
    return selection.unmatched_selections(t.databases, "DB7, absent1, USER_DATABASES, db_, -[Gone], none%")


@query(
    "total:i",
    """
    SELECT SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'
    """,
)
def adaptive_join_sum(t):
    header = t.base("orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("territory_id"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("sub_total"),
    )
    return samples.adaptive_join_sum(header, t.base("lineitem").select(F.col("l_orderkey").alias("order_id")), "1-URGENT")


@query(
    "variant:s product_id:i product_name:s unit_price:d stock:i",
    """
    SELECT 'plain' AS variant, p_partkey AS product_id, p_name AS product_name, l_extendedprice AS unit_price, NULL AS stock FROM part JOIN lineitem ON l_partkey = p_partkey
    UNION ALL SELECT 'with_stock', p_partkey, p_name, l_extendedprice, stock FROM part JOIN lineitem ON l_partkey = p_partkey
    JOIN (SELECT l_partkey AS k, SUM(l_linenumber) AS stock FROM lineitem GROUP BY l_partkey) s ON s.k = p_partkey
    """,
)
def product_sales(t):
    lines = t.base("lineitem")
    product = t.base("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))
    detail = lines.select(F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("unit_price"))
    stock = lines.select(F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("quantity"))
    return variants(plain=samples.product_sales(product, detail), with_stock=samples.product_sales(product, detail, stock))


@query(
    "c_custkey:i staged_c_name:s c_name:s c_mktsegment:s",
    "SELECT a.c_custkey, a.c_name AS staged_c_name, b.c_name, b.c_mktsegment FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey",
)
def staged_self_join(t):
    return samples.staged_self_join(t.base("customer"), "c_custkey", ["c_name"])
