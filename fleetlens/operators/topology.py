"""Replication, availability groups and mirroring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import optional, shared_keys
from fleetlens.functions.ordering import running_totals
from fleetlens.functions.tsql import blank_if_null, decode, text

# fixed values: run states and subscription kinds
RUN_STATUS = {1: "Start", 2: "Succeed", 3: "InProgress", 4: "Idle", 5: "Retry", 6: "Fail"}
SUBSCRIPTION_TYPES = {0: "Push", 1: "Pull", 2: "Anonymous"}


def undelivered_commands(history: DataFrame, commands: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Per agent: last delivered sequence number, its time, and commands still to come.

    Commands and agents meet on the article.  Instead of pairing each command
    with each agent, both are put in one ordering per article and the commands
    above an agent's mark are a running count.
    """
    k = shared_keys(history, commands, subscriptions)
    # the time belongs to the history row of the highest number, so rows without a number set no mark
    numbered = history.filter(F.col("xact_seqno").isNotNull())
    marks = numbered.groupBy(*k, "agent_id").agg(F.max(F.struct("xact_seqno", "time")).alias("m")).select(
        *k, "agent_id", F.col("m.xact_seqno").alias("max_seqno"), F.col("m.time").alias("time")
    )
    article = [*k, *[c for c in ("publisher_database_id",) if c in commands.columns and c in subscriptions.columns], "article_id"]
    wanted = subscriptions.select(*article, "agent_id").join(marks, [*k, "agent_id"])
    # commands with the same number count once per row, so they are summed first
    arrivals = commands.groupBy(*article, "xact_seqno").agg(F.count(F.lit(1)).alias("n"))
    both = arrivals.select(*article, F.col("xact_seqno").alias("seq"), "n", F.lit(None).cast("bigint").alias("agent_id"), F.lit(1).alias("is_command")).unionByName(
        wanted.groupBy(*article, "agent_id").agg(F.max("max_seqno").alias("seq"), F.count(F.lit(1)).alias("_times"))
        .select(*article, "seq", F.lit(0).cast("bigint").alias("n"), "agent_id", F.lit(0).alias("is_command"), "_times"),
        allowMissingColumns=True,
    )
    # highest first; a mark comes before the commands of its own number, which are delivered
    order = [F.col("seq").desc(), F.col("is_command").asc(), F.col("agent_id").asc()]
    counted = running_totals(both, article, order, F.col("n")).filter(F.col("is_command") == 0)
    per_agent = (
        counted.filter(F.col("sum_total") > 0).groupBy(*k, "agent_id").agg(F.sum(F.col("sum_before") * F.col("_times")).alias("undelivered"))
    )
    return marks.join(per_agent, [*k, "agent_id"])


def replication_latency(agents: DataFrame, history: DataFrame, commands: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """History rows at each agent's last synchronisation with the undelivered count."""
    k = shared_keys(agents, history, commands, subscriptions)
    pending = undelivered_commands(history, commands, subscriptions)
    last_rows = history.join(pending.select(*k, "agent_id", "time", "undelivered"), [*k, "agent_id", "time"])
    real = agents.filter(F.col("subscriber_db") != "virtual")
    status = F.coalesce(F.concat(decode("runstatus", RUN_STATUS), F.lit(" - "), text("runstatus")), text("runstatus"))
    return real.join(last_rows, [*k, "agent_id"]).withColumns({
        "run_status": status,
        "subscription": decode("subscription_type", SUBSCRIPTION_TYPES, text("subscription_type")),
    })


def replication_articles(
    articles: DataFrame, publications: DataFrame, subscriptions: DataFrame, servers: DataFrame, agents: DataFrame
) -> DataFrame:
    """Publisher, article and subscriber with the agent between them."""
    k = shared_keys(articles, publications, subscriptions, servers, agents)
    named = lambda id_as, name_as: servers.select(*k, F.col("srvid").alias(id_as), F.col("srvname").alias(name_as))
    routes = (
        publications.select(*k, "publication_id", "publisher_id", F.col("publication").alias("publication_name"))
        .join(subscriptions.select(*k, "publication_id", "subscriber_id", "subscriber_db").distinct(), [*k, "publication_id"])
        .join(agents.select(*k, "publisher_id", "subscriber_id", F.col("name").alias("agent_job")), [*k, "publisher_id", "subscriber_id"])
        .join(named("publisher_id", "publication_server"), [*k, "publisher_id"])
        .join(named("subscriber_id", "subscription_server"), [*k, "subscriber_id"])
    )
    return (
        articles.select(*k, "publication_id", "publisher_db", "article", "destination_object").join(routes, [*k, "publication_id"])
        .drop("publication_id", "publisher_id", "subscriber_id").distinct()
    )


def publisher_articles(
    publications: DataFrame, articles: DataFrame, subscriptions: DataFrame, servers: DataFrame, detail: bool = True
) -> DataFrame:
    """Publications with their tables and subscribers, or only the subscribers."""
    k = shared_keys(publications, articles, subscriptions, servers)
    out = (
        articles.select(*k, "artid", "pubid", F.col("name").alias("table_name"))
        .join(publications.select(*k, "pubid", F.col("name").alias("publication"), *optional(publications, "publisher_db")), [*k, "pubid"])
        .join(subscriptions.select(*k, "artid", "srvid"), [*k, "artid"])
        .join(servers.select(*k, "srvid", F.upper("srvname").alias("subscriber_server")), [*k, "srvid"])
        .drop("artid", "pubid", "srvid")
    )
    return out if detail else out.drop("table_name").distinct()


def ag_topology(
    db_cluster_states: DataFrame, replica_cluster: DataFrame, ag_databases: DataFrame, groups: DataFrame,
    replica_states: DataFrame, listeners: DataFrame, replicas: DataFrame,
) -> DataFrame:
    """Databases by replica and listener with role, health and modes.

    A group with several listeners repeats its rows, as each one is an address.
    """
    k = shared_keys(db_cluster_states, replica_cluster, ag_databases, groups, replica_states, listeners, replicas)
    names = groups.select(*k, "group_id", F.col("name").alias("ag_name"))
    members = ag_databases.select(*k, "group_id", "group_database_id", "database_name").join(names, [*k, "group_id"])
    addresses = listeners.select(*k, "group_id", "dns_name", "port", *optional(listeners, "ip_configuration"))
    return (
        db_cluster_states.select(*k, "replica_id", "group_database_id")
        .join(replica_cluster.select(*k, "replica_id", "group_id", "replica_server_name"), [*k, "replica_id"])
        .join(members, [*k, "group_id", "group_database_id"])
        .join(replica_states.select(*k, "group_id", "replica_id", "role_desc", "synchronization_health_desc", *optional(replica_states, "connected_state_desc")),
              [*k, "group_id", "replica_id"], "left")
        .join(addresses, [*k, "group_id"], "left")
        .join(replicas.select(*k, "replica_id", *optional(replicas, "endpoint_url", "availability_mode_desc", "failover_mode_desc", "seeding_mode_desc")),
              [*k, "replica_id"], "left")
        .withColumns({
            "listener": blank_if_null("dns_name"), "listener_port": F.coalesce(F.col("port").cast("bigint"), F.lit(0)),
            **({"ip_configuration": F.when(F.col("dns_name").isNotNull(), F.coalesce("ip_configuration", F.lit("no virtual IP addresses"))).otherwise(F.lit(""))}
               if "ip_configuration" in listeners.columns else {}),
        })
        .drop("dns_name", "port")
    )


def ag_sync_state(
    groups: DataFrame, group_states: DataFrame, replicas: DataFrame, replica_states: DataFrame,
    db_cluster_states: DataFrame, db_states: DataFrame,
) -> DataFrame:
    """Synchronisation of every database on the local replica of each group."""
    k = shared_keys(groups, group_states, replicas, replica_states, db_cluster_states, db_states)
    local = replica_states.filter(F.col("is_local") == 1).select(*k, "replica_id", "role")
    group_names = groups.select(*k, "group_id", F.col("name").alias("ag_name")).join(
        group_states.select(*k, "group_id", "primary_replica"), [*k, "group_id"], "left"
    )
    return (
        db_cluster_states.select(*k, "replica_id", "group_database_id", "database_name", "is_database_joined")
        .join(local, [*k, "replica_id"]).join(replicas.select(*k, "replica_id", "group_id"), [*k, "replica_id"])
        .join(group_names, [*k, "group_id"])
        .join(db_states.select(*k, "replica_id", "group_database_id", "synchronization_state", "is_suspended"), [*k, "replica_id", "group_database_id"], "left")
        .select(*k, "ag_name", blank_if_null("primary_replica").alias("primary_replica"),
                F.coalesce("role", F.lit(3)).alias("local_role"), "database_name",
                F.coalesce("synchronization_state", F.lit(0)).alias("synchronization_state"),
                F.coalesce("is_suspended", F.lit(0)).alias("is_suspended"),
                F.coalesce("is_database_joined", F.lit(0)).alias("is_joined"))
    )


def mirroring_status(mirroring: DataFrame, databases: DataFrame) -> DataFrame:
    """Mirrored databases with role, safety, partner and witness."""
    k = shared_keys(mirroring, databases)
    return mirroring.filter(F.col("mirroring_state_desc").isNotNull()).join(
        databases.select(*k, "database_id", F.col("name").alias("database")), [*k, "database_id"]
    )
