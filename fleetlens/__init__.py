"""Database-fleet telemetry analytics as Spark jobs.

Reports over server metadata (waits, indexes, files, backups, jobs, traces,
permissions, topology) are plain ``DataFrame -> DataFrame`` functions.  A frame
may describe one server or a whole fleet: when the inputs carry ``server_name``
(and ``database_name`` for database-scoped catalogs) every join, grouping and
window is made per server as well.
"""
