"""Writing report results: batches of reports, bulk appends, retention rewrites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import checkpoint_root

RUN_LOG_SCHEMA = "report string, format string, path string, started_at timestamp, ended_at timestamp, outcome string, error string"


def report_batch(
    spark: SparkSession,
    reports: Mapping[str, DataFrame],
    out_dir: str,
    fmt: str | Mapping[str, str] = "parquet",
    stop_on_error: bool = False,
) -> DataFrame:
    """Write every report to its own folder and return the run log.

    Results are written by the executors; only one log line per report is kept
    here.  ``fmt`` may differ per report (for example XML next to CSV).
    """
    log = []
    for name, df in reports.items():
        kind = fmt if isinstance(fmt, str) else fmt.get(name, "parquet")
        path = f"{out_dir.rstrip('/')}/{name}"
        started = datetime.now(timezone.utc)
        outcome, error = "Succeeded", None
        try:
            writer = df.write.mode("overwrite").format(kind)
            if kind == "xml":
                writer = writer.option("rowTag", "row").option("rootTag", name)
            if kind == "csv":
                writer = writer.option("header", "true")
            writer.save(path)
        except Exception as failure:  # one failing report must not lose the others
            if stop_on_error:
                raise
            outcome, error = "Failed", str(failure) or type(failure).__name__
        log.append((name, kind, path, started, datetime.now(timezone.utc), outcome, error))
    frame = spark.createDataFrame(log, RUN_LOG_SCHEMA)
    frame.write.mode("append").parquet(f"{out_dir.rstrip('/')}/_run_log")
    return frame


def bulk_append(
    df: DataFrame,
    path: str,
    batch_rows: int = 50_000,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
) -> None:
    """Append a result set; no file holds more than ``batch_rows`` rows."""
    writer = df.write.mode("append").format(fmt).option("maxRecordsPerFile", batch_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def expired(ts_column: str, as_of, keep_days: int):
    return F.col(ts_column) < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(keep_days)} days")


def retention_prune(df: DataFrame, ts_column: str, as_of, keep_days: int = 42) -> DataFrame:
    """Rows to keep: history strictly older than the cut-off is dropped, and rows
    without a timestamp stay."""
    return df.filter(F.coalesce(~expired(ts_column, as_of, keep_days), F.lit(True)))


def _overwrite_partitions(df: DataFrame, table: str) -> None:
    """Replace only the partitions present in ``df``.

    For catalog tables the mode is a session setting; as a writer option it is
    ignored and the whole table would be replaced.
    """
    conf, key = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(key)
    conf.set(key, "dynamic")
    try:
        df.write.mode("overwrite").insertInto(table)
    finally:
        conf.set(key, before)


def retention_rewrite(spark: SparkSession, table: str, ts_column: str, date_column: str, as_of, keep_days: int = 42) -> None:
    """Apply the retention in place to a catalog table partitioned by ``date_column``,
    alone or with other columns (such as a server before it).

    Partitions older than the cut-off day are dropped without reading them; only
    the partition that holds the cut-off is rewritten (dynamic overwrite).
    """
    checkpoint_root(spark)
    cut = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(keep_days)} days")
    cut_day = str(spark.range(1).select(cut.cast("date").cast("string")).first()[0])
    edge = spark.table(table).filter(F.col(date_column) == F.lit(cut_day).cast("date"))
    kept = retention_prune(edge, ts_column, as_of, keep_days).checkpoint()
    # one entry per day (and server) of history, not per row
    specs = [
        [(k, unquote(v)) for k, _, v in (part.partition("=") for part in spec.split("/"))]
        for (spec,) in spark.sql(f"SHOW PARTITIONS {table}").collect()
    ]
    if not specs:
        return
    columns = [k for k, _ in specs[0]]
    still = {tuple(map(str, r)) for r in kept.select(columns).distinct().collect()}
    if still:
        _overwrite_partitions(kept, table)
    for spec in specs:
        day = dict(spec)[date_column]
        if day < cut_day or (day == cut_day and tuple(v for _, v in spec) not in still):
            values = ", ".join(f"{k} = '{_escaped(v)}'" for k, v in spec)
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({values})")


def _escaped(value: str) -> str:
    return value.replace("\\", "\\\\").replace("'", "\\'")
