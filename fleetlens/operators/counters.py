"""Differences of counters that add up since a server started: waits, reads and writes, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import SERVER, optional, shared_keys
from fleetlens.functions.ordering import previous_values


def counter_deltas(samples: DataFrame, key: str = "counter_name", ts: str = "sample_time", tie: str = "sample_id", value: str = "value", started: str | None = None) -> DataFrame:
    """``samples`` with ``previous_time``, ``elapsed_us``, ``delta`` and ``was_reset``.

    A counter that is lower than before, or whose server has started since (column ``started``), began
    anew: its value is what it counted since.  The first sample of a counter has no delta; a null
    value has none either, and the next one is held against the last that is not null."""
    keys = [*optional(samples, *SERVER), key]
    known = samples.where(F.col(value).isNotNull())
    values = [ts, value, *([started] if started else [])]
    # names of its own, as the table may have columns like these
    placed = previous_values(known, keys, [ts, tie], values, "_was_")
    anew = F.col(value) < F.col(f"_was_{value}")
    if started:
        anew = anew | (F.col(started) > F.col(f"_was_{started}"))
    there = F.col(f"_was_{ts}").isNotNull()
    out = placed.select(
        *samples.columns, F.col(f"_was_{ts}").alias("previous_time"), F.timestamp_diff("MICROSECOND", F.col(f"_was_{ts}"), F.col(ts)).alias("elapsed_us"),
        F.when(there, F.when(anew, F.col(value)).otherwise(F.col(value) - F.col(f"_was_{value}"))).alias("delta"), F.when(there, anew).otherwise(False).alias("was_reset"),
    )
    empty = {"previous_time": samples.schema[ts].dataType, "elapsed_us": "bigint", "delta": samples.schema[value].dataType}
    rest = samples.where(F.col(value).isNull()).withColumns({c: F.lit(None).cast(t) for c, t in empty.items()}).withColumn("was_reset", F.lit(False))
    return out.unionByName(rest.select(out.columns))


def counter_rates(deltas: DataFrame, key: str = "counter_name", ts: str = "sample_time", bucket: str = "hour") -> DataFrame:
    """``window_start``, ``total``, ``covered_us``, ``resets`` of each counter and ``bucket``; the rate is total by covered time.

    A difference belongs to the bucket of its later sample."""
    k = shared_keys(deltas)
    return deltas.where(F.col("delta").isNotNull()).groupBy(*k, key, F.date_trunc(bucket, ts).cast("timestamp_ntz").alias("window_start")).agg(
        F.sum("delta").alias("total"), F.sum("elapsed_us").alias("covered_us"), F.sum(F.col("was_reset").cast("int")).alias("resets")
    )
