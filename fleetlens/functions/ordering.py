"""Running totals and positions over groups of any size.

A window without partition keys, or with a key that holds a third of the rows,
sends that group to one task.  Here the rows are range-partitioned on the full
ordering instead, so a large group spans many slices; each slice gets a local
running sum and the sums of the earlier slices are added from a table with one
row per (group, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import checkpoint_root


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add ``position``, ``sum_before`` and ``sum_total`` of ``value`` per ``keys`` group.

    ``order`` must end in a unique tiebreaker.  ``sum_before`` excludes the row
    itself.  The slice of each row is fixed with a reliable checkpoint: both
    branches below must see the same assignment, also after a lost executor.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = (F.lit(0) if value is None else value).cast("bigint")

    spread = (
        df.withColumn("_value", value)
        .repartitionByRange(slices, *[F.col(k) for k in keys], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    placed = spread.withColumns(
        {
            "_rows": F.row_number().over(local),
            "_sum": F.sum("_value").over(local.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).checkpoint()

    per_slice = placed.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_s")
    )
    # at most `slices` rows per group from here on
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"),
        F.sum("_s").over(group).alias("sum_total"),
    )
    return (
        placed.join(offsets, [*keys, "_slice"])
        .withColumn("position", F.col("_rows") + F.col("_n0"))
        .withColumn("sum_before", F.col("_s0") + F.col("_sum") - F.col("_value"))
        .drop("_value", "_slice", "_rows", "_sum", "_n0", "_s0")
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """Row number per group in ``order`` (which must be a total order)."""
    return running_totals(df, keys, order).drop("sum_before", "sum_total").withColumnRenamed("position", name)


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], prefix: str = "previous_", slices: int | None = None
) -> DataFrame:
    """Add ``previous_`` columns: ``values`` of the row before in ``order`` of the same ``keys`` group.

    A window alone would send a hot group to one task.  Here groups are cut into slices as in
    :func:`running_totals`; the last row of each slice is carried to the first row of the next
    one of its group.  ``order`` must be total; null keys are a group.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(slices, *[F.col(c) for c in (*keys, *order)]).withColumn("_slice", F.spark_partition_id())
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    row = F.struct(*values)
    placed = spread.withColumns({"_before": F.lag(row).over(local), "_first": F.row_number().over(local) == 1}).checkpoint()
    # one row a group and slice
    last = placed.groupBy(*keys, "_slice").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    carried = last.select(
        *[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_slice").alias("_k_slice"), F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry")
    ).where("_carry IS NOT NULL")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys] + [F.col("_slice") == F.col("_k_slice"), F.col("_first")]
    met = placed.join(carried, same, "left").withColumn("_before", F.coalesce("_before", "_carry"))
    return met.select(*df.columns, *[F.col("_before")[c].alias(f"{prefix}{c}") for c in values])


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str = "max_before", slices: int | None = None) -> DataFrame:
    """Add ``name``: the greatest ``value`` of the rows before in ``order`` of the same ``keys`` group, null for the first.

    Cut into slices like :func:`previous_values`; the greatest value of the earlier slices is carried
    to each slice.  ``order`` must be total up to equal rows; null keys are a group, null values are passed over."""
    spark = df.sparkSession
    checkpoint_root(spark)
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("_value", value).repartitionByRange(slices, *[F.col(c) for c in keys], *order).withColumn("_slice", F.spark_partition_id())
    local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("_local", F.max("_value").over(local)).checkpoint()
    # one row a group and slice
    tops = placed.groupBy(*keys, "_slice").agg(F.max("_value").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_slice").alias("_k_slice"), F.max("_top").over(earlier).alias("_carry")).where("_carry IS NOT NULL")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys] + [F.col("_slice") == F.col("_k_slice")]
    met = placed.join(carried, same, "left")
    return met.select(*df.columns, F.greatest("_local", "_carry").alias(name))
