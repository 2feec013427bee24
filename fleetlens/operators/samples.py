"""The small relational samples: filtered join sum, product sales, staged join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adaptive_join_sum(
    header: DataFrame, detail: DataFrame, territory, key: str = "order_id", territory_col: str = "territory_id",
    amount_col: str = "sub_total",
) -> DataFrame:
    """Sum of header amounts over all detail lines of one territory.

    Each header counts once per line, so lines are counted per key first and the
    join has one row per header.  The join strategy is left to adaptive execution.
    """
    lines = detail.groupBy(key).agg(F.count(F.lit(1)).alias("_lines"))
    return (
        header.filter(F.col(territory_col) == territory).join(lines, key)
        .agg(F.sum(F.col(amount_col) * F.col("_lines")).alias("total"))
    )


def product_sales(product: DataFrame, detail: DataFrame, stock: DataFrame | None = None, key: str = "product_id") -> DataFrame:
    """Products with the unit price of each sale, and the stock when given.

    Stock is summed per product once and joined, instead of called per row.
    """
    out = product.join(detail, key)
    if stock is not None:
        out = out.join(stock.groupBy(key).agg(F.sum("quantity").alias("stock")), key, "left").na.fill(0, ["stock"])
    return out


def staged_self_join(person: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A projection joined back to its source; the optimizer sees both sizes."""
    staged = person.select(key, *[F.col(c).alias(f"staged_{c}") for c in columns])
    return staged.join(person, key)
