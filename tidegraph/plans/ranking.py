"""Row numbers that no single task has to compute.

A window over one hot key, or over no key at all, would sort that whole group in one task. Here the
rows are range-partitioned by (keys, order), numbered inside each slice, and shifted by the sizes of
the slices before. Only the slice sizes, at most one row per key and partition, are windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegraph.session import stage


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Add a 1-based row number per key (overall when ``keys`` is empty); ``order`` must be total."""
    spread = df.repartitionByRange(*[F.col(k).asc() for k in keys], *order)
    sliced = stage(spread.withColumn("_slice", F.spark_partition_id()), "slices")
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_at", F.row_number().over(within))
        .join(shifts, [*keys, "_slice"])
        .withColumn(name, F.col("_at") + F.col("_before"))
        .drop("_at", "_before", "_slice")
    )


def page(df: DataFrame, order: list[Column], offset: int, limit: int | None) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` of the ordered table.

    A first page is a top-k. A deep page is cut by row number, since a plain offset would send every
    skipped row through one task.
    """
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must be >= 0")
    if limit is not None and offset + limit <= 10_000:
        return df.orderBy(*order).offset(offset).limit(limit)
    if offset == 0:
        return df.orderBy(*order)
    rows = numbered(df, [], order, "_row").where(F.col("_row") > offset)
    if limit is not None:
        rows = rows.where(F.col("_row") <= offset + limit)
    return rows.orderBy("_row").drop("_row")
