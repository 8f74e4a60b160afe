"""Row numbers and NTILE over whole tables, without a window that brings all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.operators.links import cut


def global_row_numbers(rows: DataFrame, order: list[str], name: str = "_n") -> DataFrame:
    """Adds the row's place from 0 in the order: numbers within sorted ranges, plus the rows of the ranges before."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_within", within).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def ntile(rows: DataFrame, n: int, order: list[str], name: str) -> DataFrame:
    """Adds the tile from 1 to n: the first tiles get a row more where n doesn't divide the rows."""
    placed = global_row_numbers(rows, order)
    small, extra = divmod(placed.count(), n)
    edge = extra * (small + 1)
    first = F.floor(F.col("_n") / (small + 1)) + 1
    rest = F.lit(extra) + F.floor((F.col("_n") - edge) / max(1, small)) + 1
    return placed.withColumn(name, F.when(F.col("_n") < edge, first).otherwise(rest).cast("int")).drop("_n")
