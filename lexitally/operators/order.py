"""Positions in a total order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitally.session import written


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """The rows with their position, from 0, in the given order, which must be total.

    Rows are sorted by range into parts and written; each part is numbered for itself and
    moved on by the rows of the parts before it. Only the sizes of parts meet in one task.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(parts.withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    firsts = sizes.select("_part", before.alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        parts.withColumn("_inside", inside)
        # As many rows as there were tasks.
        .join(F.broadcast(firsts), "_part")
        .withColumn(name, (F.col("_first") + F.col("_inside")).cast("bigint"))
        .drop("_part", "_inside", "_first")
    )
