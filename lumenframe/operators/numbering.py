"""Numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.session import cut


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: the position of each row in the order, from 0.

    Rows are spread by ranges of the order, numbered within their range, and shifted by the sizes of the ranges before;
    only those sizes, one per partition, pass through a single task.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = ranged.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(sizes), "_range")
    return rows.withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")
