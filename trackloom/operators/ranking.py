"""Global order numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.session import cut


def ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """df with the place (from 0) of each row in the whole order.

    Rows are range-partitioned, numbered within their partition, and shifted by the sizes of the partitions before (one
    row a partition). The partitioned rows are written first, so that both uses see the same partitions. Ties get
    some order; nulls come first. An empty table stays empty.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    local = placed.withColumn("__local", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    return local.join(F.broadcast(before), "__part").withColumn(name, F.col("__local") + F.col("__before")).drop("__part", "__local", "__before")
