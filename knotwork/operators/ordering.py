"""Places and running totals along a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def running(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the total of ``value`` over the rows up to and including each, along ``order``, whose columns must tell all
    rows apart: ranges of the order are totalled apart, on top of the totals of the ranges before them (a row each)."""
    # written first: both readers must see the same ranges
    ranged = stored(rows.withColumn("_v", value).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_p").agg(F.sum("_v").alias("_sum"))
    before = sums.select("_p", (F.sum("_sum").over(Window.orderBy("_p")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + inside).drop("_p", "_v", "_before")  # a row for each range


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Adds each row's place, from 1."""
    return running(rows, order, F.lit(1).cast("long"), name)
