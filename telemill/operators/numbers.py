"""Global row numbers without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.sources.scratch import written


def row_numbers(df: DataFrame, order: list[Column | str], number: str = "number") -> tuple[DataFrame, int]:
    """``df`` with gapless numbers from 0 in the given order, and how many there are; equal rows come in any order.

    Rows are dealt by range and sorted once; each partition then begins where those before it end.  Only counts of
    partitions are added up in one place.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = written(sorted_rows.select("*", F.spark_partition_id().alias("__part"), place.alias("__place")), "numbered")
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    out = parts.join(F.broadcast(starts), "__part").withColumn(number, F.col("__start") + F.col("__place"))
    return out.drop("__part", "__place", "__start"), parts.count()
