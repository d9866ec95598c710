"""Consecutive numbers for events in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], time: str, tie: str, name: str = "k", seconds: int = 3600) -> DataFrame:
    """df with each series' rows counted 0, 1, 2, ... by (time, tie), nulls first.

    Rows are ranked within intervals of that many seconds and moved by the rows of earlier intervals (a small row for each), so a
    long series is sorted by as many tasks as it has intervals.
    """
    cut = df.withColumn("_part", F.coalesce(F.floor(F.unix_seconds(time) / seconds), F.lit(-(2**62))))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_part").count().select(*keys, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(time, tie))
    return cut.withColumn("_rank", rank).join(counts, [*keys, "_part"]).withColumn(name, F.col("_rank") + F.col("_before") - 1).drop("_part", "_rank", "_before")
