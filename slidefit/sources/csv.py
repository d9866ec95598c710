"""Signals in header-less comma-separated text, one column per channel and one row per sample.

Files are read in splits; a sample's index is the number of lines before it, from counts per split (small) and a rank
within each split, so no task reads a whole file. Several files of a folder follow one another in the order of their paths.
Cells that are missing or aren't numbers are NaN; blank lines don't count; an empty file gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(lines: DataFrame, name: str = "k") -> DataFrame:
    """lines (value, _file, _start: file and place of the split) with a dense index in the order of the files."""
    split = ["_file", "_start"]
    within = lines.withColumn("_id", F.monotonically_increasing_id()).withColumn("_rank", F.row_number().over(Window.partitionBy(*split).orderBy("_id")) - 1)
    counts = lines.groupBy(*split).count()
    before = counts.select(*split, F.coalesce(F.sum("count").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per split
    return within.join(before, split).withColumn(name, F.col("_rank") + F.col("_before")).drop("_id", "_rank", "_before", *split)


def load_csv_mc(spark: SparkSession, path: str, K: int = -1, k_start: int = 0, channels=None, ds_rate: int = 1, delimiter: str = ",", skip_header: int = 0) -> DataFrame:  # noqa: N803
    """(k, y0, y1, ...): K input rows (all if negative) from k_start on, every ds_rate-th of them, numbered anew."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).where(F.length(F.trim("value")) > 0)
    lines = numbered(text, "_line")
    width = len((text.select("value").limit(skip_header + 1).collect() or [[""]])[-1][0].split(delimiter))
    first = k_start + skip_header
    chosen = lines.where((F.col("_line") >= first) & ((F.col("_line") - first) % ds_rate == 0))
    if K >= 0:
        chosen = chosen.where(F.col("_line") < first + K)
    cells = F.split("value", "\\Q" + delimiter + "\\E")
    wanted = range(width) if channels is None else channels
    number = lambda c: F.coalesce(F.expr(f"try_cast(trim(try_element_at(_cells, {int(c) + 1})) as double)"), F.lit(float("nan")))
    return chosen.withColumn("_cells", cells).select(((F.col("_line") - first) / ds_rate).cast("long").alias("k"), *[number(c).alias(f"y{i}") for i, c in enumerate(wanted)])


def load_csv(spark: SparkSession, path: str, K: int = -1, k_start: int = 0, channel: int = 0, ds_rate: int = 1, **options) -> DataFrame:  # noqa: N803
    """(k, y) of one channel."""
    return load_csv_mc(spark, path, K, k_start, [channel], ds_rate, **options).withColumnRenamed("y0", "y")


def load_lib_csv_mc(spark: SparkSession, base: str, filename: str, *args, **options) -> DataFrame:
    """load_csv_mc under a base folder."""
    return load_csv_mc(spark, f"{base.rstrip('/')}/{filename}", *args, **options)


def load_lib_csv(spark: SparkSession, base: str, filename: str, *args, **options) -> DataFrame:
    return load_csv(spark, f"{base.rstrip('/')}/{filename}", *args, **options)


def load_data_mc(spark: SparkSession, path: str, K: int = -1, kstart: int = 0, chIdxs=None) -> DataFrame:  # noqa: N803
    """The older form, where K is the row to end before."""
    return load_csv_mc(spark, path, -1 if K < 0 else max(0, K - kstart), kstart, chIdxs)


def load_data(spark: SparkSession, path: str, K: int = -1, kstart: int = 0, chIdx: int = 0) -> DataFrame:  # noqa: N803
    return load_data_mc(spark, path, K, kstart, [chIdx]).withColumnRenamed("y0", "y")


def write_coefficients(spark: SparkSession, estimator, path: str) -> None:
    """The literal output rows of a cost's finite segments as a small table (segment, j, i, value): an FIR form."""
    rows = [(p, j, i, float(v)) for p, (m, s, beta) in enumerate(estimator.cost.cells()) for j in range(*(lambda ab: (ab[0], ab[1] + 1))(s.ab_range())) for i, v in enumerate(beta * s.gamma ** (j - s.delta) * m.output_row(j).ravel())]
    spark.createDataFrame(rows, "segment int, j long, i int, value double").write.mode("overwrite").parquet(path)
