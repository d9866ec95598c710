"""Suffix-array dedup by distributed prefix doubling, row by row: Spark sorts position rank pairs at growing offsets.

A position's rank at 8 bytes is their value. Each step pairs a position's rank with that of the position 8, 16 and at last 18
bytes on (18, since two prefixes of 32 bytes at that distance span 50), sorts the distinct pairs and numbers them in order; equal
ranks mean equal bytes. Positions whose prefix stands in one document only drop out, and so does whatever is built on them.

Every step moves each position twice: on check_s (0.1 GB, 173 MB of text) that is far beyond four times the input, see README.
suffix_dedup gives the same results with a small part of the rows; this form is the reference it is tested against.

Null texts count as empty; texts under the length lose nothing; rows that share an id don't remove one another's bytes and count
as one place per position, so ids should differ; rows without an id count as the largest. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, slices, write_table

LENGTH, FIRST = 50, 8
LAST = 2**63 - 1


def _positions(docs: DataFrame) -> DataFrame:
    """(row, doc, at, a): the first eight bytes from every position as a number."""

    def run(batches):
        for b in batches:
            for part in slices(b, 2, 1 << 20):
                for row, doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    n = len(text) - FIRST + 1
                    if n > 0:
                        raw = np.frombuffer(text, np.uint8)
                        value = np.lib.stride_tricks.as_strided(raw, (n, FIRST), (1, 1)).copy().view(">i8").ravel().astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row)), pa.array(np.full(n, doc)), pa.array(np.arange(n, dtype=np.int32)), pa.array(value)], names=["row", "doc", "at", "a"])

    return docs.mapInArrow(run, "row long, doc long, at int, a long")


def _ranked(pairs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(row, doc, at, rank) of the positions whose pair (a, b) stands in several documents; ranks follow the sorted pairs."""
    groups = pairs.groupBy("a", "b").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    numbered, one = write_table(groups.orderBy("a", "b").select("a", "b", F.monotonically_increasing_id().alias("rank")), "ranks")
    ranked, two = write_table(pairs.join(numbered, ["a", "b"]).select("row", "doc", "at", "rank"), "positions")
    return ranked, [one, two]


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc, at): where 50-byte strings start that also start in a document with a smaller id."""
    spark = docs.sparkSession
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    table, path = write_table(own, "texts")
    ranked, paths = _ranked(_positions(table).withColumn("b", F.lit(0).cast("long")))
    for offset in (FIRST, 2 * FIRST, LENGTH - 4 * FIRST):
        further = ranked.select("row", (F.col("at") - offset).alias("at"), F.col("rank").alias("b"))
        pairs = ranked.withColumnRenamed("rank", "a").join(further, ["row", "at"]).select("row", "doc", "at", "a", "b")
        ranked, new = _ranked(pairs)
        for p in paths:
            drop_table(spark, p)
        paths = new
    least = ranked.groupBy("rank").agg(F.min("doc").alias("low"))
    return ranked.join(least, "rank").where("low < doc").select("row", "doc", "at")
