"""URL filters by a temporal list join: dated list entries become validity intervals; captures meet those valid at fetch time.

An event says that a list adds or removes a host at some time. Per list and host, events in time order become intervals
[valid_from, valid_to): an add opens one unless one is open, a removal closes it. Each capture's host is looked up with
all its parent hosts; the interval that holds at the fetch time (the latest add at or before it that isn't removed yet) is
its match. The join runs on the host with the time as a range condition, never on all pairs; entries are far fewer than
captures, and a host with many captures is split by Spark's skew join since only the entries' side is unique.

Events at the same time: an add counts before a removal. Nulls: events without host or time are ignored; a capture without
URL or time has no match and is kept. Repeated captures are judged each. Empty lists block nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty where the URL has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parents(host: Column) -> Column:
    """The host and its parent hosts of two labels at least."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def validity(events: DataFrame) -> DataFrame:
    """events (list, host, at, action 'add' or 'remove') -> (list, host, valid_from, valid_to); valid_to null: still valid."""
    w = Window.partitionBy("list", "host").orderBy("at", "rank")
    e = events.where("host is not null and at is not null and action in ('add', 'remove')").select("list", F.lower("host").alias("host"), "at", F.when(F.col("action") == "add", 0).otherwise(1).alias("rank"))
    turns = e.withColumn("last", F.lag("rank").over(w)).where("last is null and rank = 0 or last <> rank")
    return turns.withColumn("valid_to", F.lead("at").over(w)).where("rank = 0").select("list", "host", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Per capture: id, host, n_matches (intervals that hold), matched_host (the longest), listed_at (its valid_from), blocked."""
    rows = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(time_col).alias("fetched_at"))
    intervals = validity(events).withColumnRenamed("host", "listed")
    # hosts and times are judged once and met by all their captures, so no capture merges with another
    asked = rows.select("host", "fetched_at").distinct().withColumn("listed", F.explode(parents(F.col("host"))))
    held = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hit = asked.join(intervals.withColumnRenamed("listed", "entry"), (F.col("listed") == F.col("entry")) & held)
    found = hit.groupBy("host", "fetched_at").agg(F.count("entry").alias("n_matches"), F.max(F.struct(F.length("entry").alias("n"), "entry", "valid_from")).alias("best"))
    n = F.coalesce("n_matches", F.lit(0).cast("long"))
    return rows.join(found, ["host", "fetched_at"], "left").select(F.col("id").alias(id_col), "host", "fetched_at", n.alias("n_matches"), F.col("best.entry").alias("matched_host"), F.col("best.valid_from").alias("listed_at"), (n > 0).alias("blocked"))
