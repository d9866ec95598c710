"""Shared helpers: the folder that all executors see, written intermediate tables, null-safe inputs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the setting is absent, a temporary one, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.conf.get("spark.master", "local") or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = f"file://{tempfile.mkdtemp(prefix='slidefit-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths of the tables that stand in the shared folder.
_written: list[str] = []


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/slidefit/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    if path in _written:
        _written.remove(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written_so_far() -> int:
    """A mark for drop_since."""
    return len(_written)


def drop_since(spark: SparkSession, mark: int, but: str) -> None:
    """Remove the tables written after a mark, but for one: what a result was made from, once the result is written itself."""
    for path in [p for p in _written[mark:] if p != but]:
        drop_table(spark, path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; further columns of docs are left behind, so no name can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: int, most: int):
    """The batch in slices of at most that many bytes of a binary or string column, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Hand freed memory that Arrow and the C library hold back to the system: Spark keeps Python workers between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Meanwhile Spark hands Python workers some that many bytes at once, one row at least: a batch lies several times outside an
    executor's heap, in buffers that double as they grow, and again in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_bytes(path: str) -> bytes:
    """A vocabulary file on the driver; executors get its bytes by broadcast."""
    with open(path, "rb") as f:
        return f.read()


class Memory:
    """A bounded dictionary; when full, it starts anew. Unless first, it takes a key when it is offered for the second time."""

    def __init__(self, limit: int, first: bool = False):
        self.known: dict = {}
        self.limit, self.once = limit, None if first else bytearray(1 << 22)

    def offer(self, items: dict) -> None:
        if len(self.known) >= self.limit:
            self.known = {}
        if self.once is None:
            self.known.update(items)
            return
        known, once, mask = self.known, self.once, len(self.once) - 1
        for k, v in items.items():
            at = hash(k) & mask
            if once[at]:
                known[k] = v
            else:
                once[at] = 1
