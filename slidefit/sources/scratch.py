"""The folder that all executors and the driver see, for tables and streams that a query writes before it reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a temporary folder, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = f"file://{tempfile.mkdtemp(prefix='slidefit-')}"
    return f"{folder.rstrip('/')}/slidefit/{name}-{uuid.uuid4().hex}"
