"""A folder that the driver and all executors share, for what a query writes on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is unset, below a temporary folder in local mode, as in tests, and an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        top = tempfile.mkdtemp(prefix="shardloom-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
