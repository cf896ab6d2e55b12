"""A folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the session's ``spark.checkpoint.dir``; a local folder only where that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a shared folder")
        found = tempfile.mkdtemp(prefix="spark-kb-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/kb-{tag}-{uuid.uuid4().hex}"
