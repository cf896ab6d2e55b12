"""Where operators put intermediate tables: a folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "64000"}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a fresh local folder only where that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a shared folder")
        found = tempfile.mkdtemp(prefix="spark-kb-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/kb-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the job are dropped as soon as the table is written, and its plan is
    logged in 64,000 characters at most: constant tables in it would fill the driver's memory.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    was = {key: spark.conf.get(key) for key in _WRITING}
    try:
        for key, value in _WRITING.items():
            spark.conf.set(key, value)
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


#: The table that a Bloom filter is made of may be large: the filter itself is capped by Spark (8 MB).
_BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "4g"}


@contextmanager
def bloom_filters(spark: SparkSession) -> Iterator[None]:
    """Within, joins with a filtered side may send a Bloom filter of it to the scan of the other, whatever the sizes of both."""
    was = {key: spark.conf.get(key) for key in _BLOOM}
    for key, value in _BLOOM.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that no later step reads."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if "/kb-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of texts have at most ``rows`` rows, to bound what a Python worker holds; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
