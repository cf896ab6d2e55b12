"""Tables on shared storage: rewrites of the touched buckets only, and one commit for several tables."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64


class CommitConflict(Exception):
    """Someone else has committed since the tables were read."""


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A table in folders ``bucket=n`` by a hash of ``key``; the rows of one key are in one folder. Folders share tasks by key, so a large one is written by several."""
    rows.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket", key).write.partitionBy("bucket").parquet(path)


def _rewrite(spark: SparkSession, path: str, new: DataFrame, touched: DataFrame, key: str, merge, buckets: int) -> None:
    """Replace the buckets of the keys in ``touched`` by what ``merge(old rows)`` gives and ``new``.

    The other folders are neither read nor written. New rows take the table's types. Spark writes beside the old files and moves
    the folders at the end of the job.
    """
    hit = sorted(r[0] for r in touched.select(bucket_of(key, buckets)).distinct().collect())  # at most `buckets` numbers
    if not hit:
        return
    table = spark.read.parquet(path)
    old = table.where(F.col("bucket").isin(*hit)).drop("bucket")
    out = merge(old).select(*old.columns).unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in old.schema]))
    out = out.withColumn("bucket", bucket_of(key, buckets))
    out.repartition("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def replace_chunks_in(path: str, new: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> None:
    """``replace_chunks`` on a table of ``write_bucketed``: all chunks of the documents in ``new`` are replaced. Rows of ``new`` without a key are added."""
    docs = new.select(key).distinct()
    _rewrite(new.sparkSession, path, new, docs, key, lambda old: old.join(docs, key, "left_anti"), buckets)


def upsert_vectors_in(path: str, new: DataFrame, order: str = "seq", key: str = "chunk_id", buckets: int = BUCKETS) -> None:
    """``upsert_vectors`` on a table bucketed by ``chunk_id``: last write wins for each base, version and chunk."""
    keys = ["kb_id", "index_version", "chunk_id"]
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    ids = new.select(*keys).distinct()
    _rewrite(new.sparkSession, path, last, new, key, lambda old: old.join(ids, keys, "left_anti"), buckets)


class TableSet:
    """Several tables under one version number: readers see all tables of one commit or none of it.

    A commit writes each changed table to a folder of its own and then makes the list of folders
    current under the next number, which only one writer can do. Tables that it does not name stay
    as they were. Files of a failed commit are never listed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}".rstrip("/"))

    def version(self) -> int:
        """The newest commit; 0 before the first."""
        folder = self._at("commits")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder)), default=0) if self._fs.exists(folder) else 0

    def _folders(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        stream = self._fs.open(self._at(f"commits/{version}"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version (default: the newest) by name."""
        folders = self._folders(self.version() if version is None else version)
        return {name: self.spark.read.parquet(f"{self.path}/data/{folder}") for name, folder in folders.items()}

    def commit(self, tables: dict[str, DataFrame], base: int) -> int:
        """Make ``tables`` the version after ``base``; raises CommitConflict, and changes nothing, if that exists."""
        if self.version() != base:
            raise CommitConflict(f"version {base} is not the newest")
        folders = self._folders(base)
        for name, rows in tables.items():
            folders[name] = f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/data/{folders[name]}")
        staged, final = self._at(f"staged/{uuid.uuid4().hex}"), self._at(f"commits/{base + 1}")
        stream = self._fs.create(staged, False)
        stream.writeUTF(json.dumps(folders))
        stream.close()
        self._fs.mkdirs(final.getParent())
        try:
            if self._fs.getScheme() == "file":
                os.link(staged.toUri().getPath(), final.toUri().getPath())
            else:
                self._hadoop.FileContext.getFileContext(final.toUri(), self._fs.getConf()).rename(staged, final)
        except (FileExistsError, Py4JJavaError) as error:
            if isinstance(error, FileExistsError) or self._fs.exists(final):
                raise CommitConflict(f"version {base + 1} exists") from None
            raise
        return base + 1
