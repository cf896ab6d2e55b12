"""Shards by size-tiered compaction, under a versioned manifest.

Arrivals become small immutable Parquet files. A tier holds shards of similar size; when it has
``fanout`` of them, they are merged into files of about the target size, and the tier above gets
the result. Readers see only the files of the newest manifest. A manifest is a table of shards,
written whole under a name of its own and made current by the marker of its number, which can be
made only once: by a hard link on a local file system, elsewhere by a rename that does not
overwrite, so the file system must do such renames in one step. Files of a lost or failed commit
are never listed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD = "path string, bytes long, n_rows long, generation int"


class CommitConflict(Exception):
    """Another writer has made the next version."""


@dataclass(frozen=True)
class Tiers:
    """``target``: bytes of a full shard; ``small``: bytes of an arriving one; ``fanout``: shards that make a tier due; ``growth``: size ratio of tiers."""

    target: int = 128 << 20
    small: int = 4 << 20
    fanout: int = 4
    growth: int = 4

    def tier(self) -> Column:
        """The tier of a shard by its ``bytes``; full shards have none."""
        steps = F.floor(F.log(F.greatest(F.col("bytes") / F.lit(self.small), F.lit(1.0))) / F.log(F.lit(float(self.growth)))).cast("int")
        return F.when(F.col("bytes") < self.target // 2, steps)


class ShardStore:
    """A folder of shards that the driver and all executors can reach."""

    def __init__(self, spark: SparkSession, path: str, tiers: Tiers = Tiers()):
        self.spark, self.path, self.tiers = spark, path.rstrip("/"), tiers
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = self._hadoop.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._at(f"{self.path}/current")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """``path, bytes, n_rows, generation`` of each shard of a version (default: the newest)."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], SHARD)
        stream = self._fs.open(self._at(f"{self.path}/current/{version}"))
        try:
            name = stream.readUTF()
        finally:
            stream.close()
        return self.spark.read.schema(SHARD).parquet(f"{self.path}/manifests/{name}")

    def commit(self, shards: DataFrame, base: int) -> int:
        """Make ``shards`` the version after ``base``; raises CommitConflict if someone else did so."""
        name = uuid.uuid4().hex
        shards.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        marker, final = self._at(f"{self.path}/staged/{name}"), self._at(f"{self.path}/current/{base + 1}")
        stream = self._fs.create(marker, False)
        stream.writeUTF(name)
        stream.close()
        self._fs.mkdirs(final.getParent())
        try:
            if self._fs.getScheme() == "file":
                os.link(marker.toUri().getPath(), final.toUri().getPath())
            else:
                self._hadoop.FileContext.getFileContext(final.toUri(), self._fs.getConf()).rename(marker, final)
        except (FileExistsError, Py4JJavaError) as error:
            if isinstance(error, FileExistsError) or self._fs.exists(final):
                raise CommitConflict(f"version {base + 1} exists") from None
            raise
        return base + 1

    def _measured(self, folder: str, generation: int) -> DataFrame:
        """The shards that a job has written to ``folder``: sizes from the file listing, rows from the footers."""
        data = self.spark.read.parquet(folder)
        return data.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n_rows")).select("path", "bytes", "n_rows", F.lit(generation).alias("generation"))

    def _keep_schema(self, rows: DataFrame) -> None:
        """An empty table that tells the columns of a store without shards."""
        if not self._fs.exists(self._at(f"{self.path}/schema/_SUCCESS")):
            rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")

    def append(self, rows: DataFrame) -> int:
        """Write one arrival as small shards and commit it; an empty arrival changes nothing but the version."""
        self._keep_schema(rows)
        base = self.version()
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return self.commit(self.manifest(base).unionByName(self._measured(folder, 0)), base)

    def append_parts(self, rows: DataFrame, part: Column) -> int:
        """Write all values of ``part`` as arrivals in one job without a shuffle; each is committed by itself, and due tiers are compacted in between."""
        self._keep_schema(rows)
        folder, name = f"{self.path}/data/{uuid.uuid4().hex}", f"part_{uuid.uuid4().hex}"
        rows.withColumn(name, part).write.option("compression", "zstd").partitionBy(name).parquet(folder)
        found = [s.getPath() for s in self._fs.listStatus(self._at(folder)) if s.isDirectory()]
        for path in sorted(str(p.toString()) for p in found):
            base = self.version()
            self.commit(self.manifest(base).unionByName(self._measured(path, 0)), base)
            self.settle()
        return self.version()

    def due(self) -> list[int]:
        """Tiers with at least ``fanout`` shards, smallest first; there are only as many tiers as size ratios below the target."""
        tiers = self.manifest().select(self.tiers.tier().alias("tier")).where("tier is not null").groupBy("tier").count()
        return sorted(r["tier"] for r in tiers.where(F.col("count") >= self.tiers.fanout).collect())

    def compact(self, tier: int) -> int:
        """Merge the shards of one tier into files of about the target size and commit the new version.

        Shards are packed without a shuffle: read partitions are put together until they hold a
        target's worth of bytes, and each is written as one file. The files of one tier are listed
        in the driver, as for any read of Parquet files.
        """
        base = self.version()
        shards = self.manifest(base).withColumn("tier", self.tiers.tier())
        run = shards.where(F.col("tier") == tier)
        size, generation = run.agg(F.sum("bytes"), F.max("generation")).first()
        files = max(1, -(-size // self.tiers.target))
        paths = [r["path"] for r in run.select("path").toLocalIterator()]
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        self.spark.read.parquet(*paths).coalesce(files).write.option("compression", "zstd").parquet(folder)
        rest = shards.where(~F.col("tier").eqNullSafe(F.lit(tier))).drop("tier")
        return self.commit(rest.unionByName(self._measured(folder, generation + 1)), base)

    def settle(self) -> int:
        """Compact due tiers until none is due.

        It ends by itself: shards with a tier are below half the target, so ``fanout`` of them or
        more always become fewer files.
        """
        while due := self.due():
            self.compact(due[0])
        return self.version()

    def expire(self, keep: int = 2) -> int:
        """Delete the data of versions before the newest ``keep``; returns how many folders went. Readers of older versions must be gone."""
        versions = self._versions()
        live = None
        for v in versions[-keep:]:
            live = self.manifest(v) if live is None else live.unionByName(self.manifest(v))
        if live is None:
            return 0
        folder = F.regexp_extract("path", r"/data/(.*)/[^/]*$", 1)
        used = {r[0] for r in live.select(folder).distinct().collect()}  # one for each live commit
        gone = 0
        for own in self._fs.listStatus(self._at(f"{self.path}/data")):
            name = own.getPath().getName()
            inner = [name] if name in used or not any(u.startswith(f"{name}/") for u in used) else [f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(own.getPath()) if s.isDirectory()]
            for path in inner:
                if path not in used:
                    gone += self._fs.delete(self._at(f"{self.path}/data/{path}"), True)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; one without shards has none, under the columns of the first arrival."""
        paths = [r["path"] for r in self.manifest(version).select("path").toLocalIterator()]
        return self.spark.read.parquet(*paths or [f"{self.path}/schema"])

    def placed(self, key: str, version: int | None = None) -> DataFrame:
        """``key, shard, generation, shard_bytes, shard_rows`` for every row of a version."""
        path = "__path" if key != "__path" else "__at"
        shards = self.manifest(version).select(F.col("path").alias(path), F.element_at(F.split("path", "/"), -1).alias("shard"), "generation", F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"))
        rows = self.read(version).select(key, F.col("_metadata.file_path").alias(path))
        return rows.join(shards, path).drop(path)


def shard_arrivals(spark: SparkSession, arrivals: Iterable[DataFrame], path: str, tiers: Tiers = Tiers()) -> ShardStore:
    """Append each arrival, compact, and return the store.

    All columns are stored as they are, nulls and repeated rows too; extra columns need only be
    the same in all arrivals. A text is never split, so a shard may exceed the target by its last
    row group. Shards of equal size are in one tier. Empty arrivals make a store without shards, which reads as no rows.
    """
    store = ShardStore(spark, path, tiers)
    for rows in arrivals:
        store.append(rows)
    store.settle()
    return store


def shard_table(rows: DataFrame, path: str, key: str = "doc_id", arrivals: int = 12, tiers: Tiers = Tiers()) -> ShardStore:
    """A table as ``arrivals`` arrivals by a hash of ``key`` (null: the first), compacted as they come; only the data of the last two versions stay.

    Rows are kept as in ``shard_arrivals``; an empty table makes a store of version 0, which reads as no rows.
    """
    store = ShardStore(rows.sparkSession, path, tiers)
    store.append_parts(rows, F.when(F.col(key).isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.lit(arrivals))).cast("int"))
    store.expire()
    return store
