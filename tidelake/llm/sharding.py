"""Sharded storage with size-tiered compaction (operator 6), in DataFrame functions only.

Arrivals are appended as small immutable Parquet shards. Compaction packs shards of one size tier into files near the
target size. Each change is a new version of a manifest that lists the live shards; it is written aside and renamed
put in place whole, so a reader sees a version whole or not at all, and what a failed job left behind is never listed.
Of writers that commit the same version at the same time, one succeeds. Older versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem

#: Merged files that one Spark job writes; more are written by further jobs.
JOB_FILES = 64


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


class ShardStore:
    """Shards and manifests under ``root``. Of writers that read the same version the first commits and the others fail."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, base_bytes: int = 1 << 20):
        self.spark, self.root, self.target, self.fan_in, self.base = spark, root, target_bytes, fan_in, base_bytes
        self.fs, self._path = filesystem(spark, root)

    def _manifest(self, version: int):
        return self._path(f"{self.root}/manifest/v{version:08d}.json")

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        top = self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(top)] if self.fs.exists(top) else []
        return max((int(x[1:9]) for x in names if x.startswith("v") and x.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        lines = self.spark.read.text(str(self._manifest(version).toString())).collect()
        return [Shard(**json.loads(r[0])) for r in lines if '"path"' in r[0]]

    def commit(self, shards: list[Shard], based_on: int) -> int:
        """Writes version ``based_on`` + 1, or fails if it is there already."""
        final, aside = self._manifest(based_on + 1), self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(bytearray("".join(json.dumps(asdict(s)) + "\n" for s in shards) or "\n", "utf-8"))
        out.close()
        try:
            self._place(aside, final)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise RuntimeError(f"version {based_on + 1} was committed by another writer") from e
        finally:
            self.fs.delete(aside, False)
        return based_on + 1

    def _place(self, aside, final) -> None:
        """Gives a finished file its name, and fails if the name is taken. Looking first would let two writers through: on
        a local disk a hard link is made, which the system refuses for a taken name; elsewhere the file is renamed without
        overwriting, which HDFS checks as one step. Stores that copy on a rename (S3) need a manifest on another one."""
        jvm = self.spark._jvm
        if self.fs.makeQualified(final).toUri().getScheme() != "file":
            self._rename(aside, final)
            return
        local = lambda p: jvm.java.io.File(self.fs.makeQualified(p).toUri().getPath()).toPath()
        jvm.java.nio.file.Files.createLink(local(final), local(aside))

    def _rename(self, aside, final) -> None:
        jvm, uri = self.spark._jvm, self.fs.makeQualified(final).toUri()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark._jsc.hadoopConfiguration()).rename(aside, final, options)

    def _written(self, folder: str) -> list[Shard]:
        """The shards of a finished write, with their rows; only footers and paths are read."""
        meta = F.col("_metadata")
        found = self.spark.read.option("recursiveFileLookup", "true").parquet(folder).select(meta["file_path"].alias("path"), meta["file_size"].alias("bytes"))
        return [Shard(r.path, r.n, r.bytes) for r in found.groupBy("path", "bytes").agg(F.count("*").alias("n")).collect()]

    def append(self, df: DataFrame, arrival: Column | None = None) -> int:
        """Appends ``df`` as shards; rows with different values of ``arrival`` go to different shards, and each value is
        committed as a version of its own, in order. Returns the newest version. Nothing is committed for no rows."""
        folder, key = f"{self.root}/shards/{uuid.uuid4().hex}", "_arrival"
        while key in df.columns:
            key = f"_{key}"
        df.withColumn(key, F.lit(0) if arrival is None else arrival).write.partitionBy(key).parquet(folder)
        version = self.version()
        live = self.shards(version)
        by: dict[str, list[Shard]] = {}
        for s in self._written(folder) if self._has_rows(folder) else []:
            by.setdefault(s.path.split("/")[-2], []).append(s)
        for _, new in sorted(by.items(), key=lambda x: (len(x[0]), x[0])):
            live = [*live, *new]
            version = self.commit(live, version)
        return version

    def _has_rows(self, folder: str) -> bool:
        return any(s.isDirectory() for s in self.fs.listStatus(self._path(folder)))

    def tier(self, size: int) -> int:
        """Sizes up to base_bytes are tier 0; each further tier is fan_in times larger."""
        return 0 if size <= self.base else math.ceil(math.log(size / self.base, self.fan_in))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups of at least fan_in shards of one tier, each group as large as the target allows. Shards of three
        quarters of the target or more are finished."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < 0.75 * self.target:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        out = []
        for _, found in sorted(tiers.items()):
            group, held = [], 0
            for s in sorted(found, key=lambda s: (s.bytes, s.path)):
                if group and held + s.bytes > self.target:
                    out.append(group)
                    group, held = [], 0
                group.append(s)
                held += s.bytes
            out.append(group)
        return [g for g in out if len(g) >= self.fan_in or (len(g) > 1 and sum(s.bytes for s in g) >= 0.75 * self.target)]

    def compact(self) -> int:
        """Merges until no tier has enough shards, and returns how many merges there were. Replaced shards stay for readers
        of older versions until ``vacuum``. A merged file is written by one task, of at most the target's size."""
        merges = 0
        while True:
            version = self.version()
            live = self.shards(version)
            groups = self.plan(live)[:JOB_FILES]
            if not groups:
                return merges
            folder = f"{self.root}/shards/{uuid.uuid4().hex}"
            parts = [self.spark.read.parquet(*[s.path for s in g]).coalesce(1) for g in groups]
            reduce(DataFrame.unionByName, parts).write.parquet(folder)
            gone = {s.path for g in groups for s in g}
            new = self._written(folder)
            if sum(s.rows for s in new) != sum(s.rows for g in groups for s in g):
                raise RuntimeError("a merge lost or doubled rows; nothing was committed")
            self.commit([s for s in live if s.path not in gone] + new, version)
            merges += len(groups)

    def vacuum(self, versions: int = 2) -> int:
        """Gives up all but the newest ``versions`` versions, and returns how many shards were deleted: those that only
        versions given up list. Shards go before manifests, so that a vacuum that was stopped can be run again."""
        if versions < 1:
            raise ValueError("the newest version can't be given up")
        newest = self.version()
        first = max(1, newest - versions + 1)
        old = [v for v in range(1, first) if self.fs.exists(self._manifest(v))]
        kept = {s.path for v in range(first, newest + 1) for s in self.shards(v)}
        gone = {s.path for v in old for s in self.shards(v)} - kept
        deleted = sum(bool(self.fs.delete(self._path(p), False)) for p in gone)
        for v in old:
            self.fs.delete(self._manifest(v), False)
        return deleted

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version whose shards are still there; None if it has no shards."""
        shards = self.shards(version)
        return self.spark.read.parquet(*[s.path for s in shards]) if shards else None


def store_and_read(docs: DataFrame, root: str, arrivals: int = 16, target_bytes: int = 128 << 20) -> tuple[ShardStore, DataFrame]:
    """Appends ``docs`` in ``arrivals`` arrivals by doc_id (a null id is in the first), compacts, and reads the newest
    version with each row's arrival as a column. All columns are kept; one named arrival is replaced. An empty table
    gives an empty result and no version."""
    store = ShardStore(docs.sparkSession, root, target_bytes)
    rows = docs.withColumn("arrival", F.coalesce(F.pmod(F.col("doc_id"), F.lit(arrivals)), F.lit(0)).cast("long"))
    store.append(rows, F.col("arrival"))
    store.compact()
    found = store.read()
    return store, found.select(rows.columns) if found is not None else rows.limit(0)
