"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder: `data/<batch>/*.parquet` are shards, never changed once written; `manifest/<version>.json` lists
the shards that a version consists of. Appending writes a batch of small shards and commits the next version.
Compaction looks at sizes only: shards of one tier (sizes within a factor of `fanout`) are merged into files of about
the target size once there are `fanout` of them, then the next version is committed. A commit writes the manifest
beside its place and renames it there, which fails if that version exists. So the folder must be in a file system whose
rename is atomic and doesn't overwrite, as HDFS and local ones; plain object stores aren't such. Who loses a race takes
the winner's version as the base and commits again: an append always can, a merge if its shards are still there.

A lost task or driver leaves at most files that no manifest names. `vacuum` removes shards that only older versions
name, and files that none names if they are older than `min_age_s`, since a writer that hasn't committed yet may.

Merging reads the tier's shards and coalesces them into as many files as their bytes ask for: no shuffle, and one job
for each tier, not for each file.

Defined results: nulls, long and repeated rows are stored as they are; an empty arrival commits a version without
new shards; columns may have any names, but appends to one store must have one schema; rows are dealt to arrivals by a
hash of all their simple columns, so repeated rows come together.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    tier: int


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_mb: int = 128, fanout: int = 4, smallest_mb: float = 1.0):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fanout, self.smallest = target_mb << 20, fanout, int(smallest_mb * (1 << 20))
        self._fs_package = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # Files, by way of Hadoop's file systems.
    def _path(self, at: str):
        return self._fs_package.Path(at)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _sizes(self, folder: str) -> list[tuple[str, int]]:
        if not self._fs().exists(self._path(folder)):
            return []
        return [(s.getPath().toString(), s.getLen()) for s in self._fs().listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet") and s.getLen()]

    def tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / self.smallest, self.fanout)))

    def version(self) -> int:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs().exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "shards": []}
        stream = self._fs().open(self._path(f"{self.root}/manifest/{version:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        got = json.loads(text)
        return got | {"shards": [Shard(**s) for s in got["shards"]]}

    def commit(self, base: int, shards: list[Shard], schema: str) -> int:
        """The version base + 1 with these shards; CommitConflict if it exists. Readers see all of it or nothing."""
        version = base + 1
        folder = f"{self.root}/manifest"
        beside = self._path(f"{folder}/.{uuid.uuid4().hex}.tmp")
        self._fs().mkdirs(self._path(folder))
        out = self._fs().create(beside, True)
        try:
            out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        context = self._fs_package.FileContext.getFileContext(beside.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._fs_package.Options.Rename, 0)
        try:
            context.rename(beside, self._path(f"{folder}/{version:010d}.json"), options)
        except Py4JJavaError as e:
            self._fs().delete(beside, False)
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise  # not another writer, but a fault of the file system
            raise CommitConflict(f"version {version} exists") from e
        return version

    def _shards(self, folder: str) -> list[Shard]:
        return [Shard(path, size, self.tier(size)) for path, size in sorted(self._sizes(folder))]

    def _write(self, df: DataFrame) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self._shards(folder)

    def _add(self, shards: list[Shard], schema: str) -> int:
        while True:
            now = self.manifest()
            try:
                return self.commit(now["version"], now["shards"] + shards, schema)
            except CommitConflict:
                continue  # what others committed meanwhile stays

    def append(self, df: DataFrame) -> int:
        """Arrivals, as one small shard for each of their partitions."""
        return self._add(self._write(df), df.schema.json())

    def append_all(self, df: DataFrame, arrivals: int) -> int:
        """df as so many arrivals, each its own batch and version; written in one pass over df."""
        simple = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
        by = "arrival"
        while by in df.columns:
            by = f"_{by}"
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        which = F.pmod(F.xxhash64(*simple), F.lit(arrivals)) if simple else F.lit(0)
        df.withColumn(by, which).write.option("compression", "zstd").partitionBy(by).parquet(folder)
        batches = [self._shards(f"{folder}/{by}={i}") for i in range(arrivals)]
        if not any(batches):
            batches[0] = self._write(df)  # of no rows: a shard that has the columns alone
        for batch in batches:
            version = self._add(batch, df.schema.json())
        return version

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Tiers to merge: those of files below the target that hold fanout shards or more."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target * 0.75:
                tiers.setdefault(s.tier, []).append(s)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout]

    def compact(self) -> int:
        """Merge tiers, the smallest first, until none is due; each merge is a version."""
        version = self.version()
        while due := self.plan((now := self.manifest(version))["shards"]):
            runs = due[0]
            files = max(1, round(sum(s.bytes for s in runs) / self.target))
            if files >= len(runs):
                break
            merged, gone = self._write(self._load(runs, now["schema"]).coalesce(files)), set(runs)
            while True:
                try:
                    version = self.commit(now["version"], [s for s in now["shards"] if s not in gone] + merged, now["schema"])
                    break
                except CommitConflict:
                    now = self.manifest()
                    if not gone <= set(now["shards"]):  # another merged them first; the files made here are left to vacuum
                        version = now["version"]
                        break
        return version

    def vacuum(self, keep_versions: int = 1, min_age_s: float = 86_400) -> int:
        """Delete shards that older versions name and none of the last ones does, and files of no version older than min_age_s; how many.

        Readers of older versions lose them.
        """
        last = self.version()
        named = [{s.path for s in self.manifest(v)["shards"]} for v in range(1, last + 1)]
        kept = set().union(*named[max(0, last - keep_versions) :])
        old, oldest = set().union(*named) - kept, (time.time() - min_age_s) * 1000
        data, n = self._path(f"{self.root}/data"), 0
        found = self._fs().listFiles(data, True) if self._fs().exists(data) else None
        while found is not None and found.hasNext():
            status = found.next()
            path = status.getPath()
            if path.getName().endswith(".parquet") and path.toString() not in kept and (path.toString() in old or status.getModificationTime() < oldest):
                self._fs().delete(path, False)
                n += 1
        return n

    def _load(self, shards: list[Shard], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards]) if shards else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        if not now["version"]:
            raise ValueError("nothing was committed yet")
        return self._load(now["shards"], now["schema"])


def sharded(docs: DataFrame, root: str, arrivals: int = 4, **options) -> tuple[ShardStore, DataFrame]:
    """Append docs to a new store as several arrivals, compact it and read it back: the store, and its rows."""
    store = ShardStore(docs.sparkSession, root, **options)
    store.append_all(docs, arrivals)
    store.compact()
    store.vacuum()
    return store, store.read()


def shard_digest(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and sha256 of the text, shard (the file it lies in), shard_bytes; read from the shards."""
    return rows.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"), F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"))
