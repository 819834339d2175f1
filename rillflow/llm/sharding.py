"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. A manifest lists the shards that are live; each version of it is a
folder that is written aside and then renamed into place, which fails if another writer was faster, so that readers see
one whole version or another. An append writes only what it adds; a compaction writes the whole list anew, and reading a
version starts from the last such list. Compaction puts shards below the target size into tiers by size, and where a tier
has `fanout` shards or more it merges the tier into files of the target size. The scan does the merging: Spark fills each
of its read partitions with whole files, largest first, up to the target, and each partition is written as one file. Nothing
is shuffled, whatever the keys of the rows are.

A step of a compaction takes MERGE_SHARDS shards at most, smallest tiers first, and steps follow until none is due; the
driver holds the paths of one step, as any file scan does. Rows are stored as they are: nulls, empty and long texts, repeated
rows and columns of any name, `_metadata` and `path` included. An empty arrival adds no shard; an empty store reads as an
empty table. A manifest names shards relative to the root, so a root may have any name
and a store can be moved. The store relies on a file system whose rename is atomic. Names of shards tell version, task and file, so
they are the same in every run that finds the same input; names of the files behind them are not.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillflow.llm.common import columns_of, written
from rillflow.sources.folders import literal

MANIFEST = "path string, bytes long, n_rows long, tier int, added long"
#: Size of the lowest tier's upper edge.
LEAST_BYTES = 64 << 10
#: A shard this full stays as it is.
FULL = 0.75
#: Shards that one step of a compaction merges, and rows of one file of a manifest.
MERGE_SHARDS = 50_000
MANIFEST_ROWS = 200_000


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class ShardStore:
    """Versioned Parquet shards under `root`.

    target_bytes: size of merged files; by default that of one read partition of this session. fanout: shards of a tier
    that start a merge, and the ratio of the tiers' edges.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int | None = None, fanout: int = 4):
        self.spark, self.root, self.schema, self.fanout = spark, root.rstrip("/"), schema, fanout
        self.target = target_bytes or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, under: str):
        return self._hadoop.Path(f"{self.root}/{under}" if under else self.root)

    # -- manifest ------------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[0] == "v")

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version, the latest by default."""
        at = version if version is not None else (self.versions() or [0])[-1]
        if at == 0:
            return self.spark.createDataFrame([], MANIFEST)
        parts = [self._place(at)]
        while not parts[-1].endswith("whole"):
            at -= 1
            if at == 0:
                break
            parts.append(self._place(at))
        return self.spark.read.schema(MANIFEST).parquet(*map(literal, parts))

    def _place(self, version: int) -> str:
        """The folder of a version: `whole` has all shards, `added` those that it adds to the version before."""
        top = f"{self.root}/manifest/v{version:010d}"
        return f"{top}/{'whole' if self._files.exists(self._hadoop.Path(f'{top}/whole')) else 'added'}"

    def commit(self, shards: DataFrame, after: int, whole: bool = True) -> int:
        """Make `shards` version after + 1, in one rename, or add them to version `after`; Conflict if that version exists.

        New shards get that version.
        """
        shards = shards.withColumn("added", F.coalesce("added", F.lit(after + 1).cast("long")))
        aside, place = self._path(f"manifest/_{uuid.uuid4().hex}"), self._path(f"manifest/v{after + 1:010d}")
        files = 1 + shards.count() // MANIFEST_ROWS
        shards.coalesce(files).write.parquet(f"{aside.toString()}/{'whole' if whole else 'added'}")
        never = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(self._files.getUri(), self._conf).rename(aside, place, never)
        except Py4JJavaError as e:
            self._files.delete(aside, True)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {after + 1} exists") from e
            raise
        return after + 1

    def _tier(self):
        return F.greatest(F.lit(0), F.ceil(F.log(float(self.fanout), F.col("bytes") / F.lit(float(LEAST_BYTES))))).cast("int")

    def _written(self, rows: DataFrame, folder: str, most_rows: int = 0, by: str | None = None) -> DataFrame:
        """Write rows as new files, those of each value of `by` apart; what the manifest says of them, `added` left open."""
        writer = rows.write.option("maxRecordsPerFile", most_rows).option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        files = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(literal(folder))
        about = files.metadataColumn("_metadata")
        found = files.groupBy(about["file_path"].alias("_file"), about["file_size"].alias("bytes")).agg(F.count("*").alias("n_rows"))
        return found.select(self._shard(F.col("_file")).alias("path"), "bytes", "n_rows", self._tier().alias("tier"), F.lit(None).cast("long").alias("added"))

    @staticmethod
    def _shard(path: Column) -> Column:
        """The path of a shard below the store's data. Its names are plain, which those above need not be."""
        return F.regexp_extract(path, "[0-9a-f]{32}/(?:[^/]+/)?[^/]+$", 0)

    def _data(self, shard: str) -> str:
        return f"{self.root}/data/{shard}"

    def _fresh(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    # -- writers -------------------------------------------------------------------------------------------------------

    def append(self, rows: DataFrame, most_rows: int = 2000, tries: int = 10) -> int:
        """Add rows as shards of at most most_rows rows; the new version."""
        return self._added(self._written(rows.select(*self._columns()), self._fresh(), most_rows), tries)

    def append_parts(self, rows: DataFrame, part: Column, parts: int, most_rows: int = 2000, tries: int = 10) -> list[int]:
        """Add rows as `parts` arrivals, one after the other, in one pass over them: those for which part is k are the k-th. The new versions."""
        name = f"_part{uuid.uuid4().hex}"
        new = written(self._written(rows.select(*self._columns(), part.cast("int").alias(name)), self._fresh(), most_rows, name), "arrivals")
        return [self._added(new.filter(F.col("path").contains(f"/{name}={k}/")), tries) for k in range(parts)]

    def _columns(self) -> list[Column]:
        return columns_of(self.spark.createDataFrame([], self.schema))

    def _added(self, new: DataFrame, tries: int) -> int:
        for _ in range(tries):
            latest = (self.versions() or [0])[-1]
            try:
                return self.commit(new, latest, whole=latest == 0)
            except Conflict:
                continue
        raise Conflict(f"gave up after {tries} tries")

    def compact(self, tries: int = 10) -> int:
        """Merge tiers until none has `fanout` shards that can be merged; the latest version.

        Arrivals that are committed meanwhile stay: the merge is put into the latest version. If another compaction has
        taken one of its shards, the merge is thrown away and planned anew.
        """
        latest = (self.versions() or [0])[-1]
        while latest:
            shards = self.manifest(latest)
            small = shards.filter(F.col("bytes") < FULL * self.target)
            tiers = small.groupBy("tier").agg(F.count("*").alias("n"), F.min("bytes").alias("least")).filter((F.col("n") >= self.fanout) & (2 * F.col("least") <= self.target))
            due = small.join(F.broadcast(tiers.select("tier")), "tier")  # one row for each tier, of which there are some dozen
            due = due.orderBy("tier", "bytes", "path").select("tier", "path").limit(MERGE_SHARDS).collect()
            by_tier: dict[int, list[str]] = {}
            for r in due:
                by_tier.setdefault(r["tier"], []).append(r["path"])
            paths = [own for own in by_tier.values() if len(own) >= self.fanout]
            if not paths:
                break
            before = sum(map(len, paths))
            folder = self._fresh()
            new = self._merged(paths, folder)
            gone = self.spark.createDataFrame([(p,) for own in paths for p in own], "path string")
            if new.count() >= before:
                self._files.delete(self._hadoop.Path(folder), True)
                break  # files of these sizes don't fit two to a target
            latest = self._replaced(gone, before, new, folder, tries)
        return latest

    def _replaced(self, gone: DataFrame, n_gone: int, new: DataFrame, folder: str, tries: int) -> int:
        """Commit `new`, the files of folder, in place of `gone`; the latest version."""
        for _ in range(tries):
            latest = self.versions()[-1]
            live = self.manifest(latest)
            if live.join(gone, "path", "left_semi").count() < n_gone:
                self._files.delete(self._hadoop.Path(folder), True)
                return latest
            try:
                return self.commit(live.join(gone, "path", "left_anti").unionByName(new), latest)
            except Conflict:
                continue
        raise Conflict(f"gave up after {tries} tries")

    def _merged(self, tiers: list[list[str]], folder: str) -> DataFrame:
        """Each tier read in partitions of whole files up to the target, every partition one new file.

        The settings that make it so are those of a session of its own; this store's session keeps its own.
        """
        session = self.spark.newSession()
        for k, v in {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}.items():
            session.conf.set(k, v)
        parts = [session.read.schema(self.schema).parquet(*(literal(self._data(p)) for p in paths)) for paths in tiers]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionAll(part)
        return self._written(rows, folder)

    def vacuum(self, keep: int = 1, older_than_s: float = 86_400.0) -> None:
        """Delete the shards and manifests that none of the last `keep` versions needs.

        What no version names is left over from writers that died or lost, and goes when it is older than older_than_s,
        since a writer that is still at work may be about to commit it. Arrivals and merges have folders of their own: one
        with no live shard goes whole, file by file only where some of its shards live on.
        """
        every, now = self.versions(), time.time()
        if not every:
            return
        live = self.manifest(every[-1]).select("path")
        for later in every[-keep:-1]:
            live = live.unionAll(self.manifest(later).select("path"))
        folder = F.element_at(F.split("path", "/"), 1)
        lives = {r[0] for r in live.select(folder.alias("f")).distinct().collect()}  # one name for each arrival or merge
        old = [self.manifest(v).select("path") for v in every[:-keep]]
        for shards in old:
            part = shards.filter(folder.isin(sorted(lives))).join(live, "path", "left_anti")
            for row in part.toLocalIterator():
                self._files.delete(self._hadoop.Path(self._data(row["path"])), False)
        known = {r[0] for shards in old for r in shards.select(folder.alias("f")).distinct().collect()}
        data = self._path("data")
        for entry in self._files.listStatus(data) if self._files.exists(data) else []:
            name = entry.getPath().getName()
            if name not in lives and (name in known or now - entry.getModificationTime() / 1000 > older_than_s):
                self._files.delete(entry.getPath(), True)
        first = every[-keep] if len(every) >= keep else every[0]
        while first > 1 and not self._place(first).endswith("whole"):
            first -= 1  # versions that are kept start from this list
        for entry in self._files.listStatus(self._path("manifest")):
            name = entry.getPath().getName()
            if (name[0] == "v" and int(name[1:]) < first) or (name[0] == "_" and now - entry.getModificationTime() / 1000 > older_than_s):
                self._files.delete(entry.getPath(), True)

    # -- readers -------------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; `_metadata` tells each row's shard."""
        paths = [r["path"] for r in self.manifest(version).select("path").toLocalIterator()]
        return self.spark.read.schema(self.schema).parquet(*(literal(self._data(p)) for p in paths)) if paths else self.spark.createDataFrame([], self.schema)

    def placed(self, key: str) -> DataFrame:
        """Of each row its key and shard: the shard's name, rows, bytes and tier, and the version that added it."""
        live = self.manifest()
        name = F.concat_ws("-", F.concat(F.lit("v"), F.col("added")), F.regexp_extract("path", r"part-(\d+)-", 1), F.regexp_extract("path", r"-c(\d+)\.[^/]*$", 1))
        columns = (name.alias("shard"), F.col("n_rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.col("tier"), F.col("added").alias("version"))
        if key in ("shard", "shard_rows", "shard_bytes", "tier", "version"):
            raise ValueError(f"{key} is the name of a column that tells of the shard")
        rows = self.read()
        path = F.lit(None).cast("string") if live.isEmpty() else self._shard(rows.metadataColumn("_metadata")["file_path"])
        rows = rows.select(path.alias("_of"), rows[f"`{key}`"].alias("_key"))
        return rows.join(live.select(F.col("path").alias("_of"), *columns), "_of").drop("_of").withColumnRenamed("_key", key)
