"""Sharded document storage: size-tiered compaction under a versioned manifest.

Arrivals become small immutable shards (Parquet files). Shards of similar size (the same
power of FAN) merge into files of about the target size once there are FAN of them; a
merge reads them in place and coalesces, without a shuffle. A version is a table of
shards. It counts from the moment that a commit file with its name, written elsewhere
before, is renamed into place without overwriting: readers see a whole version or the one
before, a writer lost on the way leaves nothing, and of two writers one fails and tries
again over the other's version. A writer lists its folder as an intent until it has
committed, so that vacuum leaves it alone.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 4
#: Shards that one merge reads at most; a tier with more takes several merges.
MERGE = 10_000
SHARDS = "path string, bytes long, level int"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """A folder of shards. The manifest is a table that Spark reads and writes; the driver sees sums by tier and the paths it reads."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, abandoned_s: float = 86_400):
        """abandoned_s: the age from which an intent counts as left behind by a lost writer."""
        self.spark, self.root, self.target, self.abandoned = spark, root.rstrip("/"), target_bytes, abandoned_s
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._no_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._no_overwrite[0] = rename.NONE
        for folder in ("_manifests", "_intents", "data"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def _names(self, folder: str) -> list[tuple[str, int, float]]:
        """Name, bytes and age in seconds of what a folder holds."""
        where = self._path(f"{self.root}/{folder}")
        return sorted((s.getPath().getName(), s.getLen(), time.time() - s.getModificationTime() / 1000) for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _put(self, name: str, content: str) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()

    def _commits(self) -> dict[int, int]:
        return {int(n[1:-7]): size for n, size, _ in self._names("_manifests") if n.endswith(".commit")}

    def version(self) -> int:
        """The last committed version; 0 before the first. Empty commit files are void."""
        return max((n for n, size in self._commits().items() if size), default=0)

    def shards(self, version: int | None = None) -> DataFrame:
        """path (below the root), bytes and level of each shard of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], SHARDS)
        with_name = self._fs.open(self._path(f"{self.root}/_manifests/v{version:08d}.commit"))
        try:
            name = bytes(with_name.readAllBytes()).decode()
        finally:
            with_name.close()
        return self.spark.read.schema(SHARDS).parquet(f"{self.root}/_manifests/{name}")

    def commit(self, shards: DataFrame, over: int) -> int:
        """Makes `shards` the version after `over`, the last one; a Conflict where another came first."""
        commits = self._commits()
        if max((n for n, size in commits.items() if size), default=0) != over:
            raise Conflict(f"version {over} is not the last")
        name, now = f"table-{uuid.uuid4().hex}", max(commits, default=0) + 1  # past void commits too
        shards.coalesce(8).write.parquet(f"{self.root}/_manifests/{name}")
        self._put(f"_manifests/{name}.new", name)
        try:
            self._files.rename(self._path(f"{self.root}/_manifests/{name}.new"), self._path(f"{self.root}/_manifests/v{now:08d}.commit"), self._no_overwrite)
        except Py4JJavaError as e:
            self._fs.delete(self._path(f"{self.root}/_manifests/{name}.new"), False)
            raise Conflict(f"version {now}") from e
        return now

    def _write(self, df: DataFrame, level, **options) -> tuple[str, DataFrame]:
        """Writes shards under an intent; returns the folder and the shards."""
        folder = uuid.uuid4().hex
        self._put(f"_intents/{folder}", "")
        df.write.options(**options).parquet(f"{self.root}/data/{folder}")
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data/{folder}")  # lists the files, reads none
        path = F.concat(F.lit(f"data/{folder}/"), F.element_at(F.split("path", "/"), -1))
        return folder, found.select(path.alias("path"), F.col("length").alias("bytes"), F.lit(level).cast("int").alias("level"))

    def _settled(self, folder: str, drop: bool = False) -> None:
        if drop:
            self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)
        self._fs.delete(self._path(f"{self.root}/_intents/{folder}"), False)

    def append(self, df: DataFrame, rows_per_shard: int = 4000, tries: int = 5) -> int:
        """Adds df's rows as small shards; an empty df commits a version without new rows. Where another writer commits first, it commits again over that version."""
        folder, new = self._write(df, 0, maxRecordsPerFile=rows_per_shard)
        for left in range(tries - 1, -1, -1):
            over = self.version()
            try:
                now = self.commit(self.shards(over).union(new), over)
                self._settled(folder)
                return now
            except Conflict:
                if not left:
                    self._settled(folder, drop=True)
                    raise
        raise ValueError("tries must be positive")

    def _read(self, paths: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version. Spark's reader takes the paths of its files, about one for each target size."""
        return self._read([r[0] for r in self.shards(version).select("path").orderBy("path").collect()], schema)

    def compact(self, schema) -> int:
        """Merges tiers until none has FAN shards below the target (or merging no longer lowers their number)."""
        while True:
            over = self.version()
            shards = self.shards(over).withColumn("tier", F.when(F.col("bytes") < self.target / 2, F.floor(F.log(float(FAN), F.greatest("bytes", F.lit(1))))))
            tiers = shards.where("tier is not null").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("level").alias("level")).orderBy("tier").collect()
            ready = [t for t in tiers if t["n"] >= FAN and max(1, round(t["bytes"] / self.target)) < t["n"]]
            if not ready:
                return over
            tier = ready[0]
            own = [r[0] for r in shards.where(F.col("tier") == tier["tier"]).select("path").orderBy("path").limit(MERGE).collect()]
            files = max(1, round(tier["bytes"] * len(own) / tier["n"] / self.target))
            folder, made = self._write(self._read(own, schema).coalesce(files), tier["level"] + 1)
            merged = self.spark.createDataFrame([(p,) for p in own], "path string")
            try:
                self.commit(shards.drop("tier").join(F.broadcast(merged), "path", "left_anti").select("path", "bytes", "level").union(made), over)
                self._settled(folder)
            except Conflict:  # what came first is read anew
                self._settled(folder, drop=True)

    def vacuum(self) -> int:
        """Deletes data files that neither the last version nor a writer at work holds; returns how many. Readers of older versions lose them.

        Files are listed before intents and intents before the version: a writer whose file is in the list is then either
        still among the intents, or has committed.
        """
        held = [(folder, name) for folder, _, _ in self._names("data") for name, _, _ in self._names(f"data/{folder}") if name.endswith(".parquet")]
        intents = self._names("_intents")
        busy = {name for name, _, age in intents if age < self.abandoned}
        listed = self.spark.createDataFrame([(f"data/{folder}/{name}",) for folder, name in held if folder not in busy], "path string")
        gone = [r[0] for r in listed.join(self.shards().select("path"), "path", "left_anti").collect()]
        for path in gone:
            self._fs.delete(self._path(f"{self.root}/{path}"), False)
        for name, _, age in intents:
            if age >= self.abandoned:
                self._fs.delete(self._path(f"{self.root}/_intents/{name}"), False)
        return len(gone)


def compacted(docs: DataFrame, root: str, target_bytes: int = 64 << 20, rows_per_shard: int = 4000, arrivals: int = 4) -> DataFrame:
    """Appends docs to the store at root as several arrivals, compacts and drops what is superseded after each, and returns the committed rows.

    Arrivals are ranges of doc_id between its percentiles (null ids in the first; one arrival
    where ids are no numbers or all null). All columns are kept, whatever they are called,
    null ids, rows that repeat and empty texts included; an empty table leaves an empty version.
    """
    store, cuts = ShardStore(docs.sparkSession, root, target_bytes), []
    if dict(docs.dtypes).get("doc_id") in ("bigint", "int", "smallint", "double", "float"):
        cuts = sorted(set(docs.approxQuantile("doc_id", [k / arrivals for k in range(1, arrivals)], 0.01)))
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        above = F.lit(True) if low is None else F.col("doc_id") > low
        below = F.lit(True) if high is None else F.col("doc_id") <= high
        own = above & below | F.col("doc_id").isNull() if low is None and high is not None else above & below
        store.append(docs.where(own), rows_per_shard)
        store.compact(docs.schema)
        store.vacuum()
    return store.read(docs.schema)
