"""Sharding by size-tiered compaction with versioned manifests. DataFrame operations only."""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowmill.llm.common import fresh

#: Runs of a tier that are merged together, at least; a tier's runs are up to this many times larger than the last's.
FANOUT = 4
#: Bytes of a merged file, and of the smallest tier.
TARGET, SMALLEST = 128 << 20, 1 << 20
#: How often an append that lost its version to another writer is put on top of that writer's version.
TRIES = 20
MANIFEST = "run string, tier int, bytes long, files long, rows long, schema string"


class ShardStore:
    """Immutable Parquet files in where/data, in runs (folders); where/manifests/v=N.parquet lists the runs of version N.

    append() adds each arrival as a run of small files. compact() merges the runs of each tier that has fanout of them
    into one run of target-sized files, until no tier has. A version comes into being by one step that fails if its
    file is there: an exclusive rename, or on a local disk a hard link. So of two writers of a version one gets
    FileExistsError, and a job that failed before has changed nothing that readers see. The manifest has a row for each
    run, so it stays small; no list of files or rows comes to the driver.

    Arrivals may differ in their columns: a column that a run lacks is null there. A column whose type differs from that
    of a run in the latest version is an error. Names of columns and values of by may be anything."""

    def __init__(self, spark: SparkSession, where: str, target: int = TARGET, fanout: int = FANOUT, smallest: int = SMALLEST):
        self.spark, self.where, self.target, self.fanout, self.smallest = spark, where.rstrip("/"), target, fanout, smallest
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.where).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 if there is none."""
        at = self._path(f"{self.where}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[2:-8]) for n in names if n.startswith("v=") and n.endswith(".parquet")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.where}/manifests/v={version}.parquet")

    def commit(self, runs: DataFrame, version: int) -> None:
        """runs become version, or FileExistsError."""
        made = f"{self.where}/staged/{uuid.uuid4().hex}"
        runs.coalesce(1).write.parquet(made)
        part = next(s.getPath() for s in self._fs.listStatus(self._path(made)) if s.getPath().getName().startswith("part-"))
        self._fs.mkdirs(self._path(f"{self.where}/manifests"))
        try:
            self._publish(part, self._path(f"{self.where}/manifests/v={version}.parquet"))
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise
            raise FileExistsError(f"version {version} was committed by another writer") from None
        finally:
            self._fs.delete(self._path(made), True)

    def _publish(self, made, to) -> None:
        """made becomes to in one step, or FileAlreadyExistsException."""
        jvm = self.spark._jvm
        if self._fs.getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(to), local(made))
            return
        never = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(made, to, never)

    def _described(self, runs: list[str], schema: StructType) -> DataFrame:
        """A row for each run: its files, bytes and rows, its schema, and the tier of its size."""
        rows = self.spark.read.schema(StructType()).parquet(*(f"{self.where}/data/{r}" for r in runs))
        rows = rows.groupBy(F.regexp_extract(F.input_file_name(), "/([^/]+)/[^/]+$", 1).alias("run")).agg(F.count("*").alias("rows"))
        sizes = []
        for r in runs:
            held = self._fs.getContentSummary(self._path(f"{self.where}/data/{r}"))
            sizes.append((r, held.getLength(), sum(s.getPath().getName().startswith("part-") for s in self._fs.listStatus(self._path(f"{self.where}/data/{r}")))))
        tier = F.greatest(F.lit(0), F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)) / self.smallest) / math.log(self.fanout))).cast("int")
        out = self.spark.createDataFrame(sizes, "run string, bytes long, files long").join(rows, "run", "left")
        return out.select("run", tier.alias("tier"), "bytes", "files", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(schema.json()).alias("schema"))

    def _schema(self, runs: list) -> StructType:
        """All columns of the runs, by name; runs are rows of a manifest."""
        out: dict[str, object] = {}
        for text in dict.fromkeys(r["schema"] for r in runs):
            for f in StructType.fromJson(json.loads(text)).fields:
                known = out.setdefault(f.name, f)
                if known.dataType != f.dataType:
                    raise ValueError(f"column {f.name} is {known.dataType.simpleString()} in one run and {f.dataType.simpleString()} in another")
        return StructType(list(out.values()))

    def append(self, arrivals: DataFrame, by: str | None = None) -> int:
        """Adds the rows of arrivals; with by, each of its values (null is one) is an arrival and a run of its own, and the
        column itself is not kept. Returns the new version; without rows, the old one. If another writer commits first,
        the append goes on top of that version."""
        name, kept = uuid.uuid4().hex[:12], [c for c in arrivals.columns if c != by]
        made, (run,) = f"{self.where}/staged/{name}", fresh(arrivals.columns, "run")
        of = F.lit("0") if by is None else F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")), 256), 1, 20)
        rows = arrivals.select(*[F.col(f"`{c}`") for c in kept], of.alias(run))
        schema = rows.drop(run).schema
        self._schema([*self.manifest().select("schema").distinct().collect(), {"schema": schema.json()}])
        rows.write.partitionBy(run).parquet(made)
        runs = []
        self._fs.mkdirs(self._path(f"{self.where}/data"))
        for s in self._fs.listStatus(self._path(made)):
            if s.isDirectory() and s.getPath().getName().startswith(f"{run}="):
                runs.append(f"{name}-{s.getPath().getName()[len(run) + 1 :]}")
                self._fs.rename(s.getPath(), self._path(f"{self.where}/data/{runs[-1]}"))
        self._fs.delete(self._path(made), True)
        if not runs:
            return self.version()
        new = self._described(runs, schema)
        for left in range(TRIES - 1, -1, -1):
            old = self.version()
            self._schema([*self.manifest(old).select("schema").distinct().collect(), {"schema": schema.json()}])
            try:
                self.commit(self.manifest(old).unionByName(new), old + 1)
                return old + 1
            except FileExistsError:
                if not left:
                    raise

    def compact(self) -> int:
        """Merges until no tier has fanout runs. Returns the version. FileExistsError if another writer commits meanwhile:
        what was merged is not listed then, and vacuum() deletes it."""
        while True:
            old = self.version()
            runs = self.manifest(old).collect()  # a row for each run
            tiers = {r["tier"]: [x for x in runs if x["tier"] == r["tier"]] for r in runs}
            full = [same for _, same in sorted(tiers.items()) if len(same) >= self.fanout]
            if not full:
                return old
            listed = self.manifest(old).where(~F.col("run").isin([r["run"] for same in full for r in same]))
            for same in full:
                listed = listed.unionByName(self._described([self._merge(same)], self._schema(same)))
            self.commit(listed, old + 1)

    def _merge(self, runs: list) -> str:
        """The files of runs, read in splits of target bytes and written as one file each: no shuffle. The session is
        another one, so that the caller's split size stays."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        name = f"{uuid.uuid4().hex[:12]}-m"
        self._rows(session, runs).write.parquet(f"{self.where}/data/{name}")
        return name

    def _rows(self, session: SparkSession, runs: list) -> DataFrame:
        return session.read.schema(self._schema(runs)).parquet(*(f"{self.where}/data/{r['run']}" for r in runs))

    def vacuum(self, older_than_s: float = 86_400) -> None:
        """Deletes runs that the latest version does not list, and what appends and commits left unfinished, if it is older
        than so many seconds: younger ones may belong to a writer that has not committed yet. Readers of older versions
        must have ended."""
        listed, now = {r["run"] for r in self.manifest().select("run").collect()}, time.time()
        for folder in ("data", "staged"):
            at = self._path(f"{self.where}/{folder}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if s.getPath().getName() not in listed and now - s.getModificationTime() / 1000 >= older_than_s:
                    self._fs.delete(s.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the columns of all its runs."""
        runs = self.manifest(version).collect()
        if not runs:
            raise ValueError("the store is empty")
        return self._rows(self.spark, runs)
