"""Stored tables that change by partitions, and runs that change several of them at once or not at all.

A table is partitioned by a column (a date), or by buckets of its key. A run stages the partitions that it touches in folders
of its own, `<table>/run=<id>/<column>=<value>/`; what others see is a manifest, which names for each partition the run that
holds it. A run ends by renaming its manifest into place under the next number: all its tables change in that instant. A run
that fails deletes what it staged, and the manifest stays. Two runs that began at the same number can't both end: the second
finds the number taken and fails. So a change writes what it touches, not the table, and readers, who resolve the manifest
once, keep seeing the files that it names until vacuum().

Files are Spark's own Parquet, read with partition discovery, so filters on the partition column prune what is opened. All
listing and renaming goes through Hadoop's file systems: any store with an atomic rename will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.operators.store import upsert

BUCKET = "bucket"


class Conflict(Exception):
    """Another run has ended since this one began."""


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Warehouse:
    """The tables below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.base}/_manifests"))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        place = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def version(self) -> int:
        return max((int(n[:-5]) for n in self._names(f"{self.base}/_manifests") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{table: {by, buckets, keys, schema, parts: {value: run}}} as of a version, the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.base}/_manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as the newest manifest, or that of a version, has it."""
        return self._resolved(name, self.manifest(version))

    def _resolved(self, name: str, manifest: dict, values: set[str] | None = None) -> DataFrame:
        entry = manifest[name]
        schema = T.StructType.fromJson(entry["schema"])
        stored = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        paths = [f"{self.base}/{name}/run={run}/{entry['by']}={value}" for value, run in entry["parts"].items() if values is None or value in values]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(stored).option("basePath", f"{self.base}/{name}").parquet(*paths).select(*schema.names)

    @contextmanager
    def run(self) -> Iterator[Run]:
        """A run over several tables: its changes are seen together when the block ends, and none of them if it fails."""
        it = Run(self)
        try:
            yield it
            it._commit()
        except BaseException:
            it._roll_back()
            raise

    def vacuum(self) -> int:
        """Delete the folders and manifests that the newest manifest doesn't need; how many folders. Readers that resolved an
        older one must have ended."""
        newest, gone = self.version(), 0
        manifest = self.manifest(newest)
        for name in self._names(self.base):
            if name.startswith("_"):
                continue
            used = set(manifest.get(name, {}).get("parts", {}).items())
            for run in self._names(f"{self.base}/{name}"):
                for part in self._names(f"{self.base}/{name}/{run}"):
                    if "=" in part and (part.split("=", 1)[1], run.removeprefix("run=")) not in used:
                        gone += self._fs.delete(self._path(f"{self.base}/{name}/{run}/{part}"), True)
        for old in self._names(f"{self.base}/_manifests"):
            if old != f"{newest:012d}.json":
                self._fs.delete(self._path(f"{self.base}/_manifests/{old}"), False)
        return gone


class Run:
    """What one run changes. Its own reads see its own changes."""

    def __init__(self, warehouse: Warehouse) -> None:
        self.warehouse, self.id = warehouse, uuid.uuid4().hex[:12]
        self.began = warehouse.version()
        self.tables = self._was = warehouse.manifest(self.began)
        self.counts: dict[str, dict[str, int]] = {}

    def read(self, name: str) -> DataFrame:
        return self.warehouse._resolved(name, self.tables)

    def replace(self, name: str, df: DataFrame, by: str) -> None:
        """The partitions of column `by` that df has rows of are replaced by these rows; others stay. A first call makes the
        table. All rows of a digest's date, for instance."""
        self._stage(name, df, by)

    def merge(self, name: str, new: DataFrame, keys: list[str], buckets: int = 64, how: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """Upsert new rows by key into a table of so many buckets; how many keys are new. Only the buckets that new rows fall
        into are read and written. how(old, new) merges them, upsert() by default; keys of new must be distinct."""
        entry = self.tables.get(name)
        buckets = entry["buckets"] if entry else buckets
        new = new.withColumn(BUCKET, bucket_of(keys, buckets))
        touched = {str(r[0]) for r in new.select(BUCKET).distinct().collect()}  # at most `buckets` rows
        old = self.warehouse._resolved(name, self.tables, touched) if entry else new.limit(0)
        known = old.select(*keys, F.lit(True).alias("_known"))
        merged = (how or (lambda o, n: upsert(o, n, keys)))(old.drop(BUCKET), new.drop(BUCKET)).join(known, keys, "left")
        seen = Observation(f"{name}-{self.id}-{uuid.uuid4().hex[:6]}")
        merged = merged.observe(seen, F.count_if(F.col("_known").isNull()).alias("inserted"), F.count(F.lit(1)).alias("written"))
        self._stage(name, merged.drop("_known").withColumn(BUCKET, bucket_of(keys, buckets)), BUCKET, buckets, keys)
        self.counts[name] = dict(seen.get) if touched else {"inserted": 0, "written": 0}
        return self.counts[name]["inserted"]

    def _stage(self, name: str, df: DataFrame, by: str, buckets: int | None = None, keys: list[str] | None = None) -> None:
        w = self.warehouse
        entry = self.tables.get(name)
        if entry and entry["by"] != by:
            raise ValueError(f"{name} is partitioned by {entry['by']}, not {by}")
        schema = T.StructType([*[f for f in df.schema if f.name != by], df.schema[by]])
        part = f"{self.id}-{uuid.uuid4().hex[:6]}"
        path = f"{w.base}/{name}/run={part}"
        df.select(*schema.names).repartition(by).write.partitionBy(by).parquet(path)
        made = [n.split("=", 1)[1] for n in w._names(path) if n.startswith(f"{by}=")]
        parts = {**(entry["parts"] if entry else {}), **dict.fromkeys(made, part)}
        self.tables = {**self.tables, name: {"by": by, "buckets": buckets, "keys": keys, "schema": json.loads(schema.json()), "parts": parts}}

    def _commit(self) -> None:
        if self.tables is self._was:  # nothing was changed
            return
        w, jvm = self.warehouse, self.warehouse.spark._jvm
        staged = w._path(f"{w.base}/_manifests/staged-{self.id}")
        out = w._fs.create(staged, True)
        try:
            out.write(bytearray(json.dumps(self.tables).encode()))
        finally:
            out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(w._fs.getUri(), w.spark._jsc.hadoopConfiguration())
        none = w.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # fails if the target exists
        try:
            files.rename(staged, w._path(f"{w.base}/_manifests/{self.began + 1:012d}.json"), none)
        except Exception as e:
            if w.version() > self.began:
                raise Conflict(f"a run has ended since version {self.began}") from e
            raise

    def _roll_back(self) -> None:
        w = self.warehouse
        w._fs.delete(w._path(f"{w.base}/_manifests/staged-{self.id}"), False)
        for name in w._names(w.base):
            for run in w._names(f"{w.base}/{name}"):
                if run.startswith(f"run={self.id}"):
                    w._fs.delete(w._path(f"{w.base}/{name}/{run}"), True)
