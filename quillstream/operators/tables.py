"""Intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a temporary one and any other an error:
    its executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quillstream-"))
    return _LOCAL[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """written(df), and metrics (aggregates) that its own write has counted: `.get` has them, without another job."""
    seen = Observation(f"{name}-{uuid.uuid4().hex[:12]}")
    return written(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name), seen
