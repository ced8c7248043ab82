"""Session defaults. Every function of the package works on any session with UTC time and ANSI-compatible settings."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(app: str = "quillstream", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, adaptive execution and skew-join handling; a local master unless one is configured."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{n}]")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, which may not have it on their path. Once a session."""
    if spark.conf.get("quillstream.shipped", None) == spark.sparkContext.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillstream-")  # read by the driver, which serves it
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "quillstream"), "zip", os.path.dirname(here), os.path.basename(here)))
    spark.conf.set("quillstream.shipped", spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table, read by Spark so that any store it reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
