"""Runs over stored tables: commit, rollback, conflict, pruned reads, writes that grow with the change."""

import os

import pytest
from pyspark.sql import functions as F

from quillstream.operators import store, warehouse


def stored(path):
    return {os.path.relpath(os.path.join(d, f), path): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def customers(spark, ids, name="n"):
    return spark.createDataFrame([(i, f"{name}{i}", i * 1.5) for i in ids], "k long, name string, v double")


def test_run_changes_all_tables_or_none(spark, tmp_path):
    w = warehouse.Warehouse(spark, str(tmp_path / "w"))
    with w.run() as r:
        assert r.merge("clusters", customers(spark, range(40)), ["k"], buckets=8) == 40
        r.replace("items", spark.createDataFrame([("2026-01-01", 1), ("2026-01-01", 2), ("2026-01-02", 3)], "digest_date string, k long"), "digest_date")
    before = stored(tmp_path)
    with pytest.raises(RuntimeError, match="between"):
        with w.run() as r:
            assert r.merge("clusters", customers(spark, [1, 99], "new"), ["k"]) == 1
            assert r.read("clusters").filter("k = 99").count() == 1  # its own reads see it
            assert w.read("clusters").filter("k = 99").count() == 0  # others don't
            raise RuntimeError("between two sinks")
    assert stored(tmp_path) == before and w.version() == 1
    assert w.read("clusters").count() == 40 and w.read("clusters").filter("name like 'new%'").isEmpty()
    with w.run() as r:
        assert r.merge("clusters", customers(spark, [1, 99], "new"), ["k"]) == 1
        r.replace("items", spark.createDataFrame([("2026-01-02", 7)], "digest_date string, k long"), "digest_date")
    assert {(x.k, x.name) for x in w.read("clusters").filter("k in (1, 2, 99)").collect()} == {(1, "new1"), (2, "n2"), (99, "new99")}
    assert sorted((x.digest_date, x.k) for x in w.read("items").collect()) == [("2026-01-01", 1), ("2026-01-01", 2), ("2026-01-02", 7)]
    assert w.read("items", version=1).count() == 3  # a reader of the version before


def test_writes_grow_with_the_change(spark, tmp_path):
    w = warehouse.Warehouse(spark, str(tmp_path / "w"))
    with w.run() as r:
        r.merge("big", customers(spark, range(20_000)), ["k"], buckets=64)
    whole = sum(stored(tmp_path).values())
    with w.run() as r:
        assert r.merge("big", customers(spark, [5], "x"), ["k"]) == 0
        assert r.counts["big"]["written"] < 20_000 / 30
    assert sum(stored(tmp_path).values()) - whole < whole / 20
    assert w.read("big").count() == 20_000 and w.read("big").filter("k = 5").first().name == "x5"
    gone = w.vacuum()
    assert gone == 1 and w.read("big").count() == 20_000 and w.manifest().keys() == {"big"}


def test_reads_are_pruned(spark, tmp_path):
    w = warehouse.Warehouse(spark, str(tmp_path / "w"))
    days = spark.range(60).select(F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("digest_date"), F.col("id").alias("k"))
    with w.run() as r:
        r.replace("items", days.unionByName(spark.createDataFrame([(None, 1000)], "digest_date date, k long")), "digest_date")
        r.merge("keyed", customers(spark, range(200)), ["k"], buckets=16)
    one = w.read("items").filter(F.col("digest_date") == F.lit("2026-01-05").cast("date"))
    assert "PartitionFilters: [isnotnull(digest_date" in one._jdf.queryExecution().toString() and len(one.inputFiles()) == len(w.read("items").inputFiles()) == 61
    assert one.select(F.input_file_name()).distinct().count() == 1 and one.first().k == 4
    assert w.read("items").filter("digest_date is null").first().k == 1000
    point = w.read("keyed").filter((F.col("k") == 7) & (F.col(warehouse.BUCKET) == warehouse.bucket_of(["k"], 16)))
    assert point.first().name == "n7"


def test_runs_that_cross_conflict(spark, tmp_path):
    w = warehouse.Warehouse(spark, str(tmp_path / "w"))
    with w.run() as r:
        r.merge("t", customers(spark, [1]), ["k"], buckets=2)
    first = warehouse.Run(w)
    with pytest.raises(warehouse.Conflict):
        with w.run() as r:
            r.merge("t", customers(spark, [2]), ["k"])
            first.merge("t", customers(spark, [3]), ["k"])
            first._commit()
    assert sorted(x.k for x in w.read("t").collect()) == [1, 3] and w.version() == 2


def test_merges_of_records(spark, tmp_path):
    """The library's own merges run inside a run."""
    w = warehouse.Warehouse(spark, str(tmp_path / "w"))
    a = lambda rows: spark.createDataFrame(rows, "url string, title string, body string")
    fill = lambda o, n: store.upsert(o, n, ["url"], keep=["title"], fill=["body"])
    with w.run() as r:
        assert r.merge("articles", a([("u", "T", None), ("v", "V", "old")]), ["url"], 4, fill) == 2
    with w.run() as r:
        assert r.merge("articles", a([("u", "other", "now"), ("v", "other", "now"), ("z", "Z", "z")]), ["url"], how=fill) == 1
        assert r.merge("articles", a([]), ["url"], how=fill) == 0
    assert {(x.url, x.title, x.body) for x in w.read("articles").collect()} == {("u", "T", "now"), ("v", "V", "old"), ("z", "Z", "z")}
