"""Stored records: history, translations, digests, analyses, registry, budgets."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillstream.operators import reads, store


def walked(clusters, told, key, limit=7):
    """The analysed entries of a story, by a walk."""
    out, seen, at = [], set(), key
    while at in clusters and at not in seen and len(out) < limit:
        seen.add(at)
        if at in told:
            out.append(at)
        at = clusters[at]
    return out[1:]


def test_history_is_the_walk(spark):
    rng = random.Random(5)
    clusters = {i: rng.choice([None, 999, *range(max(0, i - 4), min(60, i + 2))]) for i in range(60)}
    clusters |= {100 + i: 100 + i - 1 if i else None for i in range(40)}  # a long line, mostly without analyses
    clusters |= {200: 201, 201: 202, 202: 200, 203: 203, 204: 203, 210: 211, 211: 210}  # circles, with and without analyses
    told = {i for i in clusters if rng.random() < 0.5 and i < 100} | {100, 101, 102, 137, 139, 200, 202, 203}
    t = dt.datetime(2026, 1, 5)
    c = spark.createDataFrame([(k, p, f"H{k}", t + dt.timedelta(days=k)) for k, p in clusters.items()], "key long, parent_key long, headline string, last_seen timestamp")
    a = spark.createDataFrame([(k, None if k % 3 else f"said {k}", None if k % 2 else "what") for k in told], "cluster_key long, headline string, what_happened string")
    for limit in (7, 3, 1):
        rows = reads.history(c, a, limit).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.start, r.place)):
            got.setdefault(r.start, []).append(r)
        want = {k: w for k in clusters if (w := walked(clusters, told, k, limit))}
        assert {k: [int(r.headline.strip("Hsaid ")) for r in v] for k, v in got.items()} == want
        assert all([r.place for r in v] == list(range(1, len(v) + 1)) for v in got.values())
    assert {(r.headline, r.what_happened) for r in rows if r.headline in ("said 0", "H1")} <= {("said 0", "what"), ("H1", "")}
    assert reads.history(c.limit(0), a).count() == 0 and reads.history(c, a.limit(0)).count() == 0


DIGEST = "digest_date string, payload string, translations map<string,struct<editorial_note:string,items:map<string,string>,deep_dive:string>>"
RUN = "run int, digest_date string, lang string, editorial_note string, items map<string,string>, deep_dive string"


def test_partial_translations_merge(spark):
    digests = spark.createDataFrame([
        ("d1", "p", {"bg": ("note", {"a": "A", "b": "B"}, None), "de": ("x", {"a": "X"}, "y")}),
        ("d2", "p", None), ("d3", "p", {}),
    ], DIGEST)
    runs = spark.createDataFrame([
        (2, "d1", "bg", "", {"b": "B2", "c": "C2"}, "dive"), (1, "d1", "bg", "note 1", {"b": "B1", "d": "D1"}, "first dive"),
        (1, "d2", "bg", None, {"a": "A"}, None), (1, "d9", "bg", "n", {"a": "A"}, None), (3, "d1", "fr", "f", None, None),
    ], RUN)
    out, stored = store.merge_translations(digests, runs)
    got = {r.digest_date: r for r in out.collect()}
    assert got["d1"].translations["bg"].asDict() == {"editorial_note": "note 1", "items": {"a": "A", "b": "B2", "c": "C2", "d": "D1"}, "deep_dive": "dive"}
    assert got["d1"].translations["de"].asDict() == {"editorial_note": "x", "items": {"a": "X"}, "deep_dive": "y"} and got["d1"].payload == "p"
    assert got["d1"].translations["fr"].asDict() == {"editorial_note": "f", "items": {}, "deep_dive": None}
    assert got["d2"].translations["bg"].asDict() == {"editorial_note": None, "items": {"a": "A"}, "deep_dive": None} and got["d3"].translations == {}
    assert {(r.digest_date, r.lang): r.stored for r in stored.collect()} == {("d1", "bg"): True, ("d1", "fr"): True, ("d2", "bg"): True, ("d9", "bg"): False}
    again = store.merge_translations(out, runs)[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))  # twice changes nothing
    assert store.merge_translations(digests, runs.limit(0))[0].count() == 3


def test_complete_needs_note_and_dive(spark):
    t = lambda note, items, dive: {"bg": (note, items, dive)}
    rows = [
        ("all", "n", "dd", t("N", {"a": "A"}, "D"), True), ("no dive", "n", "dd", t("N", {"a": "A"}, None), False), ("no note", "n", None, t("", {"a": "A"}, None), False),
        ("none asked", "", None, t(None, {"a": "A"}, None), True), ("one left", "", None, t(None, {}, None), False),
    ]
    digests = spark.createDataFrame([r[:4] for r in rows], "digest_date string, editorial_note string, deep_dive string, translations map<string,struct<editorial_note:string,items:map<string,string>,deep_dive:string>>")
    items = spark.createDataFrame([(r[0], "a") for r in rows], "digest_date string, key string")
    assert {r.digest_date: r.complete for r in store.complete_in(digests, items).collect()} == {r[0]: r[4] for r in rows}


def test_digests_and_deep_dives(spark):
    schema = "digest_date string, editorial_note string, markdown_path string"
    old = spark.createDataFrame([("d1", "o", "old.md"), ("d2", "o", "old.md"), ("d3", "o", None)], schema)
    new = spark.createDataFrame([("d1", None, ""), ("d2", "n", "new.md"), ("d4", "n", None)], schema)
    assert {tuple(r) for r in store.save_digests(old, new).collect()} == {("d1", None, "old.md"), ("d2", "n", "new.md"), ("d3", "o", None), ("d4", "n", None)}
    schema = "digest_date string, cluster_key string, payload string"
    old = spark.createDataFrame([("d1", "a", "o"), ("d2", "b", "o")], schema)
    new = spark.createDataFrame([("d1", "z", "n"), ("d3", "c", "n"), ("d4", "?", "n")], schema)
    clusters = spark.createDataFrame([("a",), ("c",)], "key string")
    assert {tuple(r) for r in store.save_deep_dives(old, new, clusters).collect()} == {("d1", "a", "n"), ("d2", "b", "o"), ("d3", "c", "n")}


def test_analyses_and_registry(spark):
    schema = "cluster_key string, relevant boolean, significance double, net_direction int"
    clusters = spark.createDataFrame([("a",), ("b",)], "key string")
    old = store.analysis_rows(spark.createDataFrame([("a", True, 0.1, 1), ("gone", True, 0.2, 1)], schema), clusters.unionByName(spark.createDataFrame([("gone",)], "key string")))
    out = store.upsert_analyses(old, spark.createDataFrame([("a", False, 0.9, -1), ("b", True, 0.5, 0), ("?", True, 1.0, 2)], schema), clusters)
    assert {(r.cluster_key, r.democracy_significance, r.democracy_net) for r in out.collect()} == {("a", 0.0, -1), ("b", 0.5, 0), ("gone", 0.2, 1)}
    reg = spark.createDataFrame([("x", "X"), ("y", "Y")], "slug string, name string")
    merged, n = store.upsert_registry(reg.filter("slug = 'x'"), reg)
    assert n.first().inserted == 1 and merged.count() == 2
    assert store.upsert_registry(merged, reg)[1].first().inserted == 0


def test_budget_stops_the_run(spark, tmp_path):
    log = str(tmp_path / "calls")

    def client(row):
        with open(log, "a") as f:
            f.write(f"{row['k']}\n")
        return {"text": f"t{row['k']}", "tokens": None if row["k"] == 1 else 30}

    rows = spark.createDataFrame([(i, 40) for i in range(12)], "k int, guess int").repartition(4)
    done, left = store.enrich_within(rows, client, "text string, tokens int", 200, ["k"], F.col("guess"))
    asked = sorted(map(int, open(log).read().split()))
    # 5 rows by their estimates, which spend 160; then one more, with 10 left after it
    assert asked == list(range(6 + 1))[: len(asked)] and sum(40 if k == 1 else 30 for k in asked) <= 200 + 30
    assert sorted(r.k for r in done.collect()) == asked and sorted(r.k for r in left.collect()) == [k for k in range(12) if k not in asked]
    assert left.columns == rows.columns
    none, all_ = store.enrich_within(rows, client, "text string, tokens int", 0, ["k"], F.col("guess"))
    assert none.count() == 0 and all_.count() == 12 and len(open(log).read().split()) == len(asked)
    calls = spark.createDataFrame([(i % 7, i, 10 + i) for i in range(100)], "o int, i int, tokens int")
    want, before = set(), 0
    for o, i, t in sorted((i % 7, i, 10 + i) for i in range(100)):
        want |= {i} if before < 900 else set()
        before += t
    assert {r.i for r in store.within_budget(calls, 900, ["o"]).collect()} == want
    plan = store.within_budget(calls, 900, ["o"])._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(single) == 1 and "HashAggregate(keys=[_range" in lines[single[0] + 1]  # a row per range
