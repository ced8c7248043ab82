"""State of streams: restarts, expiry, late rows."""

import datetime as dt
import time

import pytest
from quillstream.streaming import ingest, state

T0 = dt.datetime(2026, 1, 1)
ARTICLE = "url string, published_at timestamp, fetched_at timestamp"
MEMBER = "key string, event_ts timestamp"


def test_late_articles_are_a_stream_of_their_own(spark):
    rows = [("a", T0, T0), ("b", T0 - dt.timedelta(hours=31), T0), ("c", None, T0), ("d", T0 - dt.timedelta(hours=30), T0)]
    on_time, late = state.split_late(spark.createDataFrame(rows, ARTICLE))
    assert sorted(r.url for r in on_time.collect()) == ["a", "c", "d"] and [r.url for r in late.collect()] == ["b"]


@pytest.fixture(autouse=True)
def one_partition(spark):
    """A state store and a worker per partition and batch: one will do."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    yield
    spark.conf.set(key, before)


def feed(spark, tmp_path, schema):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run(change):
        """A query from the checkpoint that takes what is there and stops: each call is a restart."""
        ingest.run_available(change(spark.readStream.schema(schema).parquet(src)), out, ck).awaitTermination(180)
        return spark.read.parquet(out)

    return add, run


def test_known_urls_survive_a_restart_and_expire(spark, tmp_path):
    add, run = feed(spark, tmp_path, ARTICLE)
    add([("u", T0, T0), ("u", T0, T0 - dt.timedelta(hours=1)), ("v", None, T0), (None, T0, T0)])
    new = lambda s: state.new_articles(s, days=4)
    assert {(r.url, r.fetched_at) for r in run(new).collect()} == {("u", T0 - dt.timedelta(hours=1)), ("v", T0), (None, T0)}
    add([("u", T0, T0), ("w", T0, T0), (None, T0, T0)])
    assert sorted(str(r.url) for r in run(new).collect()) == ["None", "u", "v", "w"]
    assert run(new).count() == 4  # nothing new


def test_known_urls_expire(spark, tmp_path):
    add, run = feed(spark, tmp_path, ARTICLE)
    short = lambda s: state.new_articles(s, days=2 / 86_400)
    add([("u", T0, T0)])
    run(short)
    time.sleep(2.5)
    add([("u", T0, T0)])
    assert run(short).count() == 2


def test_running_stories_are_the_batch_plan(spark, tmp_path):
    add, run = feed(spark, tmp_path, MEMBER)
    day = lambda d, h=0: T0 + dt.timedelta(days=d, hours=h)
    batches = [[("s", day(0)), ("s", day(0, 5)), ("t", day(0))], [("s", day(2)), ("u", day(9)), ("x", None)], [("s", day(10)), ("u", day(10))]]
    for rows in batches:
        add(rows)
        out = run(state.running_stories)
    got = {(r.key, r.first_seen, r.last_seen, r.articles, r.status) for r in out.collect()}
    assert {x for x in got if x[4] != "ended"} == {
        ("s", day(0), day(0, 5), 2, "new"), ("t", day(0), day(0), 1, "new"), ("s", day(0), day(2), 3, "running"), ("u", day(9), day(9), 1, "new"),
        ("s", day(10), day(10), 1, "new"), ("u", day(9), day(10), 2, "running"),
    }
    # each story that ended, by a batch plan: members of one key with gaps of under four days
    ended = {x for x in got if x[4] == "ended"}
    assert {("s", day(0), day(2), 3, "ended"), ("t", day(0), day(0), 1, "ended")} <= ended
    members = sorted((k, t) for b in batches for k, t in b if t)
    sessions = []
    for k, t in members:
        if sessions and sessions[-1][0] == k and t - sessions[-1][2] < dt.timedelta(days=4):
            sessions[-1] = (k, sessions[-1][1], t, sessions[-1][3] + 1)
        else:
            sessions.append((k, t, t, 1))
    assert {x[:4] for x in ended} <= set(sessions)
