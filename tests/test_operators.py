import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.operators import neardup, routing, selection, store, stories
from quillstream.sources import feeds

VOCAB = {"civic": ["parliament", "vote"], "foreign": ["ukraine", "nato"], "tech": ["chip", "model"], "domestic": ["sofia", "bulgaria"]}


def route(spark, text, lang="en", allowed=None):
    df = spark.createDataFrame([(text, lang, allowed)], "t string, lang string, allowed array<string>")
    return routing.classify(df, F.col("t"), F.col("lang"), F.col("allowed"), VOCAB).first()["category"]


def test_routing(spark):
    assert route(spark, "parliament in sofia votes") == "bg_politics"
    assert route(spark, "parliament debates", "bg") == "bg_politics"
    assert route(spark, "parliament on ukraine", "bg", ["bg_politics"]) == "global_politics"
    assert route(spark, "a new chip model", "en", ["bg_politics"]) == "ai_tech_business"
    assert route(spark, "a chip", "en", ["bg_politics"]) is None
    assert route(spark, "football tonight") is None
    assert route(spark, "") is None


def test_noise(spark):
    df = spark.createDataFrame([("http://x/Sport/1", "A"), ("http://x/1", "Weather today"), ("http://x/1", "Vote")], "u string, t string")
    assert [r.n for r in df.select(routing.is_noise(F.col("u"), F.col("t"), ["/sport"], ["weather"]).alias("n")).collect()] == [True, True, False]


def test_lookback_keeps_undated(spark):
    now = dt.datetime(2026, 1, 2)
    df = spark.createDataFrame([(1, None), (2, now - dt.timedelta(hours=31)), (3, now)], "i int, p timestamp")
    assert {r.i for r in routing.lookback(df, "p", F.lit(now)).collect()} == {1, 3}


def test_per_source_cap(spark):
    df = spark.createDataFrame([("a", i, i % 2 == 0) for i in range(10)], "s string, o int, v boolean")
    assert [r.o for r in routing.per_source_cap(df, "s", "o", F.col("v"), 3).orderBy("o").collect()] == [0, 2, 4]


def test_near_duplicates_per_source(spark):
    df = spark.createDataFrame([("a", 1, "one two three"), ("a", 2, "one two three"), ("b", 3, "one two three"), ("a", 4, ""), ("a", 5, "")], "s string, o int, t string")
    out = neardup.drop_near_duplicates(df.withColumn("h", stories.simhash("t")), "s", "o", "h")
    assert sorted(r.o for r in out.collect()) == [1, 3, 4]


def test_simhash_locality():
    a, b, c = (stories.simhash_of(t) & (2**64 - 1) for t in ("government presents budget plan today", "government presents budget plan", "football team wins match again"))
    assert (a ^ b).bit_count() < (a ^ c).bit_count()


def test_jaccard_edges_equal_brute_force(spark):
    import random

    random.seed(4)
    rows = [(i, [f"w{random.randrange(12)}" for _ in range(random.randrange(0, 8))]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, s array<string>")
    for least in (0.35, 0.6, 1.0):
        got = {(r.a, r.b) for r in stories.jaccard_edges(df, "k", "s", least).collect()}
        sets = {k: set(s) for k, s in rows}
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert got == want


def test_tfidf_of_one_document(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "k int, w array<string>")
    assert {r.term for r in stories.tfidf(df, "k", "w").collect()} == {"a", "b", "a b"}
    assert stories.cosine_edges(stories.tfidf(df, "k", "w")).count() == 0


def test_components_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a int, b int")
    assert {(r.node, r.root) for r in stories.components(e).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100), (101, 100)}


def test_routing_searches_a_text_once(spark):
    df = spark.createDataFrame([("a", "en", None)], "t string, lang string, allowed array<string>")
    for out in (routing.classify(df, F.lower("t"), F.col("lang"), F.col("allowed"), VOCAB), routing.classify(df, F.lower("t"), F.col("lang"), F.col("allowed"), VOCAB).filter("category is not null")):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 4


def test_forward_pass_is_not_closure(spark):
    import random

    rng = random.Random(3)
    cases = [(3, {(0, 2), (1, 2)}), (40, {(i, j) for i in range(40) for j in range(i) if rng.random() < 0.05})]
    for n, linked in cases:
        both = linked | {(b, a) for a, b in linked}
        want, taken = {}, set()
        for i in range(n):  # the pass as it is defined
            if i in taken:
                continue
            group = [i]
            for j in range(i + 1, n):
                if j not in taken and any((m, j) in both for m in group):
                    group.append(j)
            taken |= set(group)
            want |= {j: i for j in group}
        got = {r.node: r.root for r in stories.forward_groups(spark.createDataFrame(sorted(linked), "a int, b int")).collect()}
        assert all(got.get(k, k) == want[k] for k in range(n))


def told(spark, rows):
    return spark.createDataFrame([(c, k, t, s, f"http://{w}/{k}", w, 1.0, None) for k, (c, t, s, w) in enumerate(rows)], "category string, ordinal long, title string, summary string, url string, source_slug string, weight double, published_at timestamp")


def test_cluster_articles(spark):
    rows = [("p", "Parliament passes budget law today", None, "a"), ("p", "MPs say parliament passes budget law", None, "b"), ("p", "Football team wins national cup", None, "c"), ("q", "Parliament passes budget law today", None, "d"), ("p", "", "", "e"), ("p", None, None, "f")]
    got = {r.ordinal: r.root for r in stories.cluster_articles(told(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}
    assert stories.cluster_articles(told(spark, rows).limit(0)).count() == 0


def test_clusters_are_brute_force(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(6)
    word = lambda: f"word{rng.randrange(40)}"
    rows = [("p", " ".join(word() for _ in range(rng.randint(2, 6))), " ".join(word() for _ in range(rng.randint(0, 6))), "s") for _ in range(60)]
    docs = [f"{t} {s}".split() for _, t, s, _ in rows]
    distinct = {(tuple(t.split()), tuple(d)) for (_, t, _, _), d in zip(rows, docs)}
    terms = lambda d: Counter([*d, *(f"{x} {y}" for x, y in zip(d, d[1:]))])
    df = Counter(x for _, d in distinct for x in terms(list(d)))
    v = [{x: (1 + math.log(c)) * (math.log((1 + len(distinct)) / (1 + df[x])) + 1) for x, c in terms(d).items()} for d in docs]
    norm = [math.sqrt(sum(w * w for w in x.values())) for x in v]

    def same(i, j):
        a, b = set(rows[i][1].split()), set(rows[j][1].split())
        share = len(a & b) / min(len(a), len(b)) if len(a & b) >= 3 else 0
        return share >= 0.5 or sum(w * v[j].get(x, 0) for x, w in v[i].items()) / norm[i] / norm[j] >= 0.42

    want, n = {}, len(rows)
    for i in range(n):
        if i not in want:
            group = [i]
            for j in range(i + 1, n):
                if j not in want and any(same(k, j) for k in group):
                    group.append(j)
            want |= {j: i for j in group}
    assert 1 < len(set(want.values())) < n
    assert {r.ordinal: r.root for r in stories.cluster_articles(told(spark, rows)).collect()} == want


def test_merge_across_languages(spark):
    rows = [("p", "zelenski visits sofia for talks", "", "a"), ("p", "zelenski visits sofia for talks", "", "b"), ("p", "zelenskij besucht sofia fur talks", "", "c"), ("p", "volcano erupts near iceland town", "", "d"), ("p", "quantum chip maker lists shares", "", "e")]
    members, found = stories.cluster_by_category(told(spark, rows), lambda t: F.lower(t))
    sizes = sorted(r.article_count for r in found.collect())
    assert sizes == [1, 1, 3]
    big = found.filter("article_count = 3").first()
    assert (big.headline, big.source_count) == ("zelenski visits sofia for talks", 3) and members.filter(F.col("root") == big.root).count() == 3
    # the key is that of the urls before the merge
    assert big.key == spark.range(1).select(F.substring(F.sha2(F.lit("http://a/0|http://b/1"), 256), 1, 32)).first()[0]
    assert stories.cluster_by_category(told(spark, rows[3:]), lambda t: F.lower(t))[1].count() == 2


def test_story_rows(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(1, "short", "u1", "s1", 1.0, 0, t), (1, "much longer", "u2", "s2", 1.0, 1, None)], "root int, title string, url string, source_slug string, weight double, ordinal int, published_at timestamp")
    r = stories.story_rows(df).first()
    assert (r.headline, r.article_count, r.source_count, r.first_seen) == ("much longer", 2, 2, t)


def test_lineage_stops_at_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None), ("e", "d")], "key string, parent_key string")
    got = {(r.start, r.ancestor, r.depth) for r in stories.lineage(df, 10).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "a", 2), ("c", "a", 1), ("c", "b", 2), ("e", "d", 1)}


def greedy(rows, used, picks=3, crowding=0.07):
    """The picks of one category as they are defined; used grows."""
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    names = {r[0]: {e.lower() for e in (r[2] or [])[:3]} for r in order}
    out = []
    for key, total, _ in order:
        if len(out) == picks:
            break
        n = len(names[key] & used)
        if n and len(order) > picks + 1 and any(k not in out and k != key and not names[k] & used and t > total - crowding * n for k, t, _ in order):
            continue
        out.append(key)
        used |= names[key]
    return out


def test_select_top_is_the_greedy_pass(spark):
    import random

    rng = random.Random(5)
    rows = [(d, c, f"{c}{i:02d}", round(rng.random(), 2), rng.sample(["A", "b", "C", "d", "E", "f", "g"], rng.randint(0, 4)) or None) for d in range(12) for c in "pqr" for i in range(rng.randint(0, 16))]
    rows += [(99, "p", "zz", 0.79, [])] + [(99, "p", f"{i:02d}", 0.8, ["x"]) for i in range(12)] + [(99, "q", "only", 0.1, None)]
    rows.append((99, "p", "aa", 0.95, ["X"]))
    df = spark.createDataFrame(rows, "digest_date int, category string, key string, total double, entities array<string>")
    got = {}
    for r in selection.select_top(df, ["p", "q", "r"]).orderBy("rank").collect():
        got.setdefault((r.digest_date, r.category), []).append(r.key)
    for d in {r[0] for r in rows}:
        used = set()
        for c in "pqr":
            assert got.get((d, c), []) == greedy([(k, t, e) for dd, cc, k, t, e in rows if (dd, cc) == (d, c)], used)
    assert got[99, "p"] == ["aa", "zz", "00"] or got[99, "p"][:2] == ["aa", "zz"]  # twelve crowded ones are passed over
    short = {(r.digest_date, r.category): r.picks for r in selection.underfilled(selection.select_top(df, ["p", "q", "r"]), ["p", "q", "r"]).collect()}
    assert short[99, "q"] == 1 and short[99, "r"] == 0


def test_select_top(spark):
    rows = [(1, c, f"{c}{i}", i / 10, [f"{c}{i}"]) for c in ("p", "q", "r") for i in range(5)]
    df = spark.createDataFrame(rows, "digest_date int, category string, key string, total double, entities array<string>")
    got = selection.select_top(df, ["p", "q", "r"]).collect()
    assert sorted((r.category, r["rank"]) for r in got) == [(c, k) for c in "pqr" for k in (1, 2, 3)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", ""), (2, "b", "x")], "k int, v string, body string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "k int, v string, body string")
    once = store.upsert(old, new, ["k"], fill=["body"])
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "a", ""), (2, None, "x"), (3, "c", None)]
    assert sorted(map(tuple, store.upsert(once, new, ["k"], fill=["body"]).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_items_maps_lists(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "digest_date int, item string")
    new = spark.createDataFrame([(2, "c")], "digest_date int, item string")
    assert sorted(map(tuple, store.replace_items(old, new).collect())) == [(1, "a"), (2, "c")]
    assert store.append_once(old, new.union(old)).count() == 1
    m = spark.range(1).select(store.merge_maps(F.expr("map('a',1,'b',2)"), F.expr("map('b',3)")).alias("m")).first()["m"]
    assert m == {"a": 1, "b": 3}
    zip_ = lambda o, t: spark.range(1).select(store.restore_list(F.expr(o), F.expr(t), lambda x, y: F.concat(x, y)).alias("l")).first()["l"]
    assert zip_("array('a','b')", "array('x','y','z')") == ["ax", "by"] and zip_("array('a','b')", "array('x')") == ["a", "b"]


def test_contract(spark):
    schema = T.StructType.fromDDL("direction int, inner struct<a:int>")
    df = spark.createDataFrame([('{"direction": 1, "inner": {"a": 1}}',), ('{"direction": 7, "inner": {}}',), ('{"direction": 1, "inner": {"b": 1}, "x": 2}',), ("nope",)], "j string")
    got = store.parse_contract(df, "j", schema, lambda p: [store.bounded("direction", p["direction"], -2, 2)]).collect()
    assert [r.violations for r in got] == [[], ["direction: outside -2 to 2"], ["unknown field x", "unknown field inner.b"], ["malformed"]]
    assert got[0].record.direction == 1 and got[1].record is None


def test_enrich_isolates_failures(spark):
    def client(row):
        if row["k"] == 2:
            raise ValueError("no")
        return {"y": f"ok{row['k']}"}

    got = {r.k: (r.y, r.error) for r in store.enrich(spark.createDataFrame([(1,), (2,)], "k long"), client, "y string").collect()}
    assert got == {1: ("ok1", None), 2: (None, "ValueError: no")}


def test_feed_and_pages(spark, tmp_path):
    p = tmp_path / "f.xml"
    p.write_text("<rss><channel><item><title> T </title><link>http://a/1</link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Thu, 01 Jan 2026 09:00:00 GMT</pubDate></item><item><title></title><link>http://a/2</link></item></channel></rss>")
    rows = feeds.read_feed(spark, str(p), "s").collect()
    assert [(r.url, r.title, r.summary, r.published_at) for r in rows] == [("http://a/1", "T", "Hi", dt.datetime(2026, 1, 1, 9))]
    pages = spark.createDataFrame([("u", "<p>x</p>"), ("u", "<p>x</p>"), ("v", "<nav>x</nav>")], "url string, html string")
    assert [r.body for r in feeds.pages_text(pages).collect()] == ["x"]
    cache = pages.select(F.lit("none").alias("url_hash"))
    assert feeds.to_fetch(pages, cache).count() == 2


def test_render(spark):
    df = spark.createDataFrame([("2026-01-01", "bg_politics", 2, "B", "why"), ("2026-01-01", "bg_politics", 1, "A", "why")], "digest_date string, category string, rank int, headline string, explanation string")
    note = feeds.render_digest(df).first()["note"]
    assert "## bg politics" in note and note.index("**A**") < note.index("**B**")


def test_streaming_dedup(spark, tmp_path):
    from quillstream.streaming import ingest

    t = dt.datetime(2026, 1, 1)
    src = str(tmp_path / "in")
    spark.createDataFrame([("u", t, t), ("u", t, t), ("v", None, t)], "url string, published_at timestamp, fetched_at timestamp").write.parquet(src)
    stream = spark.readStream.schema("url string, published_at timestamp, fetched_at timestamp").parquet(src)
    ingest.run_available(ingest.distinct_articles(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_streaming_days_by_batch(spark, tmp_path):
    from quillstream.streaming import ingest

    t = dt.datetime(2026, 1, 1, 12)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "source_slug string, event_ts timestamp"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: ingest.batches_available(ingest.daily_counts(spark.readStream.schema(schema).parquet(src), "source_slug"), out, str(tmp_path / "ck"), lambda d: d.filter("n > 0")).awaitTermination(120)
    add([("a", t), ("a", t), ("b", t)])
    run()
    add([("a", t + dt.timedelta(days=5)), ("a", t - dt.timedelta(hours=1))])
    run()
    run()  # nothing new: nothing changes
    got = spark.read.parquet(out).groupBy("source_slug", "day").agg(F.max("n").alias("n")).collect()
    assert {(r.source_slug, r.day.day, r.n) for r in got} == {("a", 1, 3), ("b", 1, 1), ("a", 6, 1)}


def test_atom_links(spark, tmp_path):
    p = tmp_path / "a.xml"
    p.write_text("<feed><entry><title>One</title><link rel='self' href='http://x/self'/><link href='http://x/1'/><summary>s</summary><author><name>N</name></author><updated>2026-01-02T03:04:05Z</updated></entry><entry><title>No link</title></entry></feed>")
    q = tmp_path / "r.xml"
    q.write_text("<rss><channel><item><title>Two</title><link>http://y/2</link><pubDate>Fri, 02 Jan 2026 03:04:05 GMT</pubDate></item></channel></rss>")
    got = feeds.read_feeds(spark, [{"slug": "y", "path": str(q)}, {"slug": "off", "path": "none", "enabled": False}, {"slug": "x", "path": str(p), "row_tag": "entry", "lang": "en"}]).orderBy("source_ord", "entry_ord").collect()
    assert [(r.source_slug, r.url, r.title, r.author, str(r.published_at)) for r in got] == [("y", "http://y/2", "Two", None, "2026-01-02 03:04:05"), ("x", "http://x/1", "One", "N", "2026-01-02 03:04:05")]


def test_page_cache_keeps_failures(spark):
    cache = spark.createDataFrame([("h", "old")], "url_hash string, body string")
    new = feeds.cached(cache, spark.createDataFrame([("http://a", "text"), ("http://b", None)], "url string, body string"))
    urls = spark.createDataFrame([("http://a",), ("http://b",), ("http://b",), ("http://c",)], "url string")
    assert new.count() == 3 and [r.url for r in feeds.to_fetch(urls, new).collect()] == ["http://c"]
    assert [(r.url, r.body) for r in feeds.bodies(urls, new, 3).collect()] == [("http://a", "tex")]


def test_feedback_signals(spark):
    import pytest

    old = spark.createDataFrame([("more", "t")], "signal string, tag string")
    assert store.add_feedback(old, old).count() == 2
    with pytest.raises(Exception, match="unknown signal"):
        store.add_feedback(old, spark.createDataFrame([("loud", "t")], "signal string, tag string")).collect()


def test_refusals_are_not_retried(spark, tmp_path):
    log = str(tmp_path / "calls")

    def client(row):
        with open(log, "a") as f:
            f.write("x")
        raise store.Refused("no") if row["k"] == 1 else ValueError("again")

    out = store.enrich(spark.createDataFrame([(1,)], "k int"), client, "v string").collect()
    assert "Refused" in out[0].error and len(open(log).read()) == 1
    store.enrich(spark.createDataFrame([(2,)], "k int"), client, "v string").collect()
    assert len(open(log).read()) == 4
    calls = spark.createDataFrame([(i, 40) for i in range(5)], "i int, tokens int")
    assert sorted(r.i for r in store.within_budget(calls, 100, ["i"]).collect()) == [0, 1, 2]


def test_reads(spark):
    from quillstream.operators import reads

    t = dt.datetime(2026, 1, 5)
    c = spark.createDataFrame([("a", "p", "A", t), ("b", "p", "B", t - dt.timedelta(days=5))], "key string, category string, headline string, last_seen timestamp")
    assert [r.key for r in reads.recent_keys(c, F.lit(t)).collect()] == ["a"] and reads.clusters_since(c, "p", F.lit(t)).count() == 1
    c = spark.createDataFrame([("x", "a", "X", t), ("a", None, "A", t)], "key string, parent_key string, headline string, last_seen timestamp")
    an = spark.createDataFrame([("a", None, None), ("x", "said", "what")], "cluster_key string, headline string, what_happened string")
    assert [tuple(r) for r in reads.history(c, an).collect()] == [("x", 1, t.date(), "A", "")]
    d = spark.createDataFrame([("2026-01-01", "k", "en")], "digest_date string, key string, analysis string")
    tr = spark.createDataFrame([("2026-01-01", "k", "bg", "бг")], "digest_date string, key string, lang string, analysis string")
    assert [reads.translated(d, tr, x).first().analysis for x in ("bg", "de")] == ["бг", "en"]
    assert reads.digest_of(d, "2026-01-01").count() == 1 and reads.digest_of(d, "yesterday").count() == 0
    assert reads.or_else(d.limit(0), d).count() == 1
