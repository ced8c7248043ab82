"""The two daily plans end to end, on a hand-made day."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quillstream.operators import store
from quillstream.plans import daily
from quillstream.sources import feeds

NOW = dt.datetime(2026, 1, 5, 7)
RULES = daily.Rules({"civic": ["parliament", "vote"], "foreign": ["ukraine", "nato"], "tech": ["chip", "model"], "domestic": ["sofia", "bulgaria"]}, ["/sport"], ["football"], lambda c: F.lower(c))
ENTRY = "source_slug string, source_ord int, entry_ord long, url string, title string, summary string, lang string, published_at timestamp"
CLIENT_SCHEMA = "relevant boolean, significance double, net_direction int, impacts array<struct<dimension:string,direction:int,confidence:double,rationale:string>>, novelty double, credibility double, impact_scope double, source_diversity double, contrarian_read string, entities array<string>, tags array<string>"


def entries(spark):
    rows = [
        ("a", 0, 0, "http://a/1", "Parliament in Sofia passes budget law", "Deputies in Sofia passed it", "bg", NOW),
        ("a", 0, 1, "http://a/2", "Parliament in Sofia passes budget law", "Deputies in Sofia passed it", "bg", NOW),  # a near copy
        ("b", 1, 0, "http://b/1", "Parliament in Sofia passes budget law late", "After a long night", "bg", None),
        ("b", 1, 1, "http://b/2", "Parliament football cup", "x", "bg", NOW),  # noise by title
        ("b", 1, 2, "http://b/sport/3", "Parliament votes", "x", "bg", NOW),  # noise by url
        ("b", 1, 3, "http://b/4", "Parliament in Sofia was old news", "x", "bg", NOW - dt.timedelta(hours=40)),
        ("c", 2, 0, "http://c/1", "New chip model ships", "A chip", "en", NOW),
        ("c", 2, 1, "http://c/2", "Ukraine and NATO leaders meet, parliament debates", "talks", "en", NOW),
        ("c", 2, 2, "http://c/3", "Cooking with herbs", "food", "en", NOW),  # no category
        ("c", 2, 3, "", "No link, chip", "food", "en", NOW),
    ]
    return spark.createDataFrame(rows, ENTRY)


def registry(spark):
    rows = [(s, s.upper(), lean, "high", 1.0, True, ["bg_politics", "global_politics", "ai_tech_business"]) for s, lean in (("a", "left"), ("b", "right"), ("c", "center"))]
    return spark.createDataFrame(rows, "slug string, name string, lean string, reliability string, weight double, enabled boolean, categories array<string>")


def test_a_day(spark):
    clusters = spark.createDataFrame([("old", "parliament in sofia passes the budget", NOW - dt.timedelta(days=1)), ("ancient", "parliament in sofia passes budget law", NOW - dt.timedelta(days=9))], "key string, headline string, last_seen timestamp")
    cache = spark.range(1).select(F.substring(F.sha2(F.lit("http://a/1"), 256), 1, 32).alias("url_hash"), F.lit("whole text").alias("body"))
    done = daily.ingest(entries(spark), registry(spark), RULES, clusters, cache, F.lit(NOW))
    found = {r.category: r for r in done["stories"].collect()}
    assert set(found) == set(daily.CATEGORIES)
    home = found["bg_politics"]
    assert (home.article_count, home.source_count, home.parent_key) == (2, 2, "old") and found["global_politics"].parent_key is None
    assert {(r.url, r.body) for r in done["articles"].filter("category = 'bg_politics'").collect()} == {("http://a/1", "whole text"), ("http://b/1", None)}
    assert {r.stat: r.value for r in done["stats"].collect()} == {"fetched": 8.0, "kept": 4.0, "clusters": 3.0, "bodies_extracted": 1.0, "sources": 3.0}

    # local, so that workers get it by value
    def client(row):
        if "chip" in row["headline"]:
            raise store.Refused("not this one")
        impact = [{"dimension": "rule_of_law", "direction": -1, "confidence": 0.7, "rationale": "one two three four five six seven"}]
        return {"relevant": True, "significance": 0.8, "net_direction": -1, "impacts": impact, "novelty": 0.7, "credibility": 0.8, "impact_scope": 0.6, "source_diversity": 0.7, "contrarian_read": "else", "entities": ["X"], "tags": ["law"]}

    said = store.enrich(done["stories"].select("key", "headline"), client, CLIENT_SCHEMA)
    assert [r.error for r in said.collect() if r.error] == ["Refused: not this one"]
    analyses = said.filter("error is null").withColumnRenamed("key", "cluster_key").drop("headline", "error")
    repeated = spark.createDataFrame([(home.key,)], "key string")
    day = daily.digest(done, analyses, registry(spark), F.create_map(F.lit("law"), F.lit(0.2)), repeated, "2026-01-05")
    items = {r.category: r for r in day["items"].collect()}
    assert set(items) == {"bg_politics", "global_politics"} and items["bg_politics"]["rank"] == 1
    # .3 * .695 + .25 * .6 + .2 * .7 + .15 * mean(.8, .8) + .1 * .7: two sources of two leans, no penalty
    assert items["bg_politics"].total == 0.6885 and items["bg_politics"].reasons == []
    assert items["global_politics"].reasons == ["single source"] and "· −0.08 (single source)" in items["global_politics"].explanation
    assert day["deep_dive"].first().key == home.key
    assert {(r.category, r.picks) for r in day["underfilled"].collect()} == {("bg_politics", 1), ("global_politics", 1), ("ai_tech_business", 0)}
    stats = {r.stat: r.value for r in day["stats"].collect()}
    assert (stats["stories"], stats["erosion_stories"], stats["net_direction"]) == (2.0, 2.0, -1.0)
    out = daily.publish(done, day, registry(spark), {c: c.title() for c in daily.CATEGORIES}, "Digest")
    said = {r.category: r.message for r in out["messages"].collect()}
    assert "No stories" in said["ai_tech_business"] and said["bg_politics"].startswith("Bg_Politics\n\n<b>1. Parliament in Sofia")
    assert '<a href="http://a/1">A</a>, <a href="http://b/1">B</a>' in said["bg_politics"] and "🔻 <i>Direction:</i> erosion; rule of law; Significance: 0.8" in said["bg_politics"]
    note = out["notes"].first()
    assert str(note.digest_date) == "2026-01-05" and "tags: [digest, topic/law]" in note.note and note.note.endswith("Previous: [[2026-01-04 — Digest]]\n")
    assert note.note.index("## Bg_Politics") < note.note.index("## Global_Politics")


def test_resume(spark):
    items = spark.createDataFrame([("d", str(k)) for k in range(4)], "digest_date string, key string")
    done = spark.createDataFrame([("d", "0", "old")], "digest_date string, key string, said string")

    def client(row):
        if row["key"] == "3":
            raise store.Refused("no")
        return {"said": "new " + row["key"]}

    now = store.resume(items, done, client, "said string")
    assert sorted((r.key, r.said) for r in now.collect()) == [("0", "old"), ("1", "new 1"), ("2", "new 2")]
    again = store.resume(items, now, lambda row: {"said": "late"}, "said string")
    assert {r.key: r.said for r in again.collect()}["3"] == "late"


def test_command_line(capsys, sf, tmp_path):
    from quillstream.__main__ import main

    assert main(["queries"]) == 0 and "lineage" in capsys.readouterr().out
    assert main(["sql", "lineage"]) == 0 and "RECURSIVE" in capsys.readouterr().out
    assert main(["show", str(tmp_path / "w")]) == 1 and "no digest" in capsys.readouterr().out
    assert main(["build", str(tmp_path / "w"), "--date", "2026-01-05"]) == 1 and "no digest" in capsys.readouterr().out
    assert main(["run", "none", sf]) == 1 and main(["run", "run_stats", sf]) == 0 and "fetched" in capsys.readouterr().out


def test_raw_entries_are_capped_before_they_are_judged(spark):
    old = NOW - dt.timedelta(hours=40)
    rows = [("s", 0, i, f"http://s/{i}" if i != 70 else "", f"T{i}", "x", "en", old if i < 60 else NOW) for i in range(120)]
    got = sorted(r.entry_ord for r in daily.taken(spark.createDataFrame(rows, ENTRY), F.lit(NOW)).collect())
    assert got == [i for i in range(60, 80) if i != 70]


def test_a_dead_feed_does_not_end_the_run(spark, tmp_path):
    p = tmp_path / "f.xml"
    p.write_text("<rss><channel><item><title>T</title><link>http://a/1</link></item><item><title></title><link>http://a/2</link></item></channel></rss>")
    (tmp_path / "empty.xml").write_text("not a feed")
    specs = [{"slug": "a", "path": str(p)}, {"slug": "gone", "path": str(tmp_path / "none.xml")}, {"slug": "odd", "path": str(tmp_path / "empty.xml")}, {"slug": "off", "path": "x", "enabled": False}]
    got, probes = feeds.fetch_feeds(spark, specs)
    assert [(r.source_slug, r.url) for r in got.collect()] == [("a", "http://a/1")]
    assert {r.slug: bool(r.error) for r in probes.collect()} == {"a": False, "gone": True, "odd": False}
    assert feeds.fetch_feeds(spark, specs, everything=True)[0].count() == 2
    known = spark.createDataFrame([(x["slug"], x.get("enabled", True)) for x in specs], "slug string, enabled boolean")
    assert {r.slug: r.status for r in feeds.feed_health(known, got, probes).collect()} == {"a": "ok", "gone": "FAIL", "odd": "DEAD", "off": "skip"}
    assert feeds.fetch_feeds(spark, [])[0].count() == 0


def test_ingest_is_a_run_over_stored_tables(spark, tmp_path):
    from quillstream.operators.warehouse import Warehouse
    from quillstream.plans import runs

    item = lambda url, title: f"<item><title>{title}</title><link>{url}</link><pubDate>Mon, 05 Jan 2026 06:00:00 GMT</pubDate></item>"
    (tmp_path / "a.xml").write_text(f"<rss><channel>{item('http://a/1', 'Parliament in Sofia passes budget law')}{item('http://a/2', 'New chip model ships')}</channel></rss>")
    specs = [{"slug": "a", "path": str(tmp_path / "a.xml"), "lang": "bg"}, {"slug": "b", "path": str(tmp_path / "b.xml"), "lang": "bg"}]
    rules = runs.rules_of('{"vocab": {"civic": ["parliament"], "foreign": ["nato"], "tech": ["chip"], "domestic": ["sofia"]}}')
    base = str(tmp_path / "w")
    one = runs.ingest(spark, base, specs, rules, F.lit(NOW))
    assert one["inserted"] == {"sources": 2, "clusters": 2, "articles": 2}
    assert {(r.category, r["rank"], r.headline) for r in one["preview"].collect()} == {("bg_politics", 1, "Parliament in Sofia passes budget law"), ("ai_tech_business", 1, "New chip model ships")}
    assert {r.slug: r.error is None for r in one["probes"].collect()} == {"a": True, "b": False}
    (tmp_path / "b.xml").write_text(f"<rss><channel>{item('http://b/1', 'Parliament in Sofia passes budget law late')}</channel></rss>")
    two = runs.ingest(spark, base, specs, rules, F.lit(NOW))
    assert two["inserted"] == {"sources": 0, "clusters": 1, "articles": 1}
    w = Warehouse(spark, base)
    assert w.version() == 2 and w.read("articles").count() == 3
    story = {r.url: r.cluster_key for r in w.read("articles").collect()}
    assert story["http://a/1"] == story["http://b/1"] != story["http://a/2"]
    analyses = [{"cluster_key": k, "created_at": f"2026-01-05T0{hour}:00:00Z", "headline": said, "relevant": True, "significance": 0.8, "net_direction": -1, "novelty": 0.2, "credibility": 0.8, "impact_scope": 0.6, "source_diversity": 0.7, "tags": ["law"], "what_happened": said, "impacts": [{"dimension": "rule_of_law", "direction": -1, "confidence": 0.7, "rationale": "w"}]} for k, hour, said in ((story["http://a/1"], 8, "late word"), (story["http://a/1"], 7, "early word"), (story["http://a/2"], 7, "chips"), ("unknown", 7, "no"))]
    (tmp_path / "said.json").write_text("\n".join(json.dumps(a) for a in analyses))
    said = spark.read.schema(runs.ANALYSIS).json(str(tmp_path / "said.json"))
    assert runs.build(spark, base, "2026-01-05", {"bg_politics": "B"}, "D").count() == 0 and w.version() == 2
    assert runs.record(spark, base, said) == 2 and runs.record(spark, base, said) == 0
    assert {r.headline for r in w.read("analyses").collect()} == {"late word", "chips"}
    titles = {"bg_politics": "B", "ai_tech_business": "T"}
    first = {r.category: r.message for r in runs.build(spark, base, "2026-01-05", titles, "D").collect()}
    assert "late word" in first["bg_politics"] and "chips" in first["ai_tech_business"]
    version = w.version()
    assert runs.build(spark, base, "2026-01-20", titles, "D").count() == 0 and w.version() == version
    again = {r.category: r.message for r in runs.build(spark, base, "2026-01-05", titles, "D").collect()}
    assert again == first and w.version() == version + 1 and w.read("items").count() == 2 and w.read("notes").count() == 1
    digest = w.read("digests").first()
    assert (digest.stats["stories"], digest.stats["fetched"]) == (2.0, 3.0) and digest.deep_dive_key in story.values()
    next_day = runs.build(spark, base, "2026-01-06", titles, "D", hours=72)
    assert {str(r.digest_date) for r in next_day.collect()} == {"2026-01-06"} and w.read("digests").count() == 2
    was, now = ({r.key: r.penalty for r in w.read("items").filter(f"digest_date = '{d}'").collect()} for d in ("2026-01-05", "2026-01-06"))
    assert all(now[k] > was[k] for k in was)  # each ran the day before
    assert runs.show(spark, base).join(next_day.select("category"), "category").count() == 2 and runs.show(spark, base, "2026-01-05").count() == 2
    assert runs.show(spark, base, "nonsense").count() == 0 and runs.show(spark, str(tmp_path / "none")).count() == 0
