"""The daily plans as runs over stored tables: feeds in, analyses in, a digest out; each changes its tables together."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.config import DEFAULT
from quillstream.functions import text as X
from quillstream.operators import reads, routing, store
from quillstream.operators.warehouse import Warehouse
from quillstream.plans import daily
from quillstream.sources import feeds

SOURCE = "slug string, name string, lean string, reliability string, weight double, enabled boolean, categories array<string>"

#: What a model says of a story, a row for each; columns that it leaves out are null.
ANALYSIS = (
    "cluster_key string, created_at timestamp, headline string, relevant boolean, significance double, net_direction double, "
    "impacts array<struct<dimension:string,direction:double,confidence:double,rationale:string>>, novelty double, credibility double, "
    "impact_scope double, source_diversity double, contrarian_read string, entities array<string>, tags array<string>, what_happened string, "
    "why_it_matters string, uncertainty string, framing array<string>, claims array<struct<status:string,text:string>>"
)


def rules_of(text: str) -> daily.Rules:
    """Rules from JSON: vocab (civic, foreign, tech, domestic), and perhaps segments, noise, lexicon and letters."""
    said = json.loads(text)
    lexicon, letters = said.get("lexicon", {}), said.get("letters", {})
    return daily.Rules(said["vocab"], said.get("segments", []), said.get("noise", []), lambda title: X.signature(title, lexicon, letters))


def registry_of(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """The registry of feed specifications (slug, path and, perhaps, name, lean, reliability, weight, enabled, categories)."""
    rows = [(s["slug"], s.get("name", s["slug"]), s.get("lean", "unknown"), s.get("reliability", "medium"), float(s.get("weight", 1.0)), bool(s.get("enabled", True)), s.get("categories")) for s in specs]
    return spark.createDataFrame(rows, SOURCE)


def preview(stories: DataFrame, n: int = 10) -> DataFrame:
    """category, rank, source_count and headline (its first 100 characters) of the first stories of each category."""
    order = [F.desc("source_count"), F.desc("article_count"), F.asc("key")]
    return routing.top_per(stories, ["category"], order, n).select("category", "rank", "source_count", F.substring("headline", 1, 100).alias("headline"))


def ingest(spark: SparkSession, base: str, specs: list[dict], rules: daily.Rules, as_of: Column | None = None, cfg=DEFAULT) -> dict:
    """Fetch, classify and cluster what the feeds have, and store it below base.

    Articles keep what they had and get a missing body, a cluster that is known keeps its category and first time, the
    registry is stored anew; the three tables change together, or not at all. Returns stats, preview, probes (slug, error) and
    inserted: how many rows of each table are new.
    """
    w = Warehouse(spark, base)
    stored, registry = w.manifest(), registry_of(spark, specs)
    entries, probes = feeds.fetch_feeds(spark, specs, everything=True)
    clusters = w.read("clusters") if "clusters" in stored else spark.createDataFrame([], "key string, headline string, last_seen timestamp")
    cache = w.read("pages") if "pages" in stored else spark.createDataFrame([], "url_hash string, body string")
    done = daily.ingest(entries, registry, rules, clusters.select("key", "headline", "last_seen"), cache.select("url_hash", "body"), as_of if as_of is not None else F.current_timestamp(), cfg)
    stories = done["stories"].select("key", "category", "headline", "first_seen", "last_seen", "source_count", "article_count", "parent_key")
    articles = done["articles"].select("url", "source_slug", "title", "summary", "lang", "published_at", F.col("key").alias("cluster_key"), "body").dropDuplicates(["url"])
    with w.run() as r:
        r.merge("sources", registry, ["slug"], 1)
        r.merge("clusters", stories, ["key"], how=store.upsert_clusters)
        r.merge("articles", articles, ["url"], how=lambda old, new: store.upsert(old, new, ["url"], keep=["source_slug", "title", "summary", "lang", "published_at"], fill=["body"]))
    return {"stats": done["stats"], "preview": preview(stories), "probes": probes, "inserted": {k: v["inserted"] for k, v in r.counts.items()}}


def record(spark: SparkSession, base: str, analyses: DataFrame) -> int:
    """Store analyses (columns of ANALYSIS) of known clusters, one a cluster; how many clusters had none before.

    What is said replaces, whole, what was stored of its cluster. Of several rows of one cluster the latest counts; those of
    unknown clusters, or without a key, are skipped. Nothing is stored before there are clusters.
    """
    w = Warehouse(spark, base)
    if "clusters" not in w.manifest():
        return 0
    told = [c for c in analyses.columns if c != "cluster_key"]
    latest = analyses.groupBy("cluster_key").agg(F.max_by(F.struct(*told), F.struct("created_at", "headline", F.xxhash64(*told))).alias("a"))
    with w.run() as r:
        return r.merge("analyses", store.analysis_rows(latest.select("cluster_key", "a.*"), r.read("clusters")), ["cluster_key"])


def build(spark: SparkSession, base: str, date: str, titles: dict[str, str], heading: str, interests: Column | None = None, hours: int | None = None, cfg=DEFAULT, **publish) -> DataFrame:
    """Select and render the digest of a date (yyyy-mm-dd) out of the stored stories; the messages stored.

    A story takes part if it was last seen within `hours` before the date's end and has an analysis. Items that ran the day
    before are known by the stored items. items, messages and notes of the date are replaced and its row in digests is
    written, all together; a day for which nothing is picked stores nothing, and has no messages.
    """
    w = Warehouse(spark, base)
    stored = w.manifest()
    end = F.to_timestamp(F.date_add(F.to_date(F.lit(date)), 1))
    seen = F.col("last_seen").between(end - F.expr(f"INTERVAL {hours or cfg.lookback_hours} HOURS"), end)
    with w.run() as r:
        if not {"clusters", "articles", "analyses"} <= set(stored):
            return spark.createDataFrame([], "digest_date date, category string, seq int, message string")
        stories = r.read("clusters").filter(seen)
        members = r.read("articles").withColumnRenamed("cluster_key", "key").join(stories.select("key"), "key", "left_semi")
        members = members.select("key", "url", "source_slug", F.struct("published_at", "url").alias("ordinal"))
        count = lambda df, name: df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("stat"), "value")
        taken = {"stories": stories, "members": members, "stats": count(members, "fetched").unionByName(count(stories, "clusters"))}
        before = r.read("items") if "items" in stored else spark.createDataFrame([], "digest_date date, key string")
        dates = spark.range(1).select(F.to_date(F.lit(date)).alias("digest_date"))
        nothing = F.create_map().cast("map<string,double>")
        day = daily.digest(taken, r.read("analyses"), r.read("sources"), nothing if interests is None else interests, reads.previous_keys(before, dates), date, cfg)
        if day["items"].isEmpty():
            return spark.createDataFrame([], "digest_date date, category string, seq int, message string")
        out = daily.publish(taken, day, r.read("sources"), titles, heading, **publish)
        stats = day["stats"].agg(F.map_from_entries(F.collect_list(F.struct("stat", "value"))).alias("stats")).withColumn("digest_date", F.to_date(F.lit(date)))
        dive = day["deep_dive"].select("digest_date", F.col("key").alias("deep_dive_key"))
        r.merge("digests", stats.join(dive, "digest_date", "left").select("digest_date", "stats", "deep_dive_key"), ["digest_date"], 1)
        r.replace("items", day["items"], "digest_date")
        r.replace("messages", out["messages"], "digest_date")
        r.replace("notes", out["notes"], "digest_date")
    return show(spark, base, date)


def show(spark: SparkSession, base: str, date: str | None = None) -> DataFrame:
    """digest_date, category, seq, message of a date, or of the latest one; no rows where there is no such digest."""
    w = Warehouse(spark, base)
    if "messages" not in w.manifest():
        return spark.createDataFrame([], "digest_date date, category string, seq int, message string")
    messages = w.read("messages")
    chosen = reads.latest_digest(messages) if date is None else reads.digest_of(messages, date)
    return chosen.select("digest_date", "category", "seq", "message")
