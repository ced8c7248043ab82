"""The two daily plans: ingestion of entries into stories, and the digest of a day."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillstream.config import DEFAULT
from quillstream.functions import scoring as S
from quillstream.functions import text as X
from quillstream.operators import neardup, reads, render, routing, selection, stories
from quillstream.operators.tables import observed, written
from quillstream.sources import feeds

CATEGORIES = [routing.BG, routing.GLOBAL, routing.TECH]


@dataclass
class Rules:
    """Vocabularies and the signature of titles, which differ from corpus to corpus."""

    vocab: dict[str, list[str]]
    segments: list[str]
    noise: list[str]
    signature: Callable[[Column], Column]


def taken(entries: DataFrame, as_of: Column, cfg=DEFAULT) -> DataFrame:
    """Of each source's first 2 * per_source entries as the feed has them, usable or not, the first per_source that have a link
    and a title and aren't too old."""
    valid = feeds.usable(F.col("url"), F.col("title")) & routing.recent(F.col("published_at"), as_of, cfg.lookback_hours)
    return routing.per_source_cap(entries, "source_slug", "entry_ord", valid, cfg.per_source)


def ingest(entries: DataFrame, registry: DataFrame, rules: Rules, clusters: DataFrame, cache: DataFrame, as_of: Column, cfg=DEFAULT) -> dict[str, DataFrame]:
    """Entries (source_slug, source_ord, entry_ord, url, title, summary, lang, published_at) to articles, members and
    stories with their parents, and the run's stats, which the plan's own writes have counted.

    In order: the first entries of each source, of these the valid and recent ones up to the cap, noise, near-duplicates of one source, category, stories, the best candidates of
    each category, bodies from the cache, continuity with the clusters (key, headline, last_seen) of the last days.
    """
    rows = F.count(F.lit(1))
    fetched, n_fetched = observed(taken(entries, as_of, cfg), "fetched", fetched=rows)
    clean = fetched.filter(~routing.is_noise(F.col("url"), F.col("title"), rules.segments, rules.noise))
    words = X.normalize(F.concat_ws(" ", "title", F.substring("summary", 1, 400)))
    apart = neardup.drop_near_duplicates(clean.withColumn("simhash", stories.simhash(words)), "source_slug", "entry_ord", "simhash", cfg.simhash_distance)
    known = routing.with_registry(apart, registry)
    live = Observation("live-" + uuid.uuid4().hex[:12])
    allowed = registry.observe(live, F.count_if("enabled").alias("sources")).select(F.col("slug").alias("source_slug"), F.col("categories").alias("allowed"))
    known = known.join(allowed, "source_slug", "left")
    routed = routing.classify(known, X.haystack(F.col("title"), F.col("summary"), F.lit(None).cast("string")), F.col("lang"), F.col("allowed"), rules.vocab, cfg)
    kept = routed.filter("category is not null").withColumn("ordinal", F.col("source_ord").cast("long") * (1 << 40) + F.col("entry_ord"))
    kept, n_kept = observed(kept, "kept", kept=rows)
    members, found = stories.cluster_by_category(kept, rules.signature, as_of=as_of, cfg=cfg)
    best = routing.top_per(found, ["category"], [F.desc("source_count"), F.desc("article_count"), F.col("root")], cfg.candidates_per_category)
    words = X.tokens(X.normalize(F.col("headline")))
    parents = stories.best_match(best.select("key", words.alias("words")), reads.recent_keys(clusters, as_of, cfg.continuity_days).select("key", words.alias("words")), cfg.continuity_threshold)
    best, n_best = observed(best.join(parents.select("key", "parent_key"), "key", "left"), "stories", clusters=rows)
    members = written(members.join(best.select("category", "root", "key"), ["category", "root"]), "members")
    bodies, n_bodies = observed(feeds.bodies(members, cache, cfg.body_chars), "bodies", bodies_extracted=rows)
    articles = members.join(bodies, "url", "left")
    counts = {k: float(v) for seen in (n_fetched, n_kept, n_best, n_bodies, live) for k, v in seen.get.items()}
    stats = entries.sparkSession.createDataFrame(list(counts.items()), "stat string, value double")
    return {"articles": articles, "members": members, "stories": best, "stats": stats}


def digest(ingested: dict[str, DataFrame], analyses: DataFrame, registry: DataFrame, interests: Column, repeated: DataFrame, date: str, cfg=DEFAULT) -> dict[str, DataFrame]:
    """Items, deep dive, underfilled categories and stats of a day.

    analyses: cluster_key, relevant, significance, net_direction, impacts, novelty, credibility, impact_scope,
    source_diversity, contrarian_read, entities, tags; a story without one is left out. interests: map of tag to weight;
    repeated: keys that ran the day before.
    """
    refs = ingested["members"].select("key", "source_slug").join(registry.select(F.col("slug").alias("source_slug"), "lean", "reliability"), "source_slug", "left")
    refs = refs.groupBy("key").agg(F.collect_set(F.coalesce("lean", F.lit("unknown"))).alias("leans"), F.collect_set(F.coalesce("reliability", F.lit("medium"))).alias("reliabilities"), F.collect_set("source_slug").alias("slugs"))
    again = repeated.select("key").distinct().withColumn("again", F.lit(True))
    rows = ingested["stories"].select("key", "category", "headline", "source_count").join(analyses.withColumnRenamed("cluster_key", "key").drop("category", "headline"), "key")
    rows = rows.join(refs, "key").join(again, "key", "left")
    flags = S.sanity_flags(F.col("significance"), F.col("credibility"), F.col("relevant"), F.col("impacts"), F.col("net_direction"), F.col("source_diversity"), F.col("contrarian_read"))
    rows = rows.withColumns({"direction": S.weighted_direction(F.col("relevant"), F.col("impacts"), cfg), "flags": flags})
    inputs = (F.col("source_count"), F.col("leans"), F.col("flags"), F.coalesce("again", F.lit(False)), F.col("novelty"))
    rows = rows.withColumns({
        "democracy": S.democracy_score(F.col("relevant"), F.col("significance"), F.col("direction")),
        "believed": S.blended_credibility(F.col("credibility"), S.source_credibility(F.col("reliabilities"), F.col("slugs"), cfg)),
        "mine": S.personal(F.concat("tags", "entities"), interests), "penalty": S.penalties(*inputs, cfg=cfg), "reasons": S.penalty_reasons(*inputs, cfg=cfg),
    })
    total = S.selection_total(F.col("democracy"), F.col("impact_scope"), F.col("novelty"), F.col("believed"), F.col("mine"), F.col("penalty"), cfg)
    said = S.explanation({"democracy": F.col("democracy"), "impact": F.col("impact_scope"), "novelty": F.col("novelty"), "credibility": F.col("believed"), "fit": F.col("mine")}, F.col("penalty"), F.col("reasons"))
    scored = written(rows.withColumns({"total": total, "explanation": said, "digest_date": F.to_date(F.lit(date))}), "scored")
    picks = selection.select_top(scored, CATEGORIES, cfg=cfg)
    items = written(picks.select("digest_date", "category", "key", "rank").join(scored, ["digest_date", "category", "key"]), "items")
    summary = selection.daily_summary(items).drop("digest_date")
    day = summary.select(F.explode(F.create_map(*[x for c in summary.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("stat", "value")).filter("value is not null")
    return {"items": items, "deep_dive": selection.deep_dive(items, cfg=cfg), "underfilled": selection.underfilled(picks, CATEGORIES, cfg=cfg), "stats": ingested["stats"].unionByName(day)}


#: What rendering reads of a story beyond what digest() makes; a column that the analyses don't have is null.
TOLD = {"what_happened": "string", "why_it_matters": "string", "uncertainty": "string", "contrarian_read": "string", "framing": "array<string>", "claims": "array<struct<status:string,text:string>>"}


def publish(ingested: dict[str, DataFrame], day: dict[str, DataFrame], registry: DataFrame, titles: dict[str, str], heading: str, compact: bool = True, refs: int = 6, wording: dict[str, str] = {}) -> dict[str, DataFrame]:
    """Chat messages (digest_date, category, seq, message) and Markdown notes (digest_date, note) of a digest.

    titles: what each category is headed by; wording: what lines are headed by (see `render`). A story shows its first articles, so that a large one is never gathered.
    """
    picked = day["items"].select("key").distinct()
    first = routing.top_per(ingested["members"].join(picked, "key", "left_semi"), ["key"], [F.col("ordinal")], refs, "_n")
    shown = routing.with_registry(first.select("key", "_n", "url", "source_slug"), registry)
    ref = F.struct("name", "url", "lean", "reliability")
    each = shown.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", ref.alias("ref")))), lambda x: x["ref"]).alias("refs"))
    items = day["items"].join(each, "key", "left")
    items = written(items.withColumns({c: F.lit(None).cast(t) for c, t in TOLD.items() if c not in items.columns}), "told")
    messages = render.category_messages(items, titles, compact, wording=wording)
    place = F.array_position(F.array(*map(F.lit, titles)), F.col("category"))
    section = items.select("digest_date", "category", place.alias("place"), "rank", render.story_note(F.struct(*items.columns), wording).alias("text"))
    parts = section.groupBy("digest_date", "place", "category").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("all"))
    title = F.element_at(F.create_map(*[F.lit(x) for p in titles.items() for x in p]), F.col("category"))
    part = F.concat(F.lit("## "), title, F.lit("\n\n"), F.array_join(F.transform("all", lambda x: x["text"]), "\n\n"))
    body = parts.groupBy("digest_date").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("text")))).alias("parts"))
    body = body.join(reads.top_tags(items), "digest_date", "left")
    when = F.col("digest_date").cast("string")
    head = F.concat(F.lit(f'---\ntitle: "{heading} — '), when, F.lit('"\ndate: '), when, F.lit("\n"), render.tag_line(F.coalesce("tags", F.array().cast("array<string>")), "digest"), F.lit("\n---\n\n# "), F.lit(f"{heading} — "), when)
    before = F.concat(F.lit("Previous: [["), F.date_sub("digest_date", 1).cast("string"), F.lit(f" — {heading}]]"))
    note = F.concat_ws("\n\n", head, F.array_join(F.transform("parts", lambda x: x["text"]), "\n\n"), before)
    return {"messages": messages, "notes": body.select("digest_date", F.concat(note, F.lit("\n")).alias("note"))}
