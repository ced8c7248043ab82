"""Reads of the stored tables: digests, stories, sources, clusters, articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.config import DEFAULT
from quillstream.operators.tables import written


def digest_dates(digests: DataFrame, n: int = 30) -> DataFrame:
    """The latest n dates, newest first."""
    return digests.select("digest_date").distinct().orderBy(F.desc("digest_date")).limit(n)


def latest_digest(digests: DataFrame) -> DataFrame:
    """The rows of the latest date."""
    return digests.join(digest_dates(digests, 1), "digest_date", "left_semi")


def digest_of(digests: DataFrame, date: str) -> DataFrame:
    """The rows of a date (yyyy-mm-dd); a malformed one has none."""
    return digests.filter(F.col("digest_date") == F.try_to_date(F.lit(date)))


def previous_keys(items: DataFrame, dates: DataFrame) -> DataFrame:
    """digest_date and key of what ran on the day before each date. A day without a digest gives nothing."""
    before = items.select(F.date_add("digest_date", 1).alias("digest_date"), "key").distinct()
    return before.join(dates.select("digest_date").distinct(), "digest_date", "left_semi")


def stories_read(clusters: DataFrame, analyses: DataFrame, category: str | None = None, n: int = 50) -> DataFrame:
    """The latest n analysed stories, of one category or all. The headline is the analysis's, else the cluster's."""
    a = analyses.select(F.col("cluster_key").alias("key"), F.col("headline").alias("said"), "democracy_significance", "democracy_net", "novelty", "credibility", "created_at")
    c = clusters.select("key", "category", "headline", "source_count")
    if category:
        c = c.filter(F.col("category") == category)
    rows = c.join(a, "key").orderBy(F.desc("created_at"), "key").limit(n)
    return rows.select("key", "category", F.coalesce("said", "headline").alias("headline"), F.col("source_count").alias("sources"), "democracy_significance", "democracy_net", "novelty", "credibility")


def trend(digests: DataFrame, n: int = 60) -> DataFrame:
    """The last n digests by their stats (a map), oldest first; what a digest doesn't state is 0."""
    stat = lambda k: F.coalesce(F.try_element_at("stats", F.lit(k)), F.lit(0.0))
    last = digests.orderBy(F.desc("digest_date")).limit(n)
    return last.select("digest_date", stat("net_direction").alias("net_direction"), stat("democracy_relevant").alias("relevant"), stat("erosion_stories").alias("erosion"), stat("strengthening_stories").alias("strengthening")).orderBy("digest_date")


def sources_read(registry: DataFrame) -> DataFrame:
    return registry.orderBy("name", "slug")


def recent_articles(articles: DataFrame, as_of: Column, hours: int = DEFAULT.lookback_hours) -> DataFrame:
    """Articles fetched within so many hours, the latest published first, undated ones last."""
    return articles.filter(F.col("fetched_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")).orderBy(F.desc_nulls_last("published_at"), "url")


def clusters_since(clusters: DataFrame, category: str, as_of: Column, hours: int = DEFAULT.lookback_hours) -> DataFrame:
    return clusters.filter((F.col("category") == category) & (F.col("last_seen") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))


def recent_keys(clusters: DataFrame, as_of: Column, days: int = DEFAULT.continuity_days) -> DataFrame:
    """key and headline of the clusters seen within so many days."""
    return clusters.filter(F.col("last_seen") >= as_of - F.expr(f"INTERVAL {days} DAYS")).select("key", "headline")


def refs_of(clusters: DataFrame, articles: DataFrame, registry: DataFrame) -> DataFrame:
    """key and what is shown of each of its articles; an unknown source is `?`, of unknown lean and medium reliability."""
    a = articles.select(F.col("cluster_key").alias("key"), "source_slug", "title", "url", "published_at")
    r = registry.select(F.col("slug").alias("source_slug"), F.col("slug").alias("known"), "name", "lean", "reliability")
    both = clusters.select("key").join(a, "key").join(r, "source_slug", "left")
    return both.select("key", F.coalesce("known", F.lit("?")).alias("source_slug"), F.coalesce("name", F.lit("?")).alias("source_name"), F.coalesce("lean", F.lit("unknown")).alias("lean"), F.coalesce("reliability", F.lit("medium")).alias("reliability"), "title", "url", "published_at")


def history(clusters: DataFrame, analyses: DataFrame, limit: int = 7) -> DataFrame:
    """start, place, date, headline, what_happened: the earlier analysed entries of every running story, nearest first.

    A story is followed along parent_key. Clusters without an analysis are walked over, however many there are; of those with
    one, the story itself included, `limit` are read, and the first of them is left out, as it is the story. A parent that
    isn't stored, and a cluster that was passed before, end the walk. analyses: cluster_key and, perhaps, headline and
    what_happened; the first of several (by both).
    """
    said = lambda c: F.col(c) if c in analyses.columns else F.lit(None).cast("string")
    told = analyses.groupBy(F.col("cluster_key").alias("key")).agg(F.min(F.struct(said("headline").alias("headline"), said("what_happened").alias("what_happened"))).alias("told"))
    known = written(clusters.join(told, "key", "left").select("key", "parent_key", "headline", "last_seen", "told"), "clusters")
    line = analysed_line(known.select("key", "parent_key", F.col("told").isNotNull().alias("on")), limit)
    of = known.select(F.col("key").alias("ancestor"), F.to_date("last_seen").alias("date"), F.coalesce("told.headline", "headline").alias("headline"), F.coalesce("told.what_happened", F.lit("")).alias("what_happened"))
    return line.filter("place > 0").join(of, "ancestor").select("start", "place", "date", "headline", "what_happened")


def analysed_line(nodes: DataFrame, limit: int) -> DataFrame:
    """start, ancestor, place (from 0): of each node (key, parent_key, on) the first `limit` nodes that are on, along parents.

    By pointer doubling: first each node learns the nearest node ahead that is on, in as many rounds as the logarithm of the
    longest stretch that is off; then hops over 1, 2, 4, ... such nodes are made, and lines grow by doubling with them. No
    join a step, and a cycle ends where it began.
    """
    keys = nodes.select(F.col("key").alias("to"), "on")
    ahead = nodes.join(keys.select(F.col("to").alias("parent_key"), F.col("on").alias("_on")), "parent_key", "left")
    # to: the nearest node so far; open: it is off, so that the way goes on
    ahead = written(ahead.select("key", F.when(F.col("_on").isNotNull(), F.col("parent_key")).alias("to"), (F.col("_on") == F.lit(False)).alias("open")), "ahead")
    passed, most = 1, nodes.count()
    while passed <= most and not ahead.filter("open").isEmpty():
        via = ahead.select(F.col("key").alias("to"), F.col("to").alias("_to"), F.col("open").alias("_open"))
        step = ahead.join(via, "to", "left")
        go = F.coalesce(F.col("open"), F.lit(False))
        ahead = written(step.select("key", F.when(go, F.col("_to")).otherwise(F.col("to")).alias("to"), F.when(go, F.coalesce("_open", F.lit(False))).otherwise(F.lit(False)).alias("open")), "ahead")
        passed *= 2
    ahead = ahead.filter("to is not null and not coalesce(open, false)").select("key", "to")  # what is open still runs in a circle
    own = nodes.filter("on").select(F.col("key").alias("start"), F.col("key").alias("ancestor"))
    rest = nodes.filter("not on").select("key").join(ahead, "key").select(F.col("key").alias("start"), F.col("to").alias("ancestor"))
    line = written(own.unionByName(rest).withColumn("place", F.lit(0)), "line")
    hop, length = ahead, 1
    while length < limit:
        more = line.join(hop.select(F.col("key").alias("ancestor"), "to"), "ancestor").select("start", F.col("to").alias("ancestor"), (F.col("place") + length).alias("place"))
        line = written(line.unionByName(more).filter(F.col("place") < limit).groupBy("start", "ancestor").agg(F.min("place").alias("place")), "line")
        length *= 2
        if length < limit:
            hop = written(hop.join(hop.select(F.col("key").alias("to"), F.col("to").alias("_to")), "to").select("key", F.col("_to").alias("to")), "hops")
    return line


def translated(items: DataFrame, translations: DataFrame, lang: str) -> DataFrame:
    """Items (digest_date, key, analysis) with the analysis in a language, where it was translated."""
    t = translations.filter(F.col("lang") == lang).select("digest_date", "key", F.col("analysis").alias("said"))
    return items.join(t, ["digest_date", "key"], "left").withColumn("analysis", F.coalesce("said", "analysis")).drop("said")


def dashboard(items: DataFrame, view: str) -> DataFrame:
    """all, erosion, strengthening (relevant ones by the sign of their net direction) or contested (with a contested or
    speculative claim)."""
    net, relevant = F.col("net_direction"), F.col("relevant")
    tests = {
        "all": F.lit(True), "erosion": relevant & (net < 0), "strengthening": relevant & (net > 0),
        "contested": F.exists("claims", lambda c: c["status"].isin("contested", "speculative")),
    }
    return items.filter(tests[view])


def in_order(items: DataFrame, categories: list[str]) -> DataFrame:
    """Items by date, category in its fixed order, and rank."""
    place = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    return items.orderBy("digest_date", place, "rank")


def top_tags(items: DataFrame, n: int = 12) -> DataFrame:
    """digest_date and the first n of its distinct tags by name."""
    each = items.select("digest_date", F.explode("tags").alias("tag")).distinct()
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("digest_date").orderBy("tag"))).filter(F.col("r") <= n)
    return first.groupBy("digest_date").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def interests(feedback: DataFrame, as_of: Column, cfg=DEFAULT) -> DataFrame:
    """tag and weight: the signals (tag, signal, created_at, id) of the last days, in order, each step held within 1 of 0.

    Steps that are held are functions x -> min(high, max(low, x + add)), and so is one after the other. The signals of an
    hour give one such function, and the hours of a tag are then folded, so that no task holds all signals of a tag.
    """
    known = F.create_map(*[x for k, v in cfg.interest_deltas.items() for x in (F.lit(k), F.lit(float(v)))])
    recent = feedback.filter(F.col("tag").isNotNull() & (F.col("created_at") >= as_of - F.expr(f"INTERVAL {cfg.interest_days} DAYS")))
    steps = recent.select("tag", F.date_trunc("hour", "created_at").alias("hour"), F.struct("created_at", "id", F.coalesce(F.try_element_at(known, F.col("signal")), F.lit(0.0)).alias("add")).alias("step"))
    one, held = F.lit(1.0), lambda x, low, high: F.least(high, F.greatest(low, x))
    start = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    then = lambda f, s: F.struct((f["add"] + s["add"]).alias("add"), held(f["low"] + s["add"], -one, one).alias("low"), held(f["high"] + s["add"], -one, one).alias("high"))
    hours = steps.groupBy("tag", "hour").agg(F.aggregate(F.array_sort(F.collect_list("step")), start, then).alias("f"))
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("hour", "f"))), F.lit(0.0), lambda x, h: held(x + h["f"]["add"], h["f"]["low"], h["f"]["high"]))
    return hours.groupBy("tag").agg(folded.alias("weight"))


def or_else(df: DataFrame, other: DataFrame) -> DataFrame:
    """df, or the other table where it has no row."""
    return other if df.isEmpty() else df
