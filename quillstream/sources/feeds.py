"""Feeds, pages, registry and rendered output."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.config import DEFAULT
from quillstream.functions.pages import main_text
from quillstream.functions.text import blank_null, html_to_text, url_hash
from quillstream.operators.tables import written

#: Fixed value: the date format of RSS items, without the day of the week.
RFC822 = "d MMM yyyy HH:mm:ss Z"


def read_feed(spark: SparkSession, path: str, slug: str, row_tag: str = "item", source_ord: int = 0, lang: str | None = None, everything: bool = False) -> DataFrame:
    """Entries of RSS (item) or Atom (entry) files: source_slug, url, title, summary, author, lang, published_at, in file
    order. An Atom link is an attribute; of several the first that is no other than the entry itself."""
    link = "string" if row_tag == "item" else "array<struct<_href: string, _rel: string>>"
    author = "string" if row_tag == "item" else "struct<name: string>"
    schema = f"title string, link {link}, description string, summary string, author {author}, pubDate string, published string, updated string"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    if row_tag != "item":
        own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        raw = raw.withColumn("link", F.coalesce(F.get(own, F.lit(0)), F.get("link", F.lit(0)))["_href"]).withColumn("author", F.col("author.name"))
    return entries(raw.withColumns({"source_slug": F.lit(slug), "source_ord": F.lit(source_ord), "entry_ord": F.monotonically_increasing_id(), "lang": F.lit(lang).cast("string")}), everything)


ENTRY = "source_slug string, source_ord int, entry_ord long, url string, title string, summary string, author string, lang string, published_at timestamp"


def fetch_feeds(spark: SparkSession, feeds: list[dict], at_once: int = 8, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, probes) of all enabled feeds (slug, path, row_tag, lang, enabled).

    Each feed is read, as its own jobs, into a table of its own, a few feeds at once. A feed that can't be read (no such path,
    not XML at all) gives no entries, and its probe (slug, error) says why; the others are not touched. Entries go by
    (source_ord, entry_ord). With everything, they are all there, also those without a link or title, for a cap that counts
    them. No enabled feed: empty tables.
    """
    live = [x for x in feeds if x.get("enabled", True)]

    def one(k: int, f: dict) -> tuple[DataFrame | None, str | None]:
        try:
            raw = read_feed(spark, f["path"], f["slug"], f.get("row_tag", "item"), k, f.get("lang"), everything)
            return written(raw, "feed"), None
        except Exception as e:  # a dead feed must not end the run
            return None, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        got = list(pool.map(one, range(len(live)), live))
    entries_ = spark.createDataFrame([], ENTRY)
    for df, _ in got:
        if df is not None:
            entries_ = entries_.unionByName(df)
    probes = spark.createDataFrame([(f["slug"], error) for f, (_, error) in zip(live, got)], "slug string, error string")
    return entries_, probes


def read_feeds(spark: SparkSession, feeds: list[dict]) -> DataFrame:
    """Entries of all enabled feeds that can be read, in their order by (source_ord, entry_ord)."""
    return fetch_feeds(spark, feeds)[0]


def sources_for(registry: DataFrame, category: str) -> DataFrame:
    """Enabled sources of a category."""
    return registry.filter(F.col("enabled") & F.array_contains("categories", category))


def timestamp_of(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|Z)$", "+0000")
    return F.when(plain.rlike(r"^\d{1,2} "), F.try_to_timestamp(plain, F.lit(RFC822))).otherwise(F.try_to_timestamp(c))


def usable(url: Column, title: Column) -> Column:
    """Whether an entry has a link and a title."""
    return (F.coalesce(F.trim(url), F.lit("")) != "") & (F.coalesce(F.trim(title), F.lit("")) != "")


def entries(raw: DataFrame, everything: bool = False) -> DataFrame:
    """Raw entries with link and title, or all that say anything, their summary as text and the first date that parses."""
    title, summary = F.trim("title"), html_to_text(F.coalesce(blank_null(F.col("summary")), blank_null(F.col("description"))))
    when = F.coalesce(timestamp_of(F.coalesce("published", "pubDate")), timestamp_of(F.col("updated")))
    said = F.coalesce("link", "title", "summary", "description", "pubDate", "published", "updated").isNotNull()
    some = raw.filter(said if everything else usable(F.col("link"), F.col("title")))
    return some.select("source_slug", "source_ord", "entry_ord", F.trim("link").alias("url"), title.alias("title"), summary.alias("summary"), "author", "lang", when.alias("published_at"))


def pages_text(pages: DataFrame, most: int = DEFAULT.body_chars) -> DataFrame:
    """url_hash and body (main text of the page, at most so many characters) of each distinct url, of several pages the
    largest; pages without text go."""
    one = pages.groupBy("url").agg(F.max("html").alias("html"))
    return one.select(url_hash(F.col("url")).alias("url_hash"), F.substring(main_text(F.col("html")), 1, most).alias("body")).filter("body <> ''")


def to_fetch(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """Urls not in the cache yet; empty cached bodies count, so a failed page isn't fetched again."""
    return urls.select("url").distinct().withColumn("url_hash", url_hash(F.col("url"))).join(cache.select("url_hash"), "url_hash", "left_anti")


def cached(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache (url_hash, body) with pages fetched now (url, body); a page that gave nothing is kept as empty, so that it
    isn't fetched again. What is known stays."""
    new = fetched.groupBy("url").agg(F.max("body").alias("body")).select(url_hash(F.col("url")).alias("url_hash"), F.coalesce("body", F.lit("")).alias("body"))
    return cache.select("url_hash", "body").unionByName(new.join(cache.select("url_hash"), "url_hash", "left_anti"))


def bodies(urls: DataFrame, cache: DataFrame, most: int = DEFAULT.body_chars) -> DataFrame:
    """url and body of the distinct urls whose page is cached with a text."""
    return urls.select("url").distinct().withColumn("url_hash", url_hash(F.col("url"))).join(cache.filter("body <> ''"), "url_hash").select("url", F.substring("body", 1, most).alias("body"))


def feed_health(registry: DataFrame, entries: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """slug, entries and status: skip for a disabled feed, FAIL for one that a probe (slug, error) could not read, DEAD for an
    enabled one without entries, else ok."""
    n = entries.groupBy(F.col("source_slug").alias("slug")).agg(F.count("*").alias("entries"))
    joined = registry.join(n, "slug", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    if probes is not None:
        joined = joined.join(probes.groupBy("slug").agg(F.max("error").alias("error")), "slug", "left")
    failed = F.col("error").isNotNull() if probes is not None else F.lit(False)
    status = F.when(~F.col("enabled"), "skip").when(failed, "FAIL").when(F.col("entries") == 0, "DEAD").otherwise("ok")
    return joined.select("slug", "entries", status.alias("status"))


def render_digest(items: DataFrame, digest: str = "digest_date") -> DataFrame:
    """digest_date and a Markdown note with its items by category and rank. A digest has a bounded number of items."""
    line = F.format_string("%d. **%s** — %s", "rank", "headline", "explanation")
    each = items.groupBy(digest, "category").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    part = F.concat(F.lit("## "), F.replace("category", F.lit("_"), F.lit(" ")), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    notes = each.groupBy(digest).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return notes.select(digest, F.concat(F.lit("---\ndate: "), F.col(digest).cast("string"), F.lit("\n---\n\n"), F.array_join("parts", "\n\n"), F.lit("\n")).alias("note"))
