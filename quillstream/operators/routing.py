"""Noise filter, routing to categories, per-source caps, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.config import DEFAULT
from quillstream.functions.text import vocabulary_hits, vocabulary_pattern

BG, GLOBAL, TECH = "bg_politics", "global_politics", "ai_tech_business"


def section_noise(url: Column, segments: list[str]) -> Column:
    low = F.lower(url)
    out = F.lit(False)
    for s in segments:
        out = out | low.contains(s)
    return out


def is_noise(url: Column, title: Column, segments: list[str], terms: list[str]) -> Column:
    return section_noise(url, segments) | F.lower(title).rlike(vocabulary_pattern(terms))


def hits(text: Column, vocab: dict[str, list[str]]) -> Column:
    """Distinct terms of each vocabulary in a lower-cased text, as a struct."""
    return F.struct(*[vocabulary_hits(text, vocab[k]).alias(k) for k in ("civic", "foreign", "tech", "domestic")])


def category(h: Column, lang: Column, allowed: Column, cfg=DEFAULT) -> Column:
    """Category by a text's hits(); null if none.

    allowed: categories of the source, null for an unknown source, which may be any.
    """
    civic, foreign, tech, home = (h[k] for k in ("civic", "foreign", "tech", "domestic"))
    politics = F.when((civic > 0) | (foreign >= 2), civic + foreign).otherwise(0)
    may = lambda c: F.coalesce(F.array_contains(allowed, c), F.lit(True))
    two, one = cfg.cross_category_min, cfg.min_signal
    domestic = (home >= one) | ((lang == "bg") & (foreign == 0))
    return (
        F.when((politics < one) & (tech < one), F.lit(None).cast("string"))
        .when((tech > politics) & (may(TECH) | (tech >= two)), TECH)
        .when((politics >= one) & domestic & (may(BG) | (home >= two)), BG)
        .when((politics >= one) & (may(GLOBAL) | may(BG) | (politics >= two)), GLOBAL)
        .when((tech >= one) & (may(TECH) | (tech >= two)), TECH)
    )


def classify(df: DataFrame, text: Column, lang: Column, allowed: Column, vocab: dict[str, list[str]], cfg=DEFAULT) -> DataFrame:
    """df with its category. The hits are the one element of an array, so that no branch or filter on the category makes
    the optimizer search the text again."""
    once = df.withColumn("_hits", F.explode(F.array(hits(text, vocab))))
    return once.withColumn("category", category(F.col("_hits"), lang, allowed, cfg)).drop("_hits")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts each task's groups before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def per_source_cap(entries: DataFrame, source: str, ordinal: str, valid: Column, limit: int = DEFAULT.per_source) -> DataFrame:
    """Of each source's first 2 * limit entries as they came, the first `limit` valid ones."""
    seen = top_per(entries, [source], [F.col(ordinal)], 2 * limit, "_raw").filter(valid).drop("_raw")
    return top_per(seen, [source], [F.col(ordinal)], limit, "_n").drop("_n")


def recent(published: Column, as_of: Column, hours: int = DEFAULT.lookback_hours) -> Column:
    """Whether it was published within so many hours before as_of, or nobody knows when."""
    return published.isNull() | (published >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def lookback(df: DataFrame, published: str, as_of: Column, hours: int = DEFAULT.lookback_hours) -> DataFrame:
    """Rows published within so many hours before as_of; undated rows stay."""
    return df.filter(recent(F.col(published), as_of, hours))


def with_registry(df: DataFrame, registry: DataFrame, slug: str = "source_slug") -> DataFrame:
    """Left join to the source registry with defaults: name is the slug, lean unknown, reliability medium, weight 1."""
    r = registry.select(F.col("slug").alias(slug), "name", "lean", "reliability", "weight", F.lit(True).alias("known"))
    out = df.join(r, slug, "left")
    return out.withColumns({"name": F.coalesce("name", slug), "lean": F.coalesce("lean", F.lit("unknown")), "reliability": F.coalesce("reliability", F.lit("medium")), "weight": F.coalesce("weight", F.lit(1.0)), "known": F.coalesce("known", F.lit(False))})


def from_known_sources(df: DataFrame, registry: DataFrame, slug: str = "source_slug") -> DataFrame:
    """Rows of registered sources, with what the registry says of them; rows of others are skipped."""
    return with_registry(df, registry, slug).filter("known")


def vocabulary_union(*vocabularies: dict[str, list[str]]) -> dict[str, list[str]]:
    """Vocabularies joined by name: each term once, in lower case, by name."""
    names = {k for v in vocabularies for k in v}
    return {k: sorted({t.strip().lower() for v in vocabularies for t in v.get(k, [])} - {""}) for k in sorted(names)}
