"""Queries that do the whole of what an older registered query cuts, against brute force."""

import math
from collections import Counter

from quillstream.plans import catalogue


def ledes(spark, sf):
    """category -> {doc_id: words}, for titles (t) and ledes (l)."""
    from pyspark.sql import functions as F

    from quillstream.functions import text as X

    words = lambda c: X.tokens(X.normalize(c))
    rows = catalogue.classified(spark, sf).filter("category is not null").select("category", "doc_id", words(F.col("title")).alias("t"), words(F.concat_ws(" ", "title", F.substring("text", 1, 400))).alias("l")).orderBy("doc_id").collect()
    return {k: {c: {r.doc_id: r[k] for r in rows if r.category == c} for c in {r.category for r in rows}} for k in "tl"}


def distinct(docs):
    seen = {}
    for d in sorted(docs):
        seen.setdefault(tuple(docs[d]), d)
    return {d: w for w, d in seen.items()}


def test_article_containment_is_brute_force(spark, sf):
    want = set()
    for c, docs in ledes(spark, sf)["t"].items():
        sets = {d: set(w) for d, w in distinct(docs).items()}
        want |= {(c, a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 3 and len(sets[a] & sets[b]) >= 0.5 * min(len(sets[a]), len(sets[b]))}
    got = catalogue.QUERIES["article_containment_pairs"](spark, sf).collect()
    assert want and sorted((r.category, r.a, r.b) for r in got) == sorted(want)


def test_article_tfidf_is_brute_force(spark, sf):
    want = {}
    for c, docs in ledes(spark, sf)["l"].items():
        docs = distinct(docs)
        tf = {d: Counter([*w, *(f"{x} {y}" for x, y in zip(w, w[1:]))]) for d, w in docs.items()}
        df = Counter(t for x in tf.values() for t in x)
        v = {d: {t: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in x.items()} for d, x in tf.items()}
        norm = {d: math.sqrt(sum(w * w for w in x.values())) for d, x in v.items()}
        for a in v:
            for b in v:
                if a < b and norm[a] and norm[b]:
                    s = sum(w * v[b].get(t, 0) for t, w in v[a].items()) / norm[a] / norm[b]
                    if s >= 0.42:
                        want[c, a, b] = s
    got = {(r.category, r.a, r.b): r.similarity for r in catalogue.QUERIES["article_tfidf_pairs"](spark, sf).collect()}
    assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_lineage_goes_seven_steps(spark, sf):
    assert max(r.depth for r in catalogue.QUERIES["lineage"](spark, sf).collect()) == 7


def test_feed_health_counts_all_articles(spark, sf):
    from quillstream.plans.adapters import articles, registry

    known = {r.slug for r in registry(spark, sf).collect()}
    n = sum(r.source_slug in known for r in articles(spark, sf).select("source_slug").collect())
    got = catalogue.QUERIES["feed_health"](spark, sf).collect()
    assert sum(r.entries for r in got) == n and all(r.status != "DEAD" or r.entries == 0 for r in got)


def test_feed_health_of_a_dead_feed(spark):
    from quillstream.sources import feeds

    registry = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "slug string, enabled boolean")
    entries = spark.createDataFrame([("a",), ("a",), ("c",)], "source_slug string")
    assert sorted(map(tuple, feeds.feed_health(registry, entries).collect())) == [("a", 2, "ok"), ("b", 0, "DEAD"), ("c", 1, "skip")]
