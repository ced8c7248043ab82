"""The query catalogue: every operator over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import display as D
from quillstream.functions import scoring as S
from quillstream.functions import text as X
from quillstream.operators import neardup, ranks, reads, render, routing, selection, store, stories
from quillstream.operators.tables import written
from quillstream.plans.adapters import ARTICLES, LETTERS, LEXICON, REGISTRY, VOCAB, articles, registry
from quillstream.session import table
from quillstream.sources import feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CATEGORIES = [routing.BG, routing.GLOBAL, routing.TECH]


def query(sql: str | None = None):
    def add(f):
        def run(spark, sf):
            df = f(spark, sf)
            return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _hits(name: str) -> str:
    terms = VOCAB[name]
    test = lambda t: f"starts_with(t, '{t}')" if len(t) > 4 else f"t = '{t}'"
    return " + ".join(f"(len(list_filter(toks, lambda t: {test(t)})) > 0)::INT" for t in terms)


_TOKS = r"regexp_split_to_array(lower(concat_ws(' ', nullif(title, ''), nullif(substr(text, 1, 1500), ''))), '[^\p{L}\p{N}_]+') AS toks"
CLASSIFIED = f"""{ARTICLES}, t AS (SELECT *, {_TOKS} FROM a), h AS (SELECT *, {", ".join(f"{_hits(k)} AS {k}" for k in VOCAB)} FROM t),
 p AS (SELECT *, CASE WHEN civic > 0 OR "foreign" >= 2 THEN civic + "foreign" ELSE 0 END AS politics FROM h),
 c AS (SELECT *, CASE WHEN politics < 1 AND tech < 1 THEN NULL WHEN tech > politics THEN 'ai_tech_business'
   WHEN politics >= 1 AND (domestic >= 1 OR (lang = 'bg' AND "foreign" = 0)) THEN 'bg_politics' WHEN politics >= 1 THEN 'global_politics'
   WHEN tech >= 1 THEN 'ai_tech_business' END AS category FROM p)""".replace(" AS foreign", ' AS "foreign"')


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return routing.classify(articles(spark, sf_dir), X.haystack(F.col("title"), none, F.col("text")), F.col("lang"), F.lit(None).cast("array<string>"), VOCAB)


@query("SELECT page_id, (lower(url) LIKE '%/de/%' OR lower(url) LIKE '%ref=%' OR lower(url) LIKE '%casino%') AS noise FROM pages")
def url_section_noise(spark, sf):
    return table(spark, sf, "pages").select("page_id", routing.section_noise(F.col("url"), ["/de/", "ref=", "casino"]).alias("noise"))


@query(f"WITH {ARTICLES}, t AS (SELECT *, regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}_]+') AS toks FROM a) SELECT doc_id, len(list_filter(toks, lambda t: t IN ('the', 'der') OR starts_with(t, 'menta'))) > 0 AS noise FROM t")
def title_noise(spark, sf):
    return articles(spark, sf).select("doc_id", routing.is_noise(F.col("url"), F.col("title"), [], ["the", "der", "menta"]).alias("noise"))


@query(f"WITH {CLASSIFIED} SELECT doc_id, civic::BIGINT AS civic, \"foreign\"::BIGINT AS foreign_hits, tech::BIGINT AS tech, domestic::BIGINT AS domestic FROM h")
def vocab_hits(spark, sf):
    h = routing.hits(X.haystack(F.col("title"), F.lit(None).cast("string"), F.col("text")), VOCAB)
    each = articles(spark, sf).select("doc_id", F.explode(F.array(h)).alias("h"))
    return each.select("doc_id", *[F.col(f"h.{k}").cast("long").alias("foreign_hits" if k == "foreign" else k) for k in VOCAB])


@query(f"WITH {CLASSIFIED} SELECT doc_id, category FROM c WHERE category IS NOT NULL")
def classify_docs(spark, sf):
    return classified(spark, sf).filter("category is not null").select("doc_id", "category")


@query(f"WITH {CLASSIFIED}, {REGISTRY}, s AS (SELECT doc_id, category, coalesce(weight, 1.0) AS weight, length(title)::BIGINT AS title_chars, row_number() OVER (PARTITION BY category ORDER BY coalesce(weight, 1.0) DESC, length(title) DESC, doc_id) AS rank FROM c LEFT JOIN reg ON source_slug = slug WHERE category IS NOT NULL) SELECT category, rank::INT AS rank, doc_id, weight, title_chars FROM s WHERE rank <= 3")
def top3_per_category(spark, sf):
    df = routing.with_registry(classified(spark, sf).filter("category is not null").drop("text"), registry(spark, sf))
    top = routing.top_per(df, ["category"], [F.desc("weight"), F.desc(F.length("title")), F.col("doc_id")], 3)
    return top.select("category", "rank", "doc_id", "weight", F.length("title").cast("long").alias("title_chars"))


@query(f"WITH {ARTICLES}, q AS (SELECT *, row_number() OVER (PARTITION BY source_slug ORDER BY doc_id) AS n FROM a), v AS (SELECT *, row_number() OVER (PARTITION BY source_slug ORDER BY doc_id) AS m FROM q WHERE n <= 80 AND length(title) > 20) SELECT doc_id, source_slug FROM v WHERE m <= 40")
def per_source_cap(spark, sf):
    return routing.per_source_cap(articles(spark, sf), "source_slug", "doc_id", F.length("title") > 20).select("doc_id", "source_slug")


@query(f"WITH {ARTICLES} SELECT doc_id FROM a WHERE published_at >= TIMESTAMP '2026-01-02 12:00:00' - INTERVAL 30 HOURS")
def lookback(spark, sf):
    return routing.lookback(articles(spark, sf), "published_at", F.to_timestamp(F.lit("2026-01-02 12:00:00"))).select("doc_id")


@query(f"WITH {ARTICLES}, {REGISTRY} SELECT doc_id, coalesce(name, source_slug) AS name, coalesce(lean, 'unknown') AS lean, coalesce(reliability, 'medium') AS reliability, coalesce(weight, 1.0) AS weight FROM a LEFT JOIN reg ON source_slug = slug")
def registry_left_join_defaults(spark, sf):
    return routing.with_registry(articles(spark, sf), registry(spark, sf)).select("doc_id", "name", "lean", "reliability", "weight")


@query(f"WITH {CLASSIFIED}, {REGISTRY} SELECT category, count(DISTINCT source_slug) AS source_count, count(*) AS article_count, round(0.6 * max(CASE reliability WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 WHEN 'low' THEN 0.45 WHEN 'propaganda' THEN 0.15 ELSE 0.75 END) + 0.4 * least(count(DISTINCT source_slug) / 4.0, 1.0), 4)::DOUBLE AS credibility, min(published_at) AS first_seen, max(published_at) AS last_seen FROM c LEFT JOIN reg ON source_slug = slug WHERE category IS NOT NULL GROUP BY category")
def source_breadth(spark, sf):
    df = routing.with_registry(classified(spark, sf).filter("category is not null"), registry(spark, sf))
    out = df.groupBy("category").agg(F.collect_set("source_slug").alias("s"), F.collect_set("reliability").alias("r"), F.count("*").alias("article_count"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))
    return out.select("category", F.size("s").cast("long").alias("source_count"), "article_count", S.source_credibility(F.col("r"), F.col("s")).alias("credibility"), "first_seen", "last_seen")


@query("SELECT page_id, substr(sha256(url), 1, 32) AS url_hash FROM pages")
def url_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.url_hash(F.col("url")).alias("url_hash"))


@query(f"WITH {ARTICLES} SELECT title, substr(sha256(array_to_string(list_sort(list(url)), '|')), 1, 32) AS cluster_key FROM a GROUP BY title")
def cluster_key(spark, sf):
    """Keys of the simplest stories: the articles of one title."""
    return articles(spark, sf).groupBy("title").agg(X.cluster_key(F.collect_list("url")).alias("cluster_key"))


_NORMAL = r"list_filter(regexp_split_to_array(trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' '), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'des'))"


@query(f"SELECT doc_id, array_to_string({_NORMAL.format(c='text')}, ' ') AS words FROM documents")
def normalize_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize(F.col("text"), ["the", "and", "des"]).alias("words"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def exact_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "h").select("doc_id", "first_id", "copies")


@query()
def near_dup_greedy_keep(spark, sf):
    words = X.normalize(F.concat_ws(" ", "title", F.substring("text", 1, 400)))
    df = articles(spark, sf).select("doc_id", "source_slug", stories.simhash(words).alias("simhash"))
    return neardup.drop_near_duplicates(df, "source_slug", "doc_id", "simhash")


def _titles(spark, sf) -> DataFrame:
    """doc_id and the words of each first line."""
    return articles(spark, sf).select("doc_id", X.tokens(X.normalize(F.col("title"))).alias("words"))


#: t: every document with the set of its title's words; c: the documents of equal sets, by the smallest; p: pairs of classes.
_TITLES = f"""{ARTICLES},
 w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda w: length(w) >= 3) AS words FROM a),
 t AS (SELECT doc_id, list_sort(list_distinct(words)) AS s FROM w),
 c AS (SELECT s, min(doc_id) AS doc_id, len(s) AS n FROM t WHERE len(s) > 0 GROUP BY s),
 e AS (SELECT doc_id, n, unnest(s) AS w FROM c),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / (min(x.n) + min(y.n) - count(*)) AS similarity
       FROM e x JOIN e y ON x.w = y.w AND x.doc_id <> y.doc_id GROUP BY ALL HAVING count(*) / (min(x.n) + min(y.n) - count(*)) >= 0.35)"""


def _title_edges(spark, sf) -> DataFrame:
    return stories.with_copies(_titles(spark, sf), "doc_id", stories.word_set(F.col("words")), lambda one: stories.jaccard_edges(one, "a", "items", 0.35))


@query(f"""WITH {_TITLES} SELECT a, b, round(similarity, 6)::DOUBLE AS similarity FROM p WHERE a < b
 UNION ALL SELECT c.doc_id, t.doc_id, 1.0::DOUBLE FROM t JOIN c USING (s) WHERE t.doc_id > c.doc_id""")
def jaccard_headline_pairs(spark, sf):
    """Pairs of different titles' words, each class by its smallest document, and that document with each of its copies."""
    return _title_edges(spark, sf).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("WITH e AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda w: length(w) >= 3))) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM e GROUP BY item_id), p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS k FROM e x JOIN e y ON x.w = y.w AND x.item_id < y.item_id GROUP BY ALL) SELECT a, b, round(k / least(i.n, j.n), 6)::DOUBLE AS similarity FROM p JOIN n i ON i.item_id = a JOIN n j ON j.item_id = b WHERE k >= 3 AND k / least(i.n, j.n) >= 0.15")
def containment_pairs(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("words", X.tokens(X.normalize(F.col("text"))))
    return stories.containment_edges(b, "item_id", "words", 0.15).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("WITH f AS (SELECT item_id, replace(lower(text), ' ', '') AS t FROM benchmark), g AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)))) AS g FROM f), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id), p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.item_id < y.item_id GROUP BY ALL) SELECT a, b, round(k / (i.n + j.n - k), 6)::DOUBLE AS similarity FROM p JOIN n i ON i.item_id = a JOIN n j ON j.item_id = b WHERE k / (i.n + j.n - k) >= 0.1")
def char4gram_pairs(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("grams", X.char_ngrams(F.lower("text")))
    return stories.jaccard_edges(b, "item_id", "grams", 0.1).select("a", "b", F.round("similarity", 6).alias("similarity"))


_TFIDF = """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda w: length(w) >= 3) AS w FROM benchmark),
 t AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
 tf AS (SELECT item_id, term, 1 + ln(count(*)) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 x AS (SELECT item_id, tf.term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN d USING (term)),
 v AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM x),
 p AS (SELECT i.item_id AS a, j.item_id AS b, sum(i.w * j.w) AS s FROM v i JOIN v j ON i.term = j.term AND i.item_id < j.item_id GROUP BY ALL)
 SELECT a, b, round(s, 5) AS similarity FROM p WHERE s >= 0.02"""


@query(_TFIDF)
def tfidf_cosine_pairs(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("words", X.tokens(X.normalize(F.col("text"))))
    return stories.cosine_edges(stories.tfidf(b, "item_id", "words"), 0.02).select("a", "b", F.round("similarity", 5).alias("similarity"))


def _classified_words(spark, sf, text) -> DataFrame:
    """category, doc_id and the words of every article that has a category."""
    return classified(spark, sf).filter("category is not null").select("category", "doc_id", X.tokens(X.normalize(text)).alias("words"))


@query()
def article_containment_pairs(spark, sf):
    t = _classified_words(spark, sf, F.col("title"))
    return stories.title_links(t, "doc_id", F.col("words")).withColumn("similarity", F.round("similarity", 6))


@query()
def article_tfidf_pairs(spark, sf):
    t = _classified_words(spark, sf, F.concat_ws(" ", "title", "text"))
    return stories.text_links(t, "doc_id", F.col("words")).withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH RECURSIVE {_TITLES}, l(a, r) AS (SELECT a, b FROM p UNION SELECT l.a, p.b FROM l JOIN p ON p.a = l.r),
 m AS (SELECT a, least(a, min(r)) AS root FROM l GROUP BY a)
 SELECT t.doc_id AS node, coalesce(m.root, c.doc_id, t.doc_id) AS root FROM t LEFT JOIN c USING (s) LEFT JOIN m ON m.a = c.doc_id""")
def story_components(spark, sf):
    """Every document with the smallest of its component; one whose title has no words, or that is like no other, is its own."""
    roots = stories.components(_title_edges(spark, sf))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("node"))
    return docs.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


@query(f"""WITH {_TITLES}, o AS (SELECT DISTINCT s FROM t WHERE len(s) > 0 AND doc_id % 2 = 1), v AS (SELECT s, min(doc_id) AS parent_key FROM t WHERE len(s) > 0 AND doc_id % 2 = 0 GROUP BY s),
 ow AS (SELECT s, unnest(s) AS w FROM o), vw AS (SELECT parent_key, len(s) AS n, unnest(s) AS w FROM v),
 k AS (SELECT ow.s, parent_key, count(*) / (min(len(ow.s)) + min(n) - count(*)) AS similarity FROM ow JOIN vw USING (w) GROUP BY ALL),
 m AS (SELECT * FROM k WHERE similarity >= 0.35 QUALIFY row_number() OVER (PARTITION BY s ORDER BY similarity DESC, parent_key) = 1)
 SELECT doc_id AS key, parent_key, round(similarity, 6)::DOUBLE AS similarity FROM t JOIN m USING (s) WHERE doc_id % 2 = 1""")
def continuity_best_match(spark, sf):
    """For every odd document, as a story of today, the even one, as a story of the days before, whose title is most alike."""
    t = _titles(spark, sf).withColumnRenamed("doc_id", "key")
    return stories.best_match(t.filter("key % 2 = 1"), t.filter("key % 2 = 0")).select("key", "parent_key", F.round("similarity", 6).alias("similarity"))


@query("WITH RECURSIVE c AS (SELECT o_orderkey AS key, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_key FROM orders), u(start, ancestor, depth) AS (SELECT key, parent_key, 1 FROM c WHERE parent_key IS NOT NULL UNION ALL SELECT u.start, c.parent_key, u.depth + 1 FROM u JOIN c ON c.key = u.ancestor WHERE c.parent_key IS NOT NULL AND u.depth < 7) SELECT start, ancestor, depth FROM u")
def lineage(spark, sf):
    o = table(spark, sf, "orders")
    chain = o.select(F.col("o_orderkey").alias("key"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("parent_key"))
    return stories.lineage(chain)


_SIGNAL = {"purchase": "more", "signup": "deep_dive", "error": "irrelevant", "click": "less"}


@query("SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(CASE event_type WHEN 'purchase' THEN 0.15::DOUBLE WHEN 'signup' THEN 0.2::DOUBLE WHEN 'click' THEN -0.15::DOUBLE WHEN 'error' THEN -0.3::DOUBLE ELSE 0.0::DOUBLE END ORDER BY ts, event_id)), lambda a, x: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, a + x))), 6) + 0.0 AS weight FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id")
def interest_weights(spark, sf):
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _SIGNAL.items() for x in p]), F.col("event_type")), F.lit("other"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("tag"), name.alias("signal"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return reads.interests(e, F.lit("2024-03-15").cast("timestamp")).select(F.col("tag").alias("user_id"), (F.round("weight", 6) + 0.0).alias("weight"))


_DIMS = ["rule_of_law", "media_freedom", "minority_rights", "other"]
_RUBRIC = """b AS (SELECT d.doc_id, l.toxic = 1 OR d.doc_id % 3 = 0 AS relevant, (d.doc_id % 11) / 10.0::DOUBLE AS significance, (d.doc_id % 7) / 7.0::DOUBLE AS novelty, l.quality::DOUBLE AS credibility,
   (d.doc_id % 5 - 2)::INT AS d1, ((d.doc_id // 5) % 5 - 2)::INT AS d2, (d.doc_id % 10) / 10.0::DOUBLE AS c1, ((d.doc_id // 10) % 10) / 10.0::DOUBLE AS c2, [1.0, 0.9, 0.7, 0.6][d.doc_id % 4 + 1]::DOUBLE AS w1, [1.0, 0.9, 0.7, 0.6][(d.doc_id + 1) % 4 + 1]::DOUBLE AS w2 FROM documents d JOIN labels l USING (doc_id)),
 g AS (SELECT *, CASE WHEN relevant AND doc_id % 13 <> 0 AND w1 * c1 + w2 * c2 > 0 THEN (d1 * w1 * c1 + d2 * w2 * c2) / (w1 * c1 + w2 * c2) ELSE 0.0 END AS direction FROM b)"""


def rubric(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    dim = lambda k: F.element_at(F.array(*map(F.lit, _DIMS)), ((i + k) % 4 + 1).cast("int"))
    impact = lambda k, d, c: F.struct(dim(k).alias("dimension"), d.cast("int").alias("direction"), c.alias("confidence"), F.when(i % 5 == 0, "too short").otherwise("a rationale of six words here").alias("rationale"))
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id")
    impacts = F.array(impact(0, i % 5 - 2, (i % 10) / 10.0), impact(1, F.floor(i / 5) % 5 - 2, (F.floor(i / 10) % 10) / 10.0))
    d = d.select("doc_id", ((F.col("toxic") == 1) | (i % 3 == 0)).alias("relevant"), ((i % 11) / 10.0).alias("significance"), ((i % 7) / 7.0).alias("novelty"), F.col("quality").cast("double").alias("credibility"), (i % 5 - 2).cast("int").alias("net_direction"), F.when(i % 2 == 0, "another reading").alias("contrarian"), F.filter(impacts, lambda _: i % 13 != 0).alias("impacts"))
    return d.withColumn("direction", S.weighted_direction(F.col("relevant"), F.col("impacts")))


@query(f"WITH {_RUBRIC} SELECT doc_id, round(direction, 6) AS direction FROM g")
def weighted_direction(spark, sf):
    return rubric(spark, sf).select("doc_id", F.round("direction", 6).alias("direction"))


@query(f"WITH {_RUBRIC} SELECT doc_id, CASE WHEN relevant THEN round(0.65::DOUBLE * significance + 0.35::DOUBLE * least(abs(direction) / 2, 1.0), 4) ELSE 0.0 END AS democracy, CASE WHEN direction < -0.15 THEN 'erosion' WHEN direction > 0.15 THEN 'strengthening' ELSE 'neutral' END AS tone FROM g")
def democracy_score(spark, sf):
    return rubric(spark, sf).select("doc_id", S.democracy_score(F.col("relevant"), F.col("significance"), F.col("direction")).alias("democracy"), X.tone(F.col("direction")).alias("tone"))


_FLAGGED = f"""{_RUBRIC}, fl AS (SELECT *, list_filter([
   CASE WHEN relevant AND significance > 0.7 AND credibility < 0.5 THEN 'high_significance_low_credibility' END, CASE WHEN relevant AND doc_id % 13 = 0 THEN 'relevant_but_no_dimensions' END,
   CASE WHEN relevant AND abs(d1) >= 2 AND novelty < 0.4 THEN 'strong_verdict_thin_sourcing' END, CASE WHEN doc_id % 13 <> 0 AND doc_id % 5 = 0 THEN 'thin_rationale' END,
   CASE WHEN relevant AND doc_id % 2 <> 0 THEN 'no_counterview' END], lambda x: x IS NOT NULL) AS flags FROM g),
 sc AS (SELECT fl.*, source, lang, DATE '2026-01-01' + (doc_id % 30)::INT AS digest_date, ['bg_politics', 'global_politics', 'ai_tech_business'][doc_id % 3 + 1] AS category,
   CASE WHEN relevant THEN round(0.65::DOUBLE * significance + 0.35::DOUBLE * least(abs(direction) / 2, 1.0), 4) ELSE 0.0 END AS democracy,
   round(0.5::DOUBLE * credibility + 0.5::DOUBLE * round(0.6::DOUBLE * (CASE substr(source, 4)::INT % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.45 ELSE 0.15 END)::DOUBLE + 0.1::DOUBLE, 4), 4) AS believed,
   CASE WHEN lang = 'en' THEN 0.5::DOUBLE + 0.25::DOUBLE WHEN lang = 'de' THEN 0.5::DOUBLE - 0.75::DOUBLE + 0.25::DOUBLE ELSE 0.5::DOUBLE END AS mine,
   (CASE WHEN doc_id % 2 = 0 THEN 0.08 ELSE 0.06 END)::DOUBLE + 0.05::DOUBLE * len(flags) + (CASE WHEN doc_id % 4 = 0 AND novelty < 0.4 THEN 0.1 ELSE 0 END)::DOUBLE AS penalty FROM fl JOIN documents USING (doc_id))"""


def scored(spark, sf) -> DataFrame:
    """Rubric, flags, penalties and total of every labelled document, with a digest date and a category."""
    i = F.col("doc_id")
    n = F.substring("source", 4, 9).cast("int")
    reliability = F.element_at(F.array(*map(F.lit, ["high", "medium", "low", "propaganda"])), n % 4 + 1)
    r = rubric(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    flags = S.sanity_flags(F.col("significance"), F.col("credibility"), F.col("relevant"), F.col("impacts"), F.col("net_direction"), F.col("novelty"), F.col("contrarian"))
    r = r.withColumn("flags", flags)
    inputs = (F.when(i % 2 == 0, 1).otherwise(2), F.array(F.lit("center")), F.col("flags"), i % 4 == 0, F.col("novelty"))
    interests = F.create_map(F.lit("en"), F.lit(0.25), F.lit("de"), F.lit(-0.5))
    r = r.withColumns({
        "digest_date": F.date_add(F.lit("2026-01-01").cast("date"), (i % 30).cast("int")), "key": i.cast("string"), "category": F.element_at(F.array(*map(F.lit, CATEGORIES)), (i % 3 + 1).cast("int")),
        "democracy": S.democracy_score(F.col("relevant"), F.col("significance"), F.col("direction")),
        "believed": S.blended_credibility(F.col("credibility"), S.source_credibility(F.array(reliability), F.array("source"))),
        "mine": S.personal(F.array("lang", "source"), interests), "penalty": S.penalties(*inputs), "reasons": S.penalty_reasons(*inputs),
    })
    return r.withColumn("total", S.selection_total(F.col("democracy"), F.col("significance"), F.col("novelty"), F.col("believed"), F.col("mine"), F.col("penalty")))


@query(f"WITH {_FLAGGED} SELECT doc_id, array_to_string(flags, ',') AS flags FROM fl")
def sanity_flags(spark, sf):
    return scored(spark, sf).select("doc_id", F.array_join("flags", ",").alias("flags"))


@query(f"WITH {_FLAGGED} SELECT doc_id, believed, round(penalty, 6) AS penalty, round((0.3::DOUBLE * democracy + 0.25::DOUBLE * significance + 0.2::DOUBLE * novelty + 0.15::DOUBLE * believed + 0.1::DOUBLE * mine - penalty)::VARCHAR::DECIMAL(30, 20), 4)::DOUBLE AS total FROM sc".replace("0.5::DOUBLE - 0.75::DOUBLE + 0.25::DOUBLE", "0.0::DOUBLE"))
def selection_score(spark, sf):
    return scored(spark, sf).select("doc_id", "believed", F.round("penalty", 6).alias("penalty"), "total")


@query(f"WITH {_FLAGGED} SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 2 = 0 THEN 'single source' ELSE 'one editorial lean' END, CASE WHEN len(flags) > 0 THEN 'flags: ' || array_to_string(flags, ', ') END, CASE WHEN doc_id % 4 = 0 AND novelty < 0.4 THEN 'ran yesterday, little new' END) AS reasons FROM sc")
def penalty_reasons(spark, sf):
    return scored(spark, sf).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


@query(f"SELECT * REPLACE (digest_date::VARCHAR AS digest_date) FROM (WITH {_FLAGGED} SELECT digest_date, count(*) AS stories, count(*) FILTER (relevant) AS democracy_relevant, coalesce(round(avg(direction) FILTER (relevant), 3), 0.0) AS net_direction, CASE WHEN count(*) FILTER (relevant) > 0 THEN count(*) FILTER (relevant AND direction < -0.3) END AS erosion_stories, CASE WHEN count(*) FILTER (relevant) > 0 THEN count(*) FILTER (relevant AND direction > 0.3) END AS strengthening_stories, round(avg(significance) FILTER (relevant), 3) AS mean_significance FROM sc GROUP BY 1)")
def daily_summary(spark, sf):
    return selection.daily_summary(scored(spark, sf))


@query("WITH d AS (SELECT ts::DATE::VARCHAR AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1) SELECT * FROM (SELECT * FROM d ORDER BY day DESC LIMIT 10) ORDER BY day")
def trend_last_n(spark, sf):
    d = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return selection.last_ascending(d, "day", 10)


@query(f"WITH {_RUBRIC}, s AS (SELECT *, doc_id % 30 AS day, CASE WHEN relevant THEN round(0.65::DOUBLE * significance + 0.35::DOUBLE * least(abs(direction) / 2, 1.0), 4) ELSE 0.0 END AS democracy FROM g), p AS (SELECT day, doc_id AS key, democracy FROM s WHERE relevant QUALIFY row_number() OVER (PARTITION BY day ORDER BY democracy DESC, novelty DESC, doc_id) = 1) SELECT * FROM p WHERE democracy >= 0.35")
def deep_dive_pick(spark, sf):
    r = rubric(spark, sf).withColumns({"day": F.col("doc_id") % 30, "key": F.col("doc_id"), "total": F.col("novelty"), "democracy": S.democracy_score(F.col("relevant"), F.col("significance"), F.col("direction"))})
    return selection.deep_dive(r, "day").select("day", "key", "democracy")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, n / 16.0::DOUBLE AS p, sum(n / 16.0::DOUBLE) OVER (PARTITION BY user_id) AS s FROM c) SELECT user_id, event_type, CASE WHEN abs(s - 1) > 0.15 AND s > 0 THEN round(least(p / s, 1.0::DOUBLE)::DECIMAL(18, 12), 3)::DOUBLE ELSE p END AS p FROM p")
def normalize_probs(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg((F.count("*") / 16.0).alias("p"))  # sums are exact
    g = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "p"))).alias("x"))
    g = g.select("user_id", F.arrays_zip(F.col("x.event_type").alias("event_type"), S.normalize_probabilities(F.col("x.p")).alias("p")).alias("x"))
    return g.select("user_id", F.inline("x").alias("event_type", "p"))


@query("SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def stories_latest(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    return j.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "c_name", "o_orderdate")


def _slices(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    old = c.filter("c_custkey % 3 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")))
    return old, c.filter("c_custkey % 2 = 0").withColumns({"c_acctbal": F.col("c_acctbal") + 1, "c_mktsegment": F.lit("NEW")})


_SLICES = "o AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, c_name, c_acctbal + 1 AS c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0)"


@query(f"WITH {_SLICES} SELECT c_custkey, coalesce(nullif(o.c_name, ''), n.c_name, o.c_name) AS c_name, round(coalesce(n.c_acctbal, o.c_acctbal), 4) AS c_acctbal, coalesce(o.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM o FULL JOIN n USING (c_custkey)")
def snapshot_upsert(spark, sf):
    old, new = _slices(spark, sf)
    return store.upsert(old, new, ["c_custkey"], keep=["c_mktsegment"], fill=["c_name"]).withColumn("c_acctbal", F.round("c_acctbal", 4))


@query(f"WITH {_SLICES} SELECT c_custkey, c_mktsegment FROM o UNION ALL SELECT c_custkey, c_mktsegment FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def insert_if_absent(spark, sf):
    old, new = _slices(spark, sf)
    return store.insert_absent(old, new, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("WITH a AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, min(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL) SELECT user_id, event_type, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (user_id, event_type)")
def map_deep_merge(spark, sf):
    e = table(spark, sf, "events")
    m = lambda d, f, n: d.groupBy("user_id", "event_type").agg(f("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias(n))
    both = m(e.filter("event_id % 2 = 0"), F.max, "a").join(m(e.filter("event_id % 2 = 1"), F.min, "b"), "user_id", "full_outer")
    return both.select("user_id", F.explode(store.merge_maps(F.col("a"), F.col("b"))).alias("event_type", "v"))


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system')")
def contested_filter(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.bool_or(F.col("role") == "system").alias("hit"))
    return g.filter("hit").select("conv_id", "turns")


@query(f"""WITH {ARTICLES}, x AS (SELECT source_slug, unnest({_NORMAL.format(c='title').replace(" AND w NOT IN ('the', 'and', 'des')", "")}) AS entity FROM a),
 y AS (SELECT source_slug, unnest({_NORMAL.format(c='text').replace(" AND w NOT IN ('the', 'and', 'des')", "")}) AS entity FROM a)
 SELECT DISTINCT source_slug, entity FROM y WHERE (source_slug, entity) NOT IN (SELECT source_slug, entity FROM x)""")
def entity_postings(spark, sf):
    """What the texts add to the postings (source, word) that the titles have made."""
    a = articles(spark, sf)
    posted = lambda c: a.select("source_slug", F.explode(F.array_distinct(X.tokens(X.normalize(F.col(c))))).alias("entity"))
    return store.append_once(posted("title").distinct(), posted("text"))


@query("SELECT count(*) AS fetched, count(*) FILTER (lower(url) LIKE '%/de/%') AS noise, count(DISTINCT url) AS urls FROM pages")
def run_stats(spark, sf):
    return table(spark, sf, "pages").agg(F.count("*").alias("fetched"), F.count_if(routing.section_noise(F.col("url"), ["/de/"])).alias("noise"), F.count_distinct("url").alias("urls"))


@query(f"WITH {ARTICLES}, {REGISTRY}, k AS (SELECT source_slug, count(*) AS entries FROM a GROUP BY 1) SELECT slug, coalesce(entries, 0) AS entries, CASE WHEN reg.n % 6 = 5 THEN 'skip' WHEN coalesce(entries, 0) = 0 THEN 'DEAD' ELSE 'ok' END AS status FROM reg LEFT JOIN k ON slug = source_slug")
def feed_health(spark, sf):
    return feeds.feed_health(registry(spark, sf), articles(spark, sf))


@query()
def html_text(spark, sf):
    return feeds.pages_text(table(spark, sf, "pages"))


@query()
def chunk_messages(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunk_messages(F.col("text"))).alias("seq", "chunk"))


@query()
def constrained_top3(spark, sf):
    c = classified(spark, sf).filter("category is not null")
    words = F.slice(X.tokens(X.normalize(F.col("title"))), 1, 3)
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("digest_date")
    return selection.select_top(c.select(day, "category", F.col("doc_id").cast("string").alias("key"), ((F.col("doc_id") % 97) / 97.0).alias("total"), words.alias("entities")), CATEGORIES)


@query("SELECT doc_id, trim(regexp_replace(lower(substr(split_part(text, chr(10), 1), 1, 160)), '[^a-z0-9]+', '-', 'g'), '-') [1:48] AS slug FROM documents")
def slugs(spark, sf):
    return articles(spark, sf).select("doc_id", X.slug(F.col("title")).alias("slug"))


def _told(spark, sf) -> DataFrame:
    """Articles with what clustering reads: title, the whole text in place of a summary, weight and order."""
    a = routing.with_registry(classified(spark, sf).filter("category is not null"), registry(spark, sf))
    return a.select("category", "title", F.col("text").alias("summary"), "url", "source_slug", "published_at", "weight", F.col("doc_id").alias("ordinal"), "lang")


@query()
def cluster_articles(spark, sf):
    """Stories of a forward pass in every category, at the production thresholds."""
    members = written(stories.cluster_articles(_told(spark, sf)).drop("summary"), "members")
    return stories.story_rows(members).select("category", "root", "key", "headline", "article_count", "source_count")


@query()
def cluster_by_category(spark, sf):
    """Stories after the merge across languages: every document with its story's key."""
    members, merged = stories.cluster_by_category(_told(spark, sf), lambda title: X.signature(title, LEXICON, LETTERS), without=("summary",))
    return members.join(merged.select("category", "root", "key"), ["category", "root"]).select("category", "key", F.col("ordinal").alias("doc_id"))


_ITEMS = f"{_FLAGGED}, it AS (SELECT *, doc_id::VARCHAR AS key, row_number() OVER (PARTITION BY digest_date, category ORDER BY doc_id) AS place FROM sc)"


def _items(spark, sf) -> DataFrame:
    return scored(spark, sf).select("doc_id", "digest_date", "category", "key", "relevant", "net_direction", "direction", "significance", "novelty", "believed", "democracy", "total", F.array("lang", "source").alias("tags"), F.array(F.struct(F.when(F.col("doc_id") % 4 == 0, "contested").otherwise("established").alias("status"))).alias("claims"))


@query(f"WITH {_ITEMS} SELECT key, category FROM it WHERE digest_date = (SELECT max(digest_date) FROM it)")
def latest_digest(spark, sf):
    return reads.latest_digest(_items(spark, sf)).select("key", "category")


@query(f"SELECT * REPLACE (digest_date::VARCHAR AS digest_date) FROM (WITH {_ITEMS} SELECT DISTINCT digest_date FROM it ORDER BY 1 DESC LIMIT 7)")
def digest_dates(spark, sf):
    return reads.digest_dates(_items(spark, sf), 7)


@query(f"SELECT * REPLACE (digest_date::VARCHAR AS digest_date) FROM (WITH {_ITEMS} SELECT DISTINCT digest_date + 1 AS digest_date, key FROM it WHERE digest_date + 1 IN (SELECT digest_date FROM it))")
def previous_keys(spark, sf):
    return reads.previous_keys(_items(spark, sf), _items(spark, sf))


@query(f"WITH {_ITEMS} SELECT doc_id FROM it WHERE doc_id % 4 = 0 UNION ALL SELECT -doc_id FROM it WHERE relevant AND d1 < 0")
def dashboard_views(spark, sf):
    i = _items(spark, sf)
    return reads.dashboard(i, "contested").select("doc_id").unionByName(reads.dashboard(i, "erosion").select((-F.col("doc_id")).alias("doc_id")))


@query(f"SELECT * REPLACE (digest_date::VARCHAR AS digest_date) FROM (WITH {_ITEMS}, t AS (SELECT DISTINCT digest_date, unnest([lang, source]) AS tag FROM it), r AS (SELECT *, row_number() OVER (PARTITION BY digest_date ORDER BY tag) AS r FROM t) SELECT digest_date, string_agg(tag, ',' ORDER BY tag) AS tags FROM r WHERE r <= 12 GROUP BY 1)")
def top_tags(spark, sf):
    return reads.top_tags(_items(spark, sf)).select("digest_date", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_ITEMS} SELECT doc_id, category, CASE WHEN doc_id % 5 = 0 THEN 'cluster ' || key ELSE 'said ' || key END AS headline FROM it WHERE category = 'global_politics' ORDER BY doc_id DESC LIMIT 50")
def stories_read(spark, sf):
    i = _items(spark, sf)
    clusters = i.select("key", "category", F.concat(F.lit("cluster "), "key").alias("headline"), F.lit(1).alias("source_count"))
    said = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("said "), "key"))
    a = i.select(F.col("key").alias("cluster_key"), said.alias("headline"), F.col("significance").alias("democracy_significance"), F.col("net_direction").alias("democracy_net"), "novelty", F.col("believed").alias("credibility"), F.timestamp_seconds("doc_id").alias("created_at"))
    return reads.stories_read(clusters, a, "global_politics").select(F.col("key").cast("long").alias("doc_id"), "category", "headline")


@query(f"SELECT * REPLACE (digest_date::VARCHAR AS digest_date) FROM (WITH {_ITEMS}, d AS (SELECT digest_date, count(*) FILTER (relevant) AS n, round(avg(significance), 6) AS m FROM it GROUP BY 1) SELECT digest_date, CASE WHEN n % 2 = 0 THEN m ELSE 0.0 END AS net_direction, n::DOUBLE AS relevant FROM (SELECT * FROM d ORDER BY digest_date DESC LIMIT 10))")
def democracy_trend(spark, sf):
    d = _items(spark, sf).groupBy("digest_date").agg(F.count_if("relevant").cast("double").alias("n"), F.round(F.avg("significance"), 6).alias("m"))
    both, one = F.create_map(F.lit("democracy_relevant"), "n", F.lit("net_direction"), "m"), F.create_map(F.lit("democracy_relevant"), F.col("n"))
    return reads.trend(d.select("digest_date", F.when(F.col("n") % 2 == 0, both).otherwise(one).alias("stats")), 10).select("digest_date", "net_direction", "relevant")


@query(f"WITH {ARTICLES}, {REGISTRY} SELECT doc_id, coalesce(slug, '?') AS source_slug, coalesce(name, '?') AS source_name, coalesce(lean, 'unknown') AS lean, coalesce(reliability, 'medium') AS reliability FROM a LEFT JOIN reg ON slug = source_slug")
def refs_of(spark, sf):
    a = articles(spark, sf).withColumn("cluster_key", (F.col("doc_id") % 3).cast("string"))
    refs = reads.refs_of(a.select(F.col("cluster_key").alias("key")).distinct(), a, registry(spark, sf))
    return refs.select(F.substring_index("url", "/", -1).cast("long").alias("doc_id"), "source_slug", "source_name", "lean", "reliability")


_CLUSTERS = "o AS (SELECT c_custkey AS k, c_name AS headline, c_nationkey AS seen, CASE WHEN c_custkey % 4 = 0 THEN 'p' END AS parent FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, 'new' AS headline, c_nationkey + 100 AS seen, CASE WHEN c_custkey % 6 = 0 THEN 'q' END AS parent FROM customer WHERE c_custkey % 2 = 0)"


@query(f"WITH {_CLUSTERS} SELECT k::VARCHAR AS key, coalesce(n.headline, o.headline) AS headline, coalesce(o.seen, n.seen) AS first_seen, coalesce(n.seen, o.seen) AS last_seen, coalesce(n.parent, o.parent) AS parent_key FROM o FULL JOIN n USING (k)")
def cluster_upsert(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    row = lambda d, headline, seen, parent: d.select(k.cast("string").alias("key"), F.lit("x").alias("category"), headline.alias("headline"), seen.alias("first_seen"), seen.alias("last_seen"), parent.alias("parent_key"))
    old = row(c.filter(k % 3 != 0), F.col("c_name"), F.col("c_nationkey"), F.when(k % 4 == 0, "p"))
    new = row(c.filter(k % 2 == 0), F.lit("new"), F.col("c_nationkey") + 100, F.when(k % 6 == 0, "q"))
    return store.upsert_clusters(old, new).drop("category")


@query(f"WITH {ARTICLES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source_slug ELSE 'old' END AS cluster_key FROM a")
def member_repoint(spark, sf):
    a = articles(spark, sf).withColumn("cluster_key", F.lit("old"))
    members = a.filter("doc_id % 2 = 0").select("url", F.col("source_slug").alias("key"))
    return store.point_members(a, members).select("doc_id", "cluster_key")


@query(f"""WITH {_ITEMS} SELECT key, CASE WHEN doc_id % 2 = 1 THEN -1.0 WHEN relevant THEN significance ELSE 0.0 END::DOUBLE AS democracy_significance,
 CASE WHEN doc_id % 2 = 1 THEN 9 ELSE d1 END::INT AS democracy_net FROM it WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def analysis_upsert(spark, sf):
    """Stored analyses of some stories, and one of every story now, of which only those of known clusters count."""
    a = _items(spark, sf).withColumn("cluster_key", F.col("key"))
    old = a.filter("doc_id % 3 = 0").select("cluster_key", "relevant", F.lit(-1.0).alias("significance"), F.lit(9).alias("net_direction"))
    old = old.withColumns({"democracy_significance": F.col("significance"), "democracy_net": F.col("net_direction")})
    out = store.upsert_analyses(old, a.select("cluster_key", "relevant", "significance", "net_direction"), a.filter("doc_id % 2 = 0").select("key"))
    return out.select(F.col("cluster_key").alias("key"), "democracy_significance", "democracy_net")


@query(f"""SELECT * REPLACE (digest_date::VARCHAR AS digest_date) FROM (WITH {_ITEMS}, d AS (SELECT digest_date, count(*) AS n, min(key) AS cluster_key, day(digest_date) AS day FROM it GROUP BY 1),
 k AS (SELECT DISTINCT key FROM it WHERE doc_id % 3 = 0)
 SELECT digest_date, n || ' stories' AS editorial_note, CASE WHEN day % 2 = 0 THEN 'new.md' ELSE 'old.md' END AS markdown_path,
  CASE WHEN day % 5 = 0 THEN 'first' WHEN cluster_key IN (SELECT key FROM k) THEN cluster_key END AS deep_dive_of, CASE WHEN day % 5 = 0 OR cluster_key IN (SELECT key FROM k) THEN 'dive ' || n END AS deep_dive FROM d)""")
def digest_records(spark, sf):
    """Digests stored once more: the note is new, a path that isn't given stays, and so does the cluster of a stored deep dive."""
    i = _items(spark, sf)
    new = i.groupBy("digest_date").agg(F.count("*").alias("n"), F.min("key").alias("cluster_key"))
    day = F.dayofmonth("digest_date")
    digests = new.select("digest_date", F.concat(F.col("n").cast("string"), F.lit(" stories")).alias("editorial_note"), F.when(day % 2 == 0, "new.md").otherwise("").alias("markdown_path"))
    saved = store.save_digests(digests.withColumns({"editorial_note": F.lit("before"), "markdown_path": F.lit("old.md")}), digests)
    dives = new.select("digest_date", "cluster_key", F.concat(F.lit("dive "), F.col("n").cast("string")).alias("payload"))
    had = dives.filter(day % 5 == 0).withColumns({"cluster_key": F.lit("first"), "payload": F.lit("before")})
    dives = store.save_deep_dives(had, dives, i.filter("doc_id % 3 = 0").select("key").distinct())
    return saved.join(dives.select("digest_date", F.col("cluster_key").alias("deep_dive_of"), F.col("payload").alias("deep_dive")), "digest_date", "left")


_SAID = """s AS (SELECT conv_id, turn // 2 AS key, max(coalesce(text, '')) AS text FROM conversations WHERE role = 'user' GROUP BY ALL),
 x AS (SELECT conv_id, turn // 3 AS key, max(coalesce(text, '')) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL),
 y AS (SELECT conv_id, turn // 5 AS key, min(coalesce(text, '')) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL)"""


def _partial_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Digests (one per conversation) with a stored translation, and two partial runs over them."""
    c = table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))

    def part(role: str, width: int, best) -> DataFrame:
        each = c.filter(F.col("role") == role).groupBy(F.col("conv_id").alias("digest_date"), F.floor(F.col("turn") / width).cast("string").alias("key")).agg(best("text").alias("text"))
        return each.groupBy("digest_date").agg(F.map_from_entries(F.collect_list(F.struct("key", "text"))).alias("items"))

    stored = F.struct(F.lit("before").alias("editorial_note"), F.col("items"), F.when(F.col("digest_date") % 3 == 0, "dive").alias("deep_dive"))
    digests = c.select(F.col("conv_id").alias("digest_date")).distinct().join(part("user", 2, F.max), "digest_date", "left")
    digests = digests.withColumn("translations", F.when(F.col("items").isNotNull(), F.create_map(F.lit("bg"), stored))).drop("items")
    run = lambda k, d, note: d.select(F.lit(k).alias("run"), "digest_date", F.lit("bg").alias("lang"), note.alias("editorial_note"), "items", F.lit(None).cast("string").alias("deep_dive"))
    second = F.when(F.col("digest_date") % 2 == 1, "after")
    return digests, run(1, part("assistant", 3, F.max), F.lit("")).unionByName(run(2, part("assistant", 5, F.min), second))


@query(f"""WITH {_SAID}, m AS (SELECT conv_id, key, coalesce(y.text, x.text, s.text) AS text FROM s FULL JOIN x USING (conv_id, key) FULL JOIN y USING (conv_id, key))
 SELECT conv_id AS digest_date, key::VARCHAR AS key, text, CASE WHEN conv_id % 2 = 1 AND conv_id IN (SELECT conv_id FROM y) THEN 'after' WHEN conv_id IN (SELECT conv_id FROM s) THEN 'before' END AS editorial_note FROM m""")
def translation_merge(spark, sf):
    """A stored translation after two partial runs: every story's text by the last run that had it, and the last note."""
    digests, runs = _partial_runs(spark, sf)
    out = store.merge_translations(digests, runs)[0].select("digest_date", F.col("translations")["bg"].alias("t"))
    return out.select("digest_date", F.explode("t.items").alias("key", "text"), F.col("t.editorial_note").alias("editorial_note"))


@query(f"""WITH {_SAID}, i AS (SELECT conv_id, count(DISTINCT turn // 2) AS items FROM conversations GROUP BY 1),
 m AS (SELECT conv_id, key FROM s UNION SELECT conv_id, key FROM x UNION SELECT conv_id, key FROM y), t AS (SELECT conv_id, count(*) AS translated FROM m GROUP BY 1)
 SELECT conv_id AS digest_date, items, translated, translated >= items AND (conv_id % 4 <> 0 OR (conv_id % 3 = 0 AND conv_id IN (SELECT conv_id FROM s)))
  AND (conv_id IN (SELECT conv_id FROM s) OR (conv_id % 2 = 1 AND conv_id IN (SELECT conv_id FROM y))) AS complete FROM i JOIN t USING (conv_id)""")
def translation_state(spark, sf):
    """Which of the merged translations have every story, the note, and the deep dive where the digest has one."""
    digests, runs = _partial_runs(spark, sf)
    merged = store.merge_translations(digests, runs)[0]
    original = merged.withColumns({"editorial_note": F.lit("note"), "deep_dive": F.when(F.col("digest_date") % 4 == 0, "dive")})
    items = table(spark, sf, "conversations").select(F.col("conv_id").alias("digest_date"), F.floor(F.col("turn") / 2).alias("key"))
    return store.complete_in(original, items).select("digest_date", "items", "translated", "complete")


@query("""WITH RECURSIVE c AS (SELECT o_orderkey AS key, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_key, o_orderdate, o_orderstatus = 'F' AS told FROM orders),
 u(start, cur, n) AS (SELECT key, key, told::INT FROM c UNION ALL SELECT u.start, p.key, u.n + p.told::INT FROM u JOIN c ON c.key = u.cur JOIN c p ON p.key = c.parent_key WHERE u.n < 7)
 SELECT u.start, n - 1 AS place, c.o_orderdate::DATE::VARCHAR AS date, CASE WHEN c.key % 5 = 0 THEN 'order ' || c.key ELSE 'said ' || c.key END AS headline, 'on ' || c.key AS what_happened
 FROM u JOIN c ON c.key = u.cur WHERE c.told AND n > 1""")
def story_history(spark, sf):
    """The earlier analysed entries of every running story: a customer's orders follow one another, the finished ones are told."""
    o = table(spark, sf, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    clusters = o.select(F.col("o_orderkey").alias("key"), before.alias("parent_key"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("headline"), F.col("o_orderdate").cast("timestamp").alias("last_seen"))
    said = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("said "), F.col("o_orderkey").cast("string")))
    told = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("cluster_key"), said.alias("headline"), F.concat(F.lit("on "), F.col("o_orderkey").cast("string")).alias("what_happened"))
    return reads.history(clusters, told)


@query(f"WITH {CLASSIFIED} SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY length(title) DESC, doc_id) AS place FROM c WHERE category IS NOT NULL")
def category_ranks(spark, sf):
    c = classified(spark, sf).filter("category is not null").select("doc_id", "category", F.length("title").alias("n"))
    return ranks.ranked(c, [F.desc("n"), F.asc("doc_id")], "place", ["category"]).drop("n")


@query("SELECT doc_id, tokens FROM (SELECT doc_id, n_chars AS tokens, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 1000000")
def calls_within_budget(spark, sf):
    return store.within_budget(table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("tokens")), 1_000_000, ["doc_id"])


@query(f"WITH {REGISTRY} SELECT slug, name, (SELECT count(*) FROM reg WHERE n % 2 = 1) AS inserted FROM reg")
def registry_upsert(spark, sf):
    """The registry stored over an older half of it, and how many sources were new."""
    new = registry(spark, sf)
    old = new.filter(F.substring("slug", 4, 9).cast("int") % 2 == 0).withColumn("name", F.lit("old"))
    merged, counts = store.upsert_registry(old, new)
    return merged.select("slug", "name").join(F.broadcast(counts))  # one row


@query(f"SELECT * REPLACE (digest_date::VARCHAR AS digest_date) FROM (WITH {_ITEMS} SELECT digest_date, key FROM it WHERE digest_date < DATE '2026-01-10' UNION ALL SELECT digest_date, 'n' || key FROM it WHERE digest_date >= DATE '2026-01-10' AND doc_id % 2 = 0)")
def digest_replace(spark, sf):
    i = _items(spark, sf).select("doc_id", "digest_date", "key")
    new = i.filter("digest_date >= date'2026-01-10'").withColumn("key", F.concat(F.lit("n"), "key"))
    return store.save_items(i, new, new.filter("doc_id % 2 = 0").select("key")).select("digest_date", "key")


@query(f"SELECT * REPLACE (digest_date::VARCHAR AS digest_date) FROM (WITH {_ITEMS}, n AS (SELECT digest_date, count(*) AS items, count(*) FILTER (doc_id % 7 <> 0) AS translated FROM it GROUP BY 1) SELECT *, translated >= items AS complete FROM n)")
def translation_complete(spark, sf):
    i = _items(spark, sf)
    return store.translation_complete(i, i.filter("doc_id % 7 <> 0"))


@query(f"SELECT * REPLACE (digest_date::VARCHAR AS digest_date) FROM (WITH {_ITEMS.replace("(doc_id % 30)", "(doc_id // 7)")}, n AS (SELECT digest_date, category, count(*) AS picks FROM it GROUP BY ALL), e AS (SELECT * FROM (SELECT DISTINCT digest_date FROM it), (SELECT unnest(['bg_politics', 'global_politics', 'ai_tech_business']) AS category)) SELECT digest_date, category, coalesce(picks, 0) AS picks FROM e LEFT JOIN n USING (digest_date, category) WHERE coalesce(picks, 0) < 3)")
def underfilled(spark, sf):
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.floor(F.col("doc_id") / 7).cast("int"))
    return selection.underfilled(_items(spark, sf).withColumn("digest_date", day), CATEGORIES)


@query("WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS s FROM a x JOIN a y ON x.vec_id < y.vec_id) SELECT a, b FROM p WHERE s >= 0.42")
def embedding_cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    return stories.embedding_edges(e, "vec_id", "embedding").select("a", "b")


_AS_OF = "2026-01-02 10:00:00"


@query(f"WITH {ARTICLES} SELECT doc_id FROM a WHERE published_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 30 HOUR")
def recent_articles(spark, sf):
    return reads.recent_articles(articles(spark, sf).withColumn("fetched_at", F.col("published_at")), F.lit(_AS_OF).cast("timestamp")).select("doc_id")


@query(f"WITH {ARTICLES}, c AS (SELECT source_slug AS key, max(published_at) AS seen FROM a GROUP BY 1) SELECT key, seen >= TIMESTAMP '2026-01-05 10:00:00' - INTERVAL 30 HOUR AS recent FROM c WHERE seen >= TIMESTAMP '2026-01-05 10:00:00' - INTERVAL 4 DAY")
def recent_clusters(spark, sf):
    c = articles(spark, sf).groupBy(F.col("source_slug").alias("key")).agg(F.max("published_at").alias("last_seen")).withColumns({"category": F.lit("x"), "headline": F.col("key")})
    as_of = F.lit("2026-01-05 10:00:00").cast("timestamp")
    since = reads.clusters_since(c, "x", as_of).select("key", F.lit(True).alias("recent"))
    return reads.recent_keys(c, as_of).join(since, "key", "left").select("key", F.coalesce("recent", F.lit(False)).alias("recent"))


@query(f"WITH {ARTICLES}, {REGISTRY} SELECT slug, name FROM reg")
def sources_by_name(spark, sf):
    return reads.sources_read(registry(spark, sf)).select("slug", "name")


@query(f"SELECT * REPLACE (digest_date::VARCHAR AS digest_date) FROM (WITH {_ITEMS} SELECT digest_date, key, CASE WHEN doc_id % 3 = 0 THEN 'bg ' || key ELSE category END AS analysis FROM it)")
def translated_items(spark, sf):
    i = _items(spark, sf).select("doc_id", "digest_date", "key", F.col("category").alias("analysis"))
    done = i.filter("doc_id % 3 = 0").select("digest_date", "key", F.lit("bg").alias("lang"), F.concat(F.lit("bg "), "key").alias("analysis"))
    return reads.translated(i, done.unionByName(done.withColumn("lang", F.lit("en"))), "bg").select("digest_date", "key", "analysis")


@query(f"SELECT * REPLACE (digest_date::VARCHAR AS digest_date) FROM (WITH {_ITEMS} SELECT digest_date, key FROM it WHERE doc_id % 3 <> 0)")
def translations_left(spark, sf):
    i = _items(spark, sf).select("doc_id", "digest_date", "key")
    return store.to_translate(i, i.filter("doc_id % 3 = 0")).select("digest_date", "key")


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'more' WHEN 'signup' THEN 'deep_dive' WHEN 'error' THEN 'irrelevant' ELSE 'less' END AS signal FROM events")
def feedback_append(spark, sf):
    signal = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in _SIGNAL.items() for x in p]), F.col("event_type")), F.lit("less"))
    e = table(spark, sf, "events").select("event_id", signal.alias("signal"))
    return store.add_feedback(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"))


@query("SELECT source AS purpose, count(*) AS calls, count(*) FILTER (n_chars > 2000) AS failed, sum(n_chars)::BIGINT AS tokens_in, sum(doc_id)::BIGINT AS tokens_out FROM documents GROUP BY 1")
def token_usage(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("purpose"), F.when(F.col("n_chars") > 2000, "too long").alias("error"), F.col("n_chars").alias("tokens_in"), F.col("doc_id").alias("tokens_out"))
    return store.usage(d, ["purpose"])


@query(f"WITH {_ITEMS} SELECT key, category, significance FROM it")
def authoritative_override(spark, sf):
    i = _items(spark, sf)
    said = i.select("key", F.struct(F.lit("made up").alias("category"), "significance").alias("record"))
    return store.overridden(said, "record", i, ["key"], ["category"]).select("key", "record.*")


@query(f"WITH {_RUBRIC} SELECT doc_id, CASE WHEN d1 < 0 THEN 'left' ELSE 'right' END AS side, least(abs(d1) / 2.0::DOUBLE, 1.0::DOUBLE) AS length, round(least(abs(d1) / 2.0::DOUBLE, 1.0::DOUBLE) * c1, 6) AS solid FROM g")
def needle_geometry(spark, sf):
    r = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", (F.col("doc_id") % 5 - 2).alias("d1"), ((F.col("doc_id") % 10) / 10.0).alias("c1"))
    return r.select("doc_id", D.needle(F.col("d1"), F.col("c1")).alias("n")).select("doc_id", "n.side", "n.length", F.round("n.solid", 6).alias("solid"))


@query("WITH d AS (SELECT event_type, ts::DATE::VARCHAR AS day, sum(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) / count(*)::DOUBLE AS v FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS place, greatest(0.4::DOUBLE, max(abs(v)) OVER (PARTITION BY event_type)) * 1.12::DOUBLE AS peak, count(*) OVER (PARTITION BY event_type) AS n FROM d) SELECT event_type, day, place, round(12 + place * CASE WHEN n > 1 THEN 976.0::DOUBLE / (n - 1) ELSE 0 END, 5) AS x, round(52 - greatest(-peak, least(peak, v)) / peak * 40, 5) AS y FROM p")
def trend_trace(spark, sf):
    sign = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, -1).otherwise(0)
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg((F.sum(sign) / F.count("*")).alias("v"))
    return D.trace(d, "event_type", "day", "v").select("event_type", "day", "place", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("SELECT timezone('Europe/Sofia', timezone('UTC', ts::TIMESTAMP))::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1")
def local_dates(spark, sf):
    return table(spark, sf, "events").groupBy(D.local_date(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, least(greatest(420.0::DOUBLE, 0.06::DOUBLE * n_chars), 1500.0::DOUBLE) AS seconds FROM documents")
def call_timeouts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.call_seconds(F.col("n_chars")).alias("seconds"))


@query("SELECT event_id, event_type AS name, 'user ' || user_id AS argument, event_type AS signal, CASE WHEN event_id % 2 = 0 THEN ts::DATE::VARCHAR END AS digest_date FROM events")
def chat_commands(spark, sf):
    e = table(spark, sf, "events")
    said = F.concat(F.lit("/"), "event_type", F.lit("@bot  User  "), F.col("user_id").cast("string"))
    data = F.concat(F.lit("fb:"), "event_type", F.lit(":"), F.when(F.col("event_id") % 2 == 0, F.to_date("ts").cast("string")).otherwise("soon"))
    return e.select("event_id", D.command(said).alias("c"), D.callback(data).alias("b")).select("event_id", "c.*", "b.*")


@query("""SELECT doc_id, 'CLUSTER KEY: ' || doc_id || chr(10) || 'CATEGORY: ' || lang || chr(10) || chr(10) || '=== SOURCE MATERIAL ===' || chr(10) || chr(10)
 || '[1] ' || source || ' (lean=center, reliability=high)' || chr(10) || '    published: 2026-01-01T00:00:00' || chr(10) || '    title: first' || chr(10) || '    url: https://a.example/1' || chr(10) || '    text: ' || CASE WHEN trim(text, ' ') = '' THEN '(body unavailable)' ELSE trim(text, ' ') END || chr(10) || chr(10)
 || '[2] other (lean=left, reliability=low)' || chr(10) || '    published: unknown' || chr(10) || '    title: second' || chr(10) || '    url: https://b.example/2' || chr(10) || '    text: (body unavailable)' || chr(10) || chr(10)
 || '=== TASK ===' || chr(10) || 'Say what happened.' AS prompt FROM documents""")
def story_prompts(spark, sf):
    ref = lambda name, lean, trust, when, title, url, body: F.struct(name.alias("source_name"), F.lit(lean).alias("lean"), F.lit(trust).alias("reliability"), F.lit(when).cast("timestamp").alias("published_at"), F.lit(title).alias("title"), F.lit(url).alias("url"), body.alias("body"))
    refs = F.array(ref(F.col("source"), "center", "high", "2026-01-01", "first", "https://a.example/1", F.col("text")), ref(F.lit("other"), "left", "low", None, "second", "https://b.example/2", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", render.prompt({"CLUSTER KEY": F.col("doc_id"), "CATEGORY": F.col("lang")}, refs, "Say what happened.").alias("prompt"))


@query()
def digest_messages(spark, sf):
    """Chat messages of the picks of each digest."""
    i = scored(spark, sf)
    picks = selection.select_top(i.withColumn("entities", F.array("lang", "source")), CATEGORIES).select("digest_date", "key", "rank")
    refs = F.array(F.struct(F.col("source").alias("name"), F.lit("https://a.example/?a=1&b=2").alias("url"), F.lit("center").alias("lean"), F.lit("high").alias("reliability")))
    told = i.join(picks, ["digest_date", "key"]).select("digest_date", "category", "rank", F.concat(F.lit("Story "), "key").alias("headline"), F.lit("It <happened>.").alias("what_happened"), F.lit("").alias("why_it_matters"), "relevant", "significance", "direction", "impacts", refs.alias("refs"))
    return render.category_messages(told, {c: f"<b>{c}</b>" for c in CATEGORIES})
