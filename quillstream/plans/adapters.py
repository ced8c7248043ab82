"""Logical tables built from the test tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.session import table

#: Words of the synthetic corpus, as vocabularies.
VOCAB = {"civic": ["the", "para", "leon"], "foreign": ["des", "dans", "und"], "tech": ["que", "ción", "menta"], "domestic": ["der", "von", "stand"]}

#: A lexicon for signatures of the synthetic corpus: words of its languages that stand for one another, and letters.
LEXICON = {"der": "the", "die": "the", "das": "the", "und": "and", "para": "for", "dans": "in", "des": "of", "que": "that"}
LETTERS = {"ä": "a", "ö": "o", "ü": "u", "ß": "ss", "á": "a", "é": "e", "è": "e", "ê": "e", "í": "i", "ó": "o", "ú": "u", "ñ": "n", "ç": "c"}

ARTICLES = """a AS (SELECT doc_id, source AS source_slug, lang, text, substr(split_part(text, chr(10), 1), 1, 160) AS title,
  'https://' || source || '.example/' || doc_id AS url, TIMESTAMP '2026-01-01 00:00:00' + to_minutes(doc_id) AS published_at FROM documents)"""

REGISTRY = """r AS (SELECT DISTINCT source AS slug, substr(source, 4)::INT AS n FROM documents),
 reg AS (SELECT slug, n, 'Source ' || n AS name, ['left', 'center', 'right'][n % 3 + 1] AS lean, ['high', 'medium', 'low', 'propaganda'][n % 4 + 1] AS reliability,
   1.0::DOUBLE + (n % 5) / 10.0::DOUBLE AS weight FROM r WHERE n % 7 <> 3)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.col("source").alias("source_slug"), "lang", "text", F.substring(F.substring_index("text", "\n", 1), 1, 160).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        F.timestamp_seconds(F.lit(1767225600) + F.col("doc_id") * 60).alias("published_at"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int")
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), n % k + 1)
    rows = table(spark, sf_dir, "documents").select("source").distinct().filter(n % 7 != 3)
    return rows.select(
        F.col("source").alias("slug"), F.concat(F.lit("Source "), n.cast("string")).alias("name"), pick(["left", "center", "right"], 3).alias("lean"),
        pick(["high", "medium", "low", "propaganda"], 4).alias("reliability"), (1.0 + (n % 5) / 10.0).alias("weight"), (n % 6 != 5).alias("enabled"),
    )
