"""Corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Texts may be null or empty, ids
null or repeated, and further columns have any name: the first four stages keep all columns as they are. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import bpe, decontaminate, simhash_wide, suffix_dedup, toxicity
from quillstream.llm.common import materialize, table
from quillstream.llm.queries import labelled, vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. Null and empty texts have no unit to score and stay."""
    model = toxicity.fit(labelled(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2, {0: 1600, 1: 800}), "label")
    return toxicity.drop_toxic(docs, model, least=0.3)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, that with the smallest id;
    null ids come last, null and empty texts are one group, and equal rows are one."""
    return simhash_wide.keep_one(docs, similarity=0.8)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere are cut out of the texts; no row goes. A null text stays null."""
    out = suffix_dedup.remove_repeats(docs, min_len=200, decode=True)
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null and empty texts don't."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and what they decode to; null and empty texts have none."""
    out = bpe.encode(docs, vocabulary(), keep_text=False)
    return out.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", "decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Trained scores, fingerprints and merges can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
