"""Removal of near-duplicates that depends on their order, without a task per source.

In input order, a row stays unless an earlier row of its source that stayed is within `distance` bits. That is the
lexicographically first independent set of the graph of near rows, and needs no pass over them: a row goes as soon as one
earlier neighbour stays, and stays as soon as all of them are gone. Rounds decide all rows that can be decided at once.

Equal fingerprints first: of those of a source only the earliest can stay, so the others never take part. Near pairs come
from blocks: fingerprints are cut into `distance` + c blocks, of which a near pair shares c; the more fingerprints the
largest source has, the larger c, so that a key of c blocks is about as selective as a source is large.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.config import DEFAULT
from quillstream.operators.tables import written


def block_keys(fingerprint: Column, distance: int, shared: int, bits: int = 64) -> list[Column]:
    """A key (which blocks, and their bits) for each choice of `shared` out of distance + shared blocks."""
    count = distance + shared
    cuts = [bits * k // count for k in range(count + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(count), shared)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.struct(F.lit(k).alias("which"), fingerprint.bitwiseAND(F.lit(mask)).alias("bits")))
    return keys


def shared_blocks(rows: int, distance: int, bits: int = 64) -> int:
    """The fewest blocks to share whose bits outnumber the rows' logarithm; three at most (35 keys at distance 4)."""
    for shared in (1, 2):
        if rows <= 1 << (bits * shared // (distance + shared)):
            return shared
    return 3


def near_pairs(first: DataFrame, distance: int, shared: int) -> DataFrame:
    """source, early, late (places) of all pairs of `first` (source, place, h) within `distance`."""
    keyed = first.select("source", "place", "h", F.explode(F.array(*block_keys(F.col("h"), distance, shared))).alias("key"))
    left = keyed.select("key", F.col("source").alias("s"), F.col("place").alias("early"), F.col("h").alias("h1"))
    right = keyed.select("key", "source", F.col("place").alias("late"), F.col("h").alias("h2"))
    near = (F.col("early") < F.col("late")) & (F.bit_count(F.col("h1").bitwiseXOR(F.col("h2"))) <= distance)
    return left.join(right, (left["key"] == right["key"]) & F.col("s").eqNullSafe(F.col("source"))).filter(near).select("source", "early", "late").distinct()


def _one_pass(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last few pairs (node, earlier), in order of node, in one task."""
    stays: dict[str, bool] = {}
    for p in pairs:
        for node, earlier in zip(p["node"], p["earlier"]):
            stays[node] = stays.get(node, True) and not stays.get(earlier, True)
    yield pd.DataFrame({"node": list(stays), "stays": list(stays.values())})


def first_independent(pairs: DataFrame, few: int = 100_000) -> DataFrame:
    """node and stays of every node that has an earlier neighbour; pairs are distinct (node, earlier) of orderable ids. All
    others stay. A round decides all nodes whose earlier neighbours tell; once no more than `few` pairs are left, one task
    goes through them in order. So long chains of near rows need no round a link, and that task's size is bounded."""
    left, out = written(pairs.select("node", "earlier"), "pairs"), None
    while (rows := left.count()) > few:
        open_ = left.select(F.col("node").alias("earlier")).distinct()
        free = left.join(open_, "earlier", "left_anti").select("earlier").distinct()  # undecided no more, and not gone: they stay
        gone = written(left.join(free, "earlier", "left_semi").select("node").distinct(), "gone")
        kept = left.join(gone, "node", "left_anti")
        rest = written(kept.join(gone.withColumnRenamed("node", "earlier"), "earlier", "left_anti"), "pairs")
        # nodes whose last earlier neighbours go now are free in the next round
        freed = kept.select("node").distinct().join(rest.select("node").distinct(), "node", "left_anti")
        now = gone.withColumn("stays", F.lit(False)).unionByName(freed.withColumn("stays", F.lit(True)))
        out = now if out is None else out.unionByName(now)
        left = rest
    if rows:
        named = left.select("node", F.to_json(F.struct("node")).alias("_node"), F.to_json(F.struct(F.col("earlier").alias("node"))).alias("_earlier"))
        ordered = named.coalesce(1).sortWithinPartitions("node").select(F.col("_node").alias("node"), F.col("_earlier").alias("earlier"))
        last = ordered.mapInPandas(_one_pass, "node string, stays boolean").join(named.select("node", "_node").distinct().withColumnRenamed("node", "_"), F.col("node") == F.col("_node"))
        last = last.select(F.col("_").alias("node"), "stays")
        out = last if out is None else out.unionByName(last)
    return out if out is not None else pairs.select("node").withColumn("stays", F.lit(True)).limit(0)


def drop_near_duplicates(df: DataFrame, source: str, ordinal: str, fingerprint: str, distance: int = DEFAULT.simhash_distance, few: int = 100_000) -> DataFrame:
    """The rows of df that the greedy pass over each source keeps. Ties of ordinal go by fingerprint; rows that repeat source,
    ordinal and fingerprint count as one; null sources are one source, a null ordinal comes first. Columns stay as they are."""
    place = F.struct(F.col(f"`{ordinal}`").alias("o"), F.col(f"`{fingerprint}`").alias("h"))
    mine = F.struct(F.col(f"`{source}`").alias("source"), place.alias("place"))
    packed = written(df.select(mine.alias("node"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), "rows")
    first = packed.groupBy("node.source", "node.place.h").agg(F.min("node.place").alias("place"))
    first = written(first.select("source", "h", "place"), "fingerprints")
    most = first.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    node = lambda c: F.struct("source", F.col(c).alias("place"))
    pairs = near_pairs(first, distance, shared_blocks(most, distance))
    decided = first_independent(pairs.select(node("late").alias("node"), node("early").alias("earlier")), few)
    gone = decided.filter("not stays").select("node")
    stay = first.select(F.struct("source", "place").alias("node")).join(gone, "node", "left_anti")
    return packed.join(stay, "node", "left_semi").dropDuplicates(["node"]).select("row.*")
