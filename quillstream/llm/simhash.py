"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, connected components.

A fingerprint has four 16-bit blocks. Fingerprints at `distance` 2 or less differ in at most two of them, so they share
two: the six pairs of blocks are the join keys (32 bits each, so chance hits stay rare at billions of fingerprints).
Only distinct fingerprints are joined, and keys that occur once drop out after an aggregation. Every bucket is verified
by exact Hamming distance in one task and gives a forest (at most one edge per member), never its pairs.

A bucket of more than `max_bucket` distinct fingerprints isn't brought together. Two fingerprints are at distance 2 or
less exactly if some value is at distance 1 or less from both, so each of its members votes for itself and its 64
one-bit neighbours, and all voters of a value are linked to their smallest: linear, with partial aggregation.

Components come from alternating large-star and small-star rounds on the edge table; each round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import map_batches, materialize, pack, partitions, utf8

SEED = 42
WORDS = 3
_FLUSH = 100_000


def fingerprints_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, words: int = WORDS) -> np.ndarray:
    """64-bit fingerprints of UTF-8 texts: bits that more than half of the word shingles' XXH64 have."""
    digest, result = xxhash.xxh64_intdigest, np.zeros(len(start), np.uint64)
    hashes: list[int] = []
    at: list[int] = []
    who: list[int] = []

    def flush() -> None:
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        n = np.diff(np.array([*at, len(hashes)]))
        top = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")
        result[who] = np.ascontiguousarray(top).view(np.uint64).ravel()
        hashes.clear(), at.clear(), who.clear()

    for i in range(len(start)):
        norm = b" ".join(data[start[i] : end[i]].tobytes().lower().split())
        if not norm:
            continue
        gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        first, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(norm)]])
        k = min(words, len(first))
        view = memoryview(norm)
        at.append(len(hashes))
        who.append(i)
        hashes += [digest(view[a:b], SEED) for a, b in zip(first[: len(first) - k + 1].tolist(), last[k - 1 :].tolist())]
        if len(hashes) >= _FLUSH:
            flush()
    if who:
        flush()
    return result


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = fingerprints_of(*utf8(batch.column(2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["did", "dx", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, dx (hash of id and text) and fp (as a signed long) of each row. Null texts are empty: fingerprint 0."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    did = F.col(f"`{id_col}`").cast("long")
    return map_batches(docs.select(did.alias("did"), F.xxhash64(did, text).alias("dx"), text.alias("text")), _fingerprint, "did long, dx long, fp long")


def forest(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) that connect the members of each bucket (equal, adjacent keys) as its links do."""
    n = len(fp)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    bucket = np.cumsum(new) - 1
    size = np.bincount(bucket)
    left = size[bucket] - (np.arange(n) - np.flatnonzero(new)[bucket]) - 1  # members that follow in the bucket
    label = np.arange(n)
    rows, step = np.flatnonzero(left >= 1), 1
    links: list[np.ndarray] = []

    def fold() -> None:
        if not links:
            return
        a, b = (np.concatenate(x) for x in zip(*links))
        links.clear()
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                return
            np.minimum.at(label, x, y)
            np.minimum.at(label, y, x)
            while (label != label[label]).any():
                label[:] = label[label]

    held = 0
    while len(rows):
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + step]) <= distance]
        if len(near):
            links.append((near, near + step))
            held += len(near)
            if held > 2_000_000:
                fold()
                held = 0
        step += 1
        rows = rows[left[rows] >= step]
    fold()
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            u, v = forest(k, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            keys = np.concatenate([keys, np.asarray(batch.column(0))])
            fps = np.concatenate([fps, np.asarray(batch.column(1)).view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            if cut >= 20_000:
                yield out(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield out(keys, fps)

    return run


def links(fps: DataFrame, distance: int = 2, max_bucket: int = 1 << 14) -> DataFrame:
    """Edges u, v between distinct fingerprints (column fp) with the same components as all links."""
    if not 0 <= distance <= 2:
        raise ValueError("four blocks find distances up to 2")
    block = [F.shiftrightunsigned("fp", 16 * b).bitwiseAND(F.lit(0xFFFF)) for b in range(4)]
    keys = [F.lit(i << 32) + F.shiftleft(block[a], 16) + block[b] for i, (a, b) in enumerate(combinations(range(4), 2))]
    keyed = fps.select(F.explode(F.array(*keys)).alias("key"), "fp")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(keyed.join(shared, "key"), "buckets")
    n = partitions(fps.sparkSession)
    near = map_batches(met.filter(F.col("n") <= max_bucket).select("key", "fp").repartition(n, "key").sortWithinPartitions("key", "fp"), _verify(distance), "u long, v long")
    large = met.filter(F.col("n") > max_bucket)
    if large.isEmpty():
        return near
    flips = [F.col("fp")] + ([F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0))) for b in range(64)] if distance == 2 else [])
    votes = large.select("fp").distinct().select("fp", F.explode(F.array(*flips)).alias("z"))
    if distance == 1:  # voters of one value may be 2 apart: the value itself must be a member
        raise ValueError("large buckets need distance 2 or 0")
    least = votes.groupBy("z").agg(F.min("fp").alias("m"), F.count("*").alias("c")).filter("c > 1")
    return near.unionByName(votes.join(least, "z").filter("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for every node of the edges u, v (longs)."""
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        now = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        star = now.join(low, "u")
        now = materialize(star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, max_bucket: int = 1 << 14) -> DataFrame:
    """did, dx, fp, component_id (smallest id reachable over links at `distance` or less) and keep (true for one row key
    of each component, the smallest (id, hash of id and text)), for every row of docs.

    Null texts are empty texts; these have fingerprint 0, linked like any other. A null id is smaller than none: the
    component's id is null only if all its ids are. Repeated rows are equal fingerprints. An empty table gives no rows.
    Further columns are not read.
    """
    made = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    each = made.groupBy("fp").agg(F.min("did").alias("low"), F.min(F.struct(F.coalesce("did", F.lit((1 << 63) - 1)).alias("did"), "dx")).alias("first"))
    each = materialize(each, "distinct")
    roots = components(links(each.select("fp"), distance, max_bucket))
    labelled = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "low", "first", F.coalesce("root", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    named = labelled.select("fp", "label").join(least, "label").select("fp", "component_id", "first")
    key = F.struct(F.coalesce("did", F.lit((1 << 63) - 1)).alias("did"), "dx")
    return made.join(named, "fp").select("did", "dx", "fp", "component_id", (key == F.col("first")).alias("keep"))


def brute_force(texts: dict[int, str | None], distance: int = 2) -> dict[int, tuple[str, int]]:
    """doc_id -> (fingerprint, component_id) over all pairs: for tests."""
    import re

    fps = {}
    for d, t in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    comp = {d: d for d in fps}
    while True:
        new = {d: min(comp[e] for e in fps if (fps[d] ^ fps[e]).bit_count() <= distance) for d in fps}
        if new == comp:
            return {d: (f"{fps[d]:016x}", comp[d]) for d in fps}
        comp = new


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """The rows of docs, one of each near-duplicate component: that with the smallest id (null ids last)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    did = F.col(f"`{id_col}`").cast("long")
    kept = near_duplicates(docs, id_col, text_col, distance).filter("keep").groupBy("dx").agg(F.count("*").alias("copies"))
    kept = materialize(kept, "kept")
    rows = pack(docs, F.xxhash64(did, text).alias("dx")).join(kept, "dx").select("row", "dx", "copies")
    if not kept.filter("copies > 1").isEmpty():  # rows equal in id and text
        once = rows.filter("copies > 1").groupBy("dx").agg(F.first("row").alias("row")).select("row")
        rows = rows.filter("copies = 1").select("row").unionByName(once)
    return rows.select("row.*")
