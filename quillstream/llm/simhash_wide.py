"""SimHash near-duplicates on five-word shingles, decided by exact Jaccard similarity, kept one of each component.

A text is the set of the 64-bit hashes of its five-word shingles; a shorter text is one shingle. Copies are one set.

1. SimHash: the sets' fingerprints meet in the pigeonhole blocks of `simhash.links`; sets of equal or close fingerprints
   are candidates. Most near copies are found here.
2. Fingerprints of two sets of similarity 0.8 may differ in any number of bits, so an exact pass finds what the blocks
   miss: two sets of similarity s or more share one of the first n - ceil(s * n) + 1 shingles of both in any common order
   of all shingles (prefix filter). The order puts shingles that chunks of the corpus repeat last: it only decides how few
   sets meet, not which links are found. Each member of a bucket is compared with the bucket's smallest, and links (those
   of SimHash, too) are closed to components. Then all pairs of a bucket whose components differ are gone through where
   the bucket is; no pair leaves it, only a forest of those that may be similar. The trees of all buckets together are
   closed to groups, a group's texts meet once, and its pairs are decided there, which again gives a forest. So what is
   made and shuffled grows with the members of buckets and groups, not with their pairs.

Candidates whose sketches (how many shingles fall in each of 128 to 1,024 slots, by the set's size, then of 1,024) differ
by more than the sets may are dropped; that is exact too. Every other one is decided on the whole sets, made anew from the
texts: a text takes a quarter of the room of its set. Buckets of the same members are one. A bucket of more than CHUNK
members, and a group of more than ITEMS shingles, is dealt out as pairs of its chunks. Texts of rows that surely stay are
not shuffled at the end: a bit table of fixed size tells which rows may go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import has_bit, map_batches, materialize, pack, partitions, rows_in, slots_of, utf8
from quillstream.llm.simhash import SEED, components
from quillstream.llm.simhash import links as near_fingerprints

SHINGLE = 5
CHUNK, ITEMS = 1 << 12, 1 << 20
#: A shingle that a chunk of so many repeats so often goes to the end of the order; at most MOST_COMMON do.
SEEN, OFTEN, MOST_COMMON = 1 << 21, 3, 1 << 17
_SLOTS = 1 << 24
_PAIRS = 200_000
_SKETCH, _FINER = 128, 1024


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a UTF-8 text."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return np.zeros(1, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    first, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(norm)]])
    n, view, digest = min(SHINGLE, len(first)), memoryview(norm), xxhash.xxh64_intdigest
    hs = {digest(view[x:y], SEED) for x, y in zip(first[: len(first) - n + 1].tolist(), last[n - 1 :].tolist())}
    return np.sort(np.fromiter(hs, np.uint64, len(hs)))


def least_shared(n, similarity: float):
    return np.ceil(n * similarity - 1e-9).astype(np.int64)


def may_differ(both, similarity: float):
    """How many shingles two sets of that similarity, of `both` together, may not share."""
    return (1 - similarity) / (1 + similarity) * both + 1e-6


def sketch(hs: np.ndarray, slots: int | None = None) -> bytes:
    """How many shingles fall in each slot: a quarter as many slots as shingles or more, up to _FINER."""
    if slots is None:
        slots = _SKETCH
        while slots < _FINER and 4 * slots <= len(hs):
            slots *= 2
    return np.minimum(np.bincount((hs % np.uint64(slots)).astype(np.int64), minlength=slots), 255).astype(np.uint8).tobytes()


def fold(sketch: bytes, slots: int) -> np.ndarray:
    """A sketch of fewer slots."""
    return np.frombuffer(sketch, np.uint8).reshape(-1, slots).sum(0, dtype=np.int16)


def fingerprint(hs: np.ndarray) -> int:
    """Bits that more than half of the hashes have, as a signed long."""
    ones = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hs), bitorder="little").view(np.int64)[0])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The id, size, fingerprint and sketch of each text's set; and, with a size of -1, shingles (as id) that a chunk of
    texts repeats, with how many of its texts have them (as dx)."""
    names = ["did", "dx", "id", "n", "fp", "sketch"]
    held: list[np.ndarray] = []
    seen = 0

    def common() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        h, c = h[c >= OFTEN], c[c >= OFTEN]
        zero = np.zeros(len(h), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(zero), pa.array(c), pa.array(h.view(np.int64)), pa.array((zero - 1).astype(np.int32)), pa.array(zero), pa.nulls(len(h), pa.binary())], names=names)

    for batch in batches:
        data, start, end = utf8(batch.column(2))
        ids, sizes, fps, sketches = [], [], [], []
        for a, b in zip(start.tolist(), end.tolist()):
            hs = shingles(data[a:b].tobytes())
            ids.append(xxhash.xxh64_intdigest(hs.tobytes(), SEED))
            sizes.append(len(hs))
            fps.append(fingerprint(hs))
            sketches.append(sketch(hs))
            held.append(hs)
            seen += len(hs)
            if seen > SEEN:
                yield common()
                seen = 0
        cols = [batch.column(0), batch.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=names)
    if held:
        yield common()


def _prefix(similarity: float, common: np.ndarray, often: np.ndarray):
    """A row for each shingle of a set's prefix: its hash and the set. A task says a set once; others may repeat it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[int] = set()
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            cols = np.concatenate(keys).view(np.int64), np.concatenate(ids)
            keys.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "id"])

        for batch in batches:
            data, start, end = utf8(batch.column(0))
            for a, b in zip(start.tolist(), end.tolist()):
                hs = shingles(data[a:b].tobytes())
                i = xxhash.xxh64_intdigest(hs.tobytes(), SEED)
                if i in said:
                    continue
                said.add(i)
                if len(common):
                    at = np.minimum(np.searchsorted(common, hs), len(common) - 1)
                    hs = hs[np.argsort(np.where(common[at] == hs, often[at], 0), kind="stable")]
                keys.append(hs[: len(hs) - int(least_shared(len(hs), similarity)) + 1])
                ids.append(np.full(len(keys[-1]), np.uint64(i)).view(np.int64))
                if sum(map(len, keys[-50:])) > 20_000 or len(keys) > 2_000:
                    yield out()
        if keys:
            yield out()

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and id those whose key occurs again, with the first of the bucket and its size. A bucket is
    named by a hash of its members: those of the same members are one."""
    parts: list[list[np.ndarray]] = []

    def out(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, i = cols
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1])])
        key, i = key[once], i[once]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(head, len(key)))
        of, m = np.repeat(head, size), np.repeat(size, size)
        named = [xxhash.xxh64_intdigest(i[x : x + c].tobytes(), SEED) if c > 1 else 0 for x, c in zip(head.tolist(), size.tolist())]
        on = m > 1
        return pa.RecordBatch.from_arrays([pa.array(c[on]) for c in (np.repeat(np.array(named, np.uint64).view(np.int64), size), i, i[of], m)], names=["key", "id", "top", "m"])

    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if not len(cols[0]):
            continue
        parts.append(cols)
        if cols[0][-1] != parts[0][0][0] and sum(len(p[0]) for p in parts) > 50_000:
            whole = [np.concatenate(c) for c in zip(*parts)]
            cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1  # the last bucket may go on
            yield out([c[:cut] for c in whole])
            parts = [[c[cut:] for c in whole]]
    if parts:
        yield out([np.concatenate(c) for c in zip(*parts)])


class _Sketches:
    """Sketches of sets of n shingles, held in as many slots as they have and in fewer."""

    def __init__(self, sketches: list[bytes], n: np.ndarray, similarity: float):
        self.n, self.similarity = n, similarity
        self.slots = np.array([len(s) for s in sketches])
        self.held = {k: np.array([fold(s, k) if len(s) >= k else np.zeros(k, np.int16) for s in sketches]) for k in np.unique(self.slots).tolist()}

    def near(self, k: int, at: np.ndarray) -> np.ndarray:
        """Those of `at` that k may be similar to."""
        may = may_differ(self.n[at] + self.n[k], self.similarity)
        ok = np.abs(self.n[at] - self.n[k]) <= may
        at, may = at[ok], may[ok]
        on = np.zeros(len(at), bool)
        fewer = np.minimum(self.slots[at], self.slots[k])
        for slots in np.unique(fewer).tolist():
            here, some = np.flatnonzero(fewer == slots), self.held[slots]
            on[here] = np.abs(some[at[here]] - some[k]).sum(1, dtype=np.int64) <= may[here]
        return at[on]


def _forest(label: np.ndarray, later: Callable[[int], np.ndarray], linked: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs (k, j) that join the labelled parts as all pairs do for which j is in later(k) and linked() holds; parts
    are joined in `label`."""
    for k in range(len(label) - 1):
        at, step = later(k), 16
        at = at[label[at] != label[k]]
        while len(at):
            some, at = at[:step], at[step:]
            for j in linked(k, some).tolist():
                if label[j] != label[k]:
                    label[label == label[j]] = label[k]
                    yield k, j
            at, step = at[label[at] != label[k]], min(2 * step, 1024)


def _cells(batches: Iterator[pa.RecordBatch], pairs: Callable[[list, list], Iterator[tuple[int, int]]], value: Callable) -> Iterator[pa.RecordBatch]:
    """The pairs of each cell (first three columns; rows sorted by these and by id, the fourth), a pair once in a task as
    far as it remembers. Of rows that repeat an id one counts; value() is what is held of the last column."""
    said: set[tuple[int, int]] = set()
    new: list[tuple[int, int]] = []
    held_key, rows = None, []

    def out() -> pa.RecordBatch:
        if len(said) > _PAIRS:
            said.clear()
        u, v = zip(*new) if new else ((), ())
        new.clear()
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def done() -> Iterator[pa.RecordBatch]:
        if len({r[1] for r in rows}) < 2:
            return
        for k, j in pairs(held_key, rows):
            p = min(rows[k][0], rows[j][0]), max(rows[k][0], rows[j][0])
            if p not in said:
                said.add(p)
                new.append(p)
        if len(new) > 10_000:
            yield out()

    for batch in batches:
        last = batch.column(batch.num_columns - 1)
        for at, (*key, i, label, mine, n) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]))):
            if key != held_key:
                yield from done()
                held_key, rows = key, []
            if not rows or rows[-1][0] != i:
                rows.append((i, label, mine, n, value(last[at].as_py())))
    yield from done()
    yield out()


def _across(key: list, label: np.ndarray, mine: np.ndarray) -> Callable[[int], np.ndarray]:
    """Later members of another label; in a cell of two chunks, of the other chunk."""

    def later(k: int) -> np.ndarray:
        ok = label[k + 1 :] != label[k]
        if key[1] != key[2]:
            ok &= mine[k + 1 :] != mine[k]
        return k + 1 + np.flatnonzero(ok)

    return later


def _apart(similarity: float):
    """A forest of the pairs of a cell (key, x, y) whose components differ and whose sketches don't exclude a link."""

    def pairs(key: list, rows: list) -> Iterator[tuple[int, int]]:
        label, mine, n = (np.array(c, np.int64) for c in list(zip(*rows))[1:4])
        yield from _forest(np.arange(len(n)), _across(key, label, mine), _Sketches([r[4] for r in rows], n, similarity).near)

    return lambda batches: _cells(batches, pairs, lambda sketch: sketch)


def _joined(similarity: float):
    """Links of a cell (root, x, y) of whole texts that join its components as all links do."""

    def pairs(key: list, rows: list) -> Iterator[tuple[int, int]]:
        label, mine, n = (np.array(c, np.int64) for c in list(zip(*rows))[1:4])
        sets = [r[4] for r in rows]
        sketches = _Sketches([sketch(x) for x in sets], n, similarity)

        def linked(k: int, at: np.ndarray) -> np.ndarray:
            at, on, x = sketches.near(k, at), [], sets[k]
            for lo in range(0, len(at), 64):
                some = at[lo : lo + 64]
                all_ = np.concatenate([sets[j] for j in some.tolist()])
                same = x[np.minimum(np.searchsorted(x, all_), len(x) - 1)] == all_
                shared = np.add.reduceat(same, np.cumsum(n[some]) - n[some], dtype=np.int64)
                on.append(some[shared >= similarity * (n[some] + len(x) - shared) - 1e-9])
            return np.concatenate(on) if on else at

        yield from _forest(label.copy(), _across(key, label, mine), linked)

    return lambda batches: _cells(batches, pairs, shingles)


def _wanted(bits: np.ndarray, whole: bool):
    """Of the rows (hash, text) whose hash falls in a marked slot the set's id with its whole text, or its size and finer
    sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(has_bit(bits, np.asarray(batch.column(0)) & (_SLOTS - 1)))
            data, start, end = utf8(batch.column(1))
            for lo in range(0, len(at), 100):
                texts = [data[start[k] : end[k]].tobytes() for k in at[lo : lo + 100]]
                sets = [shingles(t) for t in texts]
                ids = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
                if whole:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, pa.binary())], names=["id", "whole"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(h) for h in sets], pa.int32()), pa.array([sketch(h, _FINER) for h in sets], pa.binary())], names=["id", "n", "sketch"])

    return run


def _may_link(similarity: float):
    """Pairs (u, v, sizes, sketches) whose sets can be that similar: their sketches differ by no more than the sets do."""

    def differ(a: bytes, b: bytes) -> int:
        slots = min(len(a), len(b))
        return int(np.abs(fold(a, slots) - fold(b, slots)).sum(dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.asarray(batch.column(k)).astype(np.float64) for k in (2, 3))
            apart = np.array([differ(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.float64)
            on = np.maximum(apart, np.abs(n - m)) <= may_differ(n + m, similarity)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(on)) for c in batch.columns[:2]], names=["u", "v"])

    return run


def _exact(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on, last, y = np.zeros(len(batch), bool), None, None
            for k, (v, a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3))):
                x = shingles(a.as_py())
                if v != last:
                    last, y = v, shingles(b.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                on[k] = shared >= similarity * (len(x) + len(y) - shared) - 1e-9
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(on)) for c in batch.columns[:2]], names=["u", "v"])

    return run


def links(docs: DataFrame, each: DataFrame, similarity: float, common: np.ndarray, often: np.ndarray) -> DataFrame:
    """Edges u, v between sets (each: id, n, fp, sketch, low) with the same components as all pairs of that similarity or
    more. docs: dx and text of every row."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)

    def exact(pairs: DataFrame, name: str) -> DataFrame:
        side = lambda t, k: t.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))

        def sifted(pairs: DataFrame, t: DataFrame) -> DataFrame:
            met = pairs.join(side(t, "u"), "u").join(side(t, "v"), "v").select("u", "v", "n_u", "n_v", "s_u", "s_v")
            return materialize(map_batches(met, _may_link(similarity), "u long, v long"), f"{name}-maybe")

        def wanted(pairs: DataFrame) -> np.ndarray:
            ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
            return slots_of(each.select("id", F.col("low.dx").alias("dx")).join(ids, "id"), "dx", _SLOTS)

        maybe = sifted(pairs, each)
        # a set may come more than once, from texts of one slot: then so does an edge
        finer = materialize(map_batches(docs, _wanted(wanted(maybe), False), "id long, n int, sketch binary"), f"{name}-finer")
        maybe = sifted(maybe, finer)
        texts = materialize(map_batches(docs, _wanted(wanted(maybe), True), "id long, whole binary"), f"{name}-texts")
        both = maybe.join(texts.select(F.col("id").alias("u"), F.col("whole").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("whole").alias("b")), "v")
        return materialize(map_batches(both.select("u", "v", "a", "b"), _exact(similarity), "u long, v long"), name)

    # SimHash: sets of one fingerprint meet at their smallest, close fingerprints by the smallest of both
    first = materialize(each.groupBy("fp").agg(F.min("id").alias("low_id")), "fingerprints")
    same = each.select("fp", "id").join(first, "fp").filter("id <> low_id").select(F.col("low_id").alias("u"), F.col("id").alias("v"))
    close = near_fingerprints(first.select("fp")).toDF("fu", "fv")
    close = close.join(first.toDF("fu", "u"), "fu").join(first.toDF("fv", "v"), "fv").select("u", "v")

    keyed = map_batches(docs.select("text"), _prefix(similarity, common, often), "key long, id long")
    met = map_batches(keyed.repartition(n, "key").sortWithinPartitions("key", "id"), _buckets, "key long, id long, top long, m long")
    met = materialize(met.distinct(), "buckets")
    stars = met.filter("id <> top").select(F.col("top").alias("u"), F.col("id").alias("v")).distinct()
    found = exact(same.unionByName(close).unionByName(stars).distinct(), "stars")
    roots = components(found)
    labelled = lambda t: t.join(roots, t["id"] == roots["node"], "left").withColumn("label", F.coalesce("root", "id")).drop("node", "root")

    def dealt(t: DataFrame, parts: Column, key: str, *rest: str) -> DataFrame:
        """Cells (key, x, y) of the members' chunks x and y, each with itself and with every other."""
        mine = F.pmod(F.col("id"), parts)
        t = t.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        return t.select(key, F.least(mine, "other").alias("x"), F.greatest(mine, "other").alias("y"), "id", "label", mine.alias("mine"), *rest)

    def meet(t: DataFrame, key: str, last: str) -> DataFrame:
        cells = [key, "x", "y"]
        return t.select(*cells, "id", "label", "mine", "n", last).repartition(n, *cells).sortWithinPartitions(*cells, "id")

    rest = labelled(met.filter("m > 2"))  # two are settled by the first comparison
    mixed = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    rest = dealt(rest.join(mixed, "key"), F.ceil(F.col("m") / CHUNK), "key").join(each.select("id", "n", "sketch"), "id")
    trees = materialize(map_batches(meet(rest, "key", "sketch"), _apart(similarity), "u long, v long").distinct(), "trees")
    if trees.isEmpty():
        return found
    groups = components(trees)
    groups = groups.select("node", "root").union(groups.select("root", "root")).distinct().toDF("id", "of")
    members = materialize(labelled(groups.join(each.select("id", "n", F.col("low.dx").alias("dx")), "id")), "members")
    texts = map_batches(docs, _wanted(slots_of(members, "dx", _SLOTS), True), "id long, whole binary")
    sizes = members.groupBy("of").agg(F.ceil(F.sum("n") / ITEMS).alias("parts"))
    cells = dealt(members.join(sizes, "of"), F.col("parts"), "of", "n")
    joined = map_batches(meet(cells.join(texts, "id"), "of", "whole"), _joined(similarity), "u long, v long")
    return found.unionByName(materialize(joined.distinct(), "joined"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of docs, one of each component of similar texts: that with the smallest id (null ids last, then the hash
    of id and text).

    Null and empty texts are alike; texts of fewer words than a shingle are one shingle. Rows equal in id and text are
    one row. An empty table gives no rows. Further columns are kept and may have any name.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    did = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1))
    dx = F.xxhash64(did, text)
    rows = docs.select(did.alias("did"), dx.alias("dx"), text.alias("text"))
    whole = materialize(map_batches(rows, _describe, "did long, dx long, id long, n int, fp long, sketch binary"), "sets")
    made = whole.filter("n >= 0")
    seen = whole.filter("n < 0").groupBy("id").agg(F.sum("dx").alias("c")).orderBy(F.desc("c"), "id").limit(MOST_COMMON).toArrow()
    h, c = (np.asarray(seen.column(k).combine_chunks()) for k in (0, 1))
    order = np.argsort(h.view(np.uint64))
    each = made.groupBy("id").agg(F.min(F.struct("did", "dx")).alias("low"), *[F.first(c).alias(c) for c in ("n", "fp", "sketch")])
    each = materialize(each, "distinct")
    found = links(rows.select("dx", "text"), each, similarity, h.view(np.uint64)[order], c[order])
    roots = components(found)
    labelled = each.join(roots, each["id"] == roots["node"], "left").select(F.coalesce("root", "id").alias("label"), "low")
    kept = labelled.groupBy("label").agg(F.min("low").alias("low")).select(F.col("low.did").alias("did"), F.col("low.dx").alias("dx"), F.lit(True).alias("stays"))
    counted = made.groupBy("did", "dx").agg(F.count("*").alias("copies")).join(kept, ["did", "dx"], "left")
    counted = materialize(counted.select("did", "dx", "copies", F.coalesce("stays", F.lit(False)).alias("stays")), "kept")
    may_go = slots_of(counted.filter("not stays or copies > 1"), "dx", _SLOTS)
    keyed = pack(docs, did.alias("did"), dx.alias("dx"))
    sure = rows_in(keyed, "dx", may_go, False).select("row")
    asked = rows_in(keyed, "dx", may_go).join(counted.filter("stays").select("did", "dx", "copies"), ["did", "dx"])
    once = asked.filter("copies > 1").groupBy("did", "dx").agg(F.first("row").alias("row")).select("row")
    return sure.unionByName(asked.filter("copies = 1").select("row")).unionByName(once).select("row.*")
