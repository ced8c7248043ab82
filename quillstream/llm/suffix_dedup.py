"""Removal of repeated substrings by a column-wise collection Burrows-Wheeler transform.

Every window of `min_len` bytes is assigned to one anchor: the smallest hash among its 32-byte grams, the rightmost of
equals. The choice depends on the window's content alone, so equal windows have equal anchors at equal offsets. The
windows of one anchor lie next to each other; together they span a *snippet* of the text.

1. Anchors of all texts are written once as (gram hash, snippet hash, place); grams that occur once drop out. A bit table
   of fixed size tells the others; where it is too small for a corpus some single grams stay, which changes no result.
2. Equal snippets of a gram (by hash) are one, with their number; two of them are kept as representatives, of others one.
   They are cut from their texts, and the collection transform of a gram's representatives is built from right to left:
   every round inserts one symbol of each document, sorts stably by it (the LF mapping) and updates the common prefixes
   with range minima over those of the last round. Snippets are aligned at their anchor and equal windows start in the same
   column, so the segments of different columns need not be interleaved: a segment depends only on the one before. The
   columns come from the sorted shuffle files of Spark, read sequentially in blocks of bounded size.
3. Windows whose common prefix with a neighbour reaches `min_len` repeat. If both representatives of equal snippets repeat
   in all windows, so do all their copies: they are looked up, never sent through the transform.
4. A gram with more than `max_group` different snippets has its windows counted by a 128-bit hash instead, with partial
   sums before the shuffle, so that no task holds an unbounded group.

Text reaches Python once for anchors; texts of documents that have nothing to cut, by another bit table, are not shuffled.
Links are never formed in pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import blocks, has_bit, map_batches, materialize, pack, partitions, rows_in, slots_of, utf8

GRAM = 32
BLOCK = 1 << 18
#: Bits of the tables that tell grams and documents apart from those that need no further work.
_GRAM_SLOTS, _DOC_SLOTS = 1 << 25, 1 << 24
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(t: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes from each position on, by doubling."""
    h, m, base = t.astype(np.uint64) + np.uint64(1), 1, _BASE
    while m < GRAM:
        h = h[:-m] * np.uint64(base) + h[m:]
        m, base = 2 * m, base * base % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m = 1
    out = x
    while 2 * m <= width:
        out = np.minimum(out[:-m], out[m:])
        m *= 2
    return np.minimum(out[: len(out) - (width - m)], out[width - m :]) if width > m else out


def anchors(t: np.ndarray, ends: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, gram hash) of the windows in texts that lie one after another up to `ends`."""
    if len(t) < min_len:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = gram_hashes(t)
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    pos = (low - (sliding_min(key, min_len - GRAM + 1) & low)).astype(np.int64)
    valid = np.ones(len(pos), bool)
    for e in ends[:-1]:
        valid[max(0, e - min_len + 1) : min(e, len(pos))] = False
    v = np.flatnonzero(valid)
    if not len(v):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    p = pos[v]
    cut = np.flatnonzero((p[1:] != p[:-1]) | (v[1:] != v[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(v)]]) - 1
    return p[first], v[first], v[last], h[p[first]]


def _find(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, start, end = utf8(batch.column(2))
            did, dx = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            out: list[tuple[np.ndarray, ...]] = []
            for i, j in blocks(start, end, BLOCK):
                base, stop = int(start[i]), int(end[j - 1])
                # a text longer than a block is taken in parts that overlap by a window less one byte
                for a in range(base, max(stop - min_len, base) + 1, BLOCK) if j == i + 1 and stop - base > 2 * BLOCK else (base,):
                    b = min(stop, a + BLOCK + min_len - 1) if j == i + 1 and stop - base > 2 * BLOCK else stop
                    t = data[a:b]
                    p, lo, hi, h = anchors(t, end[i:j] - base if b == stop and a == base else np.array([b - a]), min_len)
                    if not len(p):
                        continue
                    view = memoryview(t)
                    sh = np.array([digest(view[x:y]) for x, y in zip(lo.tolist(), (hi + min_len).tolist())], np.uint64)
                    k = i + np.searchsorted(end[i:j] - a, lo, "right")
                    out.append((did[k], dx[k], (p + a - start[k]).astype(np.int32), (p - lo).astype(np.int16), (hi - lo + 1).astype(np.int16), h.view(np.int64), sh.view(np.int64)))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["did", "dx", "p", "lo", "nw", "ah", "sh"])

    return run


def _cut(min_len: int):
    """Snippets asked for, from their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, start, _ = utf8(batch.column(0))
            want = batch.column(1)
            rows = want.flatten()
            doc = np.repeat(np.arange(len(batch)), np.diff(np.asarray(want.offsets)))
            did, dx, p, lo, nw, ah, sh, n = (np.asarray(rows.field(k)) for k in ("did", "dx", "p", "lo", "nw", "ah", "sh", "n"))
            for a in range(0, len(p), 4000):
                s = slice(a, a + 4000)
                x = start[doc[s]] + p[s] - lo[s]
                size = nw[s].astype(np.int64) + min_len - 1
                ends = np.cumsum(size)
                at = np.arange(ends[-1]) + np.repeat(x - (ends - size), size)
                snip = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[at])])
                yield pa.RecordBatch.from_arrays([pa.array(c[s]) for c in (ah, sh, did, dx, p, lo, nw)] + [pa.array(n[s] == 1), snip], names=["ah", "sh", "did", "dx", "p", "lo", "nw", "alone", "snip"])

    return run


def _windows(min_len: int):
    """All windows asked for, as 128-bit hashes: for grams with too many different snippets for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = (row["text"] or "").encode()
                for r in row["want"]:
                    s = r["p"] - r["lo"]
                    at = list(range(s, s + r["nw"]))
                    hs = [xxhash.xxh3_128_digest(text[x : x + min_len]) for x in at]
                    yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array([r["did"]] * len(at), pa.int64()), pa.array([r["dx"]] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array([r["n"]] * len(at), pa.int64())], names=["w", "did", "dx", "s", "n"])

    return run


def repeated_windows(snips: list[bytes], lo: np.ndarray, nw: np.ndarray, group: np.ndarray, min_len: int) -> np.ndarray:
    """For each snippet and column (from the leftmost window start to the anchor) whether another snippet of its group has
    the same window there. `group` ascends; snippets are aligned at their anchors (lo bytes in)."""
    m, left = len(snips), int(lo.max())
    right = max(len(s) - int(o) for s, o in zip(snips, lo))
    text = np.zeros((left + right, m), np.int16)  # 0: no symbol in this column
    size = np.array([len(s) for s in snips])
    flat = np.frombuffer(b"".join(snips), np.uint8)
    who = np.repeat(np.arange(m), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left - lo, size)
    text[at, who] = flat.astype(np.int16) + 1
    order, common = np.arange(m), np.zeros(m + 1, np.int64)
    base = group.astype(np.int64) * 512  # order stays sorted by group, so the place decides the group
    found = np.zeros((left + 1, m), bool)
    for col in range(left + right - 1, -1, -1):
        bwt = text[col][order]  # symbols before the suffixes of the last round, in their order
        key = base + bwt
        lf = np.argsort(key, kind="stable")
        key = key[lf]
        fresh = np.zeros(m + 1, np.int64)
        same = np.flatnonzero((key[1:] == key[:-1]) & (bwt[lf[1:]] > 0)) + 1
        if len(same):
            bounds = np.empty(2 * len(same), np.int64)
            bounds[::2], bounds[1::2] = lf[same - 1] + 1, lf[same] + 1
            fresh[same] = 1 + np.minimum.reduceat(common, bounds)[::2]
        order, common = order[lf], fresh
        if col <= left:
            found[col, order] = np.maximum(common[:-1], common[1:]) >= min_len
    start = left - lo
    cols = np.arange(left + 1)[:, None]
    return found & (cols >= start) & (cols < start + nw)


def _transform(min_len: int, block_rows: int):
    names, kinds = ["did", "dx", "s", "e", "ah", "sh"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Repeated spans of snippets that stand alone, and the equal snippets that repeat as a whole."""
        ah, sh, did, dx, p, lo, nw, alone, snip = zip(*rows)
        lo, nw, p = np.array(lo, np.int64), np.array(nw, np.int64), np.array(p, np.int64)
        group = np.cumsum(np.concatenate([[0], np.diff(np.array(ah)) != 0])).astype(np.int64)
        found, alone = repeated_windows(list(snip), lo, nw, group, min_len), np.array(alone)
        whole = sorted({(ah[k], sh[k]) for k in np.flatnonzero((found.sum(0) == nw) & ~alone).tolist()})
        if whole:
            none = pa.nulls(len(whole))
            yield pa.RecordBatch.from_arrays([none.cast(t) for t in kinds[:4]] + [pa.array(c, pa.int64()) for c in zip(*whole)], names=names)
        found &= alone
        edge = np.diff(np.vstack([np.zeros((1, len(rows)), np.int8), found.astype(np.int8), np.zeros((1, len(rows)), np.int8)]), axis=0).T
        who, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        if len(who):
            shift, none = p[who] - int(lo.max()), pa.nulls(len(who), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(did)[who]), pa.array(np.array(dx)[who]), pa.array((shift + a).astype(np.int32)), pa.array((shift + b - 1 + min_len).astype(np.int32)), none, none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(rows) >= block_rows and row[0] != rows[-1][0]:
                    yield from flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from flush(rows)

    return run


def _keep(decode: bool, has: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and what is left of their texts without the cuts; or, where `has` marks the documents with cuts, all others."""
    names = ["row", "n_bytes", "n_removed", "spans", "kept"]
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    for batch in batches:
        if has is not None:
            batch = batch.filter(pa.array(~has_bit(has, np.asarray(batch.column(2)) & (_DOC_SLOTS - 1))))
            none = [[]] * len(batch)
            _, start, end = utf8(batch.column(1))
            text = batch.column(1) if decode else batch.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(end - start, pa.int64()), pa.array(np.zeros(len(batch), np.int64)), pa.array(none, span), text], names=names)
            continue
        data, start, end = utf8(batch.column(1))
        spans, kept, gone = [], [], []
        offsets = batch.column(2)
        for i, cut in enumerate(offsets):
            text = data[start[i] : end[i]]
            out: list[list[int]] = []
            if cut.is_valid and len(cut):
                v = cut.values
                s, e = np.asarray(v.field(0)), np.asarray(v.field(1))
                k = np.argsort(s, kind="stable")
                s, e = s[k], np.maximum.accumulate(e[k])
                new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                out = [[int(a), int(b)] for a, b in zip(s[new], e[np.concatenate([new[1:], [len(s)]]) - 1])]
            if out:
                mask = np.ones(len(text), bool)
                for a, b in out:
                    mask[a:b] = False
                text = text[mask]
            spans.append([{"s": a, "e": b} for a, b in out])
            kept.append(text.tobytes().decode(errors="ignore") if decode else text.tobytes())
            gone.append(sum(b - a for a, b in out))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(end - start, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string() if decode else pa.binary())], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200, max_group: int = 1 << 14, block_rows: int = 20_000, decode: bool = False) -> DataFrame:
    """Each row of docs as `row` with n_bytes, n_removed, spans (maximal removed byte ranges, ascending) and kept (the
    remaining bytes). A byte goes if a string of min_len bytes that covers it starts anywhere else, in its own text or
    another; this is judged on the input. With decode, kept is text, without the rest of characters cut in two.

    Null texts are empty; null ids are an id; rows that repeat an id are separate documents, and equal rows repeat one
    another. Empty tables give no rows. Further columns stay inside `row`, so their names cannot clash.
    """
    if min_len < 2 * GRAM:
        raise ValueError(f"min_len must be {2 * GRAM} or more")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    did = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 62)))
    keyed = pack(docs, did.alias("did"), F.xxhash64(did, text).alias("dx"))
    inner = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")).alias("text")  # never beside the row: it would be moved twice
    key = ["did", "dx"]
    n = partitions(docs.sparkSession)

    found = materialize(map_batches(keyed.select(*key, inner), _find(min_len), "did long, dx long, p int, lo short, nw short, ah long, sh long"), "anchors")
    often = found.groupBy("ah").agg(F.count("*").alias("c")).filter("c > 1")
    again = materialize(rows_in(found, "ah", slots_of(often, "ah", _GRAM_SLOTS)), "repeated")
    # the tables below are written before they are joined, so that adaptive execution can split a hot gram
    place = F.struct("did", "dx", "p", "lo", "nw")
    each = materialize(again.groupBy("ah", "sh").agg(F.count("*").alias("n"), F.min(place).alias("r"), F.max(place).alias("r2")), "snippets")
    groups = each.groupBy("ah").agg(F.count("*").alias("d"), F.max("n").alias("most")).filter("d > 1 or most > 1")
    groups = materialize(groups.select("ah", "d"), "grams")
    mixed = each.join(groups, "ah").withColumn("r", F.explode(F.when(F.col("n") > 1, F.array("r", "r2")).otherwise(F.array("r"))))
    mixed = materialize(mixed.select("r.*", "ah", "sh", "n", "d"), "mixed")

    def texts_of(rows: DataFrame) -> DataFrame:
        """text and the rows asked of it."""
        want = rows.groupBy(*key).agg(F.collect_list(F.struct(*key, "p", "lo", "nw", "ah", "sh", "n")).alias("want"))
        texts = rows_in(keyed.select(*key, inner), "dx", slots_of(rows, "dx", _DOC_SLOTS))
        return texts.join(materialize(want, "asked"), key).select("text", "want")

    bounded, hot = mixed.filter(F.col("d") <= max_group), mixed.filter(F.col("d") > max_group)
    snips = map_batches(texts_of(bounded), _cut(min_len), "ah long, sh long, did long, dx long, p int, lo short, nw short, alone boolean, snip binary")
    spans = map_batches(snips.repartition(n, "ah").sortWithinPartitions("ah"), _transform(min_len, block_rows), "did long, dx long, s int, e int, ah long, sh long")
    spans = materialize(spans, "spans")
    parts, whole = [spans.filter("ah is null").select(*key, "s", "e")], spans.filter("ah is not null").select("ah", "sh")
    if not hot.isEmpty():
        w = materialize(map_batches(texts_of(hot), _windows(min_len), "w binary, did long, dx long, s int, n long"), "windows")
        twice = w.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w")
        parts.append(w.filter("n = 1").join(materialize(twice, "twice"), "w", "left_semi").select(*key, "s", (F.col("s") + min_len).alias("e")))
        whole = whole.unionByName(hot.filter("n > 1").select("ah", "sh").distinct())
    whole = materialize(whole, "whole")
    copies = rows_in(again, "sh", slots_of(whole, "sh", _GRAM_SLOTS)).join(whole, ["ah", "sh"], "left_semi")
    parts.append(copies.select(*key, (F.col("p") - F.col("lo")).alias("s"), (F.col("p") - F.col("lo") + F.col("nw") + (min_len - 1)).alias("e")))
    cuts = parts[0]
    for part in parts[1:]:
        cuts = cuts.unionByName(part)
    cuts = materialize(cuts.groupBy(*key).agg(F.collect_set(F.struct("s", "e")).alias("cuts")), "cuts")
    has = slots_of(cuts, "dx", _DOC_SLOTS)
    texts = keyed.select(*key, "row")
    schema = f"row {docs.schema.simpleString()}, n_bytes long, n_removed long, spans array<struct<s:int,e:int>>, kept {'string' if decode else 'binary'}"
    whole_ones = map_batches(texts.select("row", inner, "dx"), partial(_keep, decode, has), schema)
    cut = map_batches(rows_in(texts, "dx", has).join(cuts, key, "left").select("row", inner, "cuts"), partial(_keep, decode, None), schema)
    return whole_ones.unionByName(cut)


def brute_force(texts: list[str | None], min_len: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text, with a table of all windows: for tests."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for t in data:
        for i in range(len(t) - min_len + 1):
            w = t[i : i + min_len]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in data:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - min_len + 1):
            if seen[t[i : i + min_len]] > 1:
                mask[i : i + min_len] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1))
        out.append((len(t), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~mask].tobytes()).hexdigest()))
    return out
