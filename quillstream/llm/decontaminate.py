"""Benchmark decontamination with spaced seeds.

Texts become lower-case word tokens. A seed is a fixed mask over consecutive tokens: it hashes the tokens under its ones
and ignores the others, so a substituted word under a zero leaves the hash as it is. The seeds of the test items, a
sorted table, meet those of the training texts by binary search behind a bit table. Every hit names a diagonal (item,
text position less item position); there the tokens are compared, and an overlap counts if some aligned stretch has
`min_tokens` tokens (or the whole item, if it is shorter) and at least `identity` of them are equal. Items of fewer than
`least_item` tokens would match half a corpus and match nothing; `short_items` lists them. Where one hash has many places
in a text and in an item, as in runs of one word, all diagonals between the outermost are taken instead of all pairs.

No overlap is missed. A stretch of twice `min_tokens` or more has a part that is one too, so only shorter ones matter, and
of these only such as hold no shorter one. Their differing tokens all lie in a middle part (`stretch_masks`), so the two
ends are equal; what ends alone don't fix, parts of the middle do, one of which is free of differing tokens.

Items are sent to the tasks in blocks of a bounded size; a larger test set takes several passes. Texts aren't shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import map_batches, pack

#: Under one of these masks of six ones, any two substitutions in 13 tokens leave a hit.
MASKS = ("111111", "11001010011")
#: Ones that a mask has at least, so that chance hits are rare.
_ONES = 6
BLOCK_CHARS = 4_000_000
_TEXT_BYTES = 1 << 18
#: Pairs of places of one hash in one text and the items beyond which diagonals are taken as an interval.
_MANY = 4096
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_POW = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the word tokens of lower-cased UTF-8 texts."""
    t = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = _WORD[t]
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new = np.concatenate([[True], np.diff(at) > 1])
    first = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    value = (t[at].astype(np.uint64) + np.uint64(1)) * _POW[within & 255]
    ends = np.cumsum([len(x) + 1 for x in texts])
    return mix(np.add.reduceat(value, first)), np.searchsorted(ends, at[first], "right")


def seeds(tok: np.ndarray, who: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its first token) of the mask at every place where it fits into one text."""
    n = len(tok) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, len(mask) * 1_000_003 + int(mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h = h * np.uint64(0xD1342543DE82EF95) + tok[i : i + n]
    at = np.flatnonzero(who[:n] == who[len(mask) - 1 :])
    return mix(h[at]), at


def stretch(equal: np.ndarray, least: int, identity: float) -> tuple[int, int]:
    """The longest stretch of at least `least` places of which `identity` are equal: (start, length), length 0 if none."""
    s = np.concatenate([[0], np.cumsum(np.where(equal, 100, 0) - round(100 * identity))])
    low, high = np.minimum.accumulate(s), np.maximum.accumulate(s[::-1])[::-1]
    best, i, j, n = (0, 0), 0, 0, len(s)
    while j < n:  # longest i < j with s[j] >= s[i]
        if high[j] >= low[i]:
            if j - i > best[1]:
                best = (i, j - i)
            j += 1
        else:
            i += 1
            j = max(i, j)
    return best if best[1] >= least else (0, 0)


def allowed(n: int, identity: float) -> int:
    """Differing tokens that an overlap of n tokens may have."""
    return n - math.ceil(n * identity - 1e-9)


def parted_masks(n: int, most: int, ends: int = 0, free: int = 2) -> list[str]:
    """Masks over n places of which `most` may differ, but none of the first and last `ends`: one of them has no such place
    under its ones. The middle falls into `free` parts more than may differ, and each mask takes all ends and `free` parts."""
    middle = n - 2 * ends
    part = [i * (most + free) // middle for i in range(middle)]
    masks = {"1" * ends + "".join("1" if p in kept else "0" for p in part) + "1" * ends for kept in combinations(range(most + free), free)}
    return sorted(masks)


def whole_masks(n: int, identity: float) -> list[str]:
    """Masks over a whole item of n tokens, one of which any match of that identity leaves as it is."""
    return parted_masks(n, allowed(n, identity))


def stretch_masks(min_tokens: int, identity: float) -> list[str]:
    """Masks of which one hits every stretch of at least `min_tokens` tokens with that identity.

    Take a stretch of n tokens, n < 2 * min_tokens, that holds no shorter one, with as many differing tokens as n allows.
    If p is the least length that allows one fewer, the first p tokens and the last p ones hold all of them: so they lie
    between n - p and p, and n - p tokens at either end are equal. Where a token fewer allows as many, the stretch holds a
    shorter one. Ends with fewer than `_ONES` tokens are completed by parts of the middle.
    """
    most = allowed(min_tokens, identity)
    masks = set(MASKS) if min_tokens >= 13 and most <= 2 else set(whole_masks(min_tokens, identity))
    for n in range(min_tokens + 1, 2 * min_tokens):
        t = allowed(n, identity)
        if t == allowed(n - 1, identity):
            continue
        p = next(m for m in range(min_tokens, n) if allowed(m, identity) == t - 1)
        ends, free = n - p, 0
        while free < n - 2 * ends and 2 * ends + free * ((n - 2 * ends) // (t + free or 1)) < _ONES:
            free += 1
        masks |= set(parted_masks(n, t, ends, free)) if free else {"1" * ends + "0" * (n - 2 * ends) + "1" * ends}
    return sorted(masks)


class Items:
    """The seeds and tokens of a block of test items."""

    def __init__(self, ids: list, texts: list[str], min_tokens: int, identity: float, least_item: int = 1) -> None:
        self.ids, self.min_tokens, self.identity = ids, min_tokens, identity
        self.tok, who = tokens([t.lower().encode() for t in texts])
        self.first = np.searchsorted(who, np.arange(len(ids) + 1))
        size = np.diff(self.first)
        if (size < least_item).any():  # as if they were empty
            keep = (size >= least_item)[who]
            self.tok, who = self.tok[keep], who[keep]
            self.first = np.searchsorted(who, np.arange(len(ids) + 1))
            size = np.diff(self.first)
        short = {m for n in np.unique(size).tolist() if 0 < n < min_tokens for m in whole_masks(n, identity)} - (long := set(stretch_masks(min_tokens, identity)))
        self.masks = sorted(long) + sorted(short)
        hs, places = [], []
        for m in self.masks:
            h, at = seeds(self.tok, who, m)
            if m in short:
                whole = size[who[at]] == len(m)
                h, at = h[whole], at[whole]
            hs.append(h), places.append(at)
        h, place = np.concatenate(hs), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        self.hash, self.place = h[order], place[order].astype(np.int32)
        self.item = who[self.place].astype(np.int32)
        self.bits = max(16, int(len(h) * 8).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.hash >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, tokens in the stretch, equal ones, first token) of the best stretch of each pair that overlaps."""
        tok, who = tokens(texts)
        start = np.searchsorted(who, np.arange(len(texts) + 1))
        pairs: set[tuple[int, int, int]] = set()
        for m in self.masks:
            h, at = seeds(tok, who, m)
            hit = np.flatnonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)]) if len(h) else []
            if not len(hit):
                continue
            h, at = h[hit], at[hit]
            a, b = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            h, at, a, b = (x[b > a] for x in (h, at, a, b))
            if not len(h):
                continue
            order = np.lexsort((at, h, who[at]))
            h, at, a, b = h[order], at[order], a[order], b[order]
            run = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (who[at[1:]] != who[at[:-1]])]))
            count = np.diff(np.append(run, len(h)))
            many = count * (b - a)[run] > _MANY
            for i, c in zip(run[many].tolist(), count[many].tolist()):
                doc, lo, hi = int(who[at[i]]), int(at[i]), int(at[i + c - 1])
                items, place = self.item[a[i] : b[i]], self.place[a[i] : b[i]]
                for k in np.unique(items).tolist():
                    p = place[items == k]
                    base = int(self.first[k] - start[doc])
                    pairs.update((doc, k, g) for g in range(lo - int(p.max()) + base, hi - int(p.min()) + base + 1))
            few = np.repeat(~many, count)
            at, a, b = at[few], a[few], b[few]
            k = np.repeat(np.arange(len(at)), b - a)
            if not len(k):
                continue
            e = np.arange(len(k)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[k]
            doc, item = who[at[k]], self.item[e]
            diagonal = (at[k] - start[doc]) - (self.place[e] - self.first[item])
            pairs.update(zip(doc.tolist(), item.tolist(), diagonal.tolist()))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, g in pairs:
            a, b, n = int(start[d]), int(start[d + 1]), int(self.first[k + 1] - self.first[k])
            x, y = max(0, -g), min(n, b - a - g)
            if y <= x:
                continue
            equal = tok[a + g + x : a + g + y] == self.tok[self.first[k] + x : self.first[k] + y]
            s, length = stretch(equal, min(self.min_tokens, n), self.identity)
            if length:
                found = (length, int(equal[s : s + length].sum()), g + x + s)
                if (found[0], found[1], -found[2]) > ((o := best.get((d, k), (0, 0, 0)))[0], o[1], -o[2]):
                    best[d, k] = found
        return [(d, k, *v) for (d, k), v in sorted(best.items())]


def item_blocks(items: DataFrame, item_col: str, text_col: str, min_tokens: int, identity: float, least_item: int) -> Iterator[Items]:
    rows = items.select(F.col(f"`{item_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    n = max(1, math.ceil((rows.agg(F.sum(F.length("t"))).first()[0] or 0) / BLOCK_CHARS))
    for b in range(n):
        got = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").collect()
        yield Items([r.i for r in got], [r.t for r in got], min_tokens, identity, least_item)


def _parts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    held, size, first = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        held.append((t or "").lower().encode())
        size += len(held[-1])
        if size >= _TEXT_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = 13, identity: float = 0.8, least_item: int = 5) -> DataFrame:
    """doc_id, item_id, n_tokens, n_equal, at: for each row of docs and item that overlap, the longest aligned stretch
    (its tokens, the equal ones among them, its first token in the text).

    Null and empty texts and items overlap with nothing; ids may be null; repeated rows are reported each; further
    columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    out = None
    for block in item_blocks(items, item_col, item_text_col, min_tokens, identity, least_item):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, texts in _parts(batch.column(1)):
                    found = sent.value.find(texts)
                    if found:
                        doc, item, n, equal, at = zip(*found)
                        ids = batch.column(0).take(pa.array([first + d for d in doc]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([sent.value.ids[k] for k in item]), pa.array(n, pa.int64()), pa.array(equal, pa.int64()), pa.array(at, pa.int64())], names=["doc_id", "item_id", "n_tokens", "n_equal", "at"])

        one = map_batches(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), run, f"doc_id {kind}, item_id {item_kind}, n_tokens long, n_equal long, at long")
        out = one if out is None else out.unionByName(one)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = 13, identity: float = 0.8, least_item: int = 5) -> DataFrame:
    """The rows of docs that overlap with no item, with their columns, whatever their names. Null and empty texts overlap
    with nothing and stay; repeated rows stay or go together; without items, or with none of `least_item` tokens, all stay."""
    for block in item_blocks(items, item_col, item_text_col, min_tokens, identity, least_item):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for first, texts in _parts(batch.column(1)):
                    clean[[first + d for d, *_ in sent.value.find(texts)]] = False
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(clean))], names=["row"])

        docs = map_batches(pack(docs, F.col(f"`{text_col}`").cast("string").alias("text")), run, f"row {docs.schema.simpleString()}").select("row.*")
    return docs


def short_items(items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", least_item: int = 5) -> DataFrame:
    """item_id and n_tokens of the items that are too short to be looked for; null texts have no token."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([len(tokens([(t or "").lower().encode()])[0]) for t in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(n < least_item)), pa.array(n[n < least_item])], names=["item_id", "n_tokens"])

    return map_batches(items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")), run, f"item_id {kind}, n_tokens long")


def brute_force(docs: dict[int, str], items: dict[int, str], min_tokens: int = 13, identity: float = 0.8, least_item: int = 5) -> set[tuple[int, int]]:
    """Pairs that have such a stretch on any diagonal, with seeds or without: for tests."""
    import re

    word = lambda t: re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", t.lower())
    out = set()
    for d, t in docs.items():
        for k, u in items.items():
            x, y = word(t), word(u)
            if len(y) < least_item:
                continue
            for g in range(-len(y), len(x)):
                e = [x[g + j] == y[j] for j in range(max(0, -g), min(len(y), len(x) - g))]
                n = min(min_tokens, len(y))
                if n and any(sum(e[a:b]) >= identity * (b - a) - 1e-9 for a in range(len(e)) for b in range(a + n, len(e) + 1)):
                    out.add((d, k))
                    break
    return out
