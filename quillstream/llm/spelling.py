"""Spelling variants: words at one edit from each other, found by Aho-Corasick automata over their halves.

Two words that differ by one inserted, deleted or replaced code point leave one half of either whole: the first half of a
word stands at the other's beginning, or its second half at the other's end. Automaton shards hold the two segments of every
word, dealt by a hash of the segment. Every word is scanned by the shards of the (at most four) segments that a word of
compatible length can share with it; a hit counts where its offset and the lengths fit, and the distance is then verified.
A pair whose both halves fit is taken from the first half only, so each is found once, and what leaves a shard is one row per
word: how many near words, and the best of them. Pairs are never written out.

A segment of more than `shard_words` words is split into pieces, each an automaton of its own, which its words all meet.

Nulls have no words, a null id counts as an empty one, repeated rows count again, an empty table gives an empty result; only
the two named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import map_batches, materialize, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments in one automaton.
SHARD_WORDS = 1 << 15


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", slips: int = 199, min_points: int = 6, min_count: int = 5) -> DataFrame:
    """word and n: runs of Latin letters with A-Z lower-cased, of min_points code points and min_count occurrences at least.

    Where `slips` divides h, the crc32 of `<doc_id>:<run>`, code point h % length of the run is left out, as a stand-in for
    slips of the pen; 0 leaves out none. Shorter runs can't become words, so the pattern skips them.
    """
    docs = df.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    runs = docs.select("d", F.explode(F.regexp_extract_all("t", F.lit(rf"[A-Za-zÀ-ÿ]{{{min_points},}}"), F.lit(0))).alias("w"))
    plain = F.octet_length("w") == F.char_length("w")
    runs = runs.select("d", F.when(plain, F.lower("w")).otherwise(F.translate("w", UPPER, LOWER)).alias("w"))
    if slips:
        h = F.crc32(F.concat_ws(":", "d", "w").cast("binary"))
        runs = runs.select("w", h.alias("h"))
        at = (F.col("h") % F.char_length("w")).cast("int")
        cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.char_length("w")))
        runs = runs.select(F.when(F.col("h") % slips == 0, cut).otherwise(F.col("w")).alias("w")).filter(F.char_length("w") >= min_points)
    return runs.groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def one_edit(u: str, v: str) -> bool:
    """Whether u and v differ by exactly one inserted, deleted or replaced code point."""
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1:
        return False
    for i, c in enumerate(u):
        if c != v[i]:
            return u[i + 1 :] == v[i + 1 :] if len(u) == len(v) else u[i:] == v[i + 1 :]
    return len(u) < len(v)


class Shard:
    """An automaton over the segments of its members. Members of a segment are kept by length and outer code point: that of
    the end which the segment doesn't reach. A near word has the same one, unless that very code point is the edit; then what
    is left without it is the same, but for the edit."""

    def __init__(self, members: list[tuple[int, str, int]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.by_outer: dict[tuple, list[tuple[str, int]]] = {}
        self.by_stem: dict[tuple, list[tuple[str, int]]] = {}
        for half, word, n in members:
            mid = len(word) // 2
            segment = word[mid:] if half else word[:mid]
            self.automaton.add_word(segment, segment)
            self.by_outer.setdefault((half, segment, len(word), word[0] if half else word[-1]), []).append((word, n))
            self.by_stem.setdefault((half, segment, word[1:] if half else word[:-1]), []).append((word, n))
        self.automaton.make_automaton()

    def near(self, u: str) -> Iterator[tuple[str, int]]:
        """The members at one edit from u whose segment stands where it should."""
        size = len(u)
        for end, segment in self.automaton.iter(u):
            if end + 1 == len(segment):
                yield from self._left(u, segment)
            if end + 1 == size:
                yield from self._right(u, segment)

    def _left(self, u: str, segment: str) -> Iterator[tuple[str, int]]:
        for length in (len(u) - 1, len(u), len(u) + 1):
            if length // 2 == len(segment):
                for v in self.by_outer.get((0, segment, length, u[-1]), ()):
                    if one_edit(u, v[0]):
                        yield v
        for stem in (u[:-2], u[:-1], u):
            for v in self.by_stem.get((0, segment, stem), ()):
                if v[0][-1] != u[-1] and one_edit(u, v[0]):
                    yield v

    def _right(self, u: str, segment: str) -> Iterator[tuple[str, int]]:
        for length in (len(u) - 1, len(u), len(u) + 1):
            if length - length // 2 == len(segment):
                for v in self.by_outer.get((1, segment, length, u[0]), ()):
                    if not u.startswith(v[0][: length // 2]) and one_edit(u, v[0]):
                        yield v
        for stem in (u[2:], u[1:], u):
            for v in self.by_stem.get((1, segment, stem), ()):
                if v[0][0] != u[0] and not u.startswith(v[0][: len(v[0]) // 2]) and one_edit(u, v[0]):
                    yield v


_FOUND = "word string, n_near long, form_n long, form string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, piece, half and word: members (half 0 or 1) before the words to scan (half 2). A word that
    has several segments in a shard is scanned once."""
    now, members, shard, last = None, [], None, None
    for batch in batches:
        out: list[tuple[str, int, int, str]] = []
        for at, piece, half, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (at, piece) != now:
                now, members, shard, last = (at, piece), [], None, None
            if half < 2:
                members.append((half, word, n))
                continue
            if not members or word == last:
                continue
            last = word
            shard = shard or Shard(members)
            count, best = 0, (0, "")
            for v, theirs in shard.near(word):
                count += 1
                best = min(best, (-theirs, v))
            if count:
                out.append((word, count, -best[0], best[1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "form_n", "form"])


def _segment(half: int, length: Column) -> Column:
    """The first or second half of a word of the given length, as a word that has it shows it."""
    mid = (length / 2).cast("int")
    return F.left("word", mid) if half == 0 else F.right("word", length - mid)


def _dealt(words: DataFrame, count: int, shard_words: int) -> DataFrame:
    """shard, piece, half, word, n: a row per segment and word that the shard holds, then one per word that it scans."""
    size = F.char_length("word")
    keyed = lambda half, length: F.struct(F.lit(half).alias("half"), _segment(half, length).alias("segment"))
    held = words.select("word", "n", F.explode(F.array(keyed(0, size), keyed(1, size))).alias("k")).select("k.*", "word", "n")
    compatible = F.array_distinct(F.array(*[keyed(half, size + d) for half in (0, 1) for d in (-1, 0, 1)]))
    asked = words.select("word", "n", F.explode(compatible).alias("k")).select("k.*", "word", "n")
    # at most 2 * count / shard_words rows
    hot = held.groupBy("half", "segment").count().filter(F.col("count") > shard_words).select("half", "segment", F.ceil(F.col("count") / shard_words).cast("int").alias("pieces"))
    hot = materialize(hot, "segments")
    shards = max(1, -(-2 * count // shard_words))
    mixed = F.xxhash64("half", "segment")
    # a split segment has negative numbers of its own
    shard = F.when(F.col("pieces").isNull(), F.pmod(mixed, F.lit(shards))).otherwise(-1 - F.shiftrightunsigned(mixed, 1))
    held = held.join(hot, ["half", "segment"], "left")
    held = held.select(shard.alias("shard"), F.coalesce(F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"), F.lit(0)).alias("piece"), "half", "word", "n")
    asked = asked.join(hot, ["half", "segment"], "left")
    asked = asked.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"), F.lit(2).alias("half"), "word", "n")
    return held.unionByName(asked)


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of every word with a form, by pointer doubling: a form has several times the occurrences, so chains are
    as long as a logarithm, and their doubling takes a few rounds."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def variants(words: DataFrame, dominance: int = 5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words (of two code points or more) and their counts n.

    A word's form is its near word of largest n, ties to the smallest in code-point order, if that n is at least `dominance`
    (2 or more) times the word's own; root follows forms to the last.
    """
    if dominance < 2:
        raise ValueError("dominance must be 2 or more, else forms could lead in a circle")
    words = materialize(words.select("word", "n"), "words")
    dealt = _dealt(words, words.count(), shard_words)
    dealt = dealt.repartition(partitions(words.sparkSession), "shard", "piece").sortWithinPartitions("shard", "piece", "half", "word")
    found = map_batches(dealt, _scan, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    near = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    enough = -F.col("best.less") >= dominance * F.col("n")
    near = materialize(near.select("word", "n", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "near")
    roots = _roots(near.filter(F.col("form").isNotNull()))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute_force(words: dict[str, int], dominance: int = 5) -> dict[str, tuple]:
    """{word: (form, root, n, n_near, form_n)} by all pairs, for tests."""

    def far(u: str, v: str) -> int:
        row = list(range(len(v) + 1))
        for i, a in enumerate(u, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(v, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return row[-1]

    out = {}
    for w, n in words.items():
        near = [v for v in words if far(w, v) == 1]
        top = min(near, key=lambda v: (-words[v], v), default=None)
        form = top if top is not None and words[top] >= dominance * n else None
        out[w] = [form, None, n, len(near), words[form] if form else None]
    for w, r in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        r[1] = at
    return {w: tuple(r) for w, r in out.items()}
