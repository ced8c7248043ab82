"""BPE encoding and decoding with batched merge rounds in numpy.

The distinct words of a batch lie in one flat array of symbol ids. A round looks up every adjacent pair of a word by
binary search in the sorted pair keys (left * n + right), takes each word's lowest rank by a segmented minimum and
merges all places of that pair from left to right; words without a mergeable pair leave. A pair that a merge creates
has a later rank than the merge itself, so this equals one merge at a time. Finished words go to a bounded cache. A word
of over LONG bytes would take a round for each kind of pair in it, so its merges are taken from a heap instead.
Texts are normalised and split as the vocabulary file says; its added tokens are found in the raw text first.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import blocks, map_batches, utf8

CACHE_WORDS = 200_000
#: Whole texts of about so many bytes are encoded together, so that a run of long texts takes no more memory than others.
BLOCK_BYTES = 1 << 20
#: Bytes of a word beyond which its merges come from a heap.
LONG = 1000
#: Characters of a text that are split into words at a time.
STRETCH = 1 << 16

_SPACE = regex.compile(r"\s")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary file, as arrays."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.split = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        text = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.text = [text.get(i, "") for i in range(max(text) + 1)]
        self.n = np.int64(len(self.text))
        symbols = byte_symbols()
        self.inner = np.array([self.ids[s] for s in symbols], np.int64)
        self.final = np.array([self.ids[s + self.suffix] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([self.ids[a] * int(self.n) + self.ids[b] for a, b in pairs], np.int64)
        _, first = np.unique(key, return_index=True)
        self.keys, self.ranks = key[first], first.astype(np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.made = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str | int, int] = {}
        self.flat, self.size, self.first = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def normal(self, text: str) -> str:
        """The file also turns runs of white space into one space, but no piece holds white space."""
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # no rule for a final sigma

    def merge_long(self, raw: bytes) -> list[int]:
        """Token ids of one word: the pair of lowest rank first, of equal ones the leftmost."""
        data = np.frombuffer(raw, np.uint8)
        sym = [*self.inner[data[:-1]].tolist(), int(self.final[data[-1]])]
        n, big, rank_of, made = len(sym), int(self.n), self.rank_of, self.made
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of.get(sym[i] * big + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j < 0 or rank_of.get(sym[i] * big + sym[j]) != r:
                continue  # one of the two is gone
            sym[i], sym[j] = int(made[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of.get(sym[i] * big + sym[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of.get(sym[h] * big + sym[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [s for s in sym if s >= 0]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, one after another, and the number of ids of each."""
        raw = [w.encode() for w in words]
        if any(len(r) > LONG for r in raw):
            short = [w for w, r in zip(words, raw) if len(r) <= LONG]
            ids, size = self.merge(short) if short else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            rest = iter(np.split(ids, np.cumsum(size)[:-1]))
            parts = [np.array(self.merge_long(r), np.uint32) if len(r) > LONG else next(rest) for r in raw]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        last = np.cumsum(size) - 1
        sym[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        none = np.int64(len(self.made))
        while len(sym):
            key = sym[:-1] * self.n + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            low = np.repeat(low, length)
            going = low < none
            done_sym.append(sym[~going]), done_word.append(word[~going])
            sym, word, rank, low = sym[going], word[going], rank[going], low[going]
            if not len(sym):
                break
            hit = rank == low
            # places of one pair that overlap (aaa): every second one of a run counts, from the left
            run = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            start = np.repeat(run, np.diff(np.append(run, len(hit))))
            place = np.arange(len(hit))
            odd = np.zeros(len(hit), bool)
            odd[len(hit) - len(start) :] = (place[len(hit) - len(start) :] - start) % 2 == 1
            take = np.flatnonzero(hit & ~odd)
            sym[take] = self.made[rank[take]]
            stay = np.ones(len(sym), bool)
            stay[take + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, a list for each stretch; no word holds white space, so stretches end there."""
        text, at = self.normal(text), 0
        while at < len(text):
            gap = _SPACE.search(text, at + STRETCH)
            end = gap.start() if gap else len(text)
            yield self.split.findall(text[at:end])
            at = end

    def pieces(self, text: str) -> Iterator[list[str | int]]:
        """Words and ids of added tokens, in order, in lists of bounded length."""
        if self.find_added is None or "<|" not in text:
            yield from self.words(text)
            return
        at = 0
        for m in self.find_added.finditer(text):
            yield from self.words(text[at : m.start()])
            yield [self.added[m[0]]]
            at = m.end()
        yield from self.words(text[at:])

    def learn(self, words: set[str | int]) -> None:
        """Append the words' ids to the flat cache."""
        plain, fixed = [w for w in words if isinstance(w, str)], [w for w in words if not isinstance(w, str)]
        flat, size = self.merge(plain) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        size = np.concatenate([size, np.ones(len(fixed), np.int64)])
        self.flat = np.concatenate([self.flat, flat, np.array(fixed, np.uint32)])
        self.size = np.concatenate([self.size, size])
        self.cache.update(zip([*plain, *fixed], range(len(self.cache), len(self.size))))
        self.first = np.cumsum(self.size) - self.size

    def lookup(self, words: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and the number of ids of each."""
        new = {w for w in words if w not in self.cache}
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.forget()
            new = set(words)
        if new:
            self.learn(new)
        k = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        size = self.size[k]
        total = np.cumsum(size) - size
        return self.flat[np.repeat(self.first[k] - total, size) + np.arange(size.sum())], size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each. Words are held for a few stretches only."""
        ids, size = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        words: list[str | int] = []
        owner: list[int] = []
        ends: list[int] = []

        def flush() -> None:
            got, each = self.lookup(words)
            ids.append(got)
            total = np.concatenate([[0], np.cumsum(each)])[[0, *ends]]
            np.add.at(size, owner, np.diff(total))
            for held in (words, owner, ends):
                held.clear()

        for i, text in enumerate(texts):
            for part in self.pieces(text):
                words += part
                owner.append(i)
                ends.append(len(words))
                if len(words) > STRETCH:
                    flush()
        if words:
            flush()
        return np.concatenate(ids), size

    def decode(self, ids: np.ndarray) -> str:
        """The file names no decoder: token strings with a space between."""
        text = self.text
        return " ".join([" ".join([text[i] for i in ids[a : a + STRETCH].tolist()]) for a in range(0, len(ids), STRETCH)])


_LOADED: dict[str, Vocabulary] = {}


def _run(content: str, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = _LOADED.setdefault(content, Vocabulary(content)) if content not in _LOADED else _LOADED[content]
        for batch in batches:
            texts = batch.column(1)
            _, start, end = utf8(texts)
            for a, b in blocks(start, end, BLOCK_BYTES):
                ids, size = voc.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                decoded = [voc.decode(ids[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                column = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at * 4), pa.py_buffer(ids.astype("<u4"))]) if packed else pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), column, pa.array(decoded, pa.string())], names=["row", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", packed: bool = False, keep_text: bool = True) -> DataFrame:
    """Each row of docs as `row` with n_tokens, ids and decoded (token strings joined by spaces) of its whole text.

    ids is an array of int or, packed, a binary of little-endian unsigned 32-bit integers. vocabulary: the content of
    the file (about 1.7 MB, part of the task); the library is not used. Null and empty texts have no ids; further
    columns stay inside `row`; rows that repeat are encoded each; an empty table gives no rows. Without keep_text, `row`
    goes without the text, unless that is the only column, and a text crosses to Python once and doesn't come back.
    """
    kept = docs.columns if keep_text else [c for c in docs.columns if c != text_col] or docs.columns
    columns = [F.col(f"`{c}`") for c in kept]
    row = docs.select(*columns).schema.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kind = "binary" if packed else "array<int>"
    return map_batches(docs.select(F.struct(*columns).alias("row"), text.alias("text")), _run(vocabulary, packed), f"row {row}, n_tokens long, ids {kind}, decoded string")
