"""Vector code compression: product quantisation in integers.

Components become floor(scale * x), vectors are cut into equal consecutive parts, and each part position has a codebook of at
most `entries` integer vectors, which starts as that part of the smallest kept ids. A round deals every part to its nearest
entry and replaces an entry by the floored mean of its parts. Codebooks are broadcast (entries * dimension integers, whatever
the rows); Arrow batches compute all squared distances as |c|^2 - 2 x.c + |x|^2 by int64 matrix products and take the first
smallest; each task adds up its parts per entry, and a grouped shuffle merges these sums. What reaches the driver in a round is
the codebooks' size. The vectors are read again in each round, in blocks, and never shuffled.

Vectors that are null or hold null or non-finite components, and those whose length isn't that of the smallest id's vector or
can't be cut into equal parts, take no part. Null ids count as the largest; of equal ids the vectors' order decides. Components
beyond +-limit(dimension), 2^27 at 64 dimensions, are held there, so that no sum of squares leaves 64 bits. With fewer rows than
entries, the codebooks have as many entries as there are rows. Unused entries stay. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import map_batches, materialize

#: Rows whose distances are in memory together: 8 MB with 256 entries.
BLOCK = 4096


def limit(dim: int) -> int:
    """A bound for components under which 4 * dim * bound^2 is below 2^63."""
    return 1 << (60 - max(1, dim - 1).bit_length()) // 2


def quantised(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list array of equal lengths without nulls, as int64."""
    x = np.asarray(vectors.flatten()).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(x * scale), -limit(dim), limit(dim)).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row's nearest entry, ties to the lower index."""
    at, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    norms, turned = (book * book).sum(1), np.ascontiguousarray(book.T)
    for a in range(0, len(x), BLOCK):
        b = x[a : a + BLOCK]
        d = norms - 2 * (b @ turned)
        first = d.argmin(1)
        at[a : a + BLOCK] = first
        far[a : a + BLOCK] = d[np.arange(len(b)), first] + (b * b).sum(1)
    return at, far


def _usable(vector: Column, parts: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & (F.size(vector) > 0) & (F.size(vector) % parts == 0)


class Codebooks:
    """An array (parts, entries, width) of int64, with what is needed to use it."""

    def __init__(self, books: np.ndarray, scale: int) -> None:
        self.books, self.scale = books, scale
        self.parts, self.entries, self.width = books.shape
        self.dim = self.parts * self.width

    def sha256(self) -> str:
        """Of all components as decimal numbers, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, squared distances), each (rows, parts)."""
        cut = x.reshape(len(x), self.parts, self.width)
        both = [nearest(np.ascontiguousarray(cut[:, p]), self.books[p]) for p in range(self.parts)]
        return np.stack([b[0] for b in both], 1), np.stack([b[1] for b in both], 1)

    def sums(self, x: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) of the parts of each entry."""
        n, total = np.zeros((self.parts, self.entries), np.int64), np.zeros(self.books.shape, np.int64)
        for p in range(self.parts):
            order = np.argsort(entry[:, p], kind="stable")
            used, first, count = np.unique(entry[order, p], return_index=True, return_counts=True)
            n[p, used] = count
            total[p, used] = np.add.reduceat(x[order, p * self.width : (p + 1) * self.width], first, axis=0)
        return n, total


def _start(vectors: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """Codebooks of the smallest ids: at most `entries` rows come to the driver."""
    ordered = vectors.orderBy(F.col("id").asc_nulls_last(), "v")
    rows = ordered.limit(entries).collect()
    if not rows:
        return None
    dim = len(rows[0].v)
    if any(len(r.v) != dim for r in rows):
        rows = ordered.filter(F.size("v") == dim).limit(entries).collect()
    x = quantised(pa.array([r.v for r in rows], pa.list_(pa.float64())), dim, scale)
    return Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, dim // parts).transpose(1, 0, 2)), scale)


def _moved(vectors: DataFrame, now: Codebooks) -> Codebooks:
    """One round: parts meet their nearest entries, whose means are the next entries."""
    sent = vectors.sparkSession.sparkContext.broadcast(now)
    sums = [f"s{i}" for i in range(now.width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = sent.value
        n, total = np.zeros((book.parts, book.entries), np.int64), np.zeros(book.books.shape, np.int64)
        for batch in batches:
            x = quantised(batch.column(0), book.dim, book.scale)
            if len(x):
                more = book.sums(x, book.assigned(x)[0])
                n += more[0]
                total += more[1]
        part, entry = np.nonzero(n)
        cols = [part.astype(np.int32), entry.astype(np.int32), n[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["part", "entry", "n", *sums])

    schema = "part int, entry int, n long" + "".join(f", {s} long" for s in sums)
    merged = map_batches(vectors.select("v"), run, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *sums]])
    books = now.books.copy()
    for r in merged.collect():  # parts * entries rows at most
        books[r.part, r.entry] = [r[s] // r.n for s in sums]
    sent.unpersist()
    return Codebooks(books, now.scale)


def fit(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks after the given rounds over all vectors; None if there is no usable one."""
    vectors = df.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("v")).filter(_usable(F.col("v"), parts))
    books = _start(vectors, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = _moved(vectors.filter(F.size("v") == books.dim), books)
    return books


_CODED = "id long, label string, code string, error long"


def compress(df: DataFrame, books: Codebooks | None, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """id, label, code, error of every usable vector. code has two hex digits for each part, in order (more where entries need
    more); error is the sum of the parts' squared distances."""
    shown = F.col(f"`{label}`").cast("string") if label else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), shown.alias("label"), F.col(f"`{vector}`").alias("v"))
    if books is None:
        return rows.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    rows = rows.filter(_usable(F.col("v"), books.parts) & (F.size("v") == books.dim))
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = sent.value
        digits = np.array([f"{i:0{max(2, len(f'{book.entries - 1:x}'))}x}" for i in range(book.entries)])
        for batch in batches:
            entry, far = book.assigned(quantised(batch.column(2), book.dim, book.scale))
            code = digits[entry[:, 0]]
            for p in range(1, book.parts):
                code = np.char.add(code, digits[entry[:, p]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()), pa.array(far.sum(1))], names=["id", "label", "code", "error"])

    return map_batches(rows, run, _CODED)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors' sum over equal labels, nulls together. The sums are made before the shuffle, and a label
    that holds many rows is met by broadcast or split by the skew join."""
    coded = materialize(coded, "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def brute_force(rows: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[dict, list]:
    """({id: (code, error)}, codebooks) in plain integers, for tests; rows are (id, vector) of usable vectors of one length."""
    kept = sorted((i, [int(scale * x // 1) for x in v]) for i, v in rows)
    width = len(kept[0][1]) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in kept}
    books = [[cut[i][p] for i, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        took = [[[] for _ in books[p]] for p in range(parts)]
        for v in cut.values():
            for p in range(parts):
                took[p][best(p, v[p])[1]].append(v[p])
        books = [[[sum(c) // len(t) for c in zip(*t)] if t else e for t, e in zip(took[p], books[p])] for p in range(parts)]
    out = {}
    for i, v in cut.items():
        found = [best(p, v[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, books
