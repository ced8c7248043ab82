"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are turned once by an orthogonal matrix, fitted on a bounded sample, so that their leading components vary most.
At resolution r the first r components stand for themselves (segments of length one) and the rest is SEGMENTS segments,
each known by its mean m and deviation s: the inner product over a segment of length l is at most l * (m * m' + s * s'),
and the squared distance at least l * ((m - m')**2 + (s - s')**2). A query block meets a candidate block coarse to fine:
the part below r is summed on from level to level, and only pairs whose bound reaches the query's floor, the k-th best
score it is known to have, go on. Once few are left they are followed one by one. Survivors get their exact integer score
from the quantised vectors. Bounds are rounded outwards, so no pair is lost.

Floors come from a first pass, in which every query block meets a few candidate blocks, so they don't depend on how the
search is split. Then query blocks and candidate blocks are dealt to a grid of cells, as many as shuffle partitions and
shaped so that the fewest copies are sent, and meet by a sort-merge join; each cell keeps k results per query, and a
window over those gives the k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import map_batches, materialize, partitions

BLOCK = 1024
#: Rows that the turning matrix of one dimension is fitted on, chosen by a hash of the id.
SAMPLE = 4096
SEGMENTS = 4
#: Pairs are followed one by one once at most one in FEW is left.
FEW = 8
_LOW = np.iinfo(np.int64).min
_PAIRS = 1 << 15


def levels(dim: int) -> list[int]:
    """Resolutions, coarse to fine; the last one is the vector itself."""
    return sorted({0, dim // 4, dim // 2, 5 * dim // 8, 3 * dim // 4, 7 * dim // 8, dim})


def stats(x: np.ndarray, r: int) -> np.ndarray:
    """sqrt(length) * (mean, deviation) of each segment behind the first r components, a row per vector."""
    cols = []
    for piece in np.array_split(x[:, r:], SEGMENTS, axis=1):
        if piece.shape[1]:
            root = math.sqrt(piece.shape[1])
            cols += [piece.mean(1) * root, piece.std(1) * root]
    return np.stack(cols, 1) if cols else np.zeros((len(x), 0))


def turning(x: np.ndarray) -> np.ndarray:
    """An orthogonal matrix under which the rows' components come in the order of their mean square."""
    _, axes = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(axes[:, ::-1])


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q with those of c, pair by pair, as int64; in floats where they are exact there, else
    in Python integers held at the ends of 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(x, y)), _LOW), -_LOW - 1) for x, y in zip(q, c)], np.int64)


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray | None, k: int, floor: np.ndarray | None = None) -> None:
        self.ids, self.x, self.turn, self.k = ids, x, turn, k
        self.turned = self.rotated(x)
        self.size = np.linalg.norm(self.turned, axis=1)
        self.bounds = {r: stats(self.turned, r) for r in levels(x.shape[1])}
        self.given = np.full(len(ids), _LOW) if floor is None else floor
        self.query, self.score, self.found = (np.zeros(0, np.int64) for _ in range(3))
        self.met = self.followed = 0

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return x @ self.turn if self.turn is not None else x

    def floor(self) -> np.ndarray:
        """A score that the k-th best of each query reaches."""
        low = self.given.copy()
        if len(self.query):
            n = np.bincount(self.query, minlength=len(low))
            full = np.flatnonzero(n >= self.k)
            last = np.cumsum(n) - 1
            low[full] = np.maximum(low[full], self.score[last[full]])
        return low

    def near(self, c: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (query, row) whose bounds reach the floor at every resolution."""
        sound = np.abs(c).max(initial=0) < 1e140 and np.abs(self.x).max(initial=0) < 1e140
        if not sound or (floor == _LOW).all():
            return tuple(x.ravel() for x in np.indices((len(self.x), len(c))))
        z = self.rotated(c)
        least = floor - 1e-9 * self.size * float(np.linalg.norm(z, axis=1).max(initial=0)) - 1e-6
        sum_, at, who, row = np.zeros((len(self.x), len(z))), 0, None, None
        for r in levels(c.shape[1]):
            if who is None:
                sum_ += self.turned[:, at:r] @ z[:, at:r].T
                alive = sum_ + self.bounds[r] @ stats(z, r).T >= least[:, None]
                if np.count_nonzero(alive) * FEW <= alive.size:
                    who, row = np.nonzero(alive)
                    sum_ = sum_[who, row]
            else:
                theirs = stats(z, r)
                stay = np.zeros(len(who), bool)
                for a in range(0, len(who), _PAIRS):
                    s = slice(a, a + _PAIRS)
                    sum_[s] += np.einsum("ij,ij->i", self.turned[who[s], at:r], z[row[s], at:r])
                    stay[s] = sum_[s] + np.einsum("ij,ij->i", self.bounds[r][who[s]], theirs[row[s]]) >= least[who[s]]
                who, row, sum_ = who[stay], row[stay], sum_[stay]
            at = r
        return (who, row) if who is not None else np.nonzero(alive)

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        floor = self.floor()
        who, row = self.near(c, floor)
        self.met += len(self.x) * len(c)
        self.followed += len(who)
        other = self.ids[who] != ids[row]
        who, row = who[other], row[other]
        parts = [(self.query, self.score, self.found)]
        for a in range(0, len(who), _PAIRS):
            w, at = who[a : a + _PAIRS], row[a : a + _PAIRS]
            s = exact(self.x[w], c[at])
            on = s >= floor[w]
            parts.append((w[on], s[on], ids[at[on]]))
        query, score, found = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((found, -np.maximum(score, _LOW + 1), query))
        query, score, found = query[order], score[order], found[order]
        first = np.searchsorted(query, query, "left")
        on = np.arange(len(query)) - first < self.k
        self.query, self.score, self.found = query[on], score[on], found[on]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.found), pa.array(self.score)], names=["query_id", "vec_id", "score"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to BLOCK vectors of one dimension: dim, ids, values as float64."""
    held: dict[int, tuple[list, list]] = {}

    def out(dim: int) -> pa.RecordBatch:
        ids, xs = held.pop(dim)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(xs).tobytes()], pa.binary())], names=["dim", "ids", "x"])

    for batch in batches:
        lists = batch.column(1)
        values, offsets = np.asarray(lists.values, np.float64), np.asarray(lists.offsets)
        for i, v in enumerate(np.asarray(batch.column(0))):
            x = values[offsets[i] : offsets[i + 1]]
            ids, xs = held.setdefault(len(x), ([], []))
            ids.append(v)
            xs.append(x)
            if len(ids) == BLOCK:
                yield out(len(x))
    for dim in list(held):
        yield out(dim)


def _search(k: int, turns: dict[int, np.ndarray], floors: bool):
    """Results of each query block against the candidate blocks beside it, or only the floors that they give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = None, None

        def out() -> pa.RecordBatch:
            if not floors:
                return best.batch()
            return pa.RecordBatch.from_arrays([pa.array([now[1]], pa.int64()), pa.array([best.floor().tobytes()], pa.binary())], names=["number", "floor"])

        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                if (row["dim"], row["number"]) != now:
                    if best:
                        yield out()
                    now = row["dim"], row["number"]
                    ids = np.frombuffer(row["q_ids"], np.int64)
                    given = np.frombuffer(row["floor"], np.int64) if row.get("floor") else None
                    best = Best(ids, np.frombuffer(row["q_x"], np.float64).reshape(len(ids), -1), turns.get(row["dim"]), k, given)
                ids = np.frombuffer(row["ids"], np.int64)
                best.add(ids, np.frombuffer(row["x"], np.float64).reshape(len(ids), -1))
        if best:
            yield out()

    return run


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and x: floor(scale * component) as double, of the vectors without null or non-finite components."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    raw = F.col(f"`{vec_col}`")
    sound = raw.isNotNull() & F.forall(raw, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return vectors.filter(sound & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x"))


def fitted(sound: DataFrame) -> dict[int, np.ndarray]:
    """The turning matrix of each dimension in a sample of at most SAMPLE rows."""
    by: dict[int, list] = {}
    for r in sound.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        by.setdefault(len(r.x), []).append(r.x)
    return {d: turning(np.array(rows) / max(1.0, float(np.abs(rows).max()))) for d, rows in by.items() if d > 1}


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for the rows where is_query (a column over `id`) holds, the k other rows with
    the highest inner products of the components floor(scale * x); ties go to the smaller id.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Vectors of
    different lengths have no score; empty ones score 0 with one another. Rows that repeat an id are candidates each but
    never score with one another; a query id that repeats gets the k best of all its rows. An empty table gives no rows.
    Further columns are not read. Products beyond 64 bits are held at its ends.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    sound = quantized(vectors, id_col, vec_col, scale)
    blocks = "dim int, ids binary, x binary"
    turns = fitted(sound)
    packed = materialize(map_batches(sound, _pack, blocks).withColumn("place", F.monotonically_increasing_id()), "candidates")
    asked = map_batches(sound.filter(is_query), _pack, blocks).withColumn("number", F.monotonically_increasing_id())
    asked = materialize(asked.select("dim", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), "number"), "queries")
    have, want = packed.count(), asked.count()

    # floors: of each dimension one block in a hundred, 1 to 8 of them, by a hash of its place
    some = Window.partitionBy("dim").orderBy(F.xxhash64("place"), "place")
    chosen = packed.select("dim", "place").withColumn("r", F.row_number().over(some)).filter(F.col("r") <= 8)
    chosen = chosen.filter(F.col("r") <= max(1, have // 100)).select("place")  # at most 8 rows a dimension
    few = packed.join(F.broadcast(chosen), "place").select("dim", "ids", "x")
    first = asked.join(few.hint("merge"), "dim").sortWithinPartitions("dim", "number")
    low = map_batches(first.select("dim", "number", "q_ids", "q_x", "ids", "x"), _search(k, turns, True), "number long, floor binary")
    asked = materialize(asked.join(low.hint("merge"), "number", "left"), "floors")

    # the grid: query blocks go to every column of their row, candidate blocks to every row of their column
    across = min(n, max(1, round(math.sqrt(n * max(have, 1) / max(want, 1)))))
    down = max(1, n // across)
    each_row, each_column = (F.explode(F.sequence(F.lit(0), F.lit(m - 1))) for m in (down, across))
    left = asked.withColumn("i", F.pmod(F.xxhash64("number"), F.lit(down)).cast("int")).withColumn("j", each_column)
    right = packed.withColumn("j", F.pmod(F.xxhash64("place"), F.lit(across)).cast("int")).withColumn("i", each_row)
    pairs = left.join(right.hint("merge"), ["dim", "i", "j"]).sortWithinPartitions("dim", "number")
    each = map_batches(pairs.select("dim", "number", "q_ids", "q_x", "floor", "ids", "x"), _search(k, turns, False), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
