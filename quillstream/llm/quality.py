"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is described by its words and its shape: counts of its hashed words, in any script; of byte-class trigrams (letters
by case, digits, spaces and kinds of punctuation; letters beyond ASCII by a hash of their bytes, a class per few letters),
so that one model serves all languages; and how its words repeat. Log counts weighted by inverse document frequency of a
bounded sample of labelled rows are projected on its leading singular vectors. The labelled vectors, at most
`max_labelled` of `dims` floats, are broadcast; the exact cosines of every document with all of them are computed in
blocks, and the `neighbours` nearest vote with weights that grow with their similarity. Of several that are equally near
where the number is reached, all vote with the share of the places left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import map_batches, pack, partitions, utf8
from quillstream.llm.decontaminate import tokens

_CLASS = np.full(256, 15, np.int64)
for _i, _c in enumerate(("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t", ".", ",", "!?", "#$%&*@^~", "|", "\"'`", "()[]{}<>", "-_=+/\\:;")):
    for _x in _c:
        _CLASS[ord(_x)] = _i
TRIGRAMS, WORDS, BINS = 4096, 2048, 32
FEATURES = TRIGRAMS + WORDS + 3 * BINS
#: Weight of words beside the shape: they say more of the topic than of the quality.
_WORD_WEIGHT = 0.2
_PART = 1 << 20


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text: shares of trigrams and of words (as log counts per 1000 bytes, per 200 words) and
    binned repetition. A text without a word or a letter has zeros only."""
    out = np.zeros((len(start), FEATURES), np.float32)
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        if a == b:
            continue
        count = np.zeros(TRIGRAMS, np.int64)
        for x in range(a, max(b - 2, a + 1), _PART):
            raw = data[x : min(b, x + _PART + 2)]
            c = np.where(raw < 128, _CLASS[raw], (raw.astype(np.int64) * 7) & 15)
            if len(c) > 2:
                count += np.bincount((c[:-2] << 8) | (c[1:-1] << 4) | c[2:], minlength=TRIGRAMS)
        out[i, :TRIGRAMS] = np.log1p(count * (1000.0 / (b - a)))
        words = tokens([data[a:b].tobytes().lower()])[0]
        n = len(words)
        if n:
            bins = np.bincount((words >> np.uint64(53)).astype(np.int64), minlength=WORDS)
            out[i, TRIGRAMS : TRIGRAMS + WORDS] = _WORD_WEIGHT * np.log1p(bins * (200.0 / n))
            ratios = (np.mean(words[1:] == words[:-1]) if n > 1 else 0.0, 1 - len(np.unique(words)) / n, min(1.0, np.log1p(n) / 12))
            for k, r in enumerate(ratios):
                out[i, TRIGRAMS + WORDS + k * BINS + min(BINS - 1, int(r * BINS))] = 3.0
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.axes
        return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        out, k = np.empty(len(x)), min(self.neighbours, len(self.labels))
        for a in range(0, len(x), 256):
            cos = np.round(self.project(x[a : a + 256]) @ self.vectors.T, 5)
            kth = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
            near = cos >= kth
            row, at = np.nonzero(near)
            value = cos[row, at]
            tie = value == kth[row, 0]
            ties, all_ = np.bincount(row, tie, len(cos)), np.bincount(row, minlength=len(cos))
            w = np.maximum(value, 1e-3).astype(np.float64) ** self.power
            w[tie] *= ((k - (all_ - ties)) / ties)[row[tie]]
            out[a : a + 256] = np.bincount(row, w * self.labels[at], len(cos)) / np.bincount(row, w, len(cos))
        out[~x.any(1)] = self.labels.mean()
        return np.clip(out, 0.0, 1.0)


def fit(labelled: DataFrame, label_col: str, text_col: str = "text", max_labelled: int = 4000, dims: int = 64, neighbours: int = 15, power: float = 8.0) -> Model:
    """Fit on at most max_labelled rows of labelled, chosen by a hash of their text. Rows without a label don't count."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = labelled.filter(F.col(f"`{label_col}`").isNotNull()).select(F.xxhash64(text).alias("h"), F.col(f"`{label_col}`").cast("double").alias("y"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*utf8(batch.column(1))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    chosen = rows.orderBy("h", "y").limit(max_labelled).select("y", "text").repartition(partitions(labelled.sparkSession))
    got = sorted(map_batches(chosen, run, "y double, x binary").collect(), key=lambda r: (r.x, r.y))
    if not got:
        return Model(np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros((0, 1), np.float32), np.zeros(0), neighbours, power)
    x = np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32)
    y = np.array([r.y for r in got])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    weighted = x
    weighted *= idf
    basis = np.random.default_rng(7).standard_normal((FEATURES, dims + 16)).astype(np.float32)
    for _ in range(4):  # subspace iteration for the leading right singular vectors
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, turn = np.linalg.svd(weighted @ basis, full_matrices=False)
    axes = (basis @ turn.T)[:, :dims]
    model = Model(idf, np.ascontiguousarray(axes).astype(np.float32), np.zeros((0, 1), np.float32), y, neighbours, power)
    z = weighted @ model.axes
    model.vectors = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Each row of docs as `row` with score, 0 to 1, higher where label 1 is likelier.

    Null and empty texts have no vector and score the share of label 1 among the labelled rows; without labelled rows
    every score is 0.5. Further columns stay inside `row`; repeated rows get equal scores; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(features(*utf8(part.column(1)))))], names=["row", "score"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return map_batches(pack(docs, text.alias("text")), run, f"row {docs.schema.simpleString()}, score double")
