"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A unit is a token of a sentence (white-space separated, also with its punctuation taken out, and runs of single letters
joined), cut into overlapping windows if it is long. The kernel of two units sums, over all triples of letters that
occur in both in order, decay**span of each occurrence, so letters put in between or left out lower it but don't hide an
insult; it is normalised. Its feature space has one axis per triple, so the machine in the Nyström space of `landmarks`
units folds into one weight per triple, and a unit is scored exactly in time linear in its triples. Letters are told
apart within their script, and every script has triples of its own.

Labels are those of documents. Sentences of documents labelled 0 are negative in all their units; of a document labelled
1 some sentence is toxic: its witness is the unit that scores highest, at first by how much likelier its own or its
first letters' occurrence is under label 1. Machine and witnesses are refitted in turn, with the worst false alarms
added to the negatives each time. The cut on the best unit of each labelled document is where the shares of toxic and of
clean ones beyond it differ most, in the widest gap there; a logistic curve through it gives the score, 0.3 at the cut.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import map_batches, pack, partitions

WINDOW = 12
CODES = 32
DECAY = 0.65
CACHE_UNITS = 200_000
_OTHER = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S{1,3}\s+\S{1,3}\s+\S{1,3}(?!\S)")


def units(text: str) -> set[str]:
    """The distinct units of a whole text. Sentences end at white space too, so no unit crosses one."""
    tokens = text.lower().split()
    distinct = set(tokens)
    found = set(filter(str.isalpha, distinct))
    for t in distinct - found:
        parts = _OTHER.sub(" ", t).split()
        found.update(parts)
        if len(parts) > 1:
            found.add("".join(parts))
    if _SPACED.search(text):
        run: list[str] = []
        for t in (*tokens, ""):
            letter = _OTHER.sub("", t) if len(t) <= 3 else ""
            if len(letter) == 1:
                run.append(letter)
            else:
                if len(run) > 2:
                    found.add("".join(run))
                run = []
    return {u for u in found if len(u) > 2}


def windows(unit: str) -> list[str]:
    return [unit] if len(unit) <= WINDOW else [unit[a : a + WINDOW] for a in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


#: First and last code point and first letter of the scripts with an alphabet of their own; all others are one.
SCRIPTS = ((0x41, 0x24F, ord("a")), (0x400, 0x4FF, 0x430), (0x370, 0x3FF, 0x3B1), (0x530, 0x58F, 0x561), (0x590, 0x5FF, 0x5D0), (0x600, 0x6FF, 0x627))


def letters(words: list[str]) -> np.ndarray:
    """Code points, a column for each word (of one length)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
    return np.ascontiguousarray(flat.reshape(len(words), -1).T)


def scripts(c: np.ndarray) -> np.ndarray:
    """The script that most letters of each word (column) have; of equally many the first."""
    of = np.full(c.shape, len(SCRIPTS))
    for k, (low, high, _) in enumerate(SCRIPTS):
        of[(c >= low) & (c <= high)] = k
    return np.stack([(of == k).sum(0) for k in range(len(SCRIPTS) + 1)]).argmax(0)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers below CODES, a column for each word (of one length), and each word's script. An alphabet's
    first 26 letters have a number each (32 in Cyrillic and in what has no alphabet here), other letters share the rest."""
    c = letters(words)
    script = scripts(c)
    first = np.array([s[2] for s in SCRIPTS] + [0])[script]
    own = np.array([32 if k in (1, len(SCRIPTS)) else 26 for k in range(len(SCRIPTS) + 1)])[script]
    at = c - first
    out = np.where((at >= 0) & (at < own), at, np.where(own < CODES, 26 + c % (CODES - 26), c % CODES))
    return np.ascontiguousarray(out.astype(np.int32)), script


def triples(c: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """The triples of letters at each choice of three places, as numbers, and the decay of the choice."""
    for j, k in combinations(range(1, len(c)), 2):
        tail = c[j] * CODES + c[k]
        for i in range(j):
            yield c[i] * (CODES * CODES) + tail, DECAY ** (k - i + 1)


def norms(c: np.ndarray) -> np.ndarray:
    """Square roots of each word's kernel with itself, by the recursion over pairs of prefixes."""
    n, m = c.shape
    same = [[(c[s] == c[t]).astype(np.float32) for t in range(n)] for s in range(n)]
    before = [[np.ones(m, np.float32)] * n] * n  # at [s][t]: pairs within the first s and t letters
    for _ in (1, 2):
        zero = np.zeros(m, np.float32)
        nxt = [[zero] * n]
        for s in range(1, n):
            row, line = zero, [zero]
            for t in range(1, n):
                row = np.float32(DECAY) * row + np.float32(DECAY**2) * before[s - 1][t - 1] * same[s - 1][t - 1]
                line.append(np.float32(DECAY) * nxt[s - 1][t] + row)
            nxt.append(line)
        before = nxt
    total = sum(before[s][t] * same[s][t] for s in range(n) for t in range(n))
    return np.sqrt(np.maximum(np.float32(DECAY**2) * total, 1e-12))


def by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for at in groups.values():
        for a in range(0, len(at), 4000):
            yield at[a : a + 4000], *codes([words[i] for i in at[a : a + 4000]])


def scripts_of(words: list[str]) -> list[int]:
    return sorted({int(k) for _, _, script in by_length(words) for k in np.unique(script)})


def dense(words: list[str], known: list[int]) -> np.ndarray:
    """Normalised features of each word (of WINDOW letters at most), one column per triple of each known script."""
    out = np.zeros((len(words), CODES**3 * len(known)), np.float32)
    place = np.array([known.index(k) if k in known else -1 for k in range(len(SCRIPTS) + 1)])
    for at, c, script in by_length(words):
        on = place[script] >= 0
        rows, offset = np.array(at)[on], place[script[on]] * CODES**3
        for key, d in triples(np.ascontiguousarray(c[:, on])):
            out[rows, key + offset] += d
        out[at] /= norms(c)[:, None]
    return out


def linear(words: list[str], table: np.ndarray, known: list[int]) -> np.ndarray:
    """Sum of the table over each word's normalised features (table: a weight per triple and known script, or a row of
    them). A word of another script has none."""
    out = np.zeros((len(words), *table.shape[1:]), np.float32)
    place = np.array([known.index(k) if k in known else -1 for k in range(len(SCRIPTS) + 1)])
    for at, c, script in by_length(words):
        on = place[script] >= 0
        c, rows, offset = np.ascontiguousarray(c[:, on]), np.array(at)[on], (place[script[on]] * CODES**3).astype(np.int32)
        if not len(rows):
            continue
        total = np.zeros((len(rows), *table.shape[1:]), np.float32)
        for key, d in triples(c):
            total += np.float32(d) * table[key + offset]
        length = norms(c)
        out[rows] = total / (length if table.ndim == 1 else length[:, None])
    return out


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss (y is -1 or 1), by Newton steps on its active rows."""
    x = np.hstack([z, np.ones((len(z), 1))]).astype(np.float64)
    w, reg = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    loss = lambda v: float((weight * np.maximum(0.0, 1 - y * (x @ v)) ** 2).sum() + (reg * v * v).sum())
    now = loss(w)
    for _ in range(60):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        step = np.linalg.solve(a.T @ x[on] + np.diag(reg), a.T @ y[on]) - w
        size = 1.0
        while (new := loss(w + size * step)) > now and size > 1e-4:
            size /= 2
        if new >= now - 1e-9 * abs(now):
            break
        w, now = w + size * step, new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float
    shift: float
    known: list[int] = field(default_factory=lambda: [0])
    cache: dict[str, float] = field(default_factory=dict)

    def best(self, texts: list[str]) -> np.ndarray:
        """The highest decision value among the units of each text."""
        per = [units(t) for t in texts]
        self.learn(set().union(*per) if per else set())
        low, cache = self.bias, self.cache
        return np.array([max(map(cache.__getitem__, u), default=low) for u in per])

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_UNITS:
            self.cache.clear()
            new = list(words)
        if new:
            part = [windows(w) for w in new]
            value = linear([x for p in part for x in p], self.table, self.known) + self.bias
            ends = np.cumsum([len(p) for p in part])
            self.cache.update(zip(new, np.maximum.reduceat(value, ends - [len(p) for p in part]).tolist()))

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.best(texts) + self.shift, -40, 40)))


def curve(x: np.ndarray, y: np.ndarray, at_cut: float = 0.3) -> tuple[float, float]:
    """Slope and shift of a logistic curve over decision values. Labels may be wrong, and a toxic document may show no
    sign, so the curve isn't fitted to all: it is `at_cut` where the shares of both labels beyond differ most (within a
    hundredth, in the middle of the widest gap), and 0.9 at the median of the documents labelled 1 beyond that."""
    v = np.unique(x)
    beyond = lambda some: 1 - np.searchsorted(np.sort(some), v[:-1], "right") / len(some)
    if len(v) < 2:
        return 1.0, -float(v[0])
    apart = beyond(x[y > 0]) - beyond(x[y <= 0])
    gap = np.where(apart >= apart.max() - 0.01, np.diff(v), -1)
    k = int(gap.argmax())
    cut = float(v[k] + v[k + 1]) / 2
    logit = lambda p: math.log(p / (1 - p))
    sure = x[(y > 0) & (x > cut)]
    slope = (logit(0.9) - logit(at_cut)) / max(0.05, float(np.median(sure)) - cut if len(sure) else 1.0)
    return slope, logit(at_cut) - slope * cut


def without_copies(documents: list[tuple[set[str], int]], slots: int = 8, alike: int = 3) -> list[tuple[set[str], int]]:
    """One of each group of near copies: words of a text copied often would else look like signs of its label. Two
    documents are copies if `alike` of their `slots` minimum hashes, over units that aren't common, agree."""
    df = Counter(u for us, _ in documents for u in us)
    hashes: dict[str, np.ndarray] = {}
    factors = np.random.default_rng(11).integers(1, 1 << 62, slots, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    seen: list[dict[int, list[int]]] = [{} for _ in range(slots)]
    kept = []
    for us, y in documents:
        rare = [u for u in us if df[u] <= 0.2 * len(documents) or len(documents) < 50]
        for u in rare:
            if u not in hashes:
                hashes[u] = (np.uint64(zlib.crc32(u.encode()) + 1) * factors) >> np.uint64(20)
        if rare:
            low = np.min([hashes[u] for u in rare], axis=0).tolist()
            if max(Counter(d for at, h in zip(seen, low) for d in at.get(h, ())).values(), default=0) >= alike:
                continue
            for at, h in zip(seen, low):
                at.setdefault(h, []).append(len(kept))
        kept.append((us, y))
    return kept


def train(documents: list[tuple[set[str], int]], landmarks: int = 256, rounds: int = 4, negatives: int = 6_000) -> Model:
    """A model from (units, label) of labelled documents."""
    # words of a text copied often would look like signs of its label: copies go where the label is rare
    clean = [u for u, y in documents if y != 1]
    toxic = [sorted(u) for u, _ in without_copies([d for d in documents if d[1] == 1], 16, 2)]
    documents = [(set(u), 1) for u in toxic] + [(u, 0) for u in clean]
    if not toxic or not clean:
        return Model(np.zeros(CODES**3, np.float32), -1.0, 1.0, 40.0 if toxic else -40.0)  # one label only: no score but 0 or 1
    keys = lambda u: {u, *(u[:n] + "*" for n in (4, 5) if len(u) > n)}
    in_toxic = Counter(k for u in toxic for k in set().union(*map(keys, u), set()))
    in_clean = Counter(k for u in clean for k in set().union(*map(keys, u), set()))
    some = min(5.0, max(2.0, len(toxic) / 12))  # documents that a sign must be seen in
    odds_of = lambda k: math.log((in_toxic[k] + 0.5) / (len(toxic) + 1)) - math.log((in_clean[k] + 0.5) / (len(clean) + 1)) if in_toxic[k] >= some else -9.0
    table = {k: odds_of(k) for k in in_toxic}
    odds = lambda k: table.get(k, -9.0)
    first = [max(((max(map(odds, keys(u))), u) for u in us), default=(-9.0, "")) for us in toxic]
    witness = [w for o, w in first if o > 1.5]
    if not witness:
        witness = [w for _, w in first if w]
    sure = [u for us in toxic for u in us if any(in_toxic[k] >= 1.6 * some and odds(k) > 2.5 for k in keys(u))]
    witness += sure
    rng = np.random.default_rng(3)
    clean_units = sorted(set().union(*clean))
    base = [clean_units[i] for i in sorted(rng.permutation(len(clean_units))[:negatives])]
    hard: set[str] = set()
    common = [w for w, _ in Counter(witness).most_common(landmarks * 2 // 3)]
    marks = [windows(w)[0] for w in dict.fromkeys([*common, *base[:: max(1, len(base) // (landmarks - len(common)))]])]
    model, everything = None, sorted(set(clean_units).union(*toxic))

    def scored() -> dict[str, float]:
        scores: dict[str, float] = {}
        for a in range(0, len(everything), CACHE_UNITS // 2):
            model.learn(set(everything[a : a + CACHE_UNITS // 2]))
            scores.update(model.cache)
            model.cache.clear()
        return scores

    known = scripts_of([w for u in toxic for w in u])
    for step in range(rounds):
        phi = dense(marks, known)
        value, vector = np.linalg.eigh((phi @ phi.T).astype(np.float64))
        good = value > 1e-5 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        axes = phi.T @ root.astype(np.float32)
        del phi
        pos = Counter(windows(w)[0] for w in witness)
        for w, _ in pos.most_common(100):  # as an insult with a letter put in would be written
            for k in range(1, min(len(w), WINDOW - 1)):
                pos[w[:k] + "xiea"[int(rng.integers(4))] + w[k:]] += 1
        neg = [x for w in {*base, *hard} - set(witness) for x in windows(w)]
        z = np.vstack([linear(list(pos), axes, known), linear(neg, axes, known)])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        weight = np.concatenate([np.sqrt(np.array(list(pos.values()), float)), np.full(len(neg), max(1.0, sum(map(math.sqrt, pos.values())) / len(neg)))])
        w, bias = svm(z, y, weight)
        # in blocks: a product with float64 copies its rows
        weights = np.concatenate([axes[a : a + CODES**2] @ w for a in range(0, len(axes), CODES**2)]).astype(np.float32)
        del axes, z, y, weight, neg
        model = Model(weights, bias, 1.0, 0.0, known)
        scores = scored()
        if step + 1 < rounds:
            worst = sorted(clean_units, key=lambda u: -scores[u])[:3000]
            hard |= set(worst)
            witness = sure + [u for us in toxic if us for u in [max(us, key=lambda u: scores[u])] if scores[u] > -0.5]
            common = [w for w, _ in Counter(witness).most_common(landmarks * 2 // 3)]
            marks = [windows(x)[0] for x in dict.fromkeys([*common, *worst[: landmarks - len(common)]])]
    x = [max(map(scores.__getitem__, us), default=model.bias) for us, _ in documents]
    model.slope, model.shift = curve(np.array(x), np.array([float(y == 1) for _, y in documents]))
    return model


def fit(labelled: DataFrame, label_col: str, text_col: str = "text", max_toxic: int = 800, max_clean: int = 1600, **options) -> Model:
    """Fit on at most max_toxic rows labelled 1 and max_clean labelled 0, chosen by a hash of their text. Rows without a
    label don't count. Units of whole texts are found where the rows are; those of the sample, bounded whatever the table,
    meet in one task that learns, and only the weights come to the driver."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = labelled.select(F.xxhash64(text).alias("h"), F.col(f"`{label_col}`").cast("int").alias("y"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(sorted(units(t))) for t in batch.column(1).to_pylist()], pa.string())], names=["y", "u"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = sorted((-y, u) for batch in batches for y, u in zip(*(c.to_pylist() for c in batch.columns)))
        shared: dict[str, str] = {}
        documents = [({shared.setdefault(x, x) for x in u.split()}, -y) for y, u in rows_of]
        del shared, rows_of
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(documents, **options))], pa.binary())], names=["model"])

    toxic, clean = (rows.filter(F.col("y") == label).orderBy("h").limit(most).select("y", "text") for label, most in ((1, max_toxic), (0, max_clean)))
    found = map_batches(toxic.unionByName(clean).repartition(partitions(labelled.sparkSession)), run, "y int, u string")
    got = map_batches(found.repartition(1), learn, "model binary").collect()
    return pickle.loads(got[0].model) if got else train([], **options)  # an empty table may have no task


def _scored(model: Model, docs: DataFrame, text_col: str, least: float | None):
    """A row and its score, or only rows that score below `least`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 250):
                part = batch.slice(a, 250)
                s = sent.value.score(part.column(1).to_pylist())
                rows = part.column(0)
                if least is not None:
                    keep = s < least
                    rows, s = rows.filter(pa.array(keep)), s[keep]
                yield pa.RecordBatch.from_arrays([rows, pa.array(s, pa.float64())], names=["row", "score"])

    return map_batches(pack(docs, text.alias("text")), run, f"row {docs.schema.simpleString()}, score double")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Each row of docs as `row` with score, 0 to 1, higher where toxicity is likelier.

    Null and empty texts have no unit and score as the bias alone does. Further columns stay inside `row`; repeated rows
    get equal scores; an empty table gives no rows. Units are deduplicated in each task and cached up to a bound.
    """
    return _scored(model, docs, text_col, None)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs that score below `least`, with their columns, whatever their names. Null and empty texts have no
    unit and stay, unless the model knows no label but 1; repeated rows stay or go together; an empty table stays empty."""
    return _scored(model, docs, text_col, least).select("row.*")
