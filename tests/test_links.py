"""Greedy near-duplicates, ranks of large groups, and similarity links against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstream.config import Config
from quillstream.functions import text as X
from quillstream.operators import neardup, ranks, stories


def greedy(rows, distance):
    """Kept (source, ordinal, fingerprint), by a pass in order."""
    kept = {}
    for s, o, h in sorted(set(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        if all(((h ^ k) & (2**64 - 1)).bit_count() > distance for _, k in kept.get(s, [])):
            kept.setdefault(s, []).append((o, h))
    return {(s, *x) for s, xs in kept.items() for x in xs}


def fingerprints(seed, n):
    """Chains of fingerprints, each a few bits from one before, so that what stays depends on the order."""
    rng = random.Random(seed)
    made = [rng.getrandbits(64) for _ in range(4)]
    while len(made) < n:
        h = rng.choice(made[-12:])
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randrange(64)
        made.append(h)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(made)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, distance", [(1, 4), (2, 4), (4, 7)])
def test_near_duplicates_are_the_greedy_pass(spark, seed, distance):
    rows = fingerprints(seed, 160 if seed < 4 else 40)
    rows += [("a", 5, 77), ("a", 5, 77), ("a", 5, 1 << 40), (None, None, 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "s string, o int, h long, node string, source int").repartition(3)
    for few in (100_000, 0) if seed == 4 else (100_000,):
        got = [(r.s, r.o, r.h) for r in neardup.drop_near_duplicates(df, "s", "o", "h", distance, few).collect()]
        assert len(got) == len(set(got)) and set(got) == greedy(rows, distance)
    assert neardup.drop_near_duplicates(df.limit(0), "s", "o", "h").count() == 0


def test_blocks_find_near_pairs_however_many_are_shared(spark):
    rows = fingerprints(9, 80)
    df = spark.createDataFrame(rows, "source string, place int, h long").filter("source = 'a'")
    mine = [(o, h) for s, o, h in rows if s == "a"]
    want = {(o, p) for o, h in mine for p, k in mine if o < p and ((h ^ k) & (2**64 - 1)).bit_count() <= 4}
    for shared in (1, 2, 3):
        assert {(r.early, r.late) for r in neardup.near_pairs(df, 4, shared).collect()} == want
    assert [neardup.shared_blocks(n, 4) for n in (0, 1 << 12, 1 << 13, 1 << 21, 1 << 22, 1 << 40)] == [1, 1, 2, 2, 3, 3]


def test_near_duplicates_need_no_task_per_source(spark):
    df = spark.createDataFrame(fingerprints(5, 20), "s string, o int, h long")
    plan = neardup.drop_near_duplicates(df, "s", "o", "h")._jdf.queryExecution().toString()
    assert "Window" not in plan and "collect_list" not in plan


def test_ranks_are_row_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.randint(0, 50), i, rng.choice([None, 1, 4])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int, cost int").repartition(5)
    got = ranks.ranked(df, [F.desc("v"), F.asc("i")], "r", ["g"]).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[2]))
    want = {r[2]: [x[2] for x in order if x[0] == r[0]].index(r[2]) + 1 for r in rows}
    assert {r.i: r.r for r in got} == want
    spent, want = 0, {}
    for r in order:
        want[r[2]] = spent
        spent += r[3] or 0
    assert {r.i: r.before for r in ranks.running(df, [F.desc("v"), F.asc("i")], F.col("cost"), "before").collect()} == want
    assert ranks.ranked(df.limit(0), [F.asc("i")], "r", ["g"]).count() == 0


def test_edges_of_groups_don_t_mix(spark):
    df = spark.createDataFrame([("g1", 1, ["a", "b"]), ("g1", 2, ["a", "b"]), ("g2", 1, ["c"]), ("g2", 2, ["a", "d"])], "g string, k int, s array<string>")
    assert [tuple(r) for r in stories.jaccard_edges(df, "k", "s", 0.3, ["g"]).collect()] == [("g1", 1, 2, 1.0)]


def test_links_of_copies(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["b", "a", "c"]), (3, ["a", "b", "c", "d"]), (4, []), (5, []), (6, ["x"]), (7, ["x"]), (8, ["x"])]
    df = spark.createDataFrame(rows, "k int, w array<string>")
    out = stories.with_copies(df, "k", stories.word_set(F.col("w")), lambda one: stories.jaccard_edges(one, "a", "items", 0.5))
    assert {(r.a, r.b): r.similarity for r in out.collect()} == {(1, 2): 1.0, (1, 3): 0.75, (6, 7): 1.0, (6, 8): 1.0}


def vectors(rows):
    """{key: {term: weight}} over all rows, copies too."""
    docs = {k: Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:])]) for k, w in rows}
    df = Counter(t for d in docs.values() for t in d)
    out = {}
    for k, d in docs.items():
        v = {t: (1 + math.log(c)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in d.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out[k] = {t: x / size for t, x in v.items()}
    return out


@pytest.mark.parametrize("least", [0.15, 0.42, 0.8])
def test_text_links_weigh_all_articles(spark, least):
    rng = random.Random(7)
    rows = []
    for k in range(120):
        base = rng.choice(rows)[1] if rows and rng.random() < 0.5 else [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randint(1, 14))]
        rows.append((k, [w if rng.random() < 0.8 else f"w{rng.randrange(40)}" for w in base] if rng.random() < 0.6 else list(base)))
    rows += [(200, []), (201, [])]
    v = vectors(rows)
    dot = lambda x, y: sum(w * v[y].get(t, 0) for t, w in v[x].items())
    first = {}
    for k, w in rows:
        first.setdefault(tuple(w), k)
    reps = sorted(first[w] for w in first if w)
    want = {(a, b) for a in reps for b in reps if a < b and dot(a, b) >= least} | {(first[tuple(w)], k) for k, w in rows if w and first[tuple(w)] != k}
    df = spark.createDataFrame([("c", k, w) for k, w in rows], "category string, k int, words array<string>")
    got = stories.text_links(df, "k", F.col("words"), Config(tfidf_threshold=least)).collect()
    assert {(r.a, r.b) for r in got} == want
    assert all(abs(r.similarity - dot(r.a, r.b)) < 1e-9 for r in got)


def test_bounds_leave_few_candidates(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.tokens(X.normalize(F.col("text"))).alias("words"))
    weights = stories.tfidf(d, "doc_id", "words").cache()
    met = stories.cosine_candidates(weights, 0.42).count()
    found = stories.cosine_edges(weights, 0.42).count()
    assert found <= met <= 4 * found + 200


@pytest.mark.parametrize("block", [1024, 7])
def test_component_links_have_all_pairs_components(spark, block):
    rng = random.Random(11)
    rows = [(rng.choice(["x", "y"]), k % 50, [f"g{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randint(0, 14))]) for k in range(90)]
    df = spark.createDataFrame(rows, "g string, k long, s array<string>")
    for least in (0.16, 0.5):
        links = {(r.g, r.a, r.b) for r in stories.same_component_links(df, "k", "s", least, ["g"], block).collect()}
        pairs = {(g, a, b) for g, a, s in rows for h, b, t in rows if g == h and a < b and s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= least}
        # rows of one key are one node
        assert components(links) == components(pairs)


def components(edges):
    to = {}

    def root(x):
        while to.setdefault(x, x) != x:
            x = to[x]
        return x

    for g, a, b in edges:
        x, y = sorted([root((g, a)), root((g, b))])
        to[y] = x
    out = {}
    for x in list(to):
        out.setdefault(root(x), set()).add(x)
    return sorted(sorted(c) for c in out.values() if len(c) > 1)


def test_best_match_of_equal_words(spark):
    now = spark.createDataFrame([(1, ["a", "b"]), (3, ["b", "a"]), (5, []), (7, ["z"])], "key long, words array<string>")
    before = spark.createDataFrame([(2, ["a", "b", "c"]), (4, ["a", "b"]), (6, ["b", "a"]), (8, [])], "key long, words array<string>")
    assert {(r.key, r.parent_key, r.similarity) for r in stories.best_match(now, before).collect()} == {(1, 4, 1.0), (3, 4, 1.0)}
