"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from quillstream.llm import queries, spelling


def slipped(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            out[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def vocabulary(seed, n):
    rng = random.Random(seed)
    words = {"banana", "bananas", "abanana", "anana", "aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaab", "baaaaa", "élevés", "eleves", "elevés", "×÷abcd", "x" * 500, "x" * 499}
    while len(words) < n:
        w = list(rng.choice(sorted(words)) if rng.random() < 0.7 else "".join(rng.choice("abcé") for _ in range(rng.randint(5, 12))))
        at = rng.randrange(len(w) + 1)
        w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "ÿ"])
        if len(w) >= 2:
            words.add("".join(w))
    return {w: rng.choice([5, 5, 6, 25, 30, 125, 125, 700]) for w in words}


@pytest.mark.parametrize("shard_words", [1 << 15, 3])
def test_variants_are_all_pairs(spark, shard_words):
    words = vocabulary(1, 350)
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, form int").repartition(4)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, shard_words=shard_words).collect()}
    assert got == spelling.brute_force(words)


def test_one_edit_of_words():
    rng = random.Random(2)
    for _ in range(2000):
        u = "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))
        near = {u[:i] + c + u[i + d :] for i in range(len(u) + 1) for c in ("", "a", "b") for d in (0, 1) if i + d <= len(u)} - {u}
        v = rng.choice([*near, "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))])
        assert spelling.one_edit(u, v) == (v in near)


def test_counts_over_given_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = slipped(docs)
    rows = queries.op12_spelling(spark, sf).collect()
    assert {r.word: r.n for r in rows} == want
    near = {r.word: (r.n_near, r.form) for r in rows}
    for w in random.Random(3).sample(sorted(want), 40):
        close = [v for v in want if spelling.one_edit(w, v)]
        top = min(close, key=lambda v: (-want[v], v), default=None)
        assert near[w] == (len(close), top if top and want[top] >= 5 * want[w] else None)


def test_odd_rows(spark):
    rows = [(None, "Bananas " * 5), (1, None), (2, ""), (3, "abc×÷ÿd " * 3), (3, "abc×÷ÿd " * 3), (4, "ÉLÉVES " * 7), (5, "z" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, word int, w string")
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == slipped(rows)
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spelling.word_counts(df), dominance=1)
