"""Vector codes against plain integers."""

import hashlib
import random

import numpy as np
import pytest

from quillstream.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("n, entries", [(120, 16), (7, 16), (300, 3)])
def test_codes_are_brute_force(spark, n, entries):
    rng = random.Random(n)
    grid = [round(rng.uniform(-1, 1), 2) for _ in range(9)]  # ties
    rows = [(i * 3, [float(np.float32(rng.choice(grid))) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(n)]
    df = frame(spark, [*rows, (-1, None, 1), (-2, [1.0, None] * 4, 1), (-3, [float("nan")] * 8, None), (-4, [float("-inf")] * 8, 2)])
    books = codes.fit(df, entries=entries, scale=16)
    want, final = codes.brute_force([(i, v) for i, v, _ in rows], entries=entries, scale=16)
    assert books.books.tolist() == final
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in final for e in p for x in e).encode()).hexdigest()
    got = codes.with_label_error(codes.compress(df, books)).collect()
    assert {r.id: (r.code, r.error) for r in got} == want and len(got) == n
    sums = {}
    for i, _, label in rows:
        sums[label] = sums.get(label, 0) + want[i][1]
    assert {r.id: r.label_error for r in got} == {i: sums[label] for i, _, label in rows}


def test_odd_vectors(spark):
    rows = [(5, [1.0] * 8, 1), (6, [2.0] * 4, 1), (7, [1.0] * 6, 1), (8, [], 1), (9, [3e38] * 8, 1), (9, [-3e38] * 8, 1), (None, [0.5] * 8, None)]
    books = codes.fit(frame(spark, rows), entries=2)
    got = codes.compress(frame(spark, rows), books).collect()
    assert sorted(str(r.id) for r in got) == ["5", "9", "9", "None"]
    assert all(r.error >= 0 for r in got)
    assert codes.compress(frame(spark, rows[1:2]), books).count() == 0
    none = frame(spark, rows).limit(0)
    assert codes.fit(none) is None
    assert codes.with_label_error(codes.compress(none, None)).count() == 0
    assert codes.compress(frame(spark, rows), books, label=None).filter("label IS NULL").count() == 4


def test_squares_stay_in_64_bits():
    for dim in (1, 3, 64, 65, 4096):
        assert 4 * dim * codes.limit(dim) ** 2 < 2**63
    x = np.full((3, 16), codes.limit(64))
    at, far = codes.nearest(x, np.stack([-x[0], x[0], x[0]]))
    assert at.tolist() == [1, 1, 1] and far.tolist() == [0, 0, 0]
    assert codes.nearest(x, -x[:1])[1].tolist() == [4 * 16 * codes.limit(64) ** 2] * 3
