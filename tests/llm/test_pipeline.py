from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import decontaminate, queries, suffix_dedup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        after = out.collect()
        ids = {r.doc_id for r in after}
        assert len(ids) == len(after) and ids <= set(before), name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if name == "suffix_array_dedup":
            want = dict(zip(before, suffix_dedup.brute_force(list(before.values()), 200)))
            assert all((r.text == before[r.doc_id]) == (want[r.doc_id][1] == 0) for r in after)
        if name == "benchmark_decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
            assert set(before) - ids == {d for d, _ in decontaminate.brute_force({d: t for d, t in before.items() if d not in ids}, items)}
        if k < len(corpus_pipeline.STAGES) - 1:
            docs = spark.createDataFrame(after, out.schema)


def test_near_copies(spark):
    import random

    from quillstream.llm import simhash_wide

    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    near = [*base[:100], "other", *base[101:200], "words", *base[201:]]
    far = [w if k % 4 else "x" for k, w in enumerate(base)]
    texts = [" ".join(t) for t in (base, near, base, far)] + [None, "", "lone", "lone"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "of its own", 1), (6, "lone", 1)], "doc_id long, text string, did int")
    assert sorted((r.doc_id for r in simhash_wide.keep_one(df).collect()), key=str) == [0, 3, 4, 6, None]
    assert simhash_wide.keep_one(df.limit(0)).count() == 0


def test_queries_give_a_row_each(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_suffix_dedup", "op6_simhash", "op3_quality", "op4_bpe"):
        assert queries.QUERIES[name](spark, sf).count() == n
    scores = queries.QUERIES["op3_quality"](spark, sf).agg(F.min("score"), F.max("score")).first()
    assert 0 <= scores[0] <= scores[1] <= 1


def shingled(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def jaccard(a, b):
    return len(shingled(a) & shingled(b)) / len(shingled(a) | shingled(b))


def near_pairs(least, most, seed):
    """Pairs of texts whose similarity is from least to most: a passage appended or swapped, words changed, short ones."""
    import random

    rng = random.Random(seed)
    pairs = []
    while len(pairs) < 80:
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((8, 9, 30, 120, 400)))]
        k, at = rng.randrange(1, max(2, len(w) // 3)), rng.randrange(len(w))
        new = [f"v{rng.randrange(10**6)}" for _ in range(k)]
        kind = len(pairs) % 3
        other = [*w, *new] if kind == 0 else [*w[:at], *new, *w[at + k :]] if kind == 1 else [rng.choice(new) if rng.random() < 0.03 else x for x in w]
        a, b = " ".join(w), " ".join(other)
        if least <= jaccard(a, b) <= most:
            pairs.append((a, b))
    return pairs


def kept_of(spark, texts, **named):
    from quillstream.llm import simhash_wide

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash_wide.keep_one(df, **named).collect()}


def test_near_copies_at_the_limit_all_go(spark):
    texts = [t for p in near_pairs(0.8, 0.85, 1) for t in p]
    assert kept_of(spark, texts) == set(range(0, len(texts), 2))


def test_texts_below_the_limit_all_stay(spark):
    texts = [t for p in near_pairs(0.74, 0.7999, 2) for t in p]
    assert kept_of(spark, texts) == set(range(len(texts)))


def test_near_copies_are_brute_force(spark, monkeypatch):
    import random

    from quillstream.llm import simhash_wide

    rng = random.Random(3)
    base = [[f"w{rng.randrange(50)}" for _ in range(rng.choice((6, 20, 60)))] for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.02 else "x" for w in b[: len(b) - rng.randrange(4)]) for b in base for _ in range(25)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert 12 < len(set(root)) < len(texts)
    assert kept_of(spark, texts) == set(root)
    monkeypatch.setattr(simhash_wide, "CHUNK", 3)
    assert kept_of(spark, texts) == set(root)


def test_near_copies_below_the_limit_leave_no_pairs(spark, monkeypatch):
    """Texts of one passage with words of their own (similarity 0.77), and some that do link: what is written grows with the
    texts, not with their pairs."""
    from quillstream.llm import simhash_wide

    passage = [f"w{k}" for k in range(300)]
    texts = [" ".join([*passage, *(f"v{i}-{k}" for k in range(44))]) for i in range(120)]
    for i in range(40, 43):  # like one in the middle, by words of its own
        texts.append(f"{texts[i]} more")
    assert 0.76 < jaccard(texts[0], texts[1]) < 0.78 and jaccard(texts[40], texts[120]) > 0.8
    rows, write = {}, simhash_wide.materialize

    def counted(df, name):
        out = write(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash_wide, "materialize", counted)
    assert kept_of(spark, texts) == set(range(120))
    assert max(rows.values()) < 25 * len(texts), rows
    monkeypatch.setattr(simhash_wide, "ITEMS", 5000)
    assert kept_of(spark, texts) == set(range(120))


def test_groups_of_several_chunks_are_brute_force(spark, monkeypatch):
    """Links that neither fingerprints nor the smallest of a bucket give, in a group that is dealt out as pairs of chunks."""
    import random

    from quillstream.llm import simhash_wide

    rng = random.Random(5)
    passage = [f"w{k}" for k in range(200)]
    own = [[f"v{g}-{k}" for k in range(36)] for g in range(12)]
    texts = [" ".join([*passage, *own[g][: 36 - rng.randrange(4)], *(f"u{g}-{i}-{k}" for k in range(rng.randrange(12)))]) for g in range(12) for i in range(6)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert 1 < len(set(root)) < len(texts)
    assert kept_of(spark, texts) == set(root)
    monkeypatch.setattr(simhash_wide, "ITEMS", 2000)
    assert kept_of(spark, texts) == set(root)
