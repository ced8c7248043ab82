"""Operators against brute force, exact round trips and held-out accuracy, with nulls, empties, ties, clashes."""

import base64
import hashlib
import os
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import bpe, chat, common, decontaminate, quality, queries, simhash, suffix_dedup, topk, toxicity, urls, warc

ODD = "doc_id long, text string, n_removed int, ah string, spans string, row int"


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}é" if rng.random() < 0.05 else f"w{rng.randrange(size)}" for _ in range(n))


def corpus(seed, n=80):
    rng = random.Random(seed)
    passages = [words(rng, 60) for _ in range(4)]
    out = []
    for _ in range(n):
        x = words(rng, rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            p, k = rng.choice(passages), rng.randint(0, 40)
            x = x[: len(x) // 2] + p[k:] + x[len(x) // 2 :]
        out.append(x)
    return [*out, "a" * 1000, "ab" * 500, None, "", out[0], out[0], out[3][:100] + "X" + out[3][100:]]


@pytest.mark.parametrize("max_group, rows", [(1 << 16, 20_000), (3, 7)])
def test_suffix_dedup_is_brute_force(spark, max_group, rows):
    texts = corpus(1)
    df = spark.createDataFrame([(i, t, 0, "x", "y", 1) for i, t in enumerate(texts)], ODD)
    out = suffix_dedup.remove_repeats(df, min_len=80, max_group=max_group, block_rows=rows)
    got = {r.doc_id: tuple(r)[1:] for r in out.select("row.doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()}
    assert got == dict(enumerate(suffix_dedup.brute_force(texts, 80)))


def test_suffix_dedup_of_long_texts_in_blocks(spark, monkeypatch):
    # blocks are set in the worker, so its function runs here
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    text = words(random.Random(3), 400)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["did", "dx", "text"])
    rows = [r for b in suffix_dedup._find(100)([batch]) for r in b.to_pylist()]
    starts = sorted(s for r in rows for s in range(r["p"] - r["lo"], r["p"] - r["lo"] + r["nw"]))
    assert starts == list(range(len(text.encode()) - 99))


def test_suffix_dedup_ids_and_empty_table(spark):
    t = words(random.Random(5), 60)
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (8, "short")], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(df).collect())[0] == 0
    assert suffix_dedup.remove_repeats(df).filter("n_removed > 0").count() == 3
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_simhash_is_brute_force(spark):
    rng = random.Random(2)
    base = words(rng, 200).split()
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "Zq"
        texts[i] = " ".join(w)
    texts |= {60: None, 61: "", 62: " \t", 63: "One", 64: "one", 65: "a b", 66: texts[0], 67: "é\x85x"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, fp int")
    want = simhash.brute_force(texts)
    for bucket in (1 << 14, 3):
        got = {r.did: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(df, max_bucket=bucket).collect()}
        assert got == want
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == {c for _, c in want.values()}


def test_simhash_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "x y z"), (5, "x y z"), (5, "x y z"), (None, "lone text here")], "doc_id long, text string")
    got = sorted(((r.did, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]
    assert sorted((r.doc_id for r in simhash.keep_one(df).collect()), key=str) == [5, None]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_forest_of_a_chain():
    fp = np.array([1, 3, 7, 15, 255, 1 << 40], np.uint64)
    u, v = simhash.forest(np.zeros(6, np.int64), fp, 1)
    assert set(u.tolist()) == {3, 7, 15} and set(v.tolist()) == {1}


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", None, "Hello  World!! it's", "<|startoftext|>Hi <|endoftext|>x", "ΑΣ ΟΔΟΣ İ é é", "aaaaaaaa hahahaha", "123٣ 中文🎉 a_b", "<|startoftext|"]
    texts += [t for t in corpus(9, 20) if t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encode(df, queries.vocabulary()).select("row.doc_id", "ids", "decoded").collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, lib.decode(ids, skip_special_tokens=False))
    packed = {r.doc_id: bytes(r.ids) for r in bpe.encode(df, queries.vocabulary(), packed=True).select("row.doc_id", "ids").collect()}
    assert packed == {i: np.array(v[0], "<u4").tobytes() for i, v in got.items()}
    lean = bpe.encode(df, queries.vocabulary(), keep_text=False).select("row.*", "ids")
    assert lean.columns == ["doc_id", "ids"] and {r.doc_id: list(r.ids) for r in lean.collect()} == {i: v[0] for i, v in got.items()}


def test_bpe_of_long_words_and_edge_cases(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import time

    import public_tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = ["".join(rng.choice("etaoinshrd") for _ in range(3000)), "a" * 2001, "ab" * 700 + " x " + "é" * 900, "word " * 10]
    voc = bpe.Vocabulary(queries.vocabulary())
    ids, size = voc.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    began = time.perf_counter()
    voc.encode(["".join(rng.choice("etaoinshrd") for _ in range(100_000))])
    assert time.perf_counter() - began < 10
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 2)], "doc_id long, text string, ids int")
    assert [list(r.ids) for r in bpe.encode(df, queries.vocabulary()).collect()] == [lib.encode("x").ids] * 2
    assert bpe.encode(df.limit(0), queries.vocabulary()).count() == 0


def test_bpe_in_short_stretches(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(bpe, "STRETCH", 7)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    texts = ["", " \n ", "x" * 50, "one <|endoftext|> two's  three" * 9, *[t for t in corpus(9, 20) if t]]
    voc = bpe.Vocabulary(queries.vocabulary())
    ids, size = voc.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [voc.decode(x) for x in np.split(ids, np.cumsum(size)[:-1])] == [lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts]


def test_short_items_with_substitutions_are_found():
    for n in range(1, 13):  # of any length, if so wanted
        item = [f"w{n}x{i}" for i in range(n)]
        found = decontaminate.Items([n], [" ".join(item)], 13, 0.8)
        for k in range(n // 5 + 2):
            for out in combinations(range(n), min(k, n)):
                text = "before it " + " ".join("other" if i in out else w for i, w in enumerate(item)) + " and after"
                assert bool(found.find([text.encode()])) == (5 * len(out) <= n), (n, out)


def test_too_short_items_match_nothing(spark):
    docs = spark.createDataFrame([(i, f"the {i} cat sat on the mat", "x") for i in range(10)] + [(None, None, "x"), (11, "", "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, "the"), (2, None), (3, "on the mat"), (4, "3 cat sat on the mat")], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, items).count() == 2 and decontaminate.drop_contaminated(docs, items).columns == docs.columns
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()} == {(i, 4) for i in range(10)}  # five of six tokens
    assert decontaminate.drop_contaminated(docs, items.filter("item_id < 4")).count() == 12
    assert {(r.item_id, r.n_tokens) for r in decontaminate.short_items(items).collect()} == {(1, 1), (2, 0), (3, 3)}
    assert decontaminate.overlaps(docs.limit(0), items).count() == 0


def test_runs_of_one_word():
    import time

    found = decontaminate.Items([1], [" ".join(["the"] * 400)], 13, 0.8)
    began = time.perf_counter()
    assert found.find([b" ".join([b"the"] * 8000), b"the cat " * 20]) == [(0, 0, 400, 400, 0)]
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("least, identity", [(13, 0.8), (8, 0.8), (8, 0.7), (10, 0.9), (5, 0.5), (1, 0.8), (6, 1.0)])
def test_masks_hit_every_overlap(least, identity):
    """All choices of differing tokens in all lengths that matter: some mask has none of them under its ones."""
    masks = decontaminate.stretch_masks(least, identity)
    for n in range(least, 2 * least):
        at = [sum(1 << (i + k) for k, c in enumerate(m) if c == "1") for m in masks for i in range(n - len(m) + 1)]
        for out in combinations(range(n), decontaminate.allowed(n, identity)):
            other = sum(1 << i for i in out)
            assert any(not other & one for one in at), (n, out)


def test_every_overlap_at_a_fifth_of_substitutions():
    rng = random.Random(14)
    for _ in range(1000):
        n = rng.randint(13, 60)
        item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        out = set(rng.sample(range(n), n // 5))
        text = " ".join("x" if i in out else w for i, w in enumerate(item))
        assert decontaminate.Items([1], [" ".join(item)], 13, 0.8).find([f"before {text} after".encode()]), (n, out)


def test_decontamination_is_brute_force(spark):
    rng = random.Random(4)
    items = {k: words(rng, n) for k, n in enumerate([3, 6, 12, 13, 15, 30, 45, 0])}
    docs = {}
    for d in range(40):
        y = rng.choice(list(items.values())).split()
        for at in rng.sample(range(len(y)), rng.randint(0, min(len(y), len(y) // 5 + 1))):
            y[at] = "other"
        docs[d] = " ".join([words(rng, 20), *y, words(rng, 20)])
    docs |= {90: "", 91: items[5]}
    table = lambda d, name: spark.createDataFrame([(k, t) for k, t in d.items()], f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table(docs, "doc_id"), table(items, "item_id")).collect()}
    want = decontaminate.brute_force(docs, items)
    assert got == want
    clean = {r.doc_id for r in decontaminate.drop_contaminated(table(docs, "doc_id"), table(items, "item_id")).collect()}
    assert clean == set(docs) - {d for d, _ in got}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(table(docs, "doc_id"), none).count() == len(docs)


def test_stretch():
    e = np.array([1] * 10 + [0] + [1] * 3 + [0] * 9, bool)
    assert decontaminate.stretch(e, 13, 0.8) == (0, 16) and decontaminate.stretch(e, 17, 0.8) == (0, 0)


def test_topk_is_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[7] = x[13]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 24), (1150, [1.0] * 3), (1200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, F.col("id") % 50 == 0).collect()}
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = {}
    for i in range(0, 400, 50):
        s = q @ q[i]
        order = sorted((j for j in range(400) if j != i), key=lambda j: (-s[j], j))[:5]
        want |= {(i, k + 1): (j, int(s[j])) for k, j in enumerate(order)}
    assert got == want


def test_topk_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [3.0, 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in topk.search(df, F.col("id") % 50 == 0, k=3, scale=1).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 3), (0, 2, 1, 1), (0, 3, 1, 1)]
    assert topk.search(df.limit(0), F.col("id") == 0).count() == 0


def test_topk_bounds_hold_and_large_values():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 30)) * 100, rng.normal(size=(60, 30)) * 100
    for r in topk.levels(30):
        assert (a[:, :r] @ b[:, :r].T + topk.stats(a, r) @ topk.stats(b, r).T >= a @ b.T - 1e-6).all()
    turn = topk.turning(a)
    assert np.allclose(turn @ turn.T, np.eye(30)) and np.allclose((a @ turn) @ (b @ turn).T, a @ b.T)
    big = np.array([[2.0**40, 1.0]])
    assert topk.exact(big, big)[0] == min(2**80 + 1, 2**63 - 1)


def test_topk_bounds_exclude():
    """Without the bounds every pair would get its exact product; with them few do, and the results are the same."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(4000, 64)) / 8)
    ids = np.arange(len(x))
    best = topk.Best(ids[:100], x[:100], topk.turning(x), 5)
    for a in range(0, len(x), 500):
        best.add(ids[a : a + 500], x[a : a + 500])
    product = x[:100] @ x.T
    product[np.arange(100), np.arange(100)] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, product.shape), -product), axis=1)[:, :5]
    assert (best.found.reshape(100, 5) == want).all()
    assert best.met == 400_000 and best.followed < 0.3 * best.met  # the first block has no floor yet
    again = topk.Best(ids[:100], x[:100], topk.turning(x), 5, best.floor())
    again.add(ids, x)
    assert (again.found.reshape(100, 5) == want).all() and again.followed < 0.01 * again.met


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_end|>", "<n|", "<\\n|<|", None, "", "a\nb", queries.HOSTILE, "é<|"]
    rows = [(c, t, ["user", "assistant", "a\n<n|role", None][t % 4], nasty[(c + t) % len(nasty)], 1) for c in range(9) for t in range(8)] + [(None, None, "assistant", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, masked int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: r[1] or 0)
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in chat.format_turns(df).collect():
        assert r.formatted.count("<|im_start|>") == 1 and r.formatted.count("<|im_end|>") == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_of_long_texts(spark):
    import pyarrow as pa

    rows = ["x" * 3_000_000, "", "é" * 20_000, "short", "y" * 1_200_000]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 5), pa.array(range(5)), pa.array(["user"] * 5), pa.array(rows), pa.array([False] * 5)], names=list("abcde"))
    parts = list(chat._assemble([batch]))
    assert len(parts) >= 3 and [t for p in parts for t in p.column(2).to_pylist()] == [f"<|im_start|>user\n{t}<|im_end|>\n" for t in rows]


def test_warc_round_trip(spark):
    pages = [(1, "http://A.example.com/x?q#f", "<p>é</p>"), (2, "http://b.example.com/", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "http://c.org/\r\nX: y", "WARC/1.1\r\n\r\n\r\n\r\n"), (6, "http://d.org", "\x00" * 5), (7, "http://b.example.com/", "z" * 100_000)]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, copies string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    last = {}
    for i, _, h in pages:
        last[h or ""] = i
    for i, _, h in pages:
        data = (h or "").encode()
        r = got[i]
        assert (r["size"], r.digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.kind, r.refers_to) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert bytes(r.payload) == (data if r.kind == "response" else b"")
    a, c = common.shared_path(spark, "w"), common.shared_path(spark, "c")
    warc.write_archives(df, a, least=10_000)
    warc.write_index(spark, a, c, block_lines=2)
    found = warc.lookup(spark, a, c, ["http://b.example.com/", "HTTP://B.EXAMPLE.COM/", "http://none.org/"]).collect()
    assert sorted((r.page_id, r.kind) for r in found) == [(2, "response"), (7, "response")]
    assert {r.page_id for r in warc.lookup(spark, a, c, [None]).collect()} == {3, 4}


def test_warc_of_repeated_and_null_ids_and_no_pages(spark):
    rows = [(None, "u", "x"), (9, "u", "x"), (9, "u", "x"), (1, "v", "x"), (None, "w", "only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.kind, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    assert got == sorted([(None, "revisit", 9), (9, "response", None), (9, "response", None), (1, "revisit", 9), (None, "response", None)], key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_is_valid_for_another_reader(spark):
    import io
    import gzip

    a = common.shared_path(spark, "w")
    df = spark.createDataFrame([(i, f"http://h.org/{i}", "same" * (i % 2)) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, a)
    kinds = []
    for r in spark.read.format("binaryFile").load(a).collect():
        text, at = gzip.decompress(bytes(r.content)), 0
        while at < len(text):
            head, _, rest = text[at:].partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length", b"Content-Type"} <= set(fields)
            n = int(fields[b"Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            kinds.append(fields[b"WARC-Type"].decode())
            at += len(head) + 4 + n + 4
    assert kinds.count("warcinfo") >= 1 and kinds.count("response") == 2 and kinds.count("revisit") == 18


def test_warc_lookup_reads_few_ranges(tmp_path):
    """A key costs the directory and the blocks that can hold it, by binary search; not the index."""
    import pyarrow as pa

    lines = [(f"com,h{i // 3:04d})/", f"<urn:page:{i}>", "response", "f", i, 1) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines)], names=list("abcdef"))
    (tmp_path / "part").write_bytes(b"".join(v + b"\x00" for b in warc._blocks(10)([batch]) for v in b.column(0).to_pylist()))
    reads = []

    class Counted:
        def __init__(self, file):
            self.file, self.seek, self.size = file, file.seek, file.size

        def read(self, n):
            reads.append(n)
            return self.file.read(n)

    file = warc.opened(str(tmp_path / "part"))
    got = [x[1] for x in warc.find_lines(Counted(file), iter(["com,h0000)/", "com,h0500)/", "com,h9999)/", "nothing"]))]
    assert got == [f"<urn:page:{i}>" for i in (0, 1, 2, 1500, 1501, 1502)]
    assert len(reads) <= 8 and sum(reads) < 0.5 * file.size()
    assert warc.holders([("a", "c", "1"), ("c", "c", "2"), ("c", "f", "3"), ("h", "k", "4")], "c") == ["3", "2", "1"]
    assert warc.holders([("a", "c", "1")], "d") == [] and list(warc.ranges_of([(0, 5), (5, 5), (9_000_000, 1)])) == [(0, 10, [(0, 5), (5, 5)]), (9_000_000, 1, [(9_000_000, 1)])]


def test_warc_member_of_16_mib():
    import io

    raw = warc.member(1, "u", "response", "d", 1 << 24, None, b"x" * (1 << 24)) + b"\x00"
    ((at, n, data),) = warc.members(io.BytesIO(raw))
    assert (at, n) == (0, len(raw)) and len(warc.payload_of(warc.parse(data)[1])[1]) == 1 << 24


def test_url_rules(spark):
    rows = [("http://x.net/a", "net/", "block"), ("http://www.example.net/en/1", "example.net/en/", "allow"), ("http://EXAMPLE.net/fr", "net/", "block"), ("http://badexample.com/de/", None, None), ("https://a.example.com/de/1?x#y", "example.com/de/", "block"), ("http://o.org/fr/", "org/fr/", "allow"), ("nothing", None, "allow"), (None, None, "allow"), ("http://example.com/de", None, None)]
    df = spark.createDataFrame([(i, u, "h") for i, (u, *_) in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, (u, rule, verdict) in enumerate(rows):
        assert got[i].rule == rule and (verdict is None and got[i].verdict in ("allow", "block") or got[i].verdict == verdict)
    assert (got[4].host, got[4].path) == ("a.example.com", "/de/1") and (got[7].host, got[7].path) == ("", "")
    assert urls.judge(df.limit(0)).count() == 0


def judged(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, url string")
    return {texts[r.page_id]: r for r in urls.judge(df, **options).collect()}


def test_url_templates_of_one_host_differ(spark):
    """Labels cover ids that begin with 1; the others get the verdict of their template, not of their host."""
    rules = (("h.org", "/p/1", "block"), ("h.org", "/q/1", "allow"))
    texts = [f"http://h.org/{s}/{i}" for s in "pq" for i in (*range(10, 20), *range(20, 24))]
    got = judged(spark, [*texts, "http://h.org/other/7", "http://new.com/p/5", "http://new.com/q/5", "http://new.com/zz/y"], rules=rules)
    for t in texts:
        assert got[t].verdict == ("block" if "/p/" in t else "allow") and got[t].rule == (None if t[-2] == "2" else f"h.org/{t[13]}/1")
    assert got["http://h.org/p/20"].template != got["http://h.org/q/20"].template
    # an unseen host: what its template is elsewhere, and by default allowed
    assert [got[f"http://new.com/{x}"].verdict for x in ("p/5", "q/5", "zz/y")] == ["block", "allow", "allow"]


def test_url_segments_become_wildcards_and_branches_merge(spark):
    rules = (("h.org", "/a", "block"), ("h.org", "/w/b/1", "block"), ("h.org", "/w/c/1", "block"), ("h.org", "/w/d/1", "allow"))
    many = [f"http://h.org/{c}{i}x" for c in "az" for i in range(40)]
    deep = [f"http://h.org/w/{s}/{i}/end" for s in "bcd" for i in range(10, 24)]
    got = judged(spark, many, rules=rules, max_children=50)
    assert {got[u].template for u in many} == {"/*"} and {got[u].verdict for u in many} == {"block"}
    got = judged(spark, deep, rules=rules)
    merged = {s: {got[u].template for u in deep if f"/{s}/" in u} for s in "bcd"}
    assert merged["b"] == merged["c"] == {"/w/~1/*/end"} and merged["d"] == {"/w/d/*/end"}
    assert {got[u].verdict for u in deep if "/d/" not in u} == {"block"} and {got[u].verdict for u in deep if "/d/" in u} == {"allow"}


def test_url_rows_one_by_one(spark):
    df = spark.createDataFrame([(None, "http://a.net/x"), (1, "http://a.net/x"), (1, "http://b.com/y"), (1, None)], "page_id int, url string")
    assert sorted((str(r.page_id), r.host, r.verdict) for r in urls.judge(df).collect())[:2] == [("1", "", "allow"), ("1", "a.net", "block")]
    assert urls.judge(df).count() == 4


def test_url_columns_are_sql(spark, sf):
    import duckdb

    sql = f"""WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM '{sf}/pages.parquet'),
      h AS (SELECT page_id, lower(regexp_extract(u, '^.*?://([^/?#]*)', 1)) AS host, regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u)
      SELECT page_id, host, path, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h"""
    got = queries.op9_url_filter(spark, sf).collect()
    assert sorted((r.page_id, r.host, r.path, str(r.rule)) for r in got) == sorted((*r[:3], str(r[3])) for r in duckdb.connect().execute(sql).fetchall())
    assert all(r.verdict == ("allow" if r.rule in ("example.net/en/", "org/fr/") else "block") for r in got if r.rule)


def test_quality_held_out():
    rng = random.Random(6)
    texts = [(words(rng, 80) + ".", 1) if i % 3 else (" | ".join(words(rng, 60).upper().split()), 0) for i in range(120)]
    blob = [t.encode() for t, _ in texts]
    ends = np.cumsum([len(b) for b in blob])
    x = quality.features(np.frombuffer(b"".join(blob), np.uint8), ends - [len(b) for b in blob], ends)
    y = np.array([v for _, v in texts], float)
    model = quality.Model(np.ones(quality.FEATURES, np.float32), np.eye(quality.FEATURES, dtype=np.float32), np.zeros((0, 1), np.float32), y[:80], 5, 8.0)
    model.vectors = model.project(x[:80])
    s = model.score(np.vstack([x[80:], np.zeros_like(x[:1])]))
    assert ((s[:-1] >= 0.5) == (y[80:] == 1)).all() and 0 <= s[-1] <= 1


def test_quality_votes_are_brute_force(spark):
    rng = random.Random(12)
    texts = [words(rng, rng.randint(1, 60)) if i % 2 else " | ".join(words(rng, 20).split()).upper() for i in range(60)]
    texts += [texts[0], texts[2], "", None]
    rows = [(i, t, i % 2 if i < 40 else None, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, score string")
    model = quality.fit(df, "label", dims=8, neighbours=5)
    got = {r.doc_id: r.score for r in quality.score(df.unionByName(df), model).select("row.doc_id", "score").distinct().collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if not t:
            assert got[i] == model.labels.mean()
            continue
        data = np.frombuffer(t.encode(), np.uint8)
        v = model.project(quality.features(data, np.array([0]), np.array([len(data)])))[0]
        near = sorted(((round(float(np.dot(v, u)), 5), y) for u, y in zip(model.vectors, model.labels)), key=lambda p: -p[0])
        kth = near[4][0]
        sure, ties = [p for p in near if p[0] > kth], [p for p in near if p[0] == kth]
        part = (5 - len(sure)) / len(ties)
        weights = [(max(c, 1e-3) ** 8, y) for c, y in sure] + [(part * max(c, 1e-3) ** 8, y) for c, y in ties]
        assert abs(got[i] - sum(w * y for w, y in weights) / sum(w for w, _ in weights)) < 1e-3
    assert quality.score(df.limit(0), model).count() == 0
    none = quality.fit(df.limit(0), "label")
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    one = quality.fit(df.filter("label = 1"), "label")
    assert {r.score for r in quality.score(df, one).collect()} == {1.0}


def test_quality_sees_words_of_other_scripts():
    texts = ["правителството прие бюджета на страната днес", "ъъъъ щщщщ ъъщъ щъщъ ъщъщ ьььь", "κυβέρνηση και βουλή"]
    blob = [t.encode() for t in texts]
    ends = np.cumsum([len(b) for b in blob])
    x = quality.features(np.frombuffer(b"".join(blob), np.uint8), ends - [len(b) for b in blob], ends)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (unit @ unit.T)[0, 1] < 0.5 and (unit @ unit.T)[0, 2] < 0.5


def test_toxicity_tolerates_gaps():
    rng = random.Random(7)
    plain = [f"w{rng.choice('aeiou')}{rng.choice('rtnl')}{rng.choice('aeiou')}{rng.choice('dgst')}{rng.choice('aeiou')}" for _ in range(400)]
    bad = ["idiot", "moron", "clown"]
    docs = []
    for i in range(300):
        t = [rng.choice(plain) for _ in range(30)] + ([rng.choice(bad)] if i % 3 == 0 else [])
        docs.append((toxicity.units(" ".join(t)), int(i % 3 == 0)))
    model = toxicity.train(docs, landmarks=48, negatives=300)
    s = model.score(["you idiot there", "an i.d.i.o.t", "i d i o t now", "an idiiot", plain[0], "", "moron"])
    assert (s[[0, 1, 2, 3, 6]] >= 0.3).all() and (s[[4, 5]] < 0.3).all()


def test_toxicity_kernel_is_brute_force():
    from itertools import combinations

    def k3(s, t):
        return sum(toxicity.DECAY ** (a[2] - a[0] + b[2] - b[0] + 2) for a in combinations(range(len(s)), 3) for b in combinations(range(len(t)), 3) if all(s[x] == t[y] for x, y in zip(a, b)))

    ws = ["banana", "ananab", "naanna"]
    d = toxicity.dense(ws, [0])
    want = [[k3(a, b) / (k3(a, a) * k3(b, b)) ** 0.5 for b in ws] for a in ws]
    assert np.allclose(d @ d.T, want, atol=1e-5)
    table = np.random.default_rng(1).normal(size=toxicity.CODES**3).astype(np.float32)
    assert np.allclose(toxicity.linear(ws, table, [0]), d @ table, atol=1e-4)


def test_toxicity_learns_other_scripts():
    rng = random.Random(9)
    plain = ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(400)]
    bad = ["идиот", "глупак", "боклук"]
    docs = [(toxicity.units(" ".join([rng.choice(plain) for _ in range(30)] + ([rng.choice(bad)] if i % 3 == 0 else []))), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.train(docs, landmarks=48, negatives=300)
    s = model.score(["ти си идиот", "и.д.и.о.т", "глуупак", "боклук", *plain[:40], "an english text"])
    assert (s[:4] >= 0.3).all() and (s[4:] < 0.3).mean() > 0.9 and s[-1] < 0.3
    assert toxicity.codes(["абв"])[0].T.tolist() == [[0, 1, 2]] and toxicity.codes(["abв"])[1].tolist() == [0]


def test_toxicity_edge_cases(spark):
    rows = [(1, "a b", None), (2, None, 1), (3, "", 1), (4, "you utter moron", 1), (5, "plain words here", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumn("score", F.lit("s")).withColumn("row", F.lit(1))
    model = toxicity.fit(df, "label")
    out = toxicity.score(df.unionByName(df), model).select("row.doc_id", "score").collect()
    assert len(out) == 10 and all(0 <= r.score <= 1 for r in out) and len({(r.doc_id, r.score) for r in out}) == 5
    assert toxicity.drop_toxic(df, model).columns == df.columns
    assert toxicity.score(df.limit(0), model).count() == 0 and toxicity.drop_toxic(df.limit(0), model).count() == 0
    for only, score in ((0, 0.0), (1, 1.0)):
        one = toxicity.fit(df.filter(F.col("label") == only), "label")
        assert {round(r.score, 6) for r in toxicity.score(df, one).collect()} == {score}
    assert 0 <= toxicity.fit(df.limit(0), "label").score(["x", ""]).max() <= 1


def test_toxicity_is_learnt_in_a_task(spark, monkeypatch):
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows = [(" ".join([rng.choice(plain) for _ in range(20)] + (["idiot"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame([*rows, (None, 0), ("no label", None)], "text string, label int")
    got = toxicity.fit(df, "label", landmarks=24, negatives=100)
    sample = sorted([(toxicity.units(t), y) for t, y in [*rows, ("", 0)]], key=lambda d: (-d[1], " ".join(sorted(d[0]))))
    want = toxicity.train(sample, landmarks=24, negatives=100)
    texts = ["an idiot", "an i.d.i.o.t", "", *plain[:20]]
    assert np.allclose(got.score(texts), want.score(texts), atol=1e-3) and got.known == want.known and not toxicity.fit(df, "label").cache
    # the driver's memory holds no sample: its process gets weights only
    monkeypatch.setattr(toxicity, "train", lambda documents, **_: toxicity.Model(np.zeros(8, np.float32), float(os.getpid()), 1.0, float(len(documents))))
    told = toxicity.fit(df, "label")
    assert told.bias != os.getpid() and told.shift == 121
    assert toxicity.fit(df, "label", max_toxic=10, max_clean=20).shift == 30
    assert toxicity.fit(df.filter("label > 1"), "label").shift == 0


def held_out_rates(spark, sf, name, label):
    rows = queries.QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    rate = lambda y: np.mean([r.predicted == y for r in rows if r[label] == y])
    return rate(0), rate(1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    assert min(held_out_rates(spark, sf, "op3_quality", "quality")) >= 0.97
    clean, toxic = held_out_rates(spark, sf, "op8_toxicity", "toxic")
    assert clean >= 0.95 and toxic >= 0.84  # a few labels are wrong in these tables, too


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", queries.held_out(3, 1).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}
