"""What a query's method decides, against plain Python that follows its docstring: op1 at 200 bytes, op8's scores, op9's verdicts."""

import hashlib
import math
import random
import re
from collections import defaultdict
from itertools import combinations

import corpus_pipeline
from quillstream.llm import queries, suffix_dedup, toxicity, urls


def test_kept_bytes_of_whole_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, suffix_dedup.brute_force(list(texts.values()), 200)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op1_suffix_dedup(spark, sf).collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 20


def test_kept_texts_of_the_stage(spark):
    rng = random.Random(21)
    passages = [" ".join(f"w{rng.randrange(500)}" for _ in range(70)) for _ in range(3)]
    texts = [f"{i} first {rng.choice(passages)} then {rng.randrange(10**9)} {rng.choice(passages)[rng.randrange(60) :]} last" for i in range(30)]
    texts += [None, "", "of its own", texts[0], texts[0]]
    df = spark.createDataFrame([(i, t, len(t or ""), "r", "k", i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, row string, kept string, n_removed int")
    out = corpus_pipeline.suffix_stage(spark, df, "")
    assert out.columns == df.columns
    want = suffix_dedup.brute_force(texts, 200)
    for r in out.collect():
        if texts[r.doc_id] is None:
            assert r.text is None
        else:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3] and (want[r.doc_id][1] == 0 or r.n_chars == len(r.text))
        assert (r.row, r.kept, r.n_removed) == ("r", "k", r.doc_id)


def test_toxicity_scores(spark):
    """The curve of the highest weighted sum over all triples of letters of any window of any unit."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abdegilnorstu") for _ in range(rng.randint(3, 9)))
    plain, bad = [word() for _ in range(300)], ["wretch", "numbskull", "dimwit"]
    docs = [(toxicity.units(" ".join([rng.choice(plain) for _ in range(25)] + ([rng.choice(bad)] if i % 3 == 0 else []))), int(i % 3 == 0)) for i in range(240)]
    model = toxicity.train(docs, landmarks=40, negatives=300)
    texts = [" ".join(rng.choice(plain) for _ in range(rng.randint(1, 12))) for _ in range(20)] + ["a wr.etch", "n u m b s k u l l", "dimmwit here", "".join(plain[:6]), "", None, "a b"]

    def value(window):
        sums = defaultdict(float)
        for i, j, k in combinations(range(len(window)), 3):
            a, b, c = (ord(window[x]) - ord("a") for x in (i, j, k))
            sums[(a * 32 + b) * 32 + c] += 0.65 ** (k - i + 1)
        return sum(float(model.table[t]) * v for t, v in sums.items()) / math.sqrt(sum(v * v for v in sums.values())) + model.bias

    def score(text):
        best = max((value(w) for u in toxicity.units(text or "") for w in toxicity.windows(u)), default=model.bias)
        return 1 / (1 + math.exp(-min(40, max(-40, model.slope * best + model.shift))))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(df, model).select("row.doc_id", "score").collect()}
    want = {i: score(t) for i, t in enumerate(texts)}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-3
    assert all(want[i] >= 0.3 for i in (20, 21, 22))


def verdicts(pages, depth, most, alpha, least, z):
    """(verdict, template, purity) of each url of (url, rule's verdict or None), host by host and level by level."""
    leaves = {}
    split = [re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "") for url, _ in pages]
    host = [m[1].lower() if m else "" for m in split]
    shape = []
    for m in split:
        parts = [s for s in (m[2] if m else "").split("/") if s]
        variable = lambda s: re.search(r"^[0-9]+(\.[a-z]+)?$|^[0-9a-fA-F-]{16,}$|^([*]+|~[0-9]*)$", s) or len(s) > 40
        shape.append("/".join(["*" if variable(s) else s for s in parts[:depth]] + ["**"] * (len(parts) > depth)))
    for h, s, (_, given) in zip(host, shape, pages):
        n, b = leaves.get((h, s), (0, 0))
        leaves[h, s] = (n + (given is not None), b + (given == "block"))
    template = {key: "" for key in leaves}
    for level in range(depth + 1):
        branches = defaultdict(lambda: defaultdict(list))
        for h, s in leaves:
            part = s.split("/")
            if level < len(part):
                branches[h, template[h, s]][part[level]].append((h, s))
        for kids in branches.values():
            name = {s: "*" if len(kids) > most else s for s in kids}
            if 2 <= len(kids) <= most:
                counts = {s: [sum(leaves[k][x] for k in ks) for x in (0, 1)] for s, ks in kids.items()}
                groups = []  # [n, b, names]
                for s in sorted((s for s in kids if counts[s][0]), key=lambda s: (counts[s][1] / counts[s][0], s)):
                    n, b = counts[s]
                    if groups:
                        gn, gb, _ = groups[-1]
                        p = (gb + b) / (gn + n)
                        if abs(gb / gn - b / n) <= z * math.sqrt(p * (1 - p) * (1 / gn + 1 / n)) + 1e-12:
                            groups[-1] = [gn + n, gb + b, groups[-1][2] + [s]]
                            continue
                    groups.append([n, b, [s]])
                for g, (_, _, names) in enumerate(groups):
                    if len(names) > 1:
                        name |= {s: f"~{g}" for s in names}
            for s, ks in kids.items():
                for k in ks:
                    template[k] += "/" + name[s]
    total = lambda some: [sum(leaves[k][x] for k in leaves if some(k)) for x in (0, 1)]
    labels, blocked = total(lambda k: True)
    share = (blocked + 0.5) / (labels + 2)
    out = []
    for h, s, (_, given) in zip(host, shape, pages):
        (n, b), (hn, hb), (sn, sb) = total(lambda k: k[0] == h and template[k] == template[h, s]), total(lambda k: k[0] == h), total(lambda k: k[1] == s)
        if not h or hn + sn == 0:
            out.append((given or "allow", template[h, s] if h else None, None))
            continue
        odds = math.prod((x + alpha * share) / (y + alpha) / (1 - (x + alpha * share) / (y + alpha)) for x, y in ((hb, hn), (sb, sn))) / (share / (1 - share))
        purity = (b + alpha * odds / (1 + odds)) / (n + alpha)
        out.append((given or ("block" if purity >= least else "allow"), template[h, s], purity))
    return out


def test_url_verdicts(spark):
    rng = random.Random(23)
    rules = (("a.net", "/bad", "block"), ("a.net", "/good", "allow"), ("b.org", "/x/ads", "block"), ("b.org", "/x/news", "allow"), ("b.org", "/y/", "allow"), ("c.com", "/", "block"), *(("e.com", f"/{x}/{y}", v) for x in "pq" for y, v in (("a1", "block"), ("a2", "block"), ("b1", "allow"))))
    segment = lambda: rng.choice(["bad", "bad2", "good", "good1", "x", "y", "ads", "news", "17", "p.html", "deadbeefdeadbeef0", "~1", "*"])
    made = [f"http://{rng.choice(['a.net', 'w.a.net', 'B.org', 'b.org', 'd.com', 'c.com'])}/" + "/".join(segment() for _ in range(rng.randint(0, 6))) for _ in range(500)]
    made += [f"http://b.org/x/{s}/{i}" for s in ("ads", "ads2", "news", "news2", "else") for i in range(6)] + [f"http://a.net/good/k{i}" for i in range(9)]
    made += [f"http://e.com/{x}/{y}{end}" for x in "pq" for y in ("a1", "a2", "b1", "c1") for end in ("", "/u", "/u/v", "/w") for _ in range(rng.randint(0, 3))]
    made += [None, "", "no scheme", "http://", "http://d.com", "http://a.net/" + "s/" * 3000]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    options = dict(depth=4, max_children=6, alpha=2.0, least=0.5, z=1.96)
    got = {r.page_id: r for r in urls.judge(df, rules=rules, **options).collect()}
    given = [got[i].verdict if got[i].rule else None for i in range(len(made))]
    want = verdicts(list(zip(made, given)), 4, 6, 2.0, 0.5, 1.96)
    for i, (verdict, template, purity) in enumerate(want):
        assert got[i].template == template, made[i]
        assert (got[i].purity is None) == (purity is None) and (purity is None or abs(got[i].purity - purity) < 1e-9), made[i]
        assert got[i].verdict == verdict or abs(purity - 0.5) < 1e-9, made[i]
    learnt = {v for (v, _, _), g in zip(want, given) if g is None}
    assert learnt == {"allow", "block"} and any(t and "~" in t for _, t, _ in want) and any(t and "/*" in t for _, t, _ in want)
