"""Licence scan against a plain scan with regular expressions, and the expressions it evaluates."""

import random
import re

import pytest

from quillstream.llm import licences, queries


def plain(text):
    """Base columns by looking at every place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def pieces(seed, n):
    rng = random.Random(seed)
    some = ["cc", "by", "CC-BY", "nc", "General", "public", "license", "all", "rights", "reserved", "All\trights, reserved", "é", "x{y", "\x01", "3", "CC BY-NC 4.0", "mit license", "or", "SPDX-License-Identifier: MIT OR", "licensed under the", "\n", "Ünder"]
    return [rng.choice([" ", "", "-", "; "]).join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_base_is_plain_scan(spark):
    texts = [*pieces(1, 150), None, "", " ", "cc by", "cc by cc by", "all rights reserved" * 3, "all rights", "reserved", "x" * 300_000 + " cc by", "cc by " * 20_000]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words string")
    got = {r.doc_id: tuple(r)[1:] for r in licences.scan(df.repartition(3)).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_query_over_given_table(spark, sf):
    rows = {r.doc_id: r for r in queries.op11_licences(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (not r.score or r.labels)


CASES = {
    "SPDX-License-Identifier: MIT": ("mit", 0.1),
    "// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0\nint x;": ("apache-2.0,gpl-3.0-only,mit", 0.1),
    "SPDX-License-Identifier: MIT OR GPL-3.0-only AND CC-BY-NC-4.0": ("cc-by,cc-by-nc-4.0,gpl-3.0-only,mit", 0.1),
    "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND CC-BY-NC-4.0": ("cc-by,cc-by-nc-4.0,gpl-3.0-only,mit", 0.8),
    "SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0": ("gpl-2.0-or-later-with-classpath-exception-2.0", 0.45),
    "SPDX-License-Identifier: ((MIT OR": ("mit", 0.1),
    "SPDX-License-Identifier: MIT) AND GPL-3.0": ("mit", 0.1),
    "SPDX-License-Identifier:": ("", 0.0),
    "SPDX-License-Identifier: LicenseRef-Own": ("licenseref-own", 0.5),
    "Licensed under the MIT License or the Apache License, Version 2.0, at your option.": ("apache-2.0,mit", 0.1),
    "This work is licensed under the GNU General Public License, version 3.": ("gpl,gpl-3.0", 0.6),
    "licensed under the GNU General Public License version 2 or any later version with the Classpath exception": ("gpl,gpl-2.0-or-later-with-classpath-exception-2.0", 0.45),
    "Licensed under CC BY-NC 4.0.": ("cc-by,cc-by-nc-4.0", 0.8),
    "Released under the MIT License. All rights reserved.": ("mit,reserved", 1.0),
    "Released under the MIT License and something": ("mit", 0.1),
    "we like the mit license": ("mit", 0.1),
    "no notice, or and with (": ("", 0.0),
    "licensed under": ("", 0.0),
}


def test_expressions(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id int, text string")
    got = {r.text: (r.labels, pytest.approx(r.score)) for r in licences.scan(df).select("row.text", "labels", "score").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in CASES.items()}
    assert all(got[k][1] == v[1] for k, v in CASES.items())
    assert licences.scan(df.limit(0)).count() == 0


def test_postfix_is_evaluation_by_precedence():
    rng = random.Random(4)
    value = {"mit": 0.1, "mpl-2.0": 0.4, "gpl-3.0": 0.6, "reserved": 1.0}

    def made(depth):
        """(tokens, value) of a random tree, with the parentheses it needs."""
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(list(value))
            return [name], value[name], 9
        op = rng.choice(["or", "and"])
        own = {"or": 1, "and": 2}[op]
        left, right = made(depth - 1), made(depth - 1)
        wrap = lambda x, low: ["(", *x[0], ")"] if x[2] < low else x[0]
        return [*wrap(left, own), op, *wrap(right, own)], (min if op == "or" else max)(left[1], right[1]), own

    for _ in range(300):
        tokens, want, _ = made(4)
        assert licences.evaluate(licences.to_postfix(tokens))[0] == want
