"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates the
licence expressions that they open.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. A block of texts becomes one stream of words with
single spaces, in numpy, and the automaton runs over it once; its patterns begin and end with a space, so they match whole
words, and a mark between texts keeps matches inside one. Only texts with a hit are looked at one by one:

* a tag ("SPDX-License-Identifier:", "License-Expression:") opens an expression of identifiers up to the end of its line;
* a lead ("licensed under", "released under", ...) opens an expression of named licences, joined by and / or / with;
* a named licence elsewhere is a statement of its own.

WITH binds tighter than AND, AND tighter than OR. An expression has a restriction between 0 (public domain) and 1 (all
rights reserved): the reader may choose at OR (minimum), must obey both at AND (maximum), and an exception takes a quarter
off. A text's score is that of its strictest statement, 0 without any.

Nulls and empty texts have no words; repeated rows are scanned each; input columns are kept in the struct `row`, so their
names cannot clash; an empty table gives an empty result. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import arrow_schema, blocks, map_batches, pack, utf8

# Fixed values of the contract: phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Phrases of named licences (as words) and their identifiers, in lower case.
NAMES = {
    "mit license": "mit", "mit licence": "mit", "isc license": "isc", "zlib license": "zlib", "the unlicense": "unlicense",
    "apache license version 2 0": "apache-2.0", "apache license 2 0": "apache-2.0", "apache 2 0": "apache-2.0", "apache license": "apache-2.0",
    "bsd 2 clause license": "bsd-2-clause", "bsd 3 clause license": "bsd-3-clause", "bsd license": "bsd-3-clause",
    "mozilla public license version 2 0": "mpl-2.0", "mozilla public license": "mpl-2.0", "eclipse public license": "epl-2.0",
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "gnu general public license": "gpl", "general public license": "gpl",
    "gnu lesser general public license": "lgpl", "lesser general public license": "lgpl", "gnu lesser general public license version 3": "lgpl-3.0", "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu affero general public license": "agpl-3.0", "affero general public license": "agpl-3.0", "gnu affero general public license version 3": "agpl-3.0",
    "cc0": "cc0-1.0", "public domain": "public-domain", "all rights reserved": "reserved",
    **{f"cc {kind.replace('-', ' ')}{f' {v[0]} {v[1]}' if v else ''}": f"cc-{kind}{f'-{v[0]}.{v[1]}' if v else ''}" for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("", "20", "25", "30", "40")},
    "classpath exception": "classpath-exception-2.0", "llvm exception": "llvm-exception",
}
TAGS = ("spdx license identifier", "license expression")
LEADS = ("licensed under", "released under", "distributed under", "available under", "published under")
LATER = ("or any later version", "or later", "or at your option any later version")
#: Words that may stand between the names of an expression.
FILLERS = frozenset("the a an terms of version license licence either both at your option choice".split())

#: Restriction by the beginning of an identifier; the longest one that fits decides.
RESTRICTION = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "0bsd": 0.0, "mit": 0.1, "isc": 0.1, "zlib": 0.1, "bsd": 0.1, "apache": 0.1, "cc-by": 0.1,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.4, "cc-by-sa": 0.4, "gpl": 0.6, "agpl": 0.7, "cc-by-nc": 0.8, "cc-by-nd": 0.8, "reserved": 1.0,
}
UNKNOWN = 0.5
EXCEPTION = 0.75

_SPACE, _MARK, BLOCK = 32, 1, 4 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else _SPACE for c in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.:+-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def restriction(name: str) -> float:
    fits = [k for k in RESTRICTION if name == k or name.startswith(f"{k}-")]
    return RESTRICTION[max(fits, key=len)] if fits else UNKNOWN


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands, operators and parentheses to postfix order. The expression ends at the first token that can't
    continue it; operators without a right side and open parentheses are closed there."""
    out: list[str] = []
    stack: list[str] = []
    wants = True  # an operand comes next
    for t in tokens:
        if wants and t == "(":
            stack.append(t)
        elif wants and t not in _BINDS and t != ")":
            out.append(t)
            wants = False
        elif not wants and t in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[t]:
                out.append(stack.pop())
            stack.append(t)
            wants = True
        elif not wants and t == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            break
    if wants:
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    return out + [t for t in reversed(stack) if t != "("]


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """(restriction, labels) of an expression in postfix order."""
    stack: list[tuple[float, set[str]]] = []
    for t in postfix:
        if t not in _BINDS:
            name = t[:-1] + "-or-later" if t.endswith("+") else t
            stack.append((restriction(name), {name}))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            made = {f"{a}-with-{b}" for a in left[1] for b in right[1]}
            stack.append((left[0] * EXCEPTION, made))
        else:
            stack.append(((min if t == "or" else max)(left[0], right[0]), left[1] | right[1]))
    return stack[-1] if stack else (0.0, set())


def tag_tokens(line: str) -> list[str]:
    """Tokens of the identifiers that follow a tag on its line."""
    return [t.rstrip(".:-") for t in (m.lower() for m in _TOKEN.findall(line)) if t.strip(".:-")]


def _automaton():
    import ahocorasick

    made, says = ahocorasick.Automaton(), {}
    for kind, phrases in (("base", BASE), ("name", NAMES), ("tag", TAGS), ("lead", LEADS), ("later", LATER)):
        for p in phrases:
            says.setdefault(p, []).append(kind)
    for p, kinds in says.items():
        made.add_word(f" {p} ", (p, len(p.split()), tuple(kinds)))
    made.make_automaton()
    return made


class Stream:
    """The words of a block of texts: one string, and for each byte its word, its text and its place in the block."""

    def __init__(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> None:
        self.raw = raw
        flat = np.frombuffer(raw.translate(_TABLE), np.uint8)
        at = np.repeat(start, 3)
        made = np.insert(flat, at, np.tile(np.array([_SPACE, _MARK, _SPACE], np.uint8), len(start)))
        place = np.insert(np.arange(len(flat)), at, -1)
        made, place = np.append(made, np.uint8(_SPACE)), np.append(place, -1)
        space = made == _SPACE
        keep = np.append(True, ~(space[1:] & space[:-1]))
        self.chars, self.place = made[keep], place[keep]
        mark = self.chars == _MARK
        begins = np.append(False, (self.chars[1:] > _SPACE) & (self.chars[:-1] == _SPACE))
        self.begins = np.flatnonzero(begins)
        self.word, self.text = np.cumsum(begins) - 1, np.cumsum(mark) - 1
        self.first = self.word[np.flatnonzero(mark)] + 1
        self.words = np.diff(np.append(self.first, len(self.begins)))
        self.string = self.chars.tobytes().decode("latin-1")

    def hits(self, automaton) -> dict[int, list[tuple[int, str, int, tuple]]]:
        """Per text: (word, phrase, words, kinds) of each hit, in order of their ends."""
        out: dict[int, list] = {}
        for end, (phrase, n, kinds) in automaton.iter(self.string):
            at = end - len(phrase)
            out.setdefault(int(self.text[at]), []).append((int(self.word[at]), phrase, n, kinds))
        return out

    def word_at(self, w: int) -> str:
        a = self.begins[w]
        return self.string[a : self.string.index(" ", a)]

    def rest_of_line(self, w: int, end: int) -> str:
        """What follows word w on its line, in the text that ends at `end`."""
        a = int(self.begins[w])
        a = int(self.place[self.string.index(" ", a) - 1]) + 1
        stop = min([end, *(x for x in (self.raw.find(c, a, end) for c in (b"\n", b"\r")) if x >= 0)])
        return self.raw[a:stop].decode("utf-8", "replace")


def statements(stream: Stream, hits: list, last: int, end: int) -> Iterator[list[str]]:
    """The expressions of one text, as token lists. Names inside a longer name or an expression make none of their own."""
    names: dict[int, tuple[int, str]] = {}
    later: dict[int, int] = {}
    opens: list[tuple[int, int, str]] = []
    for w, phrase, n, kinds in hits:
        if "name" in kinds and n > names.get(w, (0, ""))[0]:
            names[w] = (n, NAMES[phrase])
        if "later" in kinds:
            later[w] = max(n, later.get(w, 0))
        opens += [(w, n, k) for k in kinds if k in ("tag", "lead")]
    used: set[int] = set()
    for w, n, kind in sorted(opens):
        if kind == "tag":
            line = stream.rest_of_line(w + n - 1, end)
            yield tag_tokens(line)
            used.update(range(w, w + n + len(line.encode("utf-8", "replace").translate(_TABLE).split())))
            continue
        tokens: list[str] = []
        at = w + n
        while at < last:
            if at in later and tokens and tokens[-1] not in _BINDS:
                tokens[-1] += "+"
                step = later[at]
            elif at in names and tokens and tokens[-1] not in _BINDS:
                break
            elif at in names:
                tokens.append(names[at][1])
                step = names[at][0]
                used.update(range(at, at + step))
            else:
                step, said = 1, stream.word_at(at)
                if said in _BINDS:
                    tokens.append(said)
                elif said not in FILLERS:
                    break
            at += step
        yield tokens
    free = -1
    for w in sorted(names):
        if w > free and w not in used:
            free = w + names[w][0] - 1
            after = later.get(w + names[w][0], 0)
            yield [names[w][1] + ("+" if after else "")]


def judged(raw: bytes, start: np.ndarray, end: np.ndarray, automaton) -> list[dict]:
    """One result per text of a block."""
    stream = Stream(raw, start, end)
    out = [{"n_words": int(n), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0} for n in stream.words]
    for i, hits in stream.hits(automaton).items():
        base = [(w, BASE[p]) for w, p, _, kinds in hits if "base" in kinds]
        labels, score = {x for _, x in base}, 0.0
        out[i]["base_labels"] = ",".join(sorted(labels))
        for tokens in statements(stream, hits, int(stream.first[i] + stream.words[i]), int(end[i])):
            value, found = evaluate(to_postfix(tokens))
            labels |= found
            score = max(score, value)
        out[i] |= {"labels": ",".join(sorted(labels)), "score": score, "n_base": len(base)}
        if base:
            at = [w - int(stream.first[i]) for w, _ in base]
            out[i] |= {"first_word": min(at), "last_word": max(at)}
    return out


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """row (all input columns), n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    base_labels and labels are distinct, sorted and comma-joined, empty if there are none.
    """
    packed = pack(df, F.col(f"`{text}`").cast("string").alias("text"))
    schema = packed.select("row", *[F.lit(0).cast("long").alias(c) for c in ("n_words", "n_base")], *[F.lit(None).cast("long").alias(c) for c in ("first_word", "last_word")], F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score")).schema
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            data, start, end = utf8(batch.column(1))
            rows: list[dict] = []
            for i, j in blocks(start, end, BLOCK):
                a, b = int(start[i]), int(max(end[i:j].max(), start[i]))
                rows += judged(data[a:b].tobytes(), start[i:j] - a, end[i:j] - a, automaton)
            made = [pa.array([r[f.name] for r in rows], f.type) for f in arrow if f.name != "row"]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field("row").type), *made], schema=arrow)

    return map_batches(packed, run, schema)
