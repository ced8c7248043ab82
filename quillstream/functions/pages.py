"""The main text of a web page: one pass over its tags, then blocks by how much of their text is links.

A page is cut at block tags. A block knows its text, how much of it stands in links, and whether it is a heading, in page
furniture (nav, aside, footer, ...), in an article or in the main part. Of a page with articles only these count, else its
main part, else all of it; furniture goes, and so do blocks that are mostly links or too short to be prose, unless they stand
between prose. The pass looks at each character once, whatever is left open: a comment, script or tag without its end takes
the rest of the page, an open piece of furniture ends where an article, main part or the body's end begins, and is none if nothing ends it.
"""

from __future__ import annotations

import html
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FURNITURE = frozenset("nav aside footer form button select noscript template svg figure dialog menu".split())
SILENT = ("script", "style", "noscript", "template", "textarea", "title")
BREAKS = frozenset("p div li ul ol dl dt dd section article main header body td th tr table caption h1 h2 h3 h4 h5 h6 blockquote pre br hr address option".split()) | FURNITURE
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A block of prose has so many characters, and at most such a part of them in links.
PROSE, LINKED = 40, 0.4


@dataclass
class Block:
    text: str
    linked: float
    heading: bool
    furniture: bool
    article: bool
    main: bool


def tokens(page: str):
    """(tag, closes, text): a piece of text has no tag."""
    low, i, n = page.lower(), 0, len(page)
    while i < n:
        j = page.find("<", i)
        if j < 0:
            yield "", False, page[i:]
            return
        if j > i:
            yield "", False, page[i:j]
        if low.startswith("<!--", j):
            k = page.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        closes = low.startswith("</", j)
        a = j + 1 + closes
        if not (a < n and (low[a].isalpha() or low[a] in "!?")):
            yield "", False, "<"
            i = j + 1
            continue
        k = page.find(">", a)
        if k < 0:
            return
        b = a
        while b < k and (low[b].isalnum()):
            b += 1
        tag = low[a:b]
        i = k + 1
        if tag in SILENT and not closes and page[k - 1] != "/":
            end = low.find(f"</{tag}", i)
            i = n if end < 0 else end
            continue
        yield tag, closes, ""


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    text: list[str] = []
    linked = size = link = article = main = 0
    heading = False
    furniture: list[str] = []
    opened = 0  # blocks before the piece of furniture that is open

    def flush() -> None:
        nonlocal linked, size
        said = " ".join(html.unescape("".join(text)).split())
        if said:
            out.append(Block(said, linked / max(1, size), heading, bool(furniture), article > 0, main > 0))
        text.clear()
        linked = size = 0

    for tag, closes, said in tokens(page):
        if not tag:
            text.append(said)
            size += len(said.strip())
            linked += len(said.strip()) if link else 0
            continue
        if tag == "a":
            link = 0 if closes else 1
        if tag not in BREAKS:
            continue
        flush()
        link = 0
        heading = tag in HEADINGS and not closes
        if tag in ("article", "main") or (tag == "body" and closes):
            furniture.clear()
        if tag == "article":
            article = max(0, article + (-1 if closes else 1))
        if tag == "main":
            main = max(0, main + (-1 if closes else 1))
        if tag in FURNITURE:
            if not closes:
                opened = opened if furniture else len(out)
                furniture.append(tag)
            elif tag in furniture:
                while furniture.pop() != tag:
                    pass
    flush()
    for b in out[opened:] if furniture else ():  # it has no end, so it is none
        b.furniture = False
    return out


def main_text_of(page: str | None) -> str:
    """The main text of a page, its blocks joined by spaces; empty for null, empty or tag-only pages."""
    here = [b for b in blocks(page or "") if not b.furniture]
    for part in ("article", "main"):
        some = [b for b in here if getattr(b, part)]
        if some:
            here = some
            break
    prose = [len(b.text) >= PROSE and b.linked <= LINKED for b in here]
    if not any(prose):
        return " ".join(b.text for b in here if b.linked <= LINKED or b.heading) or " ".join(b.text for b in here)
    first, last = prose.index(True), len(prose) - 1 - prose[::-1].index(True)
    lead = first
    while lead and here[lead - 1].heading:
        lead -= 1
    kept = [b for i, b in enumerate(here) if prose[i] or b.heading and lead <= i < last or (first < i < last and b.linked <= LINKED)]
    return " ".join(b.text for b in kept)


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text_of)
