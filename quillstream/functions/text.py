"""Text functions over columns. Built-in functions, but for NFKC, which Spark lacks."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.config import DEFAULT

WORD = r"[\p{L}\p{N}_]"


def blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: Characters that are their own NFKC and don't combine: ASCII, letters of Latin-1, basic Cyrillic.
_STABLE = r"[^\x00-\x7FÀ-ÖØ-öø-ÿА-я]"


def nfkc(c: Column) -> Column:
    """NFKC. Only texts with other characters than stable ones are sent to the Python worker."""
    return F.coalesce(_nfkc(F.when(c.rlike(_STABLE), c)), c)


def normalize(c: Column, stop: list[str] = (), min_len: int = 3, compatibility: bool = True) -> Column:
    """Lower-case words of min_len letters or more that aren't stop words, joined by spaces; by default of the text's NFKC."""
    low = F.lower(nfkc(c) if compatibility else c)
    words = F.split(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " ")), " ")
    stop_words = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    return F.array_join(F.filter(words, lambda w: (F.length(w) >= min_len) & ~F.array_contains(stop_words, w)), " ")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def vocabulary_pattern(terms: list[str], exact: int = DEFAULT.exact_term_length) -> str:
    """Java pattern: short terms as whole words, before longer ones as word starts, the longest first."""
    clean = sorted({t.strip().lower() for t in terms} - {""}, key=lambda t: (-len(t), t))
    quote = lambda ts: "|".join(re.escape(t) for t in ts)
    whole, start = quote(t for t in clean if len(t) <= exact), quote(t for t in clean if len(t) > exact)
    parts = [f"(?:{whole})(?!{WORD})"] * bool(whole) + [f"(?:{start})"] * bool(start)
    return f"(?<!{WORD})(?:{'|'.join(parts)})" if parts else "(?!)"


def vocabulary_hits(c: Column, terms: list[str]) -> Column:
    """Number of distinct terms in a lower-cased text."""
    return F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(vocabulary_pattern(terms)), F.lit(0))))


def haystack(title: Column, summary: Column, body: Column) -> Column:
    return F.lower(F.concat_ws(" ", blank_null(title), blank_null(summary), blank_null(F.substring(body, 1, 1500))))


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 32)


def cluster_key(urls: Column) -> Column:
    return url_hash(F.array_join(F.array_sort(urls), "|"))


def char_ngrams(c: Column, n: int = 4) -> Column:
    """Distinct n-grams of a text without its spaces; a shorter text is its own gram, an empty one has none."""
    flat = F.replace(c, F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.length(flat) - (n - 1)), lambda i: F.substr(flat, i, F.lit(n)))
    return F.when(F.length(flat) >= n, F.array_distinct(grams)).when(F.length(flat) > 0, F.array(flat)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(F.array_union(a, b))), F.lit(0.0))


def containment(a: Column, b: Column, least: int = DEFAULT.containment_shared) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared < least, 0.0).otherwise(shared / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda col, p: F.replace(col, F.lit(p[0]), F.lit(p[1])), pairs, c)


def transliterate(c: Column, letters: dict[str, str]) -> Column:
    """Lower case, then letter by letter: one-to-one letters in a single pass, the others as replacements."""
    one = {k: v for k, v in letters.items() if len(v) == 1}
    return replace_all(F.translate(F.lower(c), "".join(one), "".join(one.values())), [(k, v) for k, v in letters.items() if len(v) != 1])


def signature(c: Column, lexicon: dict[str, str], letters: dict[str, str], stop: list[str] = ()) -> Column:
    """Language-neutral words: lexicon terms (longest first, anywhere in the text), then transliteration."""
    terms = sorted(lexicon.items(), key=lambda p: (-len(p[0]), p[0]))
    return normalize(transliterate(replace_all(F.lower(nfkc(c)), [(k, f" {v} ") for k, v in terms]), letters), stop, compatibility=False)


def slug(c: Column, most: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def safe_filename(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r'[\\/:*?"<>|]', "-"))


def escape_html(c: Column) -> Column:
    return replace_all(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def _main_part(html: Column) -> Column:
    part = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1)
    some = lambda c: F.when(F.regexp_replace(c, r"(?s)<[^>]*>|\s+", "") != "", c)
    return F.coalesce(some(part("article")), some(part("main")), html)


def html_to_text(c: Column) -> Column:
    """Text of a page: scripts, styles, comments and page furniture go, then tags; entities are read, spaces collapsed.
    Of a page with an article, or else a main part, that holds any text, only what stands from the first to the last one."""
    gone = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style|nav|aside|footer|table|noscript|head)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(_main_part(gone), r"(?s)<[^>]*>", " ")
    read = replace_all(bare, [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")])
    return F.trim(F.regexp_replace(read, r"\s+", " "))


def extract_json(c: Column) -> Column:
    """The object in a reply: without code fences, from the first brace to the last; null if there is none."""
    bare = F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*|\s*```$", "")
    return blank_null(F.regexp_extract(bare, r"(?s)\{.*\}", 0))


def severity(direction: Column) -> Column:
    """-2 to 2, by rounding half to even."""
    return F.rint(direction).cast("int")


def tone(direction: Column) -> Column:
    return F.when(direction < -0.15, "erosion").when(direction > 0.15, "strengthening").otherwise("neutral")


def chunks(text: str | None, most: int = DEFAULT.message_chars) -> list[str]:
    """A text within the limit as it is, also an empty one; a longer one by paragraphs, as many to a message as fit with
    the blank line between and behind them. A longer paragraph is cut, and its last piece may be followed by others."""
    whole = text or ""
    if len(whole) <= most:
        return [whole]
    done: list[str] = []
    open_ = ""
    for paragraph in re.split(r"\n\n+", whole):
        if open_ and len(open_) + len(paragraph) + 2 <= most:
            open_ += "\n\n" + paragraph
            continue
        done += [open_] if open_ else []
        cuts = max(0, (len(paragraph) - 1) // most)
        done += [paragraph[i * most : (i + 1) * most] for i in range(cuts)]
        open_ = paragraph[cuts * most :]
    return done + ([open_] if open_ else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_messages(s: pd.Series) -> pd.Series:
    return s.map(chunks)
