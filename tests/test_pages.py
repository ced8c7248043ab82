"""The main text of pages with menus, nested articles, missing ends."""

import time

from pyspark.sql import functions as F

from quillstream.functions.pages import main_text, main_text_of

PROSE = "The council met on Monday and passed the budget after a long debate."
MORE = "Members of both parties said that they would watch how it is spent."
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Section number {i} of our site</a></li>" for i in range(9)) + "</ul>"


def test_menus_and_furniture_go():
    page = f"<html><head><title>T</title><style>p {{}}</style></head><body><nav>{MENU}</nav><h1>Budget</h1><p>{PROSE}</p>{MENU}<h2>Next</h2><p>{MORE}</p><div>{MENU}</div><footer><p>{PROSE} All rights.</p></footer><script>var a = '<p>{PROSE}</p>'</script></body></html>"
    assert main_text_of(page) == f"Budget {PROSE} Next {MORE}"


def test_articles_before_main_before_all():
    outer = f"<article><p>{PROSE}</p><article><p>{MORE}</p></article><p>{PROSE} Again.</p></article>"
    assert main_text_of(f"<p>{MORE} Outside.</p><main><p>{MORE} Main.</p>{outer}</main>") == f"{PROSE} {MORE} {PROSE} Again."
    assert main_text_of(f"<p>{MORE}</p><main><p>{PROSE}</p></main><p>{MORE}</p>") == PROSE
    assert main_text_of(f"<article></article><p>{PROSE}</p>") == PROSE


def test_missing_ends():
    assert main_text_of(f"<nav>{MENU}<main><p>{PROSE}<p>{MORE}</main>") == f"{PROSE} {MORE}"
    assert main_text_of(f"<p>{PROSE}<!-- open <p>{MORE}") == PROSE
    assert main_text_of(f"<p>{PROSE}<script>{MORE}") == PROSE
    assert main_text_of(f"<p>{PROSE}</p><a href='x") == PROSE
    assert main_text_of(f"<p>a < b and 3 <4 {PROSE}</p>") == f"a < b and 3 <4 {PROSE}"
    assert main_text_of(f"<aside><p>{PROSE}") == PROSE  # nothing else is there
    assert main_text_of(f"</div></article></nav><p>{PROSE}</p>") == PROSE


def test_short_pages_entities_and_blanks(spark):
    assert main_text_of("<p>Hi &amp; bye &lt;3&nbsp;&#39;</p>") == "Hi & bye <3 '"
    assert [main_text_of(x) for x in (None, "", "<p></p>", "plain")] == ["", "", "", "plain"]
    df = spark.createDataFrame([(f"<p>{PROSE}</p>",), (None,)], "html string")
    assert [r.t for r in df.select(main_text(F.col("html")).alias("t")).collect()] == [PROSE, ""]


def test_time_is_linear():
    took = []
    for n in (20_000, 80_000):
        for hostile in ("<!--", "<script", "<nav>", "<a<a", "</nav><nav><div>", "<script></"):
            began = time.perf_counter()
            main_text_of(hostile * n)
            took.append(time.perf_counter() - began)
    assert max(took) < 5
